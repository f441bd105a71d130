"""Document indexing and retrieval as Spark DataFrame jobs."""

from .session import get_spark

__all__ = ["get_spark"]
