"""Append-only logs and their compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from ..operators.diff import latest


def read_log(spark: SparkSession, path: str, schema: StructType, key: str | None = None) -> DataFrame:
    """SRC-2: JSON lines of a declared schema. Blank, cut-off and malformed lines are skipped; no log reads as empty.

    ``key`` names a column every entry has: a line that parses as JSON but lacks it is malformed too.
    """
    probe = StructType([*schema.fields, StructField("_bad", StringType())])
    try:
        rows = spark.read.schema(probe).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    good = F.col("_bad").isNull() & F.col(key or schema.fieldNames()[0]).isNotNull()
    return rows.filter(good).drop("_bad")


def append_log(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SRC-3: append entries; a later ``seq`` wins when the log is read through ``latest``."""
    df.write.mode("append").format(fmt).save(path)


def compact(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """CDC-12: the live latest rows, all a compacted log holds."""
    return latest(log, key, seq)


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """CDC-12: write a compacted table as a new version directory and return its path.

    The old version stays readable until the caller moves its pointer, so a failed or repeated run
    leaves nothing half-replaced.
    """
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return path
