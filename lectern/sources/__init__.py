"""Files, logs and JSON documents."""

from .files import read_contents, scan_files
from .logs import append_log, compact, read_log, write_version
from .tables import export_table, read_docs, write_docs
from .tree import watch

__all__ = ["append_log", "compact", "export_table", "read_contents", "read_docs", "read_log", "scan_files", "watch", "write_docs", "write_version"]
