"""JSON documents (sessions, artifacts, notebooks) and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_docs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC-4: one JSON object per file; a file that is no valid object is left out, a missing folder is empty."""
    probe = StructType([*schema.fields, StructField("_bad", StringType())])
    try:
        rows = (
            spark.read.schema(probe)
            .option("multiLine", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json")
            .json(path)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def write_docs(df: DataFrame, path: str, partition: str = "notebook_id", mode: str = "append") -> None:
    """SRC-4: one table per entity in place of one file per document."""
    df.write.mode(mode).partitionBy(partition).parquet(path)


def export_table(df: DataFrame, path: str, partitions: Sequence[str] = (), fmt: str = "json") -> None:
    """SRC-6: export an index or artifacts; file names are a column (see ``generation.export_filename``)."""
    writer = df.write.mode("overwrite").format(fmt)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(path)
