"""Session defaults and the lineage cut used by long plans."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",  # top_k limits in the task up to this depth
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",  # a busy notebook costs its sessions, not its events
}


def get_spark(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that its functions run there wherever it is installed on the driver."""
    if getattr(spark.sparkContext, "_lectern_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lectern-ship-")
    archive = shutil.make_archive(os.path.join(folder, "lectern"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._lectern_shipped = True


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``; None if it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: they go with the end of its write, not when the driver forgets them."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before) if before is not None else spark.conf.unset(FREE)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder; a lost executor loses none of it.

    Only a local session that names no such folder (a test) gets a temporary one; a cluster without one is told so.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-ckpt-"))
    with freed(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, inside


def kept(df: DataFrame, by: str | None = None, parts: int = 0) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: a checkpoint for large tables, compressed and
    read by column. The files stay until the folder goes.

    With ``by``, whose values must be dealt over ``parts`` partitions by hash already, it is a bucketed table: rows of one value
    stay together, and later groupings by it need no exchange.
    """
    spark = df.sparkSession
    base, name = shared_folder(spark), f"lectern_{uuid.uuid4().hex}"
    path = f"{base.rstrip('/')}/{name}" if base else tempfile.mkdtemp(prefix="lectern-kept-")
    with freed(spark):
        if by is None:
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(parts, by).saveAsTable(name)
        return spark.table(name)
