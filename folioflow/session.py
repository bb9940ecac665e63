"""Session, table and checkpoint helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def local_session(cores: str = "8", app: str = "folioflow") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


class Tables:
    """Parquet tables of one folder, read on attribute access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only a session in one process (a local test) may go without it and gets a folder of its own;
    on a cluster a folder of one machine would lose data, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark not in _local:
        _local[spark] = tempfile.mkdtemp(prefix="folioflow-")
    return _local[spark]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for streaming state, output and stored rows, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: with it, Spark deletes the shuffle files of a query when the query ends, not when the driver collects its garbage
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write the rows as parquet into the shared folder and read them back.

    Later reads prune columns, know the size, and survive a lost executor. The shuffle files of the
    write are not kept, as no one reads them again.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    was = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, was)
    return spark.read.schema(df.schema).parquet(path)


def release(stored: DataFrame) -> None:
    """Give back the disk of rows of ``cut_lineage`` that nothing reads any more: no rows take their place."""
    spark = stored.sparkSession
    folders = {f.rpartition("/")[0] for f in stored.inputFiles()}
    for folder in folders:
        spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(folder)
