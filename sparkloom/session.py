"""Session factory and the shared folder for data that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only a session without that setting, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(shared)
        current = sc.getCheckpointDir()
    return shared or current


#: Folders written by this process in the shared folder, by application.
_written: dict[str, list[str]] = {}


def _folder(spark: SparkSession, kind: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table to the shared folder and continue from there.

    A table that is read again brings its true size, only the columns asked for and no derived constraints along.
    """
    spark = df.sparkSession
    path = _folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables this process has written for cut lineages; results that still read them can't be used afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


class Rounds:
    """Tables of an iteration, each written to the shared folder; the one before the last is deleted when the next is there.

    ``keep`` leaves all of them until ``release``.
    """

    def __init__(self, spark: SparkSession, keep: bool = False) -> None:
        self.spark, self.keep = spark, keep
        self.base = _folder(spark, "rounds")
        self.written: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them from there."""
        path = f"{self.base}/{len(self.written)}"
        df.write.parquet(path)
        self.written.append(path)
        if not self.keep and len(self.written) > 2:
            _delete(self.spark, self.written[-3])
        return self.spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle gets in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
