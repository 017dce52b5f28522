"""Session helpers: table access, shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evistrata-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: With this setting Spark deletes the shuffle files of a query as soon as it is over, not when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *, free: bool = False) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back; ``free`` deletes its shuffle files then.

    It cuts lineage like ``checkpoint()`` does, survives the loss of executors, and is columnar and
    compressed, so wide text and vector columns cost less disk than a checkpointed RDD.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(FREED, None)
    if free:
        df.sparkSession.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            df.sparkSession.conf.unset(FREED) if before is None else df.sparkSession.conf.set(FREED, before)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete the table behind what ``materialize`` returned, once nothing that reads it is to run any more."""
    path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
