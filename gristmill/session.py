"""Session defaults and what must be taken from the session of a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and notebooks; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpointed(df, eager: bool = True):
    """The DataFrame with its lineage cut, in the folder that ``spark.checkpoint.dir`` names.

    Only where that is not set and all of Spark is one process, as in tests, a temporary folder of this machine is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))
    return df.checkpoint(eager)


#: Bytes of a table up to which it may be spread anew; larger ones have files enough.
SPREAD_BYTES = 256 << 20


def spread(df):
    """The rows of a small table of few files on all cores; a large one is left as it lies, without a shuffle.

    A file of a single row group is read by one task, whatever Python does with its rows afterwards.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files <= cores // 2 else df
