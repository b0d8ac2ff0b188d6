"""Session settings used by tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the same adaptive settings the library expects on a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Text extraction is heavy per byte: keep all cores busy even where a shuffle moves little.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every node can reach for cut lineage and stream state.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests) do we make one.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def cut_lineage(df):
    """Materialise ``df`` reliably in the shared folder and continue from the written copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df):
    """``df`` as a Parquet table in the shared folder: what is read several times is made once, and its columns are compressed."""
    path = f"{shared_folder(df.sparkSession)}/tallyweave-{uuid.uuid4().hex}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
