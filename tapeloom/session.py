"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tapeloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the engine's settings; master and sizes come from spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a private one only for a local session without a setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tapeloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame, *cols: str) -> DataFrame:
    """Write ``df`` (only ``cols`` when given) to the shared checkpoint folder and continue from the files.

    Used where an input is read several times (so that the raw tables are scanned and aggregated once), where all
    reads of one layout must agree (range ranks), or where a loop would grow the lineage (connected components).
    The files outlive any executor. A frame that is already settled is returned as it is.
    """
    if getattr(df, "_settled", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = (df.select(*cols) if cols else df).checkpoint(eager=True)
    out._settled = True
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared checkpoint folder, removed at the end of the block."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the shared checkpoint folder while the block runs, for loops that read it again and again.

    Reads prune columns, a lost executor costs no lineage, and the folder is removed at the end.
    """
    spark = df.sparkSession
    with scratch(spark) as path:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While the block runs, a query's shuffle files go when it ends, not when the driver next collects its garbage.

    For audits that run many queries one after another: the disk holds the shuffles of those that run, not of all.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def settled_apart(spark: SparkSession) -> Iterator[None]:
    """What is settled in the block is removed at its end; frames that were built in it are not to be read after it.

    The checkpoint folder belongs to the whole application, so nothing else is to be settled meanwhile.
    """
    context, before = spark.sparkContext, ensure_checkpoint_dir(spark).rstrip("/")
    with scratch(spark) as path:
        context.setCheckpointDir(path)
        try:
            yield
        finally:
            context.setCheckpointDir(before.rpartition("/")[0])  # Spark makes a folder of its own below the one it is given
