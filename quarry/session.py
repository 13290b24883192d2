"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """Return the active session or build a local one (tests, bench).

    On a cluster the session is created by the submitter; this only fills in
    settings that are not already set.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("QUARRY_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediate tables.

    Read from ``spark.checkpoint.dir``; only a local-mode session (tests,
    bench) without the setting gets a fresh scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder shared by all executors"
            )
        path = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str = "stage"):
    """Cut lineage: write ``df`` to a fresh folder under the shared checkpoint folder and read it back.

    One job (an eager ``checkpoint()`` of an unpersisted frame computes it
    twice), columnar, and it survives executor loss.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def grouped(df, rows: int):
    """A writer of Parquet row groups of at most ``rows`` rows: what a reader of large rows holds at once."""
    return df.write.option("parquet.block.row.count.limit", str(rows))


@contextmanager
def small_batches(spark, size: str = "16m"):
    """Within it, jobs send rows to Python in Arrow batches of about ``size``: a task holds a batch several times over.

    For rows of megabytes. The session's own bound (64 MB) comes back afterwards; a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(was)) if was[:1] != "-" else -1
    if 0 < least <= int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)):
        yield
        return
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def path_exists(spark, path: str) -> bool:
    """Whether a file or folder is there, asked of the path's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def files_fingerprint(spark, path: str) -> str:
    """Names, sizes and times of the files under ``path``: changes when the table does."""
    import hashlib

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, found = fs.listFiles(p, True), []
    while seen.hasNext():
        f = seen.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()
