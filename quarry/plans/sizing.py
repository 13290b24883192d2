"""Size checks for broadcasts and distributed dense ordinals.

``bounded_broadcast`` is the only place a side is marked for broadcast: the
row count is measured (one cheap job over the small side) and the hint is
given only below the bound; above it the side is left to a shuffle join, where
AQE's skew handling splits hot partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 2_000_000


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its measured row count is within ``max_rows``."""
    small = known_rows <= max_rows if known_rows is not None else row_count_at_most(df, max_rows)
    return F.broadcast(df) if small else df


TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def partitions_for(rows: int, row_bytes: int, floor: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count so that each holds about ``target_bytes`` (never below ``floor``)."""
    return max(int(floor), -(-int(rows) * int(row_bytes) // int(target_bytes)))


def dense_ordinal(df: DataFrame, order_col: str, out_col: str = "ord", n_partitions: int | None = None,
                  carry: bool = False) -> DataFrame:
    """Add a 0-based dense ordinal by ``order_col`` (unique) without a single-partition window.

    The key column alone is range-partitioned, sorted inside partitions and
    numbered per partition with ``monotonically_increasing_id`` (partition id in
    the upper bits), then **written once**: range bounds come from sampling
    shuffle output, whose order is not deterministic, so the numbering and the
    per-partition row counts must be read from the same evaluation. The row
    counts of all earlier partitions (a table with one row per partition) give
    the offsets; the ordinals are joined back to ``df`` by key. ``carry``: all columns
    (few and short ones) are ranged with the key, so ``df`` is read once and nothing is joined back.
    """
    from quarry.session import written

    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        (df if carry else df.select(order_col)).repartitionByRange(n, F.col(order_col))
        .sortWithinPartitions(order_col)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordinal",
    )
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    # one row per partition: bounded by the partition count
    kept = df.columns if carry else [order_col]
    ords = ranged.join(F.broadcast(offsets), "_pid").select(*kept, (F.col("_off") + pos).cast("long").alias(out_col))
    if carry or df.columns == [order_col]:
        return ords
    return df.join(ords, order_col)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    A large table arrives in many splits and is returned unchanged (no shuffle);
    a table stored as one big row group would otherwise be tokenised by one task.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
