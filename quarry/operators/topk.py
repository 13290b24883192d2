"""Top-k per group in the form Catalyst turns into a partial + final WindowGroupLimit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the best ``k`` rows per group; ``rank`` is 1-based BIGINT.

    ``row_number() <= k`` lets Spark cut each input partition to k rows per
    group before the shuffle on the group key, so a hot group moves only
    k rows per partition.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return (
        df.withColumn(rank_col, F.row_number().over(w))
        .filter(F.col(rank_col) <= k)
        .withColumn(rank_col, F.col(rank_col).cast("long"))
    )
