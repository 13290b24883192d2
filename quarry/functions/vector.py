"""Dense-vector expressions on ARRAY<DOUBLE> columns (higher-order functions, codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col: Column | str) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sq_distance(a, b))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a: Column | str) -> Column:
    """Unit L2 vector; the zero vector stays zero."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(_c(a))


def token_hash(term: Column | str) -> Column:
    """h = first 8 hex digits of md5(token) as an unsigned 32-bit integer."""
    return F.conv(F.substring(F.md5(_c(term)), 1, 8), 16, 10).cast("long")


def hash_bucket(h: Column, dims: int) -> Column:
    return F.pmod(h, F.lit(dims)).cast("int")


def hash_sign(h: Column, dims: int) -> Column:
    """+1 when floor(h / dims) is even, else -1."""
    return F.when(F.pmod(F.floor(h / F.lit(dims)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def bucket_vectors(entries: DataFrame, id_col: str, dims: int, all_ids: DataFrame | None = None) -> DataFrame:
    """(id, b, v) entries, b in [0, dims) -> (id, unit ARRAY<DOUBLE> of length dims), summing v per bucket.

    One hash aggregate per id with ``dims`` primitive buffers (map-side
    combined, so each input partition emits one row per id). Ids of
    ``all_ids`` without entries get the zero vector: they enter the same
    aggregate as entry-less rows, so no join is needed.
    """
    rows = entries.select(F.col(id_col), F.col("b").cast("int").alias("b"), F.col("v").cast("double").alias("v"))
    if all_ids is not None:
        rows = rows.unionByName(all_ids.select(F.col(id_col), F.lit(None).cast("int").alias("b"),
                                               F.lit(None).cast("double").alias("v")))
    wide = rows.groupBy(id_col).agg(
        *[F.sum(F.when(F.col("b") == i, F.col("v")).otherwise(F.lit(0.0))).alias(f"_b{i}") for i in range(dims)]
    )
    return wide.select(F.col(id_col), normalize(F.array(*[F.col(f"_b{i}") for i in range(dims)])).alias("embedding"))
