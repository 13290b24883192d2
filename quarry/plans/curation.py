"""Curation jobs on a versioned table: each reads the newest version and writes the next one.

A job that fails leaves the table at the version before, and the versions before a job stay
readable until ``expire``. A job whose base was overtaken by another writer raises
``VersionConflictError`` and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import curate as CU
from quarry.sources import versioned as VT


def _next(spark: SparkSession, root: str, operation: str, job: Callable[[DataFrame], DataFrame]) -> VT.Version:
    base = VT.latest(spark, root)
    docs = VT.read_version(spark, root, base.number)
    return VT.write_version(job(docs).select(*docs.columns), root, operation, base.number)


def dedup_table(spark: SparkSession, root: str) -> VT.Version:
    """Keep the first row of every text."""
    return _next(spark, root, "dedup", CU.dedup_exact)


def patch_table(spark: SparkSession, root: str, edits: Sequence[CU.Edit] | DataFrame) -> VT.Version:
    """Apply the edits in order; without a row to change the newest version stays and is returned."""
    base = VT.latest(spark, root)
    if CU.patch_rows(VT.read_version(spark, root, base.number), edits).isEmpty():
        return base
    return _next(spark, root, "patch", lambda docs: CU.patched_corpus(docs, edits))


def append_table(spark: SparkSession, root: str, rows: Sequence[CU.NewRow]) -> VT.Version:
    """Append each row unless a text contains its marker."""
    return _next(spark, root, "append", lambda docs: CU.append_if_absent(docs, rows))
