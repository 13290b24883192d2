"""Stop-word list and custom dictionary as data, with the reference's missing-file policy.

* dictionary file missing -> warning, continue with no custom words
* stop-word file missing  -> warning, empty stop-word set

Both lists are small configuration (tens to thousands of lines) and are the
only things read to the driver: they become literals in the segmentation
regex / stop-word filter.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.session import path_exists


def wordlist_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct stripped non-blank line."""
    lines = spark.read.text(path)
    return lines.select(strip(F.col("value")).alias("word")).filter(F.length("word") > 0).distinct()


def _load(spark: SparkSession, path: str, what: str) -> list[str] | None:
    if not path_exists(spark, path):
        warnings.warn(f"{what} not found: {path}", stacklevel=3)
        return None
    return sorted(r.word for r in wordlist_frame(spark, path).collect())   # configuration: literals of the regex


def load_stopwords(spark: SparkSession, path: str) -> list[str]:
    words = _load(spark, path, "stop-word list")
    return [] if words is None else words


def load_dictionary(spark: SparkSession, path: str) -> list[str]:
    words = _load(spark, path, "custom dictionary")
    return [] if words is None else words
