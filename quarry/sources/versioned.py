"""Versioned tables: every write is a new folder, and a version counts once its manifest is there.

    <root>/data/<number>-<token>/        Parquet files of one version, never changed
    <root>/versions/<number>.json        manifest: folder, parent, operation, rows

A writer writes the data first and the manifest last, by renaming a finished file to a name that
must not exist yet. A write that fails leaves no manifest, so readers go on with the version
before; of two writers with the same parent only one gets the next number. Readers are pinned: a
frame reads the folder of the version it was opened with, whatever is written later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from quarry.session import path_exists


class VersionNotFoundError(FileNotFoundError):
    """The table, or the version asked for, is not there."""


class VersionConflictError(RuntimeError):
    """Another writer has made a version since the one that this write started from."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    parent: int
    operation: str
    rows: int


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    if not path_exists(spark, f"{root}/versions"):
        return []
    fs, path = _hadoop(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def _manifest(root: str, number: int) -> str:
    return f"{root}/versions/{number:08d}.json"


def _version(spark: SparkSession, root: str, number: int) -> Version:
    body = "\n".join(r.value for r in spark.read.text(_manifest(root, number)).collect())   # one small file
    return Version(**json.loads(body))


def versions(spark: SparkSession, root: str) -> list[Version]:
    """Every version of the table, oldest first; empty without a table."""
    return [_version(spark, root, n) for n in _numbers(spark, root)]


def latest(spark: SparkSession, root: str) -> Version:
    numbers = _numbers(spark, root)
    if not numbers:
        raise VersionNotFoundError(f"no versioned table at {root}; write one first")
    return _version(spark, root, numbers[-1])


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    if number is not None and number not in _numbers(spark, root):
        raise VersionNotFoundError(f"no version {number} at {root}")
    found = latest(spark, root) if number is None else _version(spark, root, number)
    return spark.read.parquet(f"{root}/{found.folder}")


def write_version(df: DataFrame, root: str, operation: str = "write", parent: int | None = None) -> Version:
    """Write ``df`` as the version after ``parent`` (the newest one when not given; 0: a new table).

    Raises ``VersionConflictError`` if a version after ``parent`` is there by then; its data stand,
    and those of the failed write belong to no version. ``df`` may read any version of the table.
    """
    spark = df.sparkSession
    have = _numbers(spark, root)
    base = parent if parent is not None else (have[-1] if have else 0)
    if (have[-1] if have else 0) != base:
        raise VersionConflictError(f"{root} is at version {have[-1] if have else 0}, not {base}")
    folder = f"data/{base + 1:08d}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{folder}")
    made = Version(base + 1, folder, base, operation, spark.read.parquet(f"{root}/{folder}").count())   # counted from the files' footers
    _commit(spark, root, made)
    return made


def _commit(spark: SparkSession, root: str, made: Version) -> None:
    """Put the finished manifest in its place; the place must be free."""
    draft = f"{root}/drafts/{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, draft)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    place = spark._jvm.org.apache.hadoop.fs.Path(_manifest(root, made.number))
    fs.mkdirs(place.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(path, place, no_options)   # refuses a name that is taken
    except Py4JJavaError as exc:
        if "FileAlreadyExistsException" in exc.java_exception.getClass().getName():
            fs.delete(path, False)
            raise VersionConflictError(f"{root} already has a version {made.number}") from exc
        raise


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Remove all but the ``keep`` newest versions, manifests first; the removed numbers.

    Frames that are pinned to a removed version can't be read any more. At least one version stays.
    """
    gone = _numbers(spark, root)[: -max(keep, 1)]
    for number in gone:
        old = _version(spark, root, number)
        for path in (_manifest(root, number), f"{root}/{old.folder}"):
            fs, p = _hadoop(spark, path)
            fs.delete(p, True)
    return gone
