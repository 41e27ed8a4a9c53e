"""Versions of a table below one root: published in one step, read by number, expired when nothing needs them.

``<root>/data`` holds a folder per version and ``<root>/published`` an empty marker per version, named by its number and the folder.
A version exists once its marker does, and a marker is made only after its data is complete, so a writer that fails leaves no trace a
reader can see. Readers name a version and keep reading it whatever is published later; a job may therefore replace the table it reads.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from pairwright.sources.readers import read_table
from pairwright.sources.writers import write_new_version


class SnapshotError(RuntimeError):
    """A version that does not exist, or a number somebody else has published."""


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of change (milliseconds) of what lies in a folder; nothing where there is none."""
    fs, at = _files(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Published versions, oldest first, and where their data lies."""
    root = root.rstrip("/")
    marks = sorted(name.split("--", 1) for name, _ in _names(spark, f"{root}/published") if "--" in name)
    return {int(number): f"{root}/data/{folder}" for number, folder in marks}


def publish(df: DataFrame, root: str, fmt: str = "parquet") -> int:
    """Write ``df`` as the next version and return its number.

    ``df`` may read any version of the same root. The number is reserved by creating a file that must not exist yet, which is one step in
    HDFS and object stores with conditional writes: of two writers one gets a :class:`SnapshotError`, and can publish again.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    known = versions(spark, root)
    number = max(known, default=-1) + 1
    folder = write_new_version(df, f"{root}/data", fmt).rsplit("/", 1)[1]
    fs, lock = _files(spark, f"{root}/numbers/{number:012d}")
    try:
        fs.create(lock, False).close()
    except Exception as error:
        raise SnapshotError(f"version {number} of {root} was taken by another writer") from error
    _, mark = _files(spark, f"{root}/published/{number:012d}--{folder}")
    fs.create(mark, False).close()
    return number


def read_version(spark: SparkSession, root: str, version: int | None = None, schema=None) -> DataFrame:
    """One version of the table, the newest unless a number is given. The DataFrame stays on that version."""
    known = versions(spark, root)
    number = max(known, default=None) if version is None else version
    if number not in known:
        raise SnapshotError(f"{root} has no version {number}; it has {list(known)}")
    return read_table(spark, known[number], schema)


def expire(spark: SparkSession, root: str, keep: int = 2, pinned: tuple[int, ...] = (), grace_seconds: float = 86_400) -> list[str]:
    """Delete all but the newest ``keep`` versions and the ``pinned`` ones, and data that never became a version.

    Markers go before data, so no reader finds a version without it. Data without a marker may belong to a writer at work and is left
    alone for ``grace_seconds``. Returns the deleted folders.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    root, known = root.rstrip("/"), versions(spark, root)
    stay = {*sorted(known)[-keep:], *pinned}
    gone = []
    for number, path in known.items():
        if number not in stay:
            fs, mark = _files(spark, f"{root}/published/{number:012d}--{path.rsplit('/', 1)[1]}")
            fs.delete(mark, False)
            gone.append(path)
    oldest = (time.time() - grace_seconds) * 1000
    gone += [f"{root}/data/{name}" for name, changed in _names(spark, f"{root}/data") if changed <= oldest and f"{root}/data/{name}" not in known.values()]
    for path in gone:
        fs, at = _files(spark, path)
        fs.delete(at, True)
    return gone
