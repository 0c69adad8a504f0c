"""Small files beside tables, through the file system that the tables themselves are in (any that Spark can write to)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, sorted; nothing where there is none."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of each file at or under a path, sorted. Nothing where there is none."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    found, each = [], fs.listFiles(place, True)
    while each.hasNext():
        s = each.next()
        found.append(f"{s.getPath().getName()}|{s.getLen()}|{s.getModificationTime()}")
    return sorted(found)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename, or drop ``old`` where another was faster."""
    fs, place = _at(spark, new)
    _, source = _at(spark, old)
    if fs.exists(place) or not fs.rename(source, place):
        fs.delete(source, True)


def read(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet: whole under another name, then renamed. The rename is the commit."""
    fs, place = _at(spark, path)
    new = f"{path}.{uuid.uuid4().hex}"
    _, beside = _at(spark, new)
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, False)
        raise FileExistsError(path)


class Commits:
    """The commits of a folder: numbered files, written once and never changed; the highest number holds.

    Two writers that commit the same number at once can't both succeed: one gets ``FileExistsError`` and has changed
    nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/_commits"

    def _numbers(self) -> list[int]:
        return [int(n) for n in names(self.spark, self.folder) if n.isdigit()]

    def last(self) -> tuple[int, dict]:
        """Number and content of the last commit; (0, {}) before the first."""
        found = self._numbers()
        return (max(found), json.loads(read(self.spark, f"{self.folder}/{max(found):012d}"))) if found else (0, {})

    def commit(self, after: int, content: dict) -> int:
        write_once(self.spark, f"{self.folder}/{after + 1:012d}", json.dumps(content))
        return after + 1
