"""The Spark data source ``threadlake_leveldb``: a folder of .ldb and .log files as rows, one partition per file.

    spark.dataSource.register(LevelDbSource)
    spark.read.format("threadlake_leveldb").load(folder)

A row per entry, in canonical order of (file_ord, entry_ord), and a row of rec_kind 'status' per file that says whether
part of it couldn't be read. The folder must be a copy: a live store changes while it is read (``copy_store``).
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator, Mapping
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadlake.sources import clone, indexeddb, leveldb

SCHEMA = "file string, file_ord int, entry_ord long, seq long, op_type int, rec_kind string, db_id long, os_id long, index_id long, entry_key binary, name string, value string, lossy boolean"


def canonical(names: list[str]) -> list[str]:
    """Tables by name, then logs by name."""
    return sorted(n for n in names if n.endswith((".ldb", ".sst"))) + sorted(n for n in names if n.endswith(".log"))


def file_rows(name: str, file_ord: int, data: bytes) -> Iterator[tuple]:
    entries, lossy = leveldb.read_log(data) if name.endswith(".log") else leveldb.read_table(data)
    for i, e in enumerate(entries):
        d = indexeddb.describe(e)
        value = None
        if d["rec_kind"] == "record" and e.value is not None:
            try:
                body = clone.unwrap(e.value)
                value = None if body is None else clone.to_json(clone.decode(body, lenient=True))
            except (ValueError, IndexError):
                lossy = True
        yield (name, file_ord, i, e.seq, e.op, d["rec_kind"], d["db_id"], d["os_id"], d["index_id"], e.key, d["name"], value, False)
    yield (name, file_ord, len(entries), None, None, "status", None, None, None, None, None, None, lossy)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_TYPES = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in SCHEMA.split(", ")])


def batches(rows: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, so that they cross to the JVM by column."""
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _TYPES, strict=True)], schema=_TYPES)


class _File(InputPartition):
    def __init__(self, path: str, file_ord: int):
        super().__init__(path)
        self.path, self.file_ord = path, file_ord


class _Reader(DataSourceReader):
    """With the option ``only`` (names joined by '/') just those files."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.only = set(options["only"].split("/")) if options.get("only") else None

    def partitions(self):
        return [_File(os.path.join(self.folder, n), i) for i, n in enumerate(canonical(os.listdir(self.folder))) if self.only is None or n in self.only]

    def read(self, partition):
        path = Path(partition.path)
        try:
            data = path.read_bytes()
        except OSError:
            yield from batches(iter([(path.name, partition.file_ord, 0, None, None, "status", None, None, None, None, None, None, True)]))
            return
        yield from batches(file_rows(path.name, partition.file_ord, data))


class LevelDbSource(DataSource):
    @classmethod
    def name(cls):
        return "threadlake_leveldb"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def memory_rows(spark: SparkSession, files: Mapping[str, bytes]) -> DataFrame:
    """The entries of files held in memory (name to content), in the data source's form."""
    order = {n: i for i, n in enumerate(canonical(list(files)))}
    held = spark.createDataFrame([(n, order[n], bytearray(files[n])) for n in order], "file string, file_ord int, data binary")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for f in part.to_pylist():
                yield from batches(file_rows(f["file"], f["file_ord"], f["data"]))

    return held.repartition(max(1, len(order)), "file").mapInArrow(rows, SCHEMA)


def sizes(folder: str) -> dict[str, int]:
    """The files of a store with their sizes."""
    return {n: os.path.getsize(os.path.join(folder, n)) for n in canonical(os.listdir(folder))}


def discover(root: str, pattern: str = "*.indexeddb.leveldb") -> list[str]:
    """Store folders (with CURRENT and a MANIFEST) under a root, newest first."""
    found = [p for p in Path(root).rglob(pattern) if (p / "CURRENT").exists() and any(p.glob("MANIFEST-*"))]
    return [str(p) for p in sorted(found, key=lambda p: (p / "CURRENT").stat().st_mtime, reverse=True)]


def probe(folder: str) -> tuple | None:
    """What changes when a store is written: its logs' names, sizes and times, and CURRENT's time; None if it can't be read."""
    try:
        logs = sorted((e.name, e.stat().st_size, e.stat().st_mtime_ns) for e in os.scandir(folder) if e.name.endswith(".log"))
        return tuple(logs), os.stat(os.path.join(folder, "CURRENT")).st_mtime_ns
    except OSError:
        return None


def copy_store(source: str, target: str, tries: int = 3) -> tuple[list[str], bool]:
    """Bring a copy up to date: (files copied anew, lossy). Files of the same size are kept, vanished ones removed.

    The source is only read. A file that keeps changing or vanishing is skipped, which makes the copy lossy.
    """
    os.makedirs(target, exist_ok=True)
    copied, lossy = [], False
    names = canonical(os.listdir(source))
    for n in names:
        a, b = os.path.join(source, n), os.path.join(target, n)
        for _ in range(tries):
            try:
                size = os.path.getsize(a)
                if os.path.exists(b) and os.path.getsize(b) == size:
                    break
                shutil.copyfile(a, f"{b}.part")
                if os.path.getsize(f"{b}.part") >= size:
                    os.replace(f"{b}.part", b)
                    copied.append(n)
                    break
            except OSError:
                continue
        else:
            lossy = True
    for n in canonical(os.listdir(target)):
        if n not in names:
            os.remove(os.path.join(target, n))
    return copied, lossy
