"""Refreshing a store of tables from a cache folder, reading and rebuilding only what changed.

A refresh parses the files it has not parsed before (by name and size; clean parses are kept and read again), folds them
to the live entries, and compares these with the live entries of the version before: by key and sequence number, so that
new, changed, deleted and late entries are found alike, and moves between files change nothing. Only the touched records
are extracted; messages they held or hold are shaped again, all other rows come from the version before by an anti-join,
and so do the postings of the search index, once it was built. A version's tables are complete before its numbered
commit names them (``storage.Commits``); readings stay on the version they pinned.

A full rebuild gives the same tables (tested). It is made for another layout, after a damaged start, when the account's
owner is seen otherwise, or when asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake import storage
from threadlake.functions.text import conversation_kind
from threadlake.plans import mapping as mp
from threadlake.plans import search, shape
from threadlake.sources.datasource import LevelDbSource, canonical, copy_store, probe, sizes

SHAPES = {"message": shape.messages, "conversation": shape.conversations, "profile": shape.profiles, "event": shape.events, "call": shape.calls}
#: A full rebuild at the latest after so many refreshes in place, or so many seconds.
MOST_INPLACE, MOST_SECONDS = 20, 1800
#: Refreshes wait so many seconds, or so many times what the last one took.
LEAST_WAIT, WAIT_TIMES = 15, 5


@dataclass(frozen=True)
class Outcome:
    """outcome: 'swapped' (all built), 'inplace' (only what changed), 'fresh' (nothing new), 'skipped' (a damaged read kept out), 'waiting' (too soon after the last one).

    ``parsed`` names the files read anew, ``touched`` counts the records whose live entry changed.
    """

    outcome: str
    version: str | None
    max_seq: int
    lossy: bool
    parsed: tuple[str, ...] = ()
    touched: int = 0


def due(meta: dict | None, now: float) -> bool:
    """Whether a refresh is due: not within the larger of ``LEAST_WAIT`` and ``WAIT_TIMES`` the last one's seconds."""
    return meta is None or now - meta["at"] >= max(LEAST_WAIT, WAIT_TIMES * meta["took"])


class VersionedStore:
    """Tables in a folder per version under ``root`` (any file system Spark can write to)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = storage.Commits(spark, self.root)

    def meta(self) -> dict | None:
        return self.commits.last()[1] or None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{path}")

    def _write(self, df: DataFrame, path: str) -> str:
        df.write.parquet(f"{self.root}/{path}")
        return path

    def table(self, name: str, meta: dict | None = None) -> DataFrame:
        """A table of the current version, or of the reading that ``meta`` pins."""
        return self._read((meta or self.meta())["tables"][name])

    def views(self) -> None:
        """Register all tables for ad-hoc SQL."""
        meta = self.meta()
        for name in meta["tables"]:
            self.table(name, meta).createOrReplaceTempView(name)

    # Bronze

    def bronze(self, folder: str, files: dict[str, list] | None = None) -> tuple[DataFrame, dict[str, list], list[str]]:
        """The entries of all files of a folder: (rows, manifest, files parsed now). A file of the manifest with its size is read from its kept parse."""
        known, manifest = files or {}, {}
        now = sizes(folder)
        new = [n for n in canonical(list(now)) if n not in known or known[n][0] != now[n]]
        for n in now.keys() - set(new):
            manifest[n] = known[n]
        if new:
            self.spark.dataSource.register(LevelDbSource)
            path = self._write(self.spark.read.format("threadlake_leveldb").option("only", "/".join(new)).load(folder), f"parsed/{uuid.uuid4().hex}")
            damaged = {r.file for r in self._read(path).filter("rec_kind = 'status' and lossy").select("file").collect()}
            for n in new:
                manifest[n] = [now[n], path, n in damaged]
        parts: dict[str, list[str]] = {}
        for n, (_, path, _) in manifest.items():
            parts.setdefault(path, []).append(n)
        rows = None
        for path, own in sorted(parts.items()):
            part = self._read(path).filter(F.col("file").isin(own))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], LevelDbSource({}).schema())
        return rows, manifest, new

    # Refresh

    def follow(self, source: str, copy: str, **how) -> Outcome:
        """Refresh from a live folder: where its logs show no change since the last time nothing is read, else its copy is brought up to date and taken."""
        seen = json.dumps(probe(source))
        meta = self.meta()
        if meta and meta["probe"] == seen != "null" and not how.get("full"):
            return Outcome("fresh", meta["version"], meta["max_seq"], meta["lossy"])
        _, torn = copy_store(source, copy)
        return self.refresh(copy, seen=seen, torn=torn, **how)

    def refresh(self, folder: str, mappings: tuple[mp.Mapping, ...] = (mp.V1,), full: bool = False, wait: bool = False, seen: str = "", torn: bool = False) -> Outcome:
        """Bring the store up to a copied cache folder. With ``wait`` nothing is done before a refresh is ``due``.

        A damaged read never replaces a good version; on a cold start it is taken and marked lossy. Damaged parses are
        not kept.
        """
        began = time.time()
        number, old = self.commits.last()
        old = old or None
        if wait and not due(old, began):
            return Outcome("waiting", old["version"], old["max_seq"], old["lossy"])
        usable = {n: f for n, f in old["files"].items() if not f[2]} if old else {}
        bronze, manifest, parsed = self.bronze(folder, usable)
        lossy = torn or any(f[2] for f in manifest.values())
        max_seq = bronze.agg(F.max("seq").alias("m")).first()["m"] or 0
        if lossy and old and not old["lossy"]:
            return Outcome("skipped", old["version"], old["max_seq"], True, tuple(parsed))
        if old and not full and not old["lossy"] and old["max_seq"] == max_seq and manifest.keys() == old["files"].keys():
            return Outcome("fresh", old["version"], max_seq, lossy, tuple(parsed))
        version = f"v-{uuid.uuid4().hex}"
        live = self._read(self._write(mp.winners(bronze), f"{version}/live"))
        layout = mp.layout_hash(live)
        names = mp.catalog(live).collect()
        chosen, known = mp.choose(list(mappings), layout, {r.store for r in names})
        entities = chosen.entities if chosen else {}
        stale = old is None or full or old["lossy"] or old["layout"] != layout or old["inplace"] >= MOST_INPLACE or began - old["full_at"] > MOST_SECONDS
        touched = 0
        key = F.lower(F.hex("entry_key")).alias("record_key")
        if not stale:
            before = self._read(old["live"])
            changed = live.select("entry_key", "seq").join(before.select("entry_key", "seq"), ["entry_key", "seq"], "left_anti").select("entry_key")
            gone = before.select("entry_key").join(live.select("entry_key"), "entry_key", "left_anti")
            changes = self._read(self._write(changed.unionByName(gone).distinct(), f"{version}/touched"))
            touched = changes.count()
        records, tables = {}, {}
        for name, entity in entities.items():
            if stale:
                rows = mp.extract(live, entity, names)
            else:
                fresh = mp.extract(live.join(changes, "entry_key", "left_semi"), entity, names)
                rows = self._read(old["records"][name]).join(changes.select(key), "record_key", "left_anti").unionByName(fresh)
            records[name] = self._write(rows, f"{version}/records/{name}")
        known = known or (self._verified(records, entities) if stale else old["matched"])
        me = shape.vote_self(self._read(records["message"])) if "message" in records else None
        part = not stale and me == old["me"]
        affected = None
        for name in entities:
            rows = self._read(records[name])
            if name == "message" and part:
                ids = ["conv_id", "id"]
                both = self._read(old["records"][name]).select("record_key", *ids).unionByName(rows.select("record_key", *ids))
                affected = self._read(self._write(both.join(changes.select(key), "record_key", "left_semi").select(*ids).filter("conv_id is not null").distinct(), f"{version}/affected"))
                again = shape.messages(rows.join(affected, ids, "left_semi"), me)
                shaped = self._read(old["tables"][name]).join(affected, ids, "left_anti").unionByName(again)
            else:
                shaped = shape.messages(rows, me) if name == "message" else SHAPES[name](rows)
            tables[name] = self._write(shaped, f"{version}/{name}")
        if {"message", "conversation"} <= tables.keys():
            tables["all_conversations"] = self._write(self._conversations(tables), f"{version}/all_conversations")
        if part and affected is not None and "postings" in old["tables"]:
            said = self._indexed(tables["message"]).join(affected, ["conv_id", "id"], "left_semi")
            kept = self._read(old["tables"]["postings"]).join(affected, ["conv_id", "id"], "left_anti")
            tables["postings"] = self._write(kept.unionByName(search.postings(said)), f"{version}/postings")
        meta = {
            "version": version, "tables": tables, "records": records, "live": f"{version}/live", "files": manifest, "max_seq": max_seq, "lossy": lossy, "layout": layout, "matched": known, "mapping": chosen.version if chosen else None, "me": me,
            "probe": seen, "inplace": 0 if stale else old["inplace"] + 1, "full_at": began if stale else old["full_at"], "at": time.time(), "took": time.time() - began,
        }
        self.commits.commit(number, meta)
        return Outcome("swapped" if stale else "inplace", version, max_seq, lossy, tuple(parsed), touched)

    def _verified(self, records: dict[str, str], entities) -> bool:
        """Whether the mapping fits what was read: of every entity with records half or more have their first field (its id)."""
        parts = []
        for name, path in records.items():
            first = next(iter(entities[name].fields))
            parts.append(self._read(path).agg((F.count(first) * 2 >= F.count(F.lit(1))).alias("fits")))
        return bool(parts) and bool(reduce(DataFrame.unionByName, parts).agg(F.bool_and("fits").alias("f")).first()["f"])

    def _conversations(self, tables: dict[str, str]) -> DataFrame:
        """Conversations with a record and those that only messages name; one with neither is gone. last_ts is the later of record and messages."""
        meta = self._read(tables["conversation"])
        said = self._read(tables["message"]).filter("not is_system").groupBy(F.col("conv_id").alias("id")).agg(F.max("ts").alias("said_ts"), F.count(F.lit(1)).alias("msg_count"))
        named = self._read(tables["message"]).select(F.col("conv_id").alias("id")).distinct()
        both = meta.join(named, "id", "full").join(said, "id", "left")
        return both.select("id", conversation_kind(F.col("id")).alias("kind"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("msg_count", F.lit(0)).alias("msg_count"), F.greatest(F.coalesce("meta_last_ts", F.lit(0)), F.coalesce("said_ts", F.lit(0))).alias("last_ts"), F.col("meta_last_ts").isNotNull().alias("has_record"))

    def _indexed(self, path: str) -> DataFrame:
        return self._read(path).filter("not is_system and content <> ''").select("conv_id", "id", F.col("content").alias("text"))

    def postings(self) -> DataFrame:
        """The search index of the current version: built at the first search, and from then on carried from version to version."""
        number, meta = self.commits.last()
        if "postings" not in meta["tables"]:
            path = self._write(search.postings(self._indexed(meta["tables"]["message"])), f"{meta['version']}/postings")
            meta = meta | {"tables": meta["tables"] | {"postings": path}}
            self.commits.commit(number, meta)
        return self._read(meta["tables"]["postings"])

    def inspect(self, folder: str, mappings: tuple[mp.Mapping, ...] = (mp.V1,)) -> dict:
        """What a folder holds, without building a store of it: layout, mapping, whether it is known, lossy, and counts by entity (``mapping.health``)."""
        bronze, manifest, _ = self.bronze(folder)
        live = mp.winners(bronze)
        layout = mp.layout_hash(live)
        chosen, known = mp.choose(list(mappings), layout, {r.store for r in mp.catalog(live).collect()})
        health = {r.entity: r.asDict() for r in mp.health(live, chosen).collect()} if chosen else {}
        return {"layout": layout, "mapping": chosen.version if chosen else None, "matched": known, "lossy": any(f[2] for f in manifest.values()), "health": health}
