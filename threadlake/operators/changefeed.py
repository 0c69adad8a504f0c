"""Applying a feed of puts and deletes to a keyed table.

Changes are deduplicated by their identifier (stream and sequence number), then the latest state of each key is found by
window ranking over the log sequence, then that state is merged into the base, deletes dropping their keys.

Rules of a key, in order of seq: a delete clears the record together with its version; a put is taken unless its
version (as a number, null or unreadable is 0) is below that of the record held. After the last delete the record held
therefore has the highest version put so far, and of equal versions the later put: no fold in order is needed.

A base that changes are merged into must remember more than its live records, as changes may come late: the last delete
of each key (a put from before it must not revive the key), and puts that would be held if a delete came that clears the
record now held. ``state`` keeps just these: of a key's puts after its last delete, those that no later put of the same
or a higher version outdoes. Merging is then exact for every order of arrival, and repeating a part changes nothing.

Scale: the rank-1 windows get a WindowGroupLimit before their shuffle and the last delete per key is a map-side
combined maximum, so a hot key sends one row per map task; the join of the two is on the key with AQE's skew split. The
puts to remember are reduced within blocks of the log before a key's blocks meet.

Defined results: changes with a null cache, seq or key are left out; copies of a change count once (should copies of one
identifier differ, a delete goes before a put, then the higher version, then the greater of the other columns); other op
types than 0 and 1 are ignored; an empty feed returns the base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.fold import latest

DELETE, PUT = 0, 1
#: Numbers of the log in a block.
BLOCK_BITS = 12


def version_number(version: str = "version"):
    return F.coalesce(F.expr(f"try_cast(`{version}` as decimal(38,0))"), F.lit(0).cast("decimal(38,0)"))


def _changes(feed: DataFrame, part: list[str], key: str, seq: str, op: str, version: str, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The changes once each by identifier, with ``_version``, and the names of the columns they keep."""
    columns = [*part, key, seq, op, version, *[k for k in keep if k not in (*part, key, seq, op, version)]]
    rows = feed.select(*columns).dropna(subset=[*part, key, seq, op]).filter(F.col(op).isin(DELETE, PUT)).withColumn("_version", version_number(version))
    rest = [F.col(c) for c in columns if c not in (*part, seq, op)]
    return latest(rows, [*part, seq], [-F.col(op), F.col("_version"), *rest]), columns


def _after_deletes(once: DataFrame, part: list[str], key: str, seq: str, op: str) -> tuple[DataFrame, DataFrame]:
    deleted = once.filter(F.col(op) == DELETE).groupBy(*part, key).agg(F.max(seq).alias("_deleted"))
    alive = once.filter(F.col(op) == PUT).join(deleted, [*part, key], "left").filter(F.col("_deleted").isNull() | (F.col(seq) > F.col("_deleted")))
    return alive.drop("_deleted"), deleted


def live_records(feed: DataFrame, partition: Sequence[str] = ("cache_id",), key: str = "entry_key", seq: str = "seq", op: str = "op_type", version: str = "version", keep: Sequence[str] = ()) -> DataFrame:
    """One row per key that holds a record at the end: partition columns, key, seq, version, its number ``_version`` and ``keep``."""
    part = list(partition)
    once, _ = _changes(feed, part, key, seq, op, version, keep)
    alive, _ = _after_deletes(once, part, key, seq, op)
    return latest(alive, [*part, key], [F.col("_version"), F.col(seq)]).drop(op)


def state(feed: DataFrame, partition: Sequence[str] = ("cache_id",), key: str = "entry_key", seq: str = "seq", op: str = "op_type", version: str = "version", keep: Sequence[str] = ()) -> DataFrame:
    """The changes of the feed that may still matter, as a feed: partition columns, key, seq, op, version and ``keep``.

    A delete per key that was ever deleted (the last one), and the puts after it that no later put outdoes. Write it
    before merging again: a plan that merges several times over reads its base more than once each time.
    """
    part = list(partition)
    once, columns = _changes(feed, part, key, seq, op, version, keep)
    alive, deleted = _after_deletes(once, part, key, seq, op)
    block = F.shiftright(seq, BLOCK_BITS).alias("_block")
    for by in ([*part, key, "_block"], [*part, key]):
        later = W.partitionBy(*by).orderBy(F.desc(seq)).rowsBetween(W.unboundedPreceding, -1)
        rows = alive.select("*", block) if "_block" in by else alive
        alive = rows.withColumn("_best", F.max("_version").over(later)).filter(F.col("_best").isNull() | (F.col("_version") > F.col("_best"))).drop("_best", "_block")
    gone = deleted.select(*part, key, F.col("_deleted").alias(seq), F.lit(DELETE).cast(dict(feed.dtypes)[op]).alias(op), *[F.lit(None).cast(dict(feed.dtypes)[c]).alias(c) for c in columns if c not in (*part, key, seq, op)])
    return alive.select(*columns).unionByName(gone)


def merge(base: DataFrame, feed: DataFrame, partition: Sequence[str] = ("cache_id",), key: str = "entry_key", seq: str = "seq", op: str = "op_type", version: str = "version", keep: Sequence[str] = ()) -> DataFrame:
    """The state after the feed; ``base`` is a state. ``live_records`` of it is the table."""
    columns = [*partition, key, seq, op, version, *keep]
    return state(base.select(*columns).unionByName(feed.select(*columns)), partition, key, seq, op, version, keep)
