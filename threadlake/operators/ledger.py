"""Processing only new or changed records: a ledger of processed sequence numbers as disjoint intervals.

The ledger of a stream (any key columns) is a set of disjoint, non-touching closed intervals [lo, hi] of sequence
numbers. A run subtracts them from what is available, so that late commits below the highest number are found as gaps,
processes what remains, and commits the merged intervals together with its output.

Scale: no stream is gathered in one task. ``merge_intervals`` carries the highest end reached so far (and back, the next
start) through blocks of 2**16 numbers and groups of blocks; ``runs`` compresses numbers to intervals block by block
first. ``subtract`` removes most processed rows by the lowest interval of their stream, one row per stream in an
equi-join (AQE splits a hot stream); only streams with more intervals carry the latest start through their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.ordering import LEVEL, carried
from threadlake.session import cut
from threadlake.storage import Commits

#: The lower end of an interval that is open below.
FLOOR = -(2**62)


def merge_intervals(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint intervals with the same numbers: overlapping and adjacent ones are joined. Columns: keys, lo, hi."""
    ks = [f"__tl_k{i}" for i in range(len(keys))]
    rows = intervals.filter("lo <= hi").select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], "lo", "hi").groupBy(*ks, "lo").agg(F.max("hi").alias("hi"))
    rows = cut(rows)  # both carries read their rows several times
    opened = cut(carried(rows, ks, "lo", "hi", "reached").filter("reached is null or lo > reached + 1"))
    # What is reached before the next start is the end of this one; after the last start, what the stream reaches.
    ends = carried(opened.withColumn("next", F.struct("lo", "reached")), ks, "lo", "next", "following", back=True)
    top = rows.groupBy(*[F.col(k).alias(f"{k}t") for k in ks]).agg(F.max("hi").alias("top"))
    same = F.lit(True)
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}t"))
    joined = ends.join(top, same) if ks else ends.crossJoin(top)  # without keys there is one stream, and one row on the right
    return joined.select(*[F.col(n).alias(k) for k, n in zip(keys, ks, strict=True)], "lo", F.coalesce("following.reached", "top").alias("hi"))


def runs(numbers: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The maximal intervals of consecutive numbers. Blocks are compressed apart, so a hot stream is spread."""
    block = F.shiftright(F.col(seq), LEVEL)
    once = numbers.select(*keys, F.col(seq).alias("lo"), block.alias("_block")).filter("lo is not null").distinct()
    within = W.partitionBy(*keys, "_block").orderBy("lo")
    islands = once.withColumn("_island", F.col("lo") - F.row_number().over(within))
    pieces = islands.groupBy(*keys, "_block", "_island").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    return merge_intervals(pieces, keys)


def subtract(rows: DataFrame, processed: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows whose number lies in no interval of their stream. ``processed`` has keys, lo and hi, disjoint.

    Null keys match each other; rows with a null number are left out; streams without intervals keep all rows.
    """
    ks = [f"__tl_k{i}" for i in range(len(keys))]
    named = processed.select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], F.col("lo").alias("__tl_lo"), F.col("hi").alias("__tl_hi"))
    lowest = named.groupBy(*ks).agg(F.min_by(F.struct("__tl_lo", "__tl_hi"), "__tl_lo").alias("__tl_low"), (F.count(F.lit(1)) > 1).alias("__tl_more"))
    on = F.lit(True)
    for k, n in zip(keys, ks, strict=True):
        on = on & rows[k].eqNullSafe(F.col(n))
    low = F.col("__tl_low.__tl_lo").alias("__tl_lo"), F.col("__tl_low.__tl_hi").alias("__tl_hi")
    open_ = rows.filter(F.col(seq).isNotNull()).join(lowest.select(*ks, *low, "__tl_more"), on, "left").filter(F.col("__tl_lo").isNull() | (F.col(seq) < F.col("__tl_lo")) | (F.col(seq) > F.col("__tl_hi"))).drop(*ks)
    if not lowest.filter("__tl_more").take(1):
        return open_.select(*rows.columns)
    open_ = cut(open_)
    done = open_.filter("__tl_more is null or not __tl_more").select(*rows.columns)
    # In streams with more intervals the latest start at or before a row tells: rows and starts in one order, a start before the rows of its number.
    rest = open_.filter("__tl_more").select(F.struct(*rows.columns).alias("__tl_row"), *[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], F.col(seq).cast("long").alias("__tl_at"), F.lit(1).alias("__tl_is"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("__tl_iv"))
    starts = named.select(F.lit(None).cast(rest.schema["__tl_row"].dataType).alias("__tl_row"), *ks, F.col("__tl_lo").alias("__tl_at"), F.lit(0).alias("__tl_is"), F.struct(F.col("__tl_lo").alias("lo"), F.col("__tl_hi").alias("hi")).alias("__tl_iv"))
    found = carried(rest.unionByName(starts), ks, "__tl_at", "__tl_iv", "__tl_last", ties=["__tl_is"]).filter("__tl_is = 1 and (__tl_last is null or __tl_at > __tl_last.hi)")
    return done.unionByName(found.select("__tl_row.*"))


class Ledger:
    """A ledger kept in a folder beside the outputs it accounts for.

    Each run writes its output and the merged intervals into a folder of its own, then a numbered commit that names it
    (``storage.Commits``, through the file system that the tables are in). A run that fails before it leaves no commit,
    so its folder is never read and its records are found again by the next run; a run that fails after it is complete.
    Nothing is skipped or repeated. Of two runs at once one fails at its commit and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], seq: str = "seq"):
        self.spark, self.root, self.keys, self.seq = spark, root.rstrip("/"), list(keys), seq
        self.commits = Commits(spark, self.root)

    def runs(self) -> list[str]:
        return self.commits.last()[1].get("runs", [])

    def intervals(self, schema: str | None = None) -> DataFrame:
        done = self.runs()
        return self.spark.read.parquet(f"{self.root}/{done[-1]}/ledger") if done else self.spark.createDataFrame([], schema)

    def output(self) -> DataFrame | None:
        done = self.runs()
        return self.spark.read.parquet(*[f"{self.root}/{r}/output" for r in done]) if done else None

    def run(self, available: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Process what isn't in the ledger and commit. Returns the run's name."""
        types = dict(available.dtypes)
        schema = ", ".join([*(f"`{k}` {types[k]}" for k in self.keys), "lo long", "hi long"])
        number, content = self.commits.last()
        done = self.intervals(schema)
        fresh = subtract(available, done, self.keys, self.seq)
        name = f"run-{uuid.uuid4().hex}"
        # The records are fixed in a file first: output and ledger then speak of the same ones, even if rows arrive meanwhile.
        fresh.write.parquet(f"{self.root}/{name}/input")
        fixed = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/{name}/input")
        process(fixed).write.parquet(f"{self.root}/{name}/output")
        merge_intervals(done.select(*self.keys, "lo", "hi").unionByName(runs(fixed, self.keys, self.seq)), self.keys).write.parquet(f"{self.root}/{name}/ledger")
        self.commits.commit(number, {"runs": [*content.get("runs", []), name]})
        return name


#: Entities whose progress a run keeps per store.
SIGNED = ("profile", "event", "call")
SUCCESS = ("inplace", "swapped")


def last_success(states: DataFrame) -> DataFrame:
    """Per cache, the successful run with the latest finished_at (equal times: the highest run_id)."""
    from threadlake.operators.fold import latest

    good = states.filter(F.col("outcome").isin(*SUCCESS) & F.col("finished_at").isNotNull() & F.col("cache_id").isNotNull())
    return latest(good, ["cache_id"], [F.col("finished_at"), F.col("run_id")])


def processed_intervals(states: DataFrame) -> DataFrame:
    """What the last successful run of each cache has taken, as intervals per (cache_id, stream).

    A stream is ``entity|db:os`` for entities with signatures, '*' for all others. Signature parts that can't be read
    give no interval; a null max_seq takes nothing.
    """
    run = last_success(states)
    sigs = run.select("cache_id", F.explode("store_sigs").alias("entity", "sig")).filter(F.col("entity").isin(*SIGNED))
    parts = sigs.select("cache_id", "entity", F.explode(F.split("sig", ",")).alias("part")).select("cache_id", "entity", F.split(F.trim("part"), ":").alias("p"))
    signed = parts.filter(F.size("p") >= 3).select("cache_id", F.concat_ws("|", "entity", F.concat_ws(":", F.trim(F.col("p")[0]), F.trim(F.col("p")[1]))).alias("stream"), F.expr("try_cast(p[2] as bigint)").alias("hi"))
    rest = run.select("cache_id", F.lit("*").alias("stream"), F.col("max_seq").alias("hi"))
    both = signed.unionByName(rest).filter("hi is not null")
    # All start at the floor: merged, the highest end of each stream is left.
    return both.groupBy("cache_id", "stream").agg(F.lit(FLOOR).cast("long").alias("lo"), F.max("hi").alias("hi"))


def pending_entries(entries: DataFrame, states: DataFrame) -> DataFrame:
    """The (cache_id, seq) of store entries that the last successful run hasn't taken, once each, deletes included."""
    stream = F.when(F.col("entity").isin(*SIGNED), F.concat_ws("|", "entity", F.concat_ws(":", F.col("db_id").cast("string"), F.col("os_id").cast("string")))).otherwise(F.lit("*"))
    rows = entries.filter("cache_id is not null and seq is not null").select("cache_id", stream.alias("stream"), "seq").distinct()
    return subtract(rows, processed_intervals(states), ["cache_id", "stream"]).select("cache_id", "seq").distinct()
