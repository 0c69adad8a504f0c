"""Activity analytics: days, streaks, hours, partners, rhythms. Days and hours are of the session's time zone (UTC by default)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.mri import is_bot
from threadlake.operators import sessions
from threadlake.plans import silver


def at(ms: Column | str) -> Column:
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def said(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """Messages that aren't system rows, with a time."""
    return silver.messages(spark, root, "conv_id", "id", "ts", "sender", "is_mine", "is_system", *more).filter("not is_system and ts > 0")


def per_day(spark: SparkSession, root: str) -> DataFrame:
    return said(spark, root).groupBy(F.to_date(at("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def busiest_day(spark: SparkSession, root: str) -> DataFrame:
    """The day with most messages, the first of equals."""
    return per_day(spark, root).agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("day"), F.max("n").alias("n"))


def streaks(spark: SparkSession, root: str) -> DataFrame:
    """Per sender, the longest run of days in a row: sender, days, first_day (of the earliest such run)."""
    days = said(spark, root).select("sender", F.to_date(at("ts")).alias("day")).distinct()
    numbered = days.withColumn("island", F.date_sub("day", F.row_number().over(W.partitionBy("sender").orderBy("day"))))
    runs = numbered.groupBy("sender", "island").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"))
    return runs.groupBy("sender").agg(F.max("days").alias("days"), F.max_by("first_day", F.struct("days", -F.unix_date("first_day"))).alias("first_day"))


def hour_histogram(spark: SparkSession, root: str) -> DataFrame:
    counts = said(spark, root).groupBy(F.hour(at("ts")).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def night_owls(spark: SparkSession, root: str) -> DataFrame:
    """sender, share of messages between 22 and 6 o'clock."""
    night = F.hour(at("ts")).isin(22, 23, 0, 1, 2, 3, 4, 5).cast("int")
    return said(spark, root).groupBy("sender").agg(F.round(F.avg(night), 6).alias("share"), F.count(F.lit(1)).alias("n"))


def reactions_total(spark: SparkSession, root: str) -> DataFrame:
    rows = said(spark, root, "reactions")
    n = F.aggregate(F.coalesce(F.transform("reactions", lambda g: F.greatest(F.size(F.coalesce(g["u"], F.array().cast("array<struct<mri:string,ts:bigint>>"))), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)
    return rows.agg(F.sum(n).alias("total"), F.sum(F.when(F.col("is_mine"), n).otherwise(0)).alias("mine"))


def top_partners(spark: SparkSession, root: str, limit: int = 10) -> DataFrame:
    """Partners of 1:1 conversations by the volume of the whole conversation: the other person who wrote most in it."""
    rows = said(spark, root, "kind").filter("kind = '1:1'")
    per = rows.groupBy("conv_id", "sender").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_mine").alias("mine"))
    volume = per.groupBy("conv_id").agg(F.sum("n").alias("volume"))
    other = per.filter(~F.col("mine") & ~is_bot(F.col("sender")))
    ranked = other.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "sender"))).filter("rn = 1")
    return ranked.join(volume, "conv_id").groupBy("sender").agg(F.sum("volume").alias("volume")).orderBy(F.desc("volume"), "sender").limit(limit)


def people_talked_to(spark: SparkSession, root: str) -> DataFrame:
    rows = said(spark, root)
    mine = rows.filter("is_mine").select("conv_id").distinct()
    return rows.filter(~F.col("is_mine") & ~is_bot(F.col("sender"))).join(mine, "conv_id", "left_semi").agg(F.count_distinct("sender").alias("people"))


def to_me(spark: SparkSession, root: str) -> DataFrame:
    """Messages to the owner: in a 1:1, with a mention, or replies to an earlier message of the owner."""
    rows = said(spark, root, "kind", "mentions_me", "root_id", "content")
    mine = rows.filter("is_mine").select("conv_id", F.col("id").alias("root_id"), F.col("ts").alias("my_ts"))
    found = rows.filter("not is_mine and content <> ''").join(mine, ["conv_id", "root_id"], "left")
    return found.filter("kind = '1:1' or mentions_me or (my_ts is not null and my_ts < ts)").select("conv_id", "id", "ts", "sender")


def first_to_me(spark: SparkSession, root: str) -> DataFrame:
    """Per sender, the first message to the owner."""
    return to_me(spark, root).groupBy("sender").agg(F.min(F.struct("ts", "id")).alias("f")).select("sender", "f.ts", "f.id")


def burst_60s(spark: SparkSession, root: str, gap: int = 60_000) -> DataFrame:
    """Per sender, how many messages follow the first one to the owner in its conversation, none later than ``gap`` after the one before."""
    first = to_me(spark, root).groupBy("sender").agg(F.min(F.struct("ts", "id", "conv_id")).alias("f")).select("sender", "f.conv_id", F.col("f.ts").alias("from_ts"))
    rows = said(spark, root).join(first, ["sender", "conv_id"]).filter("ts >= from_ts")
    runs = sessions.sessions(rows, "sender", "ts", gap).join(first.select("sender", F.col("from_ts").alias("start_ts")), ["sender", "start_ts"])
    return runs.select("sender", F.col("n_events").alias("n"), F.col("end_ts").alias("last_ts"))


def first_message(spark: SparkSession, root: str, gap: int = 60_000) -> DataFrame:
    """The first message of all to the owner with what its sender wrote right after it: conv_id, id, ts, sender, text (joined by line breaks), n.

    The run ends where another person writes or more than ``gap`` passes; it is cut out of the conversation by the first such row, so only its own rows are sorted.
    """
    first = to_me(spark, root).agg(F.min(F.struct("ts", "id", "conv_id", "sender")).alias("f")).first()["f"]
    if first is None:
        return said(spark, root, "content").select("conv_id", "id", "ts", "sender", F.col("content").alias("text"), F.lit(0).cast("long").alias("n")).limit(0)
    here = said(spark, root, "content").filter((F.col("conv_id") == first["conv_id"]) & ((F.col("ts") > first["ts"]) | ((F.col("ts") == first["ts"]) & (F.col("id") >= first["id"]))))
    other = here.filter(F.col("sender") != first["sender"]).agg(F.min(F.struct("ts", "id")).alias("f")).first()["f"]
    own = here.filter(F.col("sender") == first["sender"])
    if other is not None:
        own = own.filter((F.col("ts") < other["ts"]) | ((F.col("ts") == other["ts"]) & (F.col("id") < other["id"])))
    w = W.orderBy("ts", "id")  # one sender's rows before anyone else writes
    run = own.withColumn("breaks", F.sum(F.when(F.col("ts") - F.lag("ts").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("breaks = 0")
    lines = F.array_sort(F.collect_list(F.struct("ts", "id", "content")))
    return run.agg(F.array_join(F.transform(F.filter(lines, lambda x: F.trim(x["content"]) != ""), lambda x: x["content"]), "\n").alias("text"), F.count(F.lit(1)).alias("n")).select(F.lit(first["conv_id"]).alias("conv_id"), F.lit(first["id"]).alias("id"), F.lit(first["ts"]).cast("long").alias("ts"), F.lit(first["sender"]).alias("sender"), "text", "n")


def anchors(spark: SparkSession, root: str) -> DataFrame:
    """first_ts: the owner's first message with content in a conversation of people, sent or (but in channels) received; last_ts of all."""
    rows = said(spark, root, "kind", "content")
    real = F.col("kind").isin("1:1", "group", "meeting", "channel") & (F.trim("content") != "") & (F.col("is_mine") | (F.col("kind") != "channel"))
    return rows.agg(F.min(F.when(real, F.col("ts"))).alias("first_ts"), F.max("ts").alias("last_ts"))


def scale(spark: SparkSession, root: str) -> DataFrame:
    """scale, top: how messages per day are best drawn: linear below one order of magnitude between a low count (a tenth is lower) and the highest, square root below two, else symlog."""
    counts = per_day(spark, root).filter("n > 0")  # a row per day
    placed = counts.withColumn("rn", F.row_number().over(W.orderBy("n"))).withColumn("size", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    low = placed.agg(F.max("n").alias("top"), F.max("size").alias("size"), F.max(F.when(F.col("rn") == F.floor(F.col("size") * 0.1) + 1, F.col("n"))).alias("low"))
    orders = F.log10(F.col("top") / F.greatest(F.lit(1), F.col("low")))
    return low.select(F.when((F.coalesce("size", F.lit(0)) < 2) | (orders < 1), "linear").when(orders < 2, "sqrt").otherwise("symlog").alias("scale"), "top")


def ticks(top: float, most: int = 4) -> list[float]:
    """0 and the ``most`` highest of 1, 2.5 and 5 times powers of ten up to ``top``."""
    found, power = [], 1
    while power <= top:
        found += [m * power for m in (1, 2.5, 5) if m * power <= top]
        power *= 10
    return [0, *found[-most:]]


def half_year(spark: SparkSession, root: str, start: int | None = None, days: int = 182) -> DataFrame:
    """Messages per day of a window of half a year, by default the last one."""
    span = anchors(spark, root).first()
    start = max(span["first_ts"] or 0, (span["last_ts"] or 0) - days * 86_400_000) if start is None else start
    rows = said(spark, root).filter((F.col("ts") >= start) & (F.col("ts") <= start + days * 86_400_000))
    return rows.groupBy(F.to_date(at("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def kind_mix(spark: SparkSession, root: str) -> DataFrame:
    return silver.conversations(spark, root).filter("msg_count > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("msg_count").alias("messages"))


def day_axis(spark: SparkSession, root: str, senders: int = 100) -> DataFrame:
    """sender, day, n: a row for each day of the span and each of the ``senders`` busiest senders, zeros filled in.

    The axis is the report's: at most ``senders`` times the days of the span.
    """
    rows = said(spark, root).select("sender", F.to_date(at("ts")).alias("day"))
    top = rows.groupBy("sender").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sender").limit(senders)
    span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span is None or span["a"] is None:
        return rows.withColumn("n", F.lit(0).cast("long")).limit(0)
    axis = top.select("sender", F.explode(F.sequence(F.lit(span["a"]), F.lit(span["b"]))).alias("day"))
    counts = rows.groupBy("sender", "day").agg(F.count(F.lit(1)).alias("n"))
    return axis.join(counts, ["sender", "day"], "left").select("sender", "day", F.coalesce("n", F.lit(0)).alias("n"))


def rolling(spark: SparkSession, root: str) -> DataFrame:
    """Per sender and day: sum over 35 days and mean over 7 days."""
    w = W.partitionBy("sender").orderBy("day")
    return day_axis(spark, root).select("sender", "day", F.sum("n").over(w.rowsBetween(-34, 0)).alias("sum_35d"), F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 6).alias("mean_7d"))


def top_per_frame(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """The ``k`` first of each day by their 35-day sum: day, rank, sender, share of the day's highest."""
    w = W.partitionBy("day").orderBy(F.desc("sum_35d"), "sender")
    rows = rolling(spark, root).withColumn("rank", F.row_number().over(w)).withColumn("top", F.max("sum_35d").over(W.partitionBy("day")))
    return rows.filter(F.col("rank") <= k).select("day", "rank", "sender", F.round(F.when(F.col("top") > 0, F.sqrt(F.col("sum_35d") / F.col("top"))).otherwise(0.0), 6).alias("scale"))


def hysteresis(frames: DataFrame, margin: float = 0.15) -> DataFrame:
    """Ranks that change only when a value beats the one above it by ``margin``: frame, rank, key.

    ``frames`` has frame, key and value. Each frame starts from the order before it, new keys at its end by value, and
    passes over it until no neighbours swap. Frames depend on each other, so all go through one group; the input is a
    report of bounded size (days times the listed keys).
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order: list[str] = []
        out = []
        for frame, rows in pdf.sort_values(["frame", "key"]).groupby("frame", sort=True):
            value = dict(zip(rows["key"], rows["value"], strict=True))
            order = [k for k in order if k in value]
            order += sorted((k for k in value if k not in order), key=lambda k: (-value[k], k))
            for end in range(len(order), 1, -1):
                swapped = False
                for i in range(1, end):
                    if value[order[i]] > value[order[i - 1]] * (1 + margin):
                        order[i - 1], order[i] = order[i], order[i - 1]
                        swapped = True
                if not swapped:
                    break
            out += [(frame, i + 1, k) for i, k in enumerate(order)]
        return pd.DataFrame(out, columns=["frame", "rank", "key"])

    one = frames.withColumn("_all", F.lit(1))
    return one.groupBy("_all").applyInPandas(run, f"frame {dict(frames.dtypes)['frame']}, rank long, key string")


def hysteresis_rank(spark: SparkSession, root: str) -> DataFrame:
    rows = top_per_frame(spark, root).join(rolling(spark, root), ["day", "sender"])
    return hysteresis(rows.select(F.col("day").alias("frame"), F.col("sender").alias("key"), F.col("sum_35d").cast("double").alias("value")))


def slot(ts: Column) -> Column:
    """0: 0 to 6 o'clock, 1 to 68: quarter-hours from 6 to 23, 69: 23 to 24."""
    return F.when(F.hour(ts) < 6, 0).when(F.hour(ts) >= 23, 69).otherwise((F.hour(ts) - 6) * 4 + F.floor(F.minute(ts) / 15) + 1).cast("long")


def week_of(day: Column) -> Column:
    """The Sunday a day's week begins with."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def rhythm(spark: SparkSession, root: str) -> DataFrame:
    """week, weekday (0 is Sunday), slot, n of people's messages."""
    rows = said(spark, root).filter(~is_bot(F.col("sender"))).withColumn("at", at("ts")).withColumn("day", F.to_date("at"))
    return rows.groupBy(week_of(F.col("day")).alias("week"), (F.dayofweek("day") - 1).cast("long").alias("weekday"), slot(F.col("at")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def week_axis(spark: SparkSession, root: str) -> DataFrame:
    """Every week of the span with its messages."""
    weeks = per_day(spark, root).groupBy(week_of(F.col("day")).alias("week")).agg(F.sum("n").alias("n"))
    span = weeks.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    axis = span.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return axis.join(weeks, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def rolling_4w(spark: SparkSession, root: str) -> DataFrame:
    """Per weekday and slot, the mean over four weeks of the zero-filled week axis."""
    r = rhythm(spark, root)
    cells = r.select("weekday", "slot").distinct()
    weeks = week_axis(spark, root).select("week")
    axis = cells.withColumn("k", F.lit(1)).join(weeks.withColumn("k", F.lit(1)), "k").drop("k")
    w = W.partitionBy("weekday", "slot").orderBy("week").rowsBetween(-3, 0)
    return axis.join(r, ["week", "weekday", "slot"], "left").select("week", "weekday", "slot", F.round(F.avg(F.coalesce("n", F.lit(0))).over(w), 6).alias("mean_4w"))


def smoothed(spark: SparkSession, root: str, sigma: float = 2.0, reach: int = 6) -> DataFrame:
    """Messages per weekday and slot 1 to 68, smoothed by a Gaussian that is renormalised at the edges."""
    cells = rhythm(spark, root).filter("slot between 1 and 68").groupBy("weekday", "slot").agg(F.sum("n").alias("n"))
    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col("slot") - reach), F.least(F.lit(68), F.col("slot") + reach)))
    weight = F.exp(-F.pow(F.col("to") - F.col("slot"), F.lit(2)) / (2 * sigma * sigma))
    sums = cells.select("weekday", "slot", "n", near.alias("to")).groupBy("weekday", "to").agg(F.sum(weight * F.col("n")).alias("s"))
    norm = spark.range(1, 69).withColumnRenamed("id", "slot").select("slot", near.alias("to")).groupBy("to").agg(F.sum(weight).alias("w"))
    return sums.join(norm, "to").select("weekday", F.col("to").alias("slot"), F.round(F.col("s") / F.col("w"), 6).alias("value"))


def p95_positive(spark: SparkSession, root: str) -> DataFrame:
    """Per weekday, the value at place floor(0.95 n), from 0, among the sorted counts of its slots."""
    cells = rhythm(spark, root).groupBy("weekday", "slot").agg(F.sum("n").alias("n")).filter("n > 0")
    w = W.partitionBy("weekday")
    placed = cells.withColumn("rn", F.row_number().over(w.orderBy("n", "slot"))).withColumn("size", F.count(F.lit(1)).over(w))
    return placed.filter("rn = least(size, floor(0.95 * size) + 1)").select("weekday", F.col("n").alias("p95"))


def call_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Nearest-rank percentiles and population deviation of call durations by direction."""
    rows = silver.calls(spark, root).filter("duration_ms > 0").withColumn("direction", F.coalesce("direction", F.lit("")))
    # A count per value with a running sum: no group's values are held in one buffer.
    per = rows.groupBy("direction", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("direction").orderBy("duration_ms")
    placed = per.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("size", F.sum("n").over(W.partitionBy("direction")))
    reached = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("size") * q), F.col("duration_ms"))).alias(f"p{int(q * 100)}")
    points = placed.groupBy("direction").agg(*[reached(q) for q in (0.5, 0.9, 0.99)])
    return points.join(rows.groupBy("direction").agg(F.round(F.stddev_pop("duration_ms"), 3).alias("deviation"), F.count(F.lit(1)).alias("n")), "direction").select("direction", "p50", "p90", "p99", "deviation", "n")


def occupancy(spark: SparkSession, root: str, ticks: int = 200) -> DataFrame:
    """Quarter-hours meetings and calls occupy, one at least and ``ticks`` at most each: weekday, slot, n."""
    events = silver.events(spark, root).filter("not coalesce(is_cancelled, false) and not coalesce(is_all_day, false) and start_ts > 0").select("start_ts", F.col("end_ts").alias("end_ts"))
    calls = silver.calls(spark, root).filter("not coalesce(is_deleted, false) and start_ts > 0").select("start_ts", (F.col("start_ts") + F.coalesce("duration_ms", F.lit(0))).alias("end_ts"))
    q = 900_000
    first = F.col("start_ts") - F.pmod("start_ts", F.lit(q))
    last = F.greatest(first, F.least(F.coalesce("end_ts", "start_ts") - 1, first + (ticks - 1) * q))
    rows = events.unionByName(calls).select(F.explode(F.sequence(first, last, F.lit(q).cast("long"))).alias("ms")).select(at("ms").alias("at"))
    return rows.groupBy((F.dayofweek("at") - 1).cast("long").alias("weekday"), slot(F.col("at")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def interpolated(spark: SparkSession, root: str, steps: int = 4) -> DataFrame:
    """Weekly counts with ``steps`` - 1 points between each week and the next: week, step, value."""
    rows = week_axis(spark, root).withColumn("nxt", F.lead("n").over(W.orderBy("week")))  # one row per week of the span
    points = rows.select("week", "n", "nxt", F.explode(F.sequence(F.lit(0), F.when(F.col("nxt").isNull(), 0).otherwise(steps - 1))).alias("step"))
    return points.select("week", F.col("step").cast("long").alias("step"), F.round(F.col("n") + F.coalesce(F.col("nxt") - F.col("n"), F.lit(0)) * F.col("step") / steps, 6).alias("value"))
