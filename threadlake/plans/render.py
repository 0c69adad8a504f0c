"""What is shown to readers: times, durations, glyphs, reaction rows, body chunks and windows of threads."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RELATIVE = re.compile(r"([+-])(\d+)([dhm])")
_UNITS = {"d": 86_400_000, "h": 3_600_000, "m": 60_000}


def parse_time(text: str | int, now: int, zone: str = "UTC") -> int:
    """Milliseconds of a number, an offset to now (+2d, -3h, -15m) or an ISO time.

    A time without an offset is in ``zone``; a date alone is midnight UTC. Anything else raises ValueError.
    """
    s = str(text).strip()
    if re.fullmatch(r"-?\d{9,}", s):
        return int(s)
    if m := _RELATIVE.fullmatch(s):
        return now + (1 if m[1] == "+" else -1) * int(m[2]) * _UNITS[m[3]]
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        return int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.UTC).timestamp() * 1000)
    try:
        t = dt.datetime.fromisoformat(s)
    except ValueError as e:
        raise ValueError(f"not a time: {text!r}") from e
    return int((t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))).timestamp() * 1000)


def shown_time(ms: Column, now: int, zone: str = "UTC") -> Column:
    """``MM-dd HH:mm`` in ``zone``, with the year unless it is the current one; ``--`` for none or 0."""
    year = dt.datetime.fromtimestamp(now / 1000, ZoneInfo(zone)).year
    t = F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), zone)
    return F.when(ms.isNull() | (ms == 0), "--").when(F.year(t) == year, F.date_format(t, "MM-dd HH:mm")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))


def shown_duration(ms: Column) -> Column:
    """``12s``, ``5m`` or ``1h05m``."""
    s = F.floor(ms / 1000)
    return F.when(ms.isNull() | (ms <= 0), "").when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600), F.lit("h"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit("m")))


#: Reaction keys that are names.
GLYPHS = {
    "like": "👍", "plusone": "👍", "heart": "❤️", "love": "😍", "laugh": "😂", "smile": "😊", "happyface": "😊", "sad": "😢", "cry": "😢", "angry": "😠", "surprised": "😮", "wow": "😲", "yes": "✅", "check": "✅", "no": "❌", "clap": "👏", "clappinghands": "👏",
    "fire": "🔥", "praying": "🙏", "tada": "🎉", "party": "🎉", "rocket": "🚀", "launch": "🚀", "eyes": "👀", "thinking": "🤔", "think": "🤔", "sweatgrinning": "😅", "handsinair": "🙌", "champagne": "🍾", "screamingfear": "😱", "poop": "💩", "fistbump": "👊", "crossedfingers": "🤞",
    "cake": "🍰", "cakeslice": "🍰", "grinningfacewithsmilingeyes": "😄", "smilingfacewithtear": "🥲", "sun": "☀️", "stareyes": "🤩", "hearteyes": "😍", "upsidedownface": "🙃", "diamond": "💎", "rock": "🤘", "cool": "😎", "veryconfused": "😕", "seenoevil": "🙈", "ok": "👌", "salute": "🫡",
    "personrunningfacingright": "🏃", "personrunningfacingright2": "🏃", "womanshrug": "🤷‍♀️", "manshrug": "🤷‍♂️", "shrug": "🤷", "goldmedal": "🥇", "expressionless": "😑", "palmtree": "🌴", "relieved": "😌", "man_pouting": "🙎‍♂️", "angel": "😇", "confused": "😕", "muscle": "💪", "climber": "🧗",
    "gift": "🎁", "nerdy": "🤓", "trophy": "🏆", "pizzaslice": "🍕", "maracas": "🪇", "cash": "💵", "unicornhead": "🦄", "sparklingheart": "💖", "lipssealed": "🤐", "lotus_position": "🧘", "music": "🎵", "penguin": "🐧", "womanhealthworker": "👩‍⚕️", "shivering": "🥶", "cookies": "🍪", "speechbubble": "💬",
    "wink": "😉", "sweat": "😓",
}


def glyph(key: Column) -> Column:
    """The character of a reaction key: a skin tone and what follows a semicolon are left off; hexadecimal code points (the first part, or all) are decoded, names looked up, others shown as they are."""
    bare = F.regexp_extract(F.regexp_replace(key, r"-tone[1-6]$", ""), r"^([^;]*)", 1)
    name = F.when(bare == "", key).otherwise(bare)
    code = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    point = r"(?:0?[0-9a-cA-CefEF][0-9a-fA-F]{3}|0?d[0-7][0-9a-fA-F]{2}|0?D[0-7][0-9a-fA-F]{2}|0?[1-9a-fA-F][0-9a-fA-F]{4}|10[0-9a-fA-F]{4})"
    parts = F.split(name, "_")
    whole = name.rlike(f"^{point}(?:_{point})+$")
    table = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])
    named = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.lower(name)), name)
    return F.when(whole, F.array_join(F.transform(F.when(whole, parts).otherwise(F.array().cast("array<string>")), code), "")).when(name.rlike(f"^{point}(?:_|$)"), code(F.when(name.rlike(f"^{point}(?:_|$)"), parts[0]).otherwise("41"))).otherwise(named)


def reaction_rows(messages: DataFrame, me: str | None = None, people: DataFrame | None = None, named: int = 3, users: int = 3, counted: int = 2) -> DataFrame:
    """conv_id, id, rank, key, n, shown: groups by number, then first time, then key.

    The first ``named`` show up to ``users`` people (the owner first, then the latest; how many more), the next
    ``counted`` only their number, the rest is 'folded'. People are shown by name where ``people`` (mri, name) has one.
    """
    groups = messages.select("conv_id", "id", F.inline("reactions")).filter("k is not null and size(u) > 0")
    flat = groups.select("conv_id", "id", F.col("k").alias("key"), F.inline("u")).withColumn("ts", F.coalesce("ts", F.lit(0)))
    counts = flat.groupBy("conv_id", "id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("first_ts"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("conv_id", "id").orderBy(F.desc("n"), F.asc_nulls_last("first_ts"), "key")))
    own = F.coalesce(F.col("mri") == F.lit(me), F.lit(False)) if me else F.lit(False)
    order = W.partitionBy("conv_id", "id", "key").orderBy(F.desc("own"), F.desc("ts"), "mri")
    top = flat.withColumn("own", own).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= users)
    label = F.when(F.col("own"), "you")
    if people is not None:
        top = top.join(people.select("mri", F.nullif("name", F.lit("")).alias("name")), "mri", "left")
        label = label.otherwise(F.coalesce("name", F.lit("(unknown)")))
    else:
        label = label.otherwise(F.coalesce("mri", F.lit("(unknown)")))
    shown_users = top.groupBy("conv_id", "id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", label.alias("label")))), lambda x: x["label"]), ", ").alias("who"))
    rows = ranked.join(shown_users, ["conv_id", "id", "key"])
    more = F.when(F.col("n") > users, F.concat(F.lit(" +"), (F.col("n") - users).cast("string"))).otherwise("")
    shown = F.when(F.col("rank") <= named, F.concat("who", more)).when(F.col("rank") <= named + counted, F.col("n").cast("string")).otherwise("folded")
    return rows.select("conv_id", "id", "rank", "key", "n", shown.alias("shown"))


def body_chunk(text: Column, offset: int, size: int = 4000) -> Column:
    """A slice of a body in code points."""
    return F.substring(text, offset + 1, size)


def thread_blocks(messages: DataFrame, whole: int = 5, tail: int = 3) -> DataFrame:
    """Per thread the root and, if it has more than ``whole`` messages, its last ``tail`` replies: adds n and earlier (replies left out).

    A thread's last rows are found by rank (limited before the shuffle), its size by a count that combines map-side.
    """
    rows = messages.filter("not is_system")
    thread = ["conv_id", "root_id"]
    sizes = rows.groupBy(*thread).agg(F.count(F.lit(1)).alias("n"))
    last = rows.withColumn("_r", F.row_number().over(W.partitionBy(*thread).orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("_r") <= max(whole, tail))
    roots = rows.filter("id = root_id")
    kept = last.join(sizes, thread).filter((F.col("n") <= whole) | ((F.col("_r") <= tail) & (F.col("id") != F.col("root_id")))).drop("_r")
    heads = roots.join(sizes, thread).filter(F.col("n") > whole)
    shown = kept.unionByName(heads)
    counts = shown.groupBy(*thread).agg(F.count(F.lit(1)).alias("_shown"))
    return shown.join(counts, thread).withColumn("earlier", F.col("n") - F.col("_shown")).drop("_shown")


def legend(hits: DataFrame, conversations: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` conversations of search hits: conv_id, handle."""
    ids = hits.select("conv_id").distinct().orderBy("conv_id").limit(most)
    return ids.join(conversations.select(F.col("id").alias("conv_id"), "handle"), "conv_id")


def envelope(meta: dict, now: int) -> str:
    """The header line of an answer: age of the version, its layout, and whether it may be incomplete."""
    age = max(0, int(now / 1000 - meta["full_at"]))
    notes = ["incomplete"] * meta["lossy"] + ["unverified layout"] * (not meta["matched"])
    return f"version {meta['version']}, mapping {meta['mapping'] or 'none'}, {age}s old" + "".join(f", {n}" for n in notes)
