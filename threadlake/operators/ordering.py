"""Positions within large groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.fold import unused


def ordinals(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], cell: int = 86_400_000, name: str = "position", weight: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row in its group, by ``ts`` (never null), then ``ties``; with ``weight``, the sum of that column over the rows before.

    Rows are numbered within a cell of time of their group; the number of rows before a cell comes from a running sum
    over the group's cells, one row each.
    """
    cell_, n_, before_, in_ = (unused(df, c) for c in ("_cell", "_n", "_before", "_in"))
    rows = df.withColumn(cell_, F.floor(F.col(ts) / F.lit(cell)).cast("long"))
    counts = rows.groupBy(*keys, cell_).agg(F.sum(weight).alias(n_) if weight else F.count(F.lit(1)).alias(n_))
    before = F.coalesce(F.sum(n_).over(W.partitionBy(*keys).orderBy(cell_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, cell_, before.alias(before_))
    by = W.partitionBy(*keys, cell_).orderBy(ts, *ties)
    within = F.coalesce(F.sum(weight).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(by) - 1
    return rows.withColumn(in_, within).join(offsets, [*keys, cell_]).withColumn(name, F.col(before_) + F.col(in_)).drop(cell_, in_, before_)


#: Bits of the position that one level of blocks takes.
LEVEL = 16


def carried(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, ties: Sequence[str] = (), back: bool = False) -> DataFrame:
    """Adds, per group, the greatest ``value`` of all rows before each row, by ``pos`` (a long, never null), then ``ties``; null before the first.

    With ``back`` the least value of all rows after it. Values may be structs; rows equal in order should be equal in
    value. Windows run within 2**16 positions, over the blocks within 2**32, and over those blocks' groups, so a hot
    group is spread. Null keys are a group.
    """
    pick, low, high = (F.min, 1, W.unboundedFollowing) if back else (F.max, W.unboundedPreceding, -1)
    both = F.least if back else F.greatest
    b_, s_, v_, c_ = (unused(df, c) for c in ("_block", "_group", "_value", "_carry"))
    ks = [unused(df, f"_key{i}") for i in range(len(keys))]
    rows = df.withColumn(b_, F.shiftright(pos, LEVEL)).withColumn(s_, F.shiftright(pos, 2 * LEVEL))
    named = [F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)]
    blocks = rows.groupBy(*named, s_, b_).agg(pick(value).alias(v_))
    groups = blocks.groupBy(*ks, s_).agg(pick(v_).alias(v_))
    groups = groups.select(*[F.col(k).alias(f"{k}g") for k in ks], F.col(s_).alias(f"{s_}g"), pick(v_).over(W.partitionBy(*ks).orderBy(s_).rowsBetween(low, high)).alias(f"{c_}g"))
    same = F.col(s_) == F.col(f"{s_}g")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}g"))
    within = pick(v_).over(W.partitionBy(*ks, s_).orderBy(b_).rowsBetween(low, high))
    blocks = blocks.join(groups, same).select(*ks, F.col(b_).alias(f"{b_}b"), both(within, F.col(f"{c_}g")).alias(c_))
    same = F.col(b_) == F.col(f"{b_}b")
    for k, n in zip(keys, ks, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    within = pick(value).over(W.partitionBy(*keys, b_).orderBy(pos, *ties).rowsBetween(low, high))
    return rows.join(blocks, same).withColumn(name, both(within, F.col(c_))).select(*df.columns, name)
