"""Running values of groups too large for one task: a scan in blocks.

A group's samples, numbered without gaps, are cut into blocks of n. Each block is ordered in a task of its own; what it hands
on is one row (a sum, a last value), a window over those rows says what each block is handed, and the two are put together.
A group of 10^10 samples in blocks of 10^6 is 10^4 rows for that window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from undula.operators import ranks
from undula.operators.frame import OrderedFrame

#: Kinds of running values, in order: sum, greatest, least; last and first value that isn't null; last before the row.
KINDS = ("sum", "max", "min", "last", "first", "before")
BLOCK = "_block"


def numbered(df: DataFrame, order_by: Sequence[str], group: Sequence[str] = (), name: str = "sample_index", parts: int | None = None) -> DataFrame:
    """df, stored, with each sample's place in its group, from 0: ranges of (group, order_by) are numbered apart, and go on
    where those before end. Samples that tie are numbered in any order, once."""
    cut = ranks.ranges(df, group, order_by, parts=parts)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_range").orderBy(*order_by)
    made = ranks.joined(cut.withColumn("_place", F.row_number().over(own)), sizes, [*group, "_range"])
    return made.withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_range", "_place", "_before")


def cut(frame: OrderedFrame, n: int) -> OrderedFrame:
    """The frame with its samples' blocks, of n samples, and the block among its group's keys."""
    if n < 1:
        raise ValueError("a block needs at least one sample")
    return OrderedFrame(frame.df.withColumn(BLOCK, F.floor(frame.i / F.lit(n))), frame.order_by, [*frame.group, BLOCK], frame.index)


def lagged(frame: OrderedFrame, n: int, columns: Mapping[str, Column]) -> OrderedFrame:
    """cut(), and for each of columns its value at the sample before, in the same group: a block's last sample stands in
    the next block too while that is ordered."""
    spread = frame.df.withColumn("_own", F.floor(frame.i / F.lit(n)))
    both = F.array(F.col("_own"), F.when(frame.i % n == n - 1, F.col("_own") + 1))
    blocks = OrderedFrame(spread.withColumn(BLOCK, F.explode(F.array_compact(both))), frame.order_by, [*frame.group, BLOCK], frame.index)
    made = blocks.having({k: F.lag(v).over(blocks.w) for k, v in columns.items()})
    return OrderedFrame(made.df.where(F.col(BLOCK) == F.col("_own")).drop("_own"), frame.order_by, blocks.group, frame.index)


def handed(blocks: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """What each block is handed, of a row a block that says what each hands on; columns: name to kind."""
    w = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True), "before": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}
    return blocks.select(*keys, BLOCK, *(over[kind](c).over(w).alias(c) for c, kind in columns.items()))


def scan(frame: OrderedFrame, columns: Mapping[str, tuple[str, Column]], within: Sequence[str] = ()) -> OrderedFrame:
    """The frame of cut() or lagged() with running values in the order of a group; columns: name to kind and value.

    within: columns that part a group further, as a wave does. A sum is null until there is a value, and goes on over nulls;
    sums of doubles may differ in their last bits from those of one window."""
    for kind, _ in columns.values():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
    outer = [g for g in frame.group if g != BLOCK]
    keys = [*outer, *within]
    i = frame.i
    value = lambda k: columns[k][1]
    at = lambda k: F.when(value(k).isNotNull(), i)
    whole = {
        "sum": lambda k: F.sum(value(k)), "max": lambda k: F.max(value(k)), "min": lambda k: F.min(value(k)),
        "last": lambda k: F.max_by(value(k), at(k)), "before": lambda k: F.max_by(value(k), at(k)), "first": lambda k: F.min_by(value(k), at(k)),
    }
    hands = frame.df.groupBy(*keys, BLOCK).agg(*(whole[kind](k).alias(f"_of_{k}") for k, (kind, _) in columns.items()))
    given = handed(hands, keys, {f"_of_{k}": kind for k, (kind, _) in columns.items()})
    w = Window.partitionBy(*keys, BLOCK).orderBy(*frame.order_by)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = {
        "sum": lambda k: F.sum(value(k)).over(upto), "max": lambda k: F.max(value(k)).over(upto), "min": lambda k: F.min(value(k)).over(upto),
        "last": lambda k: F.last(value(k), True).over(upto), "before": lambda k: F.last(value(k), True).over(before), "first": lambda k: F.first(value(k), True).over(upto),
    }
    made = ranks.joined(frame.df.withColumns({k: own[kind](k) for k, (kind, _) in columns.items()}), given, [*keys, BLOCK], "left")
    put = {
        "sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b),
        "last": lambda a, b: F.coalesce(a, b), "before": lambda a, b: F.coalesce(a, b), "first": lambda a, b: F.coalesce(b, a),
    }
    made = made.withColumns({k: put[kind](F.col(k), F.col(f"_of_{k}")) for k, (kind, _) in columns.items()})
    return OrderedFrame(made.drop(*(f"_of_{k}" for k in columns)), frame.order_by, frame.group, frame.index)


def whole(frame: OrderedFrame) -> OrderedFrame:
    """The frame without its blocks."""
    return OrderedFrame(frame.df.drop(BLOCK), frame.order_by, [g for g in frame.group if g != BLOCK], frame.index)


def running(frame: OrderedFrame, n: int, columns: Mapping[str, tuple[str, Column]]) -> OrderedFrame:
    """The frame, its groups ordered in blocks of n, with running values (see scan)."""
    return whole(scan(cut(frame, n), columns))


def window(frame: OrderedFrame, *keys: str) -> WindowSpec:
    return Window.partitionBy(*frame.group, *keys).orderBy(*frame.order_by)
