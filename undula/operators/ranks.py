"""Order statistics and running counts of groups too large for one task.

quantiles(): radix selection. A double's bits, put in order, are four digits of 16 bits. Each pass counts the next digit of
the values whose digits so far are those of a wanted rank, so a task holds counts (65,536 a group at most), never a group's
values. running(): rows are cut into ranges of (keys, value); each range adds up what it has, a window over ranges says what
lies before each, and a window within each range does the rest.

Both store what they read again in scratch tables when they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.sources import scratch

_DIGITS, _LOW = 4, (1 << 16) - 1
_FLIP = (1 << 63) - 1


def _flipped(bits: Column) -> Column:
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_FLIP)))


def with_bits(df: DataFrame, x: Column, name: str) -> DataFrame:
    """df and a whole number for each double, in the same order; 0.0 and -0.0 are one. Null for null."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("long")
    return df.withColumn(name, F.when(x.isNotNull(), bits)).withColumn(name, _flipped(F.col(name)))


def with_double(df: DataFrame, bits: str, name: str) -> DataFrame:
    """The inverse of with_bits()."""
    return df.withColumn(name, F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _flipped(F.col(bits))).cast("double"))


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; right's keys go."""
    if not on:
        return left.join(right, how=how)  # a table without keys has one row
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in on})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on))
    both = left.join(right, same, how)
    return both if how in ("left_semi", "left_anti") else both.drop(*(f"_of_{k}" for k in on))


def quantiles(df: DataFrame, value: str, keys: Sequence[str], probabilities: Sequence[float], name: str = "quantiles") -> DataFrame:
    """keys, n and an array of exact quantiles, between two values by linear interpolation, as F.percentile gives them.

    Nulls and NaN aren't counted; a group of nothing else has n 0 and null. Null keys are a group. Ties and repeated rows
    each count. An empty table gives no groups."""
    keys = list(keys)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = scratch.stored(with_bits(df.select(*keys, x.alias("_x")), F.col("_x"), "_u").drop("_x"), "bits")
    sizes = scratch.stored(rows.groupBy(*keys).agg(F.count("_u").alias("n")), "sizes")
    wanted = sizes.where("n > 0").select("*", F.posexplode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("_j", "_p"))
    at = F.col("_p") * (F.col("n") - 1)
    ends = F.array(F.struct(F.floor(at).alias("rank"), (F.ceil(at) - at).alias("part")), F.struct(F.ceil(at).alias("rank"), (at - F.floor(at)).alias("part")))
    state = wanted.select(*keys, "_j", F.posexplode(ends).alias("_end", "_e")).select(*keys, "_j", "_end", F.col("_e.part").alias("_part"), F.col("_e.rank").alias("_rank"), F.lit(0).cast("long").alias("_prefix"))
    for k in range(_DIGITS):
        state = scratch.stored(state, "ranks")
        shift = 16 * (_DIGITS - 1 - k)
        of = rows.where("_u IS NOT NULL").withColumn("_prefix", F.lit(0).cast("long") if k == 0 else F.shiftright("_u", shift + 16))
        if k:
            of = joined(of, state.select(*keys, "_prefix").distinct(), [*keys, "_prefix"], "left_semi")
        digit = F.shiftright("_u", shift)
        counted = of.groupBy(*keys, "_prefix", digit.alias("_next")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*keys, "_prefix").orderBy("_next")  # 65,536 rows at most
        counted = counted.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
        both = joined(state, counted, [*keys, "_prefix"]).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        state = both.select(*keys, "_j", "_end", "_part", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_next").alias("_prefix"))
    state, v = with_double(state, "_prefix", "_v"), F.col("_v")
    low, high = F.max(F.when(F.col("_end") == 0, v)), F.max(F.when(F.col("_end") == 1, v))
    part = lambda e: F.max(F.when(F.col("_end") == e, F.col("_part")))
    each = state.groupBy(*keys, "_j").agg(F.when(low == high, low).otherwise(part(0) * low + part(1) * high).alias("_q"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", "_q"))).alias("_l")).withColumn(name, F.col("_l._q")).drop("_l")
    return joined(sizes, listed, keys, "left")


def medians(df: DataFrame, value: str, keys: Sequence[str], name: str = "median") -> DataFrame:
    """keys, n and the exact median."""
    return quantiles(df, value, keys, [0.5], "_q").select(*keys, "n", F.col("_q")[0].alias(name))


def ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_range", parts: int | None = None) -> DataFrame:
    """rows, stored, with the number of the range of (keys, order) that each is in; ranges are of about equal size, so those
    of a large group are several, in its order. parts: how many; by default as many as the session shuffles to, less those
    that adaptive execution finds too small to stand alone."""
    return scratch.stored(rows.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """rows, each of its own (keys, order), and the sum so far, with its own, of each of sums in the order of a group."""
    keys, cut = list(keys), ranges(rows, keys, [order], parts=parts)
    totals = cut.groupBy(*keys, "_range").agg(*(F.sum(v).alias(f"_all_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    made = cut.withColumns({k: F.sum(v).over(own) for k, v in sums.items()})
    made = joined(made, totals, [*keys, "_range"])
    return made.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_range", *(f"_before_{k}" for k in sums))
