"""Values per group, carried to its rows or to those of a neighbouring group, and named operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.operators import blocks, ranks
from undula.operators.frame import names

OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}


def _operation(op: str) -> Callable[[Column], Column]:
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}")
    return OPERATIONS[op]


def group_transform(df: DataFrame, signal: str, op: str, group, name: str, large: bool = False) -> DataFrame:
    """df and the group's value at every row. large: groups are too large for one task, so their values are aggregated (a
    median by radix selection, see ranks) and joined to the rows, which stay where they are if there are few groups."""
    if large:
        keys = names(group, "group", False)
        if op == "median":
            per = ranks.medians(df, signal, keys, name).select(*keys, name)
        else:
            per = df.groupBy(*keys).agg(_operation(op)(F.col(signal)).alias(name))
        return ranks.joined(df, per, keys, "left")
    return df.withColumn(name, _operation(op)(F.col(signal)).over(Window.partitionBy(*names(group, "group", False))))


def group_map(df: DataFrame, signal: str, op: str, group: str, name: str, offset: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """df and the value of the group `offset` before (after, where negative) in the order of group keys.

    within: outer keys whose groups are apart, and the way to keep the ordered pass from being one task's."""
    keys = [*within, group]
    per = df.groupBy(*keys).agg(_operation(op)(F.col(signal)).alias(name))
    w = Window.partitionBy(*within).orderBy(group)
    value = F.lag(name, offset).over(w) if offset > 0 else F.lead(name, -offset).over(w) if offset < 0 else F.col(name)
    return df.join(per.withColumn(name, value), keys, "left").select(*df.columns, name)


def listed(df: DataFrame, keys: Sequence[str], value: str, most: int = 1000) -> DataFrame:
    """keys, part, values and n: the distinct values of each group, in order, in lists of at most `most`, so that no row
    grows with its group. A group's lists one after another, by part from 0, are its values. Nulls aren't listed."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    placed = blocks.numbered(rows, [value], list(keys), "_at").withColumn("part", F.floor(F.col("_at") / F.lit(most)))
    return placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(value)).alias("values"), F.count("*").alias("n"))


@dataclass(frozen=True)
class OperatorRecord:
    """A named builder of columns; apply() checks that it keeps the number of rows where it says so."""

    name: str
    function: Callable[..., DataFrame]
    input_kind: str
    output_kind: str
    preserves_shape: bool = True

    def apply(self, df: DataFrame, *args, check: bool = True, **options) -> DataFrame:
        out = self.function(df, *args, **options)
        if check and self.preserves_shape and out.count() != df.count():
            raise ValueError(f"operator {self.name!r} changed the number of rows")
        return out


REGISTRY: dict[str, OperatorRecord] = {}


def register(record: OperatorRecord) -> OperatorRecord:
    if record.name in REGISTRY:
        raise ValueError(f"operator {record.name!r} is registered")
    REGISTRY[record.name] = record
    return record
