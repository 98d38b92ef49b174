"""An ordered table: groups of samples, their order and their index."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from undula.functions import states

log = logging.getLogger(__name__)


def names(value: str | Sequence[str] | None, what: str, empty: bool = True) -> list[str]:
    out = [] if value is None else [value] if isinstance(value, str) else list(value)
    if not out and not empty:
        raise ValueError(f"{what} must not be empty")
    return out


@dataclass(frozen=True)
class OrderedFrame:
    """df ordered by order_by in each group. index: a column that numbers samples; by default their place, from 0.

    A group is one task's work, as is a table without groups; what needs no order (objects, their statistics) is
    distributed again after its windows."""

    df: DataFrame
    order_by: list[str]
    group: list[str] = field(default_factory=list)
    index: str = "sample_index"

    @staticmethod
    def of(df: DataFrame, order_by, group=None, index: str | None = None, signals: Sequence[str] = ()) -> OrderedFrame:
        order, keys = names(order_by, "order_by", False), names(group, "group")
        for c in (*order, *keys, *signals, *([index] if index else [])):
            if c not in df.columns:
                raise ValueError(f"missing column {c!r}")
        if not keys:
            log.warning("no group: all samples are ordered in one task")
        df = df.withColumns({s: states.clean(F.col(s)) for s in signals}) if signals else df
        frame = OrderedFrame(df, order, keys, index or "sample_index")
        if index is None and "sample_index" not in df.columns:
            frame = frame.having({"sample_index": (F.row_number().over(frame.w) - 1).cast("long")})
        return frame

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order_by)

    def within(self, *keys: str, ordered: bool = False) -> WindowSpec:
        w = Window.partitionBy(*self.group, *keys)
        return w.orderBy(*self.order_by) if ordered else w

    def having(self, columns: dict[str, Column]) -> OrderedFrame:
        return OrderedFrame(self.df.withColumns(columns), self.order_by, self.group, self.index)

    @property
    def i(self) -> Column:
        return F.col(self.index)

    def keyed(self) -> DataFrame:
        """df without samples of a null group key, which form no object."""
        df = self.df
        for k in self.group:
            df = df.where(F.col(k).isNotNull())
        return df
