"""Oscillations: a rise and the fall after it, from trough over peak to trough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import events, states
from undula.operators.frame import OrderedFrame, names
from undula.operators.objects import Behavior, BehaviorObjects

# The columns of the object table.
PROPERTIES = (
    "oscillation_id", "is_complete", "start_index", "peak_index", "end_index", "rise_duration", "fall_duration", "duration", "period",
    "amplitude", "rising_mean_rate", "falling_mean_rate", "peak_rise_rate", "peak_fall_rate", "temporal_symmetry",
)


class Oscillation(Behavior):
    def __init__(self, signals, order_by, group=None, smooth_signal: bool = False, smooth_window: int = 20, diff_lag: int = 10, eps: float = 0.0, index: str | None = None, block: int | None = None):
        """block: samples of a group that one task orders at most, for groups too large for one; needs an index that
        numbers a group's samples without gaps."""
        self.signals = names(signals, "signals", False)
        self.group, self.order_by, self.index = names(group, "group"), names(order_by, "order_by", False), index
        if smooth_window < 1:
            raise ValueError("smooth_window must be at least 1")
        if diff_lag < 1:
            raise ValueError("diff_lag must be at least 1")
        if eps < 0:
            raise ValueError("eps must be non-negative")
        self.reach = diff_lag + (smooth_window if smooth_signal else 1) + 1  # samples back that an event hangs on
        if block is not None and (index is None or block <= self.reach):
            raise ValueError(f"block needs an index, and more than {self.reach} samples")
        self.block = block
        self.smooth_signal, self.smooth_window, self.diff_lag, self.eps = smooth_signal, smooth_window, diff_lag, eps

    def source(self, s: str) -> Column:
        return F.col(f"{s}_smooth" if self.smooth_signal else s)

    def frame(self, df: DataFrame) -> OrderedFrame:
        return OrderedFrame.of(df, self.order_by, self.group, self.index, self.signals)

    def _each(self, frame: OrderedFrame, make) -> OrderedFrame:
        return frame.having({k: v for s in self.signals for k, v in make(s).items()})

    def add_signal(self, frame: OrderedFrame) -> OrderedFrame:
        if not self.smooth_signal:
            return frame
        return self._each(frame, lambda s: {f"{s}_smooth": events.smooth(F.col(s), self.smooth_window, frame.w)})

    def add_primitives(self, frame: OrderedFrame) -> OrderedFrame:
        w, c = frame.w, F.col
        frame = self._each(frame, lambda s: {f"{s}_rate": states.difference(self.source(s), self.diff_lag, w)})
        frame = self._each(frame, lambda s: {f"{s}_rising": states.positive(c(f"{s}_rate"), self.eps), f"{s}_falling": states.negative(c(f"{s}_rate"), self.eps), f"{s}_rate": c(f"{s}_rate") / F.lit(float(self.diff_lag))})
        frame = self._each(frame, lambda s: {f"enter_{s}_rising": events.enter(c(f"{s}_rising"), w), f"exit_{s}_rising": events.exit(c(f"{s}_rising"), w)})
        frame = self._each(frame, lambda s: {f"{s}_peak": events.preceding(c(f"exit_{s}_rising"), w), f"{s}_trough": events.preceding(c(f"enter_{s}_rising"), w)})
        return self._each(frame, lambda s: {f"{s}_{x}_index": events.landmark(c(f"{s}_{x}"), frame.i, w) for x in ("peak", "trough")})

    def add_ids(self, frame: OrderedFrame) -> OrderedFrame:
        return self._each(frame, lambda s: {f"{s}_wave_id": events.number(F.col(f"enter_{s}_rising"), frame.w)})

    def add_features(self, frame: OrderedFrame) -> OrderedFrame:
        c = F.col
        last = Window.partitionBy(*self.group)

        def sums(s: str) -> dict[str, Column]:
            wave = frame.within(f"{s}_wave_id")
            top, low = F.max(self.source(s)).over(wave), F.min(self.source(s)).over(wave)
            rise, fall = F.max(f"{s}_rate").over(wave), F.min(f"{s}_rate").over(wave)
            start, peak, end = F.min(f"{s}_trough_index").over(wave), F.max(f"{s}_peak_index").over(wave), F.max(f"{s}_trough_index").over(wave)
            whole = F.max(f"enter_{s}_rising").over(wave) & (start < peak) & (peak < end) & (c(f"{s}_wave_id") < F.max(f"{s}_wave_id").over(last))
            return {
                f"{s}_rising_time": F.sum(c(f"{s}_rising").cast("long")).over(wave),
                f"{s}_falling_time": F.sum(c(f"{s}_falling").cast("long")).over(wave),
                f"{s}_amplitude": (top - low) / 2,
                f"{s}_peak_rise_rate": states.clipped(rise, 0.0),
                f"{s}_peak_fall_rate": states.clipped(-fall, 0.0),
                f"{s}_wave_complete": F.coalesce(whole, F.lit(False)),
            }

        frame = self._each(frame, sums)
        return self._each(
            frame,
            lambda s: {f"{s}_duration": c(f"{s}_rising_time") + c(f"{s}_falling_time")}
            | {f"{s}_{x}_mean_rate": F.when(c(f"{s}_{x}_time") > 0, 2 * c(f"{s}_amplitude") / c(f"{s}_{x}_time")) for x in ("rising", "falling")},
        )

    def primitives(self, df: DataFrame) -> OrderedFrame:
        return self.add_ids(self.add_primitives(self.add_signal(self.frame(df))))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """df with every derived column, sample by sample."""
        return self.add_features(self.primitives(df)).df

    def objects(self, df: DataFrame, signal: str | None = None, include_partial: bool = False) -> BehaviorObjects:
        """The object table straight from df: one exchange by group, no sample-level statistics."""
        signal = signal or self.signals[0]
        self._configured(signal)
        return self._summary(self.blocked(df) if self.block else self.primitives(df), signal, include_partial)

    def blocked(self, df: DataFrame) -> OrderedFrame:
        """As primitives(), with blocks of a group's samples apart: each has along the samples before it that its events
        hang on, and one after it. Numbers and landmarks are finished from a row per block."""
        whole, c = self.frame(df), F.col
        n, i = self.block, F.col(self.index)
        own = F.floor(i / F.lit(n))
        copies = F.array(own, F.when(i % n >= n - self.reach, own + 1), F.when(i % n == 0, own - 1))
        spread = whole.df.withColumn("_block", F.explode(F.array_compact(copies)))
        by_block = OrderedFrame(spread, whole.order_by, [*whole.group, "_block"], whole.index)
        made = self.add_primitives(self.add_signal(by_block)).df.where(c("_block") == own)
        made = self.add_ids(OrderedFrame(made, whole.order_by, by_block.group, whole.index)).df
        aggregates = [F.max(f"{s}_wave_id").alias(f"_n_{s}") for s in self.signals]
        aggregates += [F.max(F.when(c(f"{s}_{x}"), i)).alias(f"_{x}_{s}") for s in self.signals for x in ("peak", "trough")]
        before = Window.partitionBy(*whole.group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = made.groupBy(*by_block.group).agg(*aggregates)
        blocks = blocks.select(*by_block.group, *(F.coalesce(F.sum(f"_n_{s}").over(before), F.lit(0)).alias(f"_n_{s}") for s in self.signals), *(F.max(f"_{x}_{s}").over(before).alias(f"_{x}_{s}") for s in self.signals for x in ("peak", "trough")))
        blocks = blocks.withColumnsRenamed({k: f"_of_{k}" for k in by_block.group})
        same = [c(k).eqNullSafe(c(f"_of_{k}")) for k in by_block.group]
        both = made.join(blocks, same).drop(*(f"_of_{k}" for k in by_block.group))
        w = Window.partitionBy(*by_block.group).orderBy(*whole.order_by)
        columns = {f"{s}_wave_id": c(f"{s}_wave_id") + c(f"_n_{s}") for s in self.signals}
        columns |= {f"{s}_{x}_index": F.coalesce(events.landmark(c(f"{s}_{x}"), i, w), c(f"_{x}_{s}")) for s in self.signals for x in ("peak", "trough")}
        return OrderedFrame(both.withColumns(columns), whole.order_by, whole.group, whole.index)

    def summarize(self, features: DataFrame, signal: str | None = None, include_partial: bool = False) -> BehaviorObjects:
        """The object table from fit_transform()'s result."""
        signal = signal or self.signals[0]
        self._configured(signal)
        return self._summary(OrderedFrame(features, self.order_by, self.group, self.index or "sample_index"), signal, include_partial)

    def _summary(self, frame: OrderedFrame, s: str, include_partial: bool) -> BehaviorObjects:
        g, c = self.group, F.col
        waves = frame.keyed().groupBy(*g, c(f"{s}_wave_id").alias("oscillation_id")).agg(
            F.max(f"enter_{s}_rising").alias("started"),
            F.min(f"{s}_trough_index").alias("start_index"),
            F.max(f"{s}_peak_index").alias("peak_index"),
            F.max(f"{s}_trough_index").alias("end_index"),
            (F.max(self.source(s)) - F.min(self.source(s))).alias("net"),
            F.max(f"{s}_rate").alias("rise"),
            F.min(f"{s}_rate").alias("fall"),
        )
        whole = c("started") & (c("start_index") < c("peak_index")) & (c("peak_index") < c("end_index")) & (c("oscillation_id") < F.max("oscillation_id").over(Window.partitionBy(*g)))
        waves = waves.withColumn("is_complete", F.coalesce(whole, F.lit(False)))
        if not include_partial:
            waves = waves.where("is_complete")
        rise, fall, length = c("peak_index") - c("start_index"), c("end_index") - c("peak_index"), c("end_index") - c("start_index")
        made = waves.withColumns({"rise_duration": rise, "fall_duration": fall, "duration": length})
        before = F.lag("peak_index").over(Window.partitionBy(*g).orderBy("oscillation_id"))
        made = made.withColumns(
            {
                "period": c("peak_index") - before,
                "amplitude": c("net") / 2,
                "rising_mean_rate": F.when(c("rise_duration") > 0, c("net") / c("rise_duration")),
                "falling_mean_rate": F.when(c("fall_duration") > 0, c("net") / c("fall_duration")),
                "peak_rise_rate": states.clipped(c("rise"), 0.0),
                "peak_fall_rate": states.clipped(-c("fall"), 0.0),
                "temporal_symmetry": F.when(c("duration") > 0, 1 - F.abs(c("rise_duration") - c("fall_duration")) / c("duration")),
            }
        )
        construction = {"smooth_signal": self.smooth_signal, "smooth_window": self.smooth_window, "diff_lag": self.diff_lag, "eps": self.eps, "include_partial": include_partial}
        return BehaviorObjects("oscillation", s, made.select(*g, *PROPERTIES), frame.df, tuple(g), PROPERTIES, construction)
