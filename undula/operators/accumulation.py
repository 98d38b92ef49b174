"""Accumulations: what a signal gathers over a threshold within each oscillation."""

from __future__ import annotations

from collections.abc import Mapping
from numbers import Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import events, states
from undula.operators import blocks, ranks
from undula.operators.frame import OrderedFrame, names
from undula.operators.objects import Behavior, BehaviorObjects
from undula.sources import scratch

# The columns of the object table.
PROPERTIES = (
    "accumulation_id", "is_complete", "start_index", "end_index", "duration", "baseline", "total_auc", "auc_at_peak", "accumulation_before_peak",
    "accumulation_from_peak", "accumulation_rate", "accumulation_symmetry", "centroid_time", "half_accumulation_time",
)
AGGREGATES = {
    "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
}


class Accumulation(Behavior):
    """Over features of Oscillation.fit_transform(); always of the signal itself, not its smoothed form.

    threshold: the name of a column, of an aggregate over the wave (also first and last), a number, or a mapping of
    signals to these."""

    def __init__(self, signals, order_by, group=None, threshold="min", eps: float = 0.0, index: str = "sample_index"):
        self.signals, self.group, self.order_by = names(signals, "signals", False), names(group, "group"), names(order_by, "order_by", False)
        if eps < 0:
            raise ValueError("eps must be non-negative")
        self.threshold, self.eps, self.index = threshold, eps, index

    def _threshold(self, s: str, frame: OrderedFrame) -> Column:
        t = self.threshold
        if isinstance(t, Mapping):
            if s not in t:
                raise ValueError(f"no threshold for signal {s!r}")
            t = t[s]
        if isinstance(t, str):
            if t in frame.df.columns:
                return F.col(t).cast("double")
            wave = frame.within(f"{s}_wave_id")
            if t in ("first", "last"):
                whole = frame.within(f"{s}_wave_id", ordered=True).rowsBetween(-(1 << 63), (1 << 63) - 1)
                return (F.first if t == "first" else F.last)(s, ignorenulls=True).over(whole)
            if t not in AGGREGATES:
                raise ValueError(f"unknown threshold {t!r}")
            return AGGREGATES[t](F.col(s)).over(wave).cast("double")
        if isinstance(t, Real) and not isinstance(t, bool):
            return F.lit(float(t))
        raise TypeError("threshold must be a name, a number or a mapping")

    def _frame(self, features: DataFrame) -> OrderedFrame:
        for s in self.signals:
            for c in (s, f"{s}_wave_id", f"{s}_peak"):
                if c not in features.columns:
                    raise ValueError(f"missing column {c!r}: transform the oscillation first")
        return OrderedFrame(features, self.order_by, self.group, self.index)

    def _each(self, frame: OrderedFrame, make) -> OrderedFrame:
        return frame.having({k: v for s in self.signals for k, v in make(s).items()})

    def add_signal(self, frame: OrderedFrame) -> OrderedFrame:
        frame = self._each(frame, lambda s: {f"{s}_accumulation_threshold": self._threshold(s, frame)})
        frame = self._each(frame, lambda s: {f"{s}_accumulation_contribution": F.col(s) - F.col(f"{s}_accumulation_threshold")})
        return self._each(frame, lambda s: {f"{s}_accumulation": events.running_sum(F.col(f"{s}_accumulation_contribution"), frame.within(f"{s}_wave_id", ordered=True))})

    def add_primitives(self, frame: OrderedFrame) -> OrderedFrame:
        def make(s: str) -> dict[str, Column]:
            c = F.col(f"{s}_accumulation_contribution")
            return {f"{s}_is_accumulating": states.accumulating(c, self.eps), f"{s}_is_depleting": states.depleting(c, self.eps), f"{s}_accumulation_inactive": states.inactive(c, self.eps)}

        return self._each(frame, make)

    def add_ids(self, frame: OrderedFrame) -> OrderedFrame:
        return self._each(frame, lambda s: {f"{s}_accumulation_id": F.col(f"{s}_wave_id")})

    def add_features(self, frame: OrderedFrame) -> OrderedFrame:
        c = F.col

        def ordered(s: str) -> dict[str, Column]:
            w = frame.within(f"{s}_wave_id", ordered=True)
            seen = F.sum(c(f"{s}_peak").cast("int")).over(events.upto(w))
            return {f"{s}_accumulation_index": (F.row_number().over(w) - 1).cast("long"), f"{s}_source_index": frame.i, f"{s}_before_peak": seen == 0, f"{s}_after_peak": seen > 0}

        def totals(s: str) -> dict[str, Column]:
            x, zero = c(f"{s}_accumulation_contribution"), F.lit(0.0)
            total = F.coalesce(F.sum(x).over(frame.within(f"{s}_wave_id")), zero)
            return {
                f"{s}_accumulation_before_peak": F.when(c(f"{s}_before_peak"), x).otherwise(zero),
                f"{s}_accumulation_from_peak": F.when(c(f"{s}_after_peak"), x).otherwise(zero),
                f"{s}_auc_at_peak": F.when(c(f"{s}_peak"), c(f"{s}_accumulation")).otherwise(zero),
                f"{s}_weighted_accumulation": c(f"{s}_accumulation_index") * x,
                f"{s}_total_auc": total,
                f"{s}_half_auc": total / 2,
            }

        frame = self._each(self._each(frame, ordered), totals)
        frame = self._each(frame, lambda s: {f"{s}_reached_half_auc": F.coalesce(c(f"{s}_accumulation") >= c(f"{s}_half_auc"), F.lit(False))})
        return self._each(frame, lambda s: {f"{s}_half_accumulation_time": F.min(F.when(c(f"{s}_reached_half_auc"), c(f"{s}_accumulation_index"))).over(frame.within(f"{s}_wave_id"))})

    def fit_transform(self, features: DataFrame) -> DataFrame:
        return self.add_features(self.add_ids(self.add_primitives(self.add_signal(self._frame(features))))).df

    def blocked(self, frame: OrderedFrame, block: int) -> DataFrame:
        """As fit_transform(), of the samples of Oscillation.blocked(), for groups and waves too large for one task: sums
        over a wave are aggregates, joined to its samples, and running sums are scans in blocks of samples, whose last
        bits may differ (and so where a sum reaches half of one that is about zero). Also each wave's {signal}_wave_complete. What is read again is stored, when this is called."""
        made, c = self._frame(frame.df), F.col
        df = made.df
        for s in self.signals:
            wave = [*self.group, f"{s}_wave_id"]
            x, thr, sofar = f"{s}_accumulation_contribution", f"{s}_accumulation_threshold", f"{s}_accumulation"
            rows = scratch.stored(df, "samples")
            per = rows.groupBy(*wave).agg(F.max(f"enter_{s}_rising").alias("_started"), F.min(f"{s}_trough_index").alias("_s"), F.max(f"{s}_peak_index").alias("_p"), F.max(f"{s}_trough_index").alias("_e"))
            last = rows.groupBy(*self.group).agg(F.max(f"{s}_wave_id").alias("_last"))
            per = ranks.joined(per, last, self.group)
            complete = c("_started") & (c("_s") < c("_p")) & (c("_p") < c("_e")) & (c(f"{s}_wave_id") < c("_last"))
            per = per.select(*wave, F.coalesce(complete, F.lit(False)).alias(f"{s}_wave_complete"))
            column, per_wave = self._threshold_of_waves(s, rows, wave)
            if per_wave is not None:
                per = ranks.joined(per, per_wave, wave, "left")
            rows = ranks.joined(rows, per, wave, "left")
            rows = rows.withColumn(thr, column).drop("_threshold").withColumn(x, c(s) - c(thr))
            f = blocks.cut(OrderedFrame(rows, self.order_by, self.group, self.index), block)
            f = blocks.scan(f, {"_sum": ("sum", c(x)), "_at": ("sum", F.lit(1).cast("long")), "_seen": ("sum", c(f"{s}_peak").cast("int"))}, [f"{s}_wave_id"])
            f = self.add_ids(self.add_primitives(blocks.whole(f)))
            df = f.df.withColumns({sofar: F.when(c(x).isNotNull(), c("_sum")), f"{s}_accumulation_index": c("_at") - 1, f"{s}_source_index": f.i, f"{s}_before_peak": c("_seen") == 0, f"{s}_after_peak": c("_seen") > 0}).drop("_sum", "_at", "_seen")
            rows = scratch.stored(df, "accumulated")
            total = rows.groupBy(*wave).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{s}_total_auc"))
            rows, zero = ranks.joined(rows, total, wave, "left"), F.lit(0.0)
            rows = rows.withColumns(
                {
                    f"{s}_accumulation_before_peak": F.when(c(f"{s}_before_peak"), c(x)).otherwise(zero),
                    f"{s}_accumulation_from_peak": F.when(c(f"{s}_after_peak"), c(x)).otherwise(zero),
                    f"{s}_auc_at_peak": F.when(c(f"{s}_peak"), c(sofar)).otherwise(zero),
                    f"{s}_weighted_accumulation": c(f"{s}_accumulation_index") * c(x),
                    f"{s}_half_auc": c(f"{s}_total_auc") / 2,
                    f"{s}_reached_half_auc": F.coalesce(c(sofar) >= c(f"{s}_total_auc") / 2, F.lit(False)),
                }
            )
            half = rows.where(f"{s}_reached_half_auc").groupBy(*wave).agg(F.min(f"{s}_accumulation_index").alias(f"{s}_half_accumulation_time"))
            df = ranks.joined(rows, half, wave, "left")
        return df

    def _threshold_of_waves(self, s: str, rows: DataFrame, wave: list[str]) -> tuple[Column, DataFrame | None]:
        """A sample's threshold, and the table of waves that it needs (with _threshold), if any."""
        t = self.threshold
        t = t[s] if isinstance(t, Mapping) and s in t else t
        if not isinstance(t, str) or t in rows.columns:
            return self._threshold(s, OrderedFrame(rows, self.order_by, self.group, self.index)), None
        at = F.when(F.col(s).isNotNull(), F.col(self.index))
        if t == "median":
            return F.col("_threshold"), ranks.medians(rows, s, wave, "_threshold").drop("n")
        if t not in AGGREGATES and t not in ("first", "last"):
            raise ValueError(f"unknown threshold {t!r}")
        made = F.min_by(s, at) if t == "first" else F.max_by(s, at) if t == "last" else AGGREGATES[t](F.col(s)).cast("double")
        return F.col("_threshold"), rows.groupBy(*wave).agg(made.alias("_threshold"))

    def summarize(self, features: DataFrame, signal: str | None = None, include_partial: bool = False, parent_column: bool = False) -> BehaviorObjects:
        """The object table from fit_transform()'s result. parent_column: also parent_oscillation_id."""
        s = signal or self.signals[0]
        self._configured(s)
        frame, g, c = self._frame(features), self.group, F.col
        i = self.index
        table = frame.keyed().groupBy(*g, c(f"{s}_accumulation_id").alias("accumulation_id")).agg(
            F.bool_or(f"{s}_wave_complete").alias("is_complete"),
            F.min(i).alias("start_index"),
            F.max(i).alias("end_index"),
            F.count("*").alias("duration"),
            F.min_by(f"{s}_accumulation_threshold", F.when(c(f"{s}_accumulation_threshold").isNotNull(), c(i))).alias("baseline"),
            F.coalesce(F.sum(f"{s}_accumulation_contribution"), F.lit(0.0)).alias("total_auc"),
            F.max(f"{s}_auc_at_peak").alias("auc_at_peak"),
            F.coalesce(F.sum(f"{s}_accumulation_before_peak"), F.lit(0.0)).alias("accumulation_before_peak"),
            F.coalesce(F.sum(f"{s}_accumulation_from_peak"), F.lit(0.0)).alias("accumulation_from_peak"),
            F.coalesce(F.sum(f"{s}_weighted_accumulation"), F.lit(0.0)).alias("first_moment"),
            F.max(f"{s}_half_accumulation_time").alias("half_accumulation_time"),
        )
        if not include_partial:
            table = table.where("is_complete")
        both = c("accumulation_before_peak") + c("accumulation_from_peak")
        table = table.withColumns(
            {
                "accumulation_rate": F.when(c("duration") > 0, c("total_auc") / c("duration")),
                "accumulation_symmetry": F.when(both > 0, 1 - F.abs(c("accumulation_before_peak") - c("accumulation_from_peak")) / both),
                "centroid_time": F.when(c("total_auc") != 0, c("first_moment") / c("total_auc")),
            }
        )
        parent = [c("accumulation_id").alias("parent_oscillation_id")] if parent_column else []
        construction = {"threshold": self.threshold, "eps": self.eps}
        return BehaviorObjects("accumulation", s, table.select(*g, *PROPERTIES, *parent), features, tuple(g), PROPERTIES, construction, "oscillation", "parent_oscillation_id")
