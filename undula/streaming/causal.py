"""Causal features: twelve values of each sample from the samples before it, in batch and as a stream.

A direction is the sign of the last step beyond eps that there was. Where it turns, the sample before is an extremum: a
phase ends there and the next begins. Three extrema on end make a cycle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import events, states
from undula.operators import blocks, ranks
from undula.operators.frame import OrderedFrame, names
from undula.sources import scratch

#: Fixed names, in their order.
FEATURES = (
    "direction", "reversal", "phase_elapsed", "displacement_from_extremum", "running_amplitude", "running_signed_area", "previous_phase_amplitude",
    "previous_phase_duration", "completed_phases", "previous_cycle_amplitude", "previous_cycle_duration", "completed_cycles",
)


class Encoder:
    """The features of one sequence, sample by sample; its state is a tuple of numbers."""

    START = (0, None, 0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, None, None, None)

    def __init__(self, eps: float = 0.0, state: tuple | None = None):
        if eps < 0:
            raise ValueError("eps must be non-negative")
        self.eps, self.state = eps, state or self.START

    def reset(self) -> None:
        self.state = self.START

    def update(self, x: float) -> tuple[float, ...]:
        if not math.isfinite(x):
            raise ValueError("samples must be finite")
        t, last, direction, begin, begin_value, area, phases, phase_time, phase_size, cycle_time, cycle_size, e1, e2, e3 = self.state
        reversal = 0
        if last is None:
            begin_value = x
        else:
            step = x - last
            turn = 1 if step > self.eps else -1 if step < -self.eps else 0
            if turn and direction and turn != direction:
                reversal, phases = 1, phases + 1
                phase_time, phase_size = float(t - 1 - begin), abs(last - begin_value)
                e1, e2, e3 = e2, e3, (t - 1, last)
                if e1 is not None:
                    cycle_time, cycle_size = float(e3[0] - e1[0]), abs(e2[1] - e1[1])
                begin, begin_value, area = t - 1, last, 0.0
            direction = turn or direction
            area += x - begin_value
        self.state = (t + 1, x, direction, begin, begin_value, area, phases, phase_time, phase_size, cycle_time, cycle_size, e1, e2, e3)
        moved = x - begin_value
        return (float(direction), float(reversal), float(t - begin), moved, abs(moved), area, phase_size, phase_time, float(phases), cycle_size, cycle_time, float(max(phases - 2, 0)))


def causal_features(df: DataFrame, signal: str, order_by, group=None, eps: float = 0.0, block: int | None = None) -> DataFrame:
    """df (with sample_index) and the twelve features as floats, by windows alone. Samples must not be null.

    block: a group's samples are ordered in blocks of so many, for groups too large for one task (see in_blocks)."""
    if block is not None:
        return in_blocks(df, signal, order_by, group, eps, block)
    f = OrderedFrame.of(df, order_by, group, None, [signal])
    w, c, x, t = f.w, F.col, F.col(signal), f.i
    step = x - F.lag(x).over(w)
    f = f.having({"_turn": F.when(step > eps, 1).when(step < -eps, -1).otherwise(0), "_last": F.lag(x).over(w)})
    f = f.having({"_dir": F.coalesce(events.carried(F.nullif(c("_turn"), F.lit(0)), w), F.lit(0))})
    f = f.having({"_before": F.coalesce(F.lag("_dir").over(w), F.lit(0))})
    f = f.having({"_rev": (c("_turn") != 0) & (c("_before") != 0) & (c("_turn") != c("_before"))})
    f = f.having(
        {
            "_phase": events.number(c("_rev"), w),
            "_begin": F.coalesce(events.carried(F.when(c("_rev"), t - 1), w), F.lit(0).cast("long")),
            "_value": F.coalesce(events.carried(F.when(c("_rev"), c("_last")), w), F.first(x).over(events.upto(w))),
        }
    )
    f = f.having({"_moved": x - c("_value"), "_b0": F.lag("_begin").over(w), "_v0": F.lag("_value").over(w)})
    f = f.having({"_area": F.sum("_moved").over(events.upto(f.within("_phase", ordered=True))), "_pd": F.when(c("_rev"), t - 1 - c("_b0")), "_pa": F.when(c("_rev"), F.abs(c("_last") - c("_v0")))})
    # extrema two and one before, among reversals alone: rows of equal _rev are a window of their own
    turns = Window.partitionBy(*f.group, "_rev").orderBy(*f.order_by)
    f = f.having({"_s2": F.lag(t - 1, 2).over(turns), "_x1": F.lag("_last", 1).over(turns), "_x2": F.lag("_last", 2).over(turns)})
    cycle = c("_rev") & (c("_phase") > 2)
    f = f.having({"_cd": F.when(cycle, t - 1 - c("_s2")), "_ca": F.when(cycle, F.abs(c("_x1") - c("_x2")))})
    carried = lambda name: F.coalesce(events.carried(c(name), w), F.lit(0))
    made: dict[str, Column] = dict(
        zip(
            FEATURES,
            (c("_dir"), c("_rev").cast("int"), t - c("_begin"), c("_moved"), F.abs("_moved"), c("_area"), carried("_pa"), carried("_pd"), c("_phase"), carried("_ca"), carried("_cd"), F.greatest(c("_phase") - 2, F.lit(0))),
            strict=True,
        )
    )
    kept = [F.col(f"`{k}`") for k in f.df.columns if not k.startswith("_") and k not in FEATURES]
    return f.df.select(*kept, *(v.cast("float").alias(k) for k, v in made.items()))


def in_blocks(df: DataFrame, signal: str, order_by, group, eps: float, block: int) -> DataFrame:
    """causal_features() with a group's samples in blocks. What a block hands on: its last direction; its number of
    reversals and its last three extrema; the area of the phase that is open at its end. Samples are numbered by ranges, and
    what is read again is stored, when this is called."""
    order, keys, c, x = names(order_by, "order_by", False), names(group, "group"), F.col, F.col(signal)
    for name in (*order, *keys, signal):
        if name not in df.columns:
            raise ValueError(f"missing column {name!r}")
    df = df.withColumns({signal: states.clean(x)})
    base = df if "sample_index" in df.columns else blocks.numbered(df, order, keys)
    f = blocks.lagged(OrderedFrame(base, order, keys), block, {"_last": x})
    t, step = f.i, x - c("_last")
    f = f.having({"_turn": F.nullif(F.when(step > eps, 1).when(step < -eps, -1).otherwise(0), F.lit(0))})
    f = _kept(blocks.scan(f, {"_dir": ("last", c("_turn")), "_before": ("before", c("_turn")), "_x0": ("first", x)}), "turns")

    rev = F.coalesce(c("_turn") != c("_before"), F.lit(False))
    f = f.having({"_rev": rev, "_here": F.when(rev, F.struct((t - 1).alias("t"), c("_last").alias("v")))})
    f = blocks.scan(f, {"_phase": ("sum", c("_rev").cast("long"))})
    # extrema that each block is handed: a block's last three are rows, each brings along the two before it
    turns = Window.partitionBy(*f.group, "_rev").orderBy(*order)
    late = f.having({"_end": F.row_number().over(Window.partitionBy(*f.group, "_rev").orderBy(t.desc()))}).df.where(c("_rev") & (c("_end") <= 3))
    of_group = Window.partitionBy(*keys).orderBy("_here.t")
    late = late.select(*f.group, "_end", F.array("_here", F.lag("_here", 1).over(of_group), F.lag("_here", 2).over(of_group)).alias("_state"))
    every = f.df.select(*f.group).distinct()  # blocks without a reversal are handed what was before them
    hands = ranks.joined(every, late.where("_end = 1").drop("_end"), f.group, "left")
    given = blocks.handed(hands, keys, {"_state": "last"})
    n = F.count_if(c("_rev")).over(events.upto(f.w))  # reversals of this block so far
    at = lambda k: c("_state")[k]
    f = f.having({"_n": n, "_p1": F.lag("_here", 1).over(turns), "_p2": F.lag("_here", 2).over(turns)})
    f = OrderedFrame(ranks.joined(f.df, given, f.group, "left"), f.order_by, f.group, f.index)
    second = F.when(c("_n") >= 2, c("_p1")).otherwise(at(0))
    third = F.when(c("_n") >= 3, c("_p2")).when(c("_n") == 2, at(0)).otherwise(at(1))
    f = f.having({"_now": F.when(c("_rev"), F.array("_here", second, third))})
    f = f.having({"_now": F.coalesce(F.last("_now", True).over(events.upto(f.w)), c("_state"))})
    f = f.having({"_moved": x - F.coalesce(c("_now")[0]["v"], c("_x0"))})
    f = _kept(f, "phases")

    # the area of the phase that a block ends in, with what earlier blocks had of it
    area = f.df.groupBy(*f.group, "_phase").agg(F.sum("_moved").alias("_area"))
    area = area.groupBy(*f.group).agg(F.max("_phase").alias("_phase"), F.max_by("_area", "_phase").alias("_area"))
    opened = F.sum("_area").over(Window.partitionBy(*keys, "_phase").orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, 0))
    given = blocks.handed(area.withColumn("_open", F.struct(opened.alias("area"), c("_phase").alias("phase"))), keys, {"_open": "last"})
    f = OrderedFrame(ranks.joined(f.df, given, f.group, "left"), f.order_by, f.group, f.index)
    own = F.sum("_moved").over(events.upto(blocks.window(f, "_phase")))
    e1, e2, e3 = (c("_now")[k] for k in range(3))
    zero, phase = F.lit(0), c("_phase")
    made = (
        F.coalesce("_dir", zero), c("_rev").cast("int"), t - F.coalesce(e1["t"], zero), c("_moved"), F.abs("_moved"),
        own + F.when(c("_open.phase") == phase, c("_open.area")).otherwise(0.0),
        F.when(phase > 0, F.abs(e1["v"] - F.coalesce(e2["v"], c("_x0")))).otherwise(0.0), F.when(phase > 0, e1["t"] - F.coalesce(e2["t"], zero)).otherwise(0), phase,
        F.when(phase > 2, F.abs(e2["v"] - e3["v"])).otherwise(0.0), F.when(phase > 2, e1["t"] - e3["t"]).otherwise(0), F.greatest(phase - 2, zero),
    )
    kept = [c(f"`{k}`") for k in f.df.columns if not k.startswith("_") and k not in FEATURES]
    return f.df.select(*kept, *(v.cast("float").alias(k) for k, v in zip(FEATURES, made, strict=True)))


def _kept(frame: OrderedFrame, name: str) -> OrderedFrame:
    return OrderedFrame(scratch.stored(frame.df, name), frame.order_by, frame.group, frame.index)


def history(df: DataFrame, signal: str, order_by, group=None, name: str = "previous") -> DataFrame:
    """df and the sample before; a sequence's first sample is its own."""
    f = OrderedFrame.of(df, order_by, group, None, [signal])
    return f.having({name: F.coalesce(F.lag(signal).over(f.w), F.col(signal))}).df


def represent(df: DataFrame, signal: str, order_by, group=None, kind: str = "augmented", eps: float = 0.0) -> DataFrame:
    """A representation of each sample: raw, raw_history, features, or augmented (features and history)."""
    if kind == "raw":
        return df
    if kind == "raw_history":
        return history(df, signal, order_by, group)
    if kind not in ("features", "augmented"):
        raise ValueError(f"unknown representation {kind!r}")
    made = causal_features(df, signal, order_by, group, eps)
    return made if kind == "features" else history(made, signal, order_by, group)


def scaled(df: DataFrame, scales: dict[str, float], bound: float = 10.0) -> DataFrame:
    """Columns over fixed scales, clipped at the bound."""
    return df.withColumns({k: states.clipped(F.col(k) / F.lit(v), -bound, bound) for k, v in scales.items()})


def stream_features(stream: DataFrame, key: str, order: str, signal: str, eps: float = 0.0) -> DataFrame:
    """The features of a stream of (key string, order long, signal double), state by key, in append mode.

    Samples of a key must come in order; those of one trigger are sorted. Rows: key, order, features."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [key, order, *FEATURES]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            got = state.get
            pair = lambda i: None if got[i] is None else (int(got[i]), got[i + 1])
            held = (int(got[0]), got[1], int(got[2]), int(got[3]), got[4], got[5], int(got[6]), *got[7:11], pair(11), pair(13), pair(15))
        encoder = Encoder(eps, held)
        rows = pd.concat(list(frames)).sort_values(order)
        made = [(k[0], int(o), *encoder.update(float(x))) for o, x in zip(rows[order], rows[signal], strict=True)]
        s = encoder.state
        flat = lambda e: (None, None) if e is None else (int(e[0]), float(e[1]))
        state.update((*s[:11], *flat(s[11]), *flat(s[12]), *flat(s[13])))
        yield pd.DataFrame(made, columns=names)

    out = f"{key} string, {order} long, " + ", ".join(f"{f} double" for f in FEATURES)
    kept = "t long, last double, direction int, begin long, begin_value double, area double, phases long, pt double, ps double, ct double, cs double, e1 long, v1 double, e2 long, v2 double, e3 long, v3 double"
    rows = stream.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(signal).cast("double").alias(signal))
    return rows.groupBy(key).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)
