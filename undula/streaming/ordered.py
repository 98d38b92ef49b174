"""Causal features of a stream whose samples may come late and out of order.

State is a key's own: the encoder's numbers, and the samples that wait. A sample waits until the watermark has passed its
time; then a timer releases all that are due, in order. So samples that are late by less than the watermark's delay take
their place, whatever triggers and restarts lie between; later ones are dropped, as Structured Streaming does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from undula.streaming.causal import FEATURES

_KEPT = "t long, last double, direction int, begin long, begin_value double, area double, phases long, pt double, ps double, ct double, cs double, e1 long, v1 double, e2 long, v2 double, e3 long, v3 double, released long"
_WAITING = "us long, place long, x double"


def released(names: list[str], eps: float) -> StatefulProcessor:
    """The processor. Its class is made here and imports where it runs, so the process that Spark starts beside the driver to
    set up its state needs nothing but pyspark."""

    class Released(StatefulProcessor):
        """Rows (time in us, place, x) of a key in; rows (key, time in us, place, features) out, in order of time and place."""

        def __init__(self, names: list[str], eps: float):
            self.names, self.eps = names, eps

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.encoder = handle.getValueState("encoder", _KEPT)
            self.waiting = handle.getListState("waiting", _WAITING)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            released = self.encoder.get()[17] if self.encoder.exists() else None
            first = None
            for part in rows:
                if part.empty:
                    continue
                part = part if released is None else part[part["sample_us"] > released]  # later than the watermark allows
                if len(part):
                    self.waiting.appendList(list(part[["sample_us", "sample_place", "sample_value"]].itertuples(index=False, name=None)))
                    first = int(part["sample_us"].min()) if first is None else min(first, int(part["sample_us"].min()))
            if first is not None:
                self.handle.registerTimer(-(-first // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            now = timerValues.getCurrentWatermarkInMs() * 1000
            rows = sorted(tuple(r) for r in self.waiting.get())
            due = [r for r in rows if r[0] <= now]
            if not due:
                return iter(())
            from undula.streaming.causal import Encoder

            encoder = Encoder(self.eps, self._held())
            made = [(key[0], int(us), int(place), *encoder.update(float(x))) for us, place, x in due]
            flat = lambda e: (None, None) if e is None else (int(e[0]), float(e[1]))
            s = encoder.state
            self.encoder.update((*s[:11], *flat(s[11]), *flat(s[12]), *flat(s[13]), now))
            left = rows[len(due) :]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(-(-int(left[0][0]) // 1000))
            else:
                self.waiting.clear()
            return iter([pd.DataFrame(made, columns=self.names).astype({self.names[0]: object})])

        def _held(self) -> tuple | None:
            if not self.encoder.exists():
                return None
            got = self.encoder.get()
            pair = lambda k: None if got[k] is None else (int(got[k]), got[k + 1])
            return (int(got[0]), got[1], int(got[2]), int(got[3]), got[4], got[5], int(got[6]), *got[7:11], pair(11), pair(13), pair(15))

        def close(self) -> None:
            pass

    return Released(names, eps)


def ordered_features(stream: DataFrame, key: str, time: str, order: str, signal: str, delay: str, eps: float = 0.0) -> DataFrame:
    """The features of a stream (key string, time timestamp, order long, signal double), in append mode: key, time, order,
    features. delay: how late a sample may be; those of the last `delay` before the latest wait for the next trigger. Rows without key, time, order or signal are left out.

    The session's state store must be RocksDB (see plans.session)."""
    rows = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), F.col(order).cast("long").alias("sample_place"), F.col(signal).cast("double").alias("sample_value"))
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col("sample_place").isNotNull() & F.col("sample_value").isNotNull())
    rows = rows.withWatermark(time, delay).withColumn("sample_us", F.unix_micros(time))
    out = f"{key} string, sample_us long, {order} long, " + ", ".join(f"{f} double" for f in FEATURES)
    made = rows.groupBy(key).transformWithStateInPandas(released([key, "sample_us", order, *FEATURES], eps), out, "Append", "EventTime")
    return made.select(key, F.timestamp_micros("sample_us").alias(time), order, *FEATURES)
