"""Scans in blocks against the windows that they stand for, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from undula.operators import blocks
from undula.operators.accumulation import Accumulation
from undula.operators.frame import OrderedFrame
from undula.operators.oscillation import Oscillation
from undula.streaming import causal


@pytest.fixture(scope="module")
def samples(spark):
    rng, rows = random.Random(9), []
    for key, n in (("long", 90), ("b", 17), (None, 12), ("one", 1), ("flat", 20)):
        level = 0
        for k in range(n):
            level += 0 if key == "flat" else rng.choice([-2, -1, -1, 0, 0, 1, 1, 3])
            rows.append((key, 3 * k + rng.randint(0, 2), float(level)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o long, x double").cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_numbers_go_on_over_ranges(spark, samples):
    got = blocks.numbered(samples, ["o"], ["g"], parts=6)
    want = OrderedFrame.of(samples, "o", "g").df
    assert rows_of(got, "g", "o", "x", "sample_index") == rows_of(want, "g", "o", "x", "sample_index")
    alone = blocks.numbered(spark.range(5000).select((F.col("id") * 3).alias("o")), ["o"], parts=7)
    assert [r.sample_index for r in alone.orderBy("o").collect()] == list(range(5000))
    assert blocks.numbered(samples.limit(0), ["o"], ["g"]).count() == 0


@pytest.mark.parametrize(("n", "group"), [(1, "g"), (7, None), (7, "g")])
def test_scans_are_windows(samples, n, group):
    d = samples.withColumn("y", F.when(F.col("o") % 4 == 0, F.col("x"))).withColumn("part", F.col("x") > 2)
    f = OrderedFrame.of(d, ["o", "g", "x"], group)
    w = f.w.rowsBetween(-(1 << 63), 0)
    y = F.col("y")
    want = f.having({"sum": F.sum(y).over(w), "max": F.max(y).over(w), "min": F.min(y).over(w), "last": F.last(y, True).over(w), "first": F.first(y, True).over(w), "before": F.last(y, True).over(f.w.rowsBetween(-(1 << 63), -1))})
    names = ["sum", "max", "min", "last", "first", "before"]
    got = blocks.running(f, n, {k: (k, y) for k in names})
    assert got.group == f.group and rows_of(got.df, "g", "o", "x", *names) == rows_of(want.df, "g", "o", "x", *names)
    within = f.within("part", ordered=True).rowsBetween(-(1 << 63), 0)
    got = blocks.whole(blocks.scan(blocks.cut(f, n), {"s": ("sum", F.col("x"))}, ["part"]))
    assert rows_of(got.df, "g", "o", "x", "s") == rows_of(f.having({"s": F.sum("x").over(within)}).df, "g", "o", "x", "s")
    lag = blocks.whole(blocks.lagged(f, n, {"previous": F.col("x")}))
    assert rows_of(lag.df, "g", "o", "x", "previous") == rows_of(f.having({"previous": F.lag("x").over(f.w)}).df, "g", "o", "x", "previous")


def test_scans_refuse_other_kinds(samples):
    f = OrderedFrame.of(samples, "o", "g")
    with pytest.raises(ValueError, match="unknown kind"):
        blocks.running(f, 4, {"m": ("median", F.col("x"))})
    with pytest.raises(ValueError, match="at least one"):
        blocks.cut(f, 0)


@pytest.mark.parametrize(("block", "eps"), [(1, 1.0), (2, 0.0), (5, 0.0), (64, 1.0)])
def test_causal_features_in_blocks(samples, block, eps):
    want = causal.causal_features(samples, "x", "o", "g", eps)
    got = causal.causal_features(samples, "x", "o", "g", eps, block)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, "g", "o", "x", "sample_index", *causal.FEATURES) == rows_of(want, "g", "o", "x", "sample_index", *causal.FEATURES)


def test_causal_features_of_a_table_in_blocks_are_the_encoder_s(samples):
    lone = samples.where("g = 'long'").drop("g")
    encoder = causal.Encoder()
    want = [encoder.update(r.x) for r in lone.orderBy("o").collect()]
    got = causal.causal_features(lone, "x", "o", block=8).orderBy("o").collect()
    assert [tuple(r[f] for f in causal.FEATURES) for r in got] == want
    assert causal.causal_features(lone.limit(0), "x", "o", block=8).count() == 0
    with pytest.raises(ValueError, match="missing column"):
        causal.causal_features(lone, "z", "o", block=8)


# values and thresholds of which sums are exact: of others, running sums differ in their last bits
@pytest.mark.parametrize("threshold", ["median", "last", 1.5, {"x": "max"}])
def test_accumulations_in_blocks(samples, threshold):
    whole = samples.where("g IS NOT NULL")
    a = Accumulation("x", "o", "g", threshold)
    features = a.fit_transform(Oscillation("x", "o", "g", diff_lag=2).fit_transform(whole))
    numbered = blocks.numbered(whole, ["o"], ["g"], parts=3)
    made = a.blocked(Oscillation("x", "o", "g", diff_lag=2, index="sample_index", block=8).blocked(numbered), 8)
    same = [c for c in features.columns if c in made.columns]
    assert {c for c in features.columns if "accumul" in c or c.endswith(("_auc", "_peak", "_complete", "half_auc"))} <= set(same)
    close = lambda df: rows_of(df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes)), *df.columns)
    assert close(made.select(*same)) == close(features.select(*same))
    for partial in (False, True):
        assert close(a.summarize(made, include_partial=partial).table) == close(a.summarize(features, include_partial=partial).table)


def test_unknown_thresholds_in_blocks(samples):
    frame = Oscillation("x", "o", "g", diff_lag=2, index="sample_index", block=8).blocked(blocks.numbered(samples, ["o"], ["g"]))
    with pytest.raises(ValueError, match="unknown threshold"):
        Accumulation("x", "o", "g", "nope").blocked(frame, 8)
