"""Oscillations and accumulations on small waves with known objects."""

import pytest
from pyspark.sql import functions as F

from undula.operators import analytics
from undula.operators.accumulation import Accumulation
from undula.operators.oscillation import Oscillation

WAVE = [0, 1, 2, 1, 0, 1, 2, 1, 0, 1, 2, 1, 0]


@pytest.fixture(scope="module")
def triangular(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(WAVE)], "i long, signal double")


def column(df, name, order="i"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def oscillation(**options):
    return Oscillation("signal", "i", diff_lag=1, index="i", **options)


def test_triangular_features(triangular):
    f = oscillation().fit_transform(triangular).cache()
    assert column(f, "signal_wave_id") == [0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]
    assert sum(column(f, "enter_signal_rising")) == sum(column(f, "exit_signal_rising")) == 3
    assert column(f, "signal_peak")[2] and column(f, "signal_peak_index")[2] == 2
    assert column(f, "signal_trough")[4] and column(f, "signal_trough_index")[5] == 4
    assert column(f, "signal_rate")[0] is None and not column(f, "signal_rising")[0]


def test_triangular_objects(triangular):
    o = oscillation().objects(triangular)
    rows = o.query().collect().collect()
    assert [r.oscillation_id for r in rows] == [1, 2]
    assert [(r.start_index, r.peak_index, r.end_index) for r in rows] == [(0, 2, 4), (4, 6, 8)]
    assert [(r.rise_duration, r.fall_duration, r.duration, r.amplitude, r.temporal_symmetry, r.period) for r in rows] == [(2, 2, 4, 1.0, 1.0, None), (2, 2, 4, 1.0, 1.0, 4)]
    assert len(o) == 2 and o.construction["diff_lag"] == 1
    again = oscillation().summarize(oscillation().fit_transform(triangular)).query().collect().collect()
    assert again == rows


def test_partial_objects(triangular):
    rows = oscillation().objects(triangular, include_partial=True).query().collect().collect()
    assert [(r.oscillation_id, r.is_complete) for r in rows] == [(0, False), (1, True), (2, True), (3, False)]


def test_groups_and_two_signals(spark):
    rows = [(g, 1, i, float(x), 2.0 * x) for g in "ab" for i, x in enumerate([0, 1, 2, 1, 0])]
    df = spark.createDataFrame(rows, "subject string, run long, i long, signal double, signal_2 double")
    f = Oscillation(["signal", "signal_2"], "i", ["subject", "run"], diff_lag=1).fit_transform(df)
    first = f.where("i = 0").collect()
    assert all(r.signal_rate is None and not r.signal_rising and not r.signal_falling and r.signal_peak_index is None and r.signal_wave_id == 0 for r in first)
    assert f.where("signal_wave_id <> signal_2_wave_id").count() == 0


def test_flat_regions(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2, 2, 1, 0, 1, 2, 2, 1, 0])], "i long, signal double")
    r = oscillation().objects(df).query().collect().first()
    assert (r.start_index, r.peak_index, r.end_index, r.rise_duration, r.fall_duration, r.duration) == (0, 2, 5, 2, 3, 5)


def test_smoothing(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 3, 5, 7])], "i long, signal double")
    assert column(oscillation(smooth_signal=True, smooth_window=2).fit_transform(df), "signal_smooth") == [None, 2.0, 4.0, 6.0]


def test_missing_values_and_null_groups(spark):
    rows = [("a", i, float(x) if i != 3 else float("nan")) for i, x in enumerate(WAVE)] + [(None, i, float(x)) for i, x in enumerate(WAVE)]
    t = Oscillation("signal", "i", "g", diff_lag=1).objects(spark.createDataFrame(rows, "g string, i long, signal double"), include_partial=True).table
    assert {r.g for r in t.collect()} == {"a"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, i long, signal double")
    assert Oscillation("signal", "i", "g").objects(df).table.count() == 0


@pytest.mark.parametrize("options", [{"smooth_window": 0}, {"diff_lag": 0}, {"eps": -1.0}])
def test_bad_parameters(options):
    with pytest.raises(ValueError):
        Oscillation("signal", "i", **options)


def test_bad_names(triangular):
    with pytest.raises(ValueError):
        Oscillation([], "i")
    with pytest.raises(ValueError):
        Oscillation("nothing", "i").fit_transform(triangular)
    with pytest.raises(ValueError, match="was not configured"):
        oscillation().objects(triangular, "other")


def accumulated(df, threshold="min", **options):
    features = oscillation().fit_transform(df)
    a = Accumulation("signal", "i", threshold=threshold, index="i")
    return a, a.fit_transform(features)


def test_accumulation(triangular):
    a, f = accumulated(triangular)
    wave = f.where("signal_wave_id = 1")
    assert column(wave, "signal_accumulation_threshold") == [0.0] * 4
    assert column(wave, "signal_accumulation_contribution") == [1, 2, 1, 0]
    assert column(wave, "signal_accumulation") == [1, 3, 4, 4]
    rows = a.summarize(f).query().collect().collect()
    assert [r.accumulation_id for r in rows] == [1, 2]
    r = rows[0]
    assert (r.start_index, r.end_index, r.duration, r.baseline, r.total_auc, r.auc_at_peak, r.accumulation_rate, r.centroid_time, r.half_accumulation_time) == (1, 4, 4, 0, 4, 3, 1, 1, 1)
    assert len(a.summarize(f, include_partial=True).table.collect()) == 4
    assert "parent_oscillation_id" in a.summarize(f, parent_column=True).columns


def test_thresholds(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5, 1, False), (1, 2.0, 1.0, 1, False), (2, 3.0, 1.5, 1, False)], "i long, signal double, level double, signal_wave_id long, signal_peak boolean")
    for threshold, expected in (("level", [0.5, 1.0, 1.5]), (2, [-1, 0, 1]), ("mean", [-1, 0, 1]), ({"signal": "max"}, [-2, -1, 0]), ("first", [0, 1, 2]), ("last", [-2, -1, 0])):
        f = Accumulation("signal", "i", threshold=threshold, index="i").add_signal(Accumulation("signal", "i", threshold=threshold, index="i")._frame(df)).df
        assert column(f, "signal_accumulation_contribution") == expected, threshold
    for bad, error in (({"x": 1}, ValueError), ("nonsense", ValueError), (object(), TypeError), (True, TypeError)):
        with pytest.raises(error):
            accumulation = Accumulation("signal", "i", threshold=bad, index="i")
            accumulation.add_signal(accumulation._frame(df))


def test_accumulation_needs_its_parent(triangular):
    with pytest.raises(ValueError, match="transform the oscillation"):
        Accumulation("signal", "i").fit_transform(triangular)


def test_validation(triangular, spark):
    o = oscillation().objects(triangular).table
    a, f = accumulated(triangular)
    acc = a.summarize(f).table
    analytics.validate_object_tables(o, acc, [])
    with pytest.raises(RuntimeError, match="different keys"):
        analytics.validate_object_tables(o, acc.where("accumulation_id = 1"), [])
    with pytest.raises(RuntimeError, match="out of order"):
        analytics.validate_object_tables(o.withColumn("peak_index", F.lit(0).cast("long")), acc, [])
    with pytest.raises(RuntimeError, match="no oscillation"):
        analytics.validate_object_tables(o.limit(0), acc, [])
    frame = oscillation().frame(triangular)
    assert analytics.representative(o, frame, "signal").first().oscillation_id == 1


def test_one_exchange(triangular, spark, sf):
    """The object path shuffles once, by group."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("value").alias("x"))
    plan = Oscillation("x", "event_id", "user_id").objects(events).table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_filter_on_group_is_pushed(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("value").alias("x"))
    plan = Oscillation("x", "event_id", "user_id").objects(events).table.where("user_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,2)" in plan


@pytest.mark.parametrize("options", [{"diff_lag": 1}, {"diff_lag": 3, "smooth_signal": True, "smooth_window": 4, "eps": 0.3}])
def test_blocks_change_nothing(spark, options):
    import random

    rng = random.Random(1)
    rows = [(g, i, float(rng.randint(0, 6))) for g, n in (("hot", 400), ("b", 37), ("c", 1), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, signal double")
    for partial in (False, True):
        whole = Oscillation("signal", "i", "g", index="i", **options).objects(df, include_partial=partial).query().collect().collect()
        for block in (10, 64, 1000):
            got = Oscillation("signal", "i", "g", index="i", block=block, **options).objects(df, include_partial=partial).query().collect().collect()
            assert got == whole, block
    with pytest.raises(ValueError):
        Oscillation("signal", "i", "g", block=100)
