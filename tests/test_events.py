"""States, events and masks, and properties that hold for all of them."""

from functools import reduce

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import Window
from pyspark.sql import functions as F

from undula.functions import events as ev
from undula.functions import states as st


def frame(spark, values, kind="double", groups=None):
    groups = groups or ["g"] * len(values)
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(zip(groups, values, strict=True))], f"i long, g string, v {kind}")


def w():
    return Window.partitionBy("g").orderBy("i")


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def test_states(spark):
    d = frame(spark, [-0.2, -0.1, 0.0, 0.1, 0.2, None])
    v = F.col("v")
    assert values(d, st.positive(v, 0.1)) == [False] * 4 + [True, False]
    assert values(d, st.negative(v, 0.1)) == [True] + [False] * 5
    assert values(d, st.inactive(v, 0.1)) == [False, True, True, True, False, False]


def test_nan_is_missing(spark):
    d = frame(spark, [float("nan"), 1.0])
    assert values(d, st.positive(st.clean(F.col("v")))) == [False, True]


def test_rising_and_falling(spark):
    d = frame(spark, [0.0, 1.0, 3.0, 2.0, 0.0])
    assert values(d, st.rising(F.col("v"), w(), 2)) == [False, False, True, True, False]
    assert values(d, st.falling(F.col("v"), w(), 2)) == [False, False, False, False, True]


def test_enter_and_exit(spark):
    d = frame(spark, [False, True, True, False, True], "boolean")
    assert values(d, ev.enter(F.col("v"), w())) == [False, True, False, False, True]
    assert values(d, ev.exit(F.col("v"), w())) == [False, False, False, True, False]
    d = frame(spark, [False, True, True, False], "boolean", list("aabb"))
    assert values(d, ev.enter(F.col("v"), w())) == [False, True, False, False]
    assert values(d, ev.exit(F.col("v"), w())) == [False, False, False, True]


def test_numbers_landmarks_and_preceding(spark):
    d = frame(spark, [False, True, False, True], "boolean", list("aabb"))
    assert values(d, ev.number(F.col("v"), w())) == [0, 1, 0, 1]
    assert values(d.withColumn("at", F.element_at(F.array(*map(F.lit, (10, 11, 20, 21))), (F.col("i") + 1).cast("int"))), ev.landmark(F.col("v"), F.col("at"), w())) == [None, 11, None, 21]
    assert values(d, ev.preceding(F.col("v"), w())) == [True, False, True, False]


def test_masks(spark):
    d = frame(spark, [False, True, True, False, True, False], "boolean")
    assert values(d, ev.enter_mask(F.col("v"), w())) == [False, True, False, False, True, False]
    assert values(d, ev.exit_mask(F.col("v"), w())) == [False, False, False, True, False, True]


def test_clipping_keeps_null(spark):
    assert values(frame(spark, [-1.0, 0.5, 9.0, None]), st.clipped(F.col("v"), 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_running_sum_keeps_null(spark):
    assert values(frame(spark, [1.0, None, 2.0]), ev.running_sum(F.col("v"), w())) == [1.0, None, 3.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.lists(hs.booleans(), min_size=1, max_size=12), min_size=1, max_size=4))
def test_between_undoes_the_masks(spark, sequences):
    groups = [str(k) for k, s in enumerate(sequences) for _ in s]
    d = frame(spark, [x for s in sequences for x in s], "boolean", groups)
    d = d.withColumns({"e": ev.enter_mask(F.col("v"), w()), "x": ev.exit_mask(F.col("v"), w())}).withColumn("b", ev.between(F.col("e"), F.col("x"), w()))
    assert all(v == b for v, b in values(d, "v", "b"))
    alone = [values(frame(spark, s, "boolean").withColumn("n", ev.enter(F.col("v"), w())), "n") for s in sequences[:1]]
    assert reduce(list.__add__, alone) == values(d.where("g = '0'").withColumn("n", ev.enter(F.col("v"), w())), "n")
