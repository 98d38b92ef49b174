import pytest

from undula.operators.measures import OperatorRecord, group_map, group_transform
from undula.operators.objects import BehaviorObjects


@pytest.fixture(scope="module")
def objects(spark):
    t = spark.createDataFrame([(1, 5, 0.5), (2, 10, 1.5), (3, 15, 1.0), (4, None, None)], "object_id long, duration long, amplitude double")
    return BehaviorObjects("object", "signal", t, t, (), ("object_id", "duration", "amplitude"))


def rows(q):
    return [tuple(r) for r in q.collect().collect()]


def test_verbs(objects):
    q = objects.query().where(duration__ge=10).select("object_id", "amplitude").order_by("amplitude", ascending=False).limit(1)
    assert rows(q) == [(2, 1.5)]


def test_operators(objects):
    ids = lambda **p: sorted(r[0] for r in rows(objects.query().where(**p).select("object_id")))
    assert ids(duration=5) == [1] and ids(duration__eq=5) == [1]
    assert ids(duration__ne=5) == [2, 3, 4]
    assert ids(duration__gt=5) == [2, 3] and ids(duration__lt=10) == [1] and ids(duration__le=10) == [1, 2]
    assert ids(object_id__in=[1, 3]) == [1, 3]
    assert ids(duration__ge=5, amplitude__gt=0.9) == [2, 3]


def test_nulls_last(objects):
    for up in (True, False):
        assert rows(objects.query().order_by("amplitude", ascending=up).select("object_id"))[-1] == (4,)


def test_errors(objects):
    q = objects.query()
    for call in (lambda: q.where(nothing=1), lambda: q.select("nothing"), lambda: q.order_by("nothing"), lambda: q.select("object_id").order_by("amplitude")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        q.where(duration__like=1)
    with pytest.raises(ValueError):
        q.limit(-1)


def test_columns_and_count(objects):
    assert objects.columns == ["object_id", "duration", "amplitude"] and objects.count() == 4
    assert list(objects.to_pandas()["object_id"]) == [1, 2, 3, 4]


def test_group_values(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (4, 7.0)], "g long, x double")
    assert sorted(tuple(r) for r in group_transform(d, "x", "mean", "g", "m").collect()) == [(1, 1.0, 2.0), (1, 3.0, 2.0), (2, 5.0, 5.0), (4, 7.0, 7.0)]
    assert sorted(tuple(r) for r in group_map(d, "x", "max", "g", "m", 1).collect()) == [(1, 1.0, None), (1, 3.0, None), (2, 5.0, 3.0), (4, 7.0, 5.0)]
    assert sorted(tuple(r) for r in group_map(d, "x", "max", "g", "m", -1).collect())[-1] == (4, 7.0, None)
    with pytest.raises(ValueError):
        group_transform(d, "x", "mode", "g", "m")


def test_records_keep_shape(spark):
    d = spark.range(3)
    assert OperatorRecord("same", lambda df: df, "signal", "signal").apply(d).count() == 3
    with pytest.raises(ValueError):
        OperatorRecord("fewer", lambda df: df.limit(1), "signal", "signal").apply(d)
    assert OperatorRecord("fewer", lambda df: df.limit(1), "signal", "object", False).apply(d).count() == 1
