"""Joins of spans of any length, matching along chains, resamples of large groups and pixel columns, against brute force."""

import logging
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import analytics as an
from undula.operators import intervals

LEFT, RIGHT = "g string, a long, ls long, le long", "g string, b long, rs long, re long"


def spans(rng, n, most):
    out = []
    for k in range(n):
        start = rng.randint(-most, most)
        out.append((rng.choice(["x", "y", None]), k, rng.choice([start, start, start, None]), start + rng.choice([-1, 0, 1, 5, rng.randint(0, most)])))
    return out


@pytest.mark.parametrize("most", [4, 60, 10**6, 10**14])
def test_spans_of_any_length(spark, most):
    rng = random.Random(most)
    left, right = spans(rng, 60, most), spans(rng, 60, most)
    got = intervals.overlap_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["g"], ("ls", "le"), ("rs", "re"))
    assert got.columns == ["g", "a", "ls", "le", "b", "rs", "re"]
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] and a[0] == b[0] and None not in (a[2], b[2]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((r.a, r.b) for r in got.collect()) == want and want


def test_nodes_make_up_their_span(spark):
    rows = [("x", k, s, e) for k, (s, e) in enumerate([(0, 0), (3, 12), (-7, 9), (5, 10**6 + 5), (-(10**12), 10**12), (8, 15), (4, 3)])]
    made = intervals.nodes(spark.createDataFrame(rows, LEFT), "ls", "le").collect()
    for _, k, s, e in rows:
        own = sorted((r._node << r._level, (r._node + 1 << r._level) - 1) for r in made if r.a == k)
        assert all(x[1] + 1 == y[0] for x, y in zip(own, own[1:], strict=False))
        assert (own[0][0], own[-1][1]) == (s, e) if s <= e else not own
        assert max([0, *(sum(r._level == n for r in made if r.a == k) for n in range(50))]) <= 2
    assert 0 < sum(r.a == 3 for r in made) <= 40  # a million samples in some tens of rows


def test_no_pair_but_those_that_overlap(spark):
    many = [("x", k, 10 * k, 10 * k + 3) for k in range(2000)]
    left, right = spark.createDataFrame([("x", 0, 0, 30_000), ("x", 1, 15, 18)], LEFT), spark.createDataFrame(many, RIGHT)
    got = intervals.overlap_join(left, right, ["g"], ("ls", "le"), ("rs", "re")).groupBy("a").count().collect()
    assert {r.a: r["count"] for r in got} == {0: 2000} and intervals.overlap_join(left.limit(0), right, ["g"], ("ls", "le"), ("rs", "re")).count() == 0


def greedy(found, true, least, tolerance):
    iou = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1) / (max(a[4], b[4]) - min(a[2], b[2]) + 1)
    by_key = {}
    for t in true:
        by_key.setdefault(t[0], []).append(t)
    near = sorted((-iou(f, t), f[1], t[1], f[0]) for f in found for t in by_key.get(f[0], []) if abs(f[3] - t[3]) <= tolerance and f[2] <= t[4] and t[2] <= f[4] and iou(f, t) >= least)
    used, out = set(), set()
    for _, f, t, g in near:
        if (g, "f", f) not in used and (g, "t", t) not in used:
            used |= {(g, "f", f), (g, "t", t)}
            out.add((g, f, t))
    return out


COLUMNS = "g string, {0}_id long, {0}_start long, {0}_peak long, {0}_end long"


def matched(spark, found, true, *args):
    rows = lambda name, own: spark.createDataFrame(own, COLUMNS.format(name))
    return {(r.g, r.found_id, r.true_id) for r in intervals.match(rows("found", found), rows("true", true), ["g"], *args).collect()}


def test_a_long_chain_takes_few_rounds(spark, caplog):
    """1000 candidates, each better than the one before it that shares a side with it."""
    ends, at = [], 0
    for k in range(1001):
        ends.append((at, at + 100_000))
        at += 40_000 - 20 * k  # nearer and nearer, so overlaps grow
    found = [("s", k, a, a, b) for k, (a, b) in enumerate(ends) if k % 2 == 0]
    true = [("s", k, a, a, b) for k, (a, b) in enumerate(ends) if k % 2]
    least = 0.42  # of a span, neighbours alone
    want = greedy(found, true, least, 10**9)
    with caplog.at_level(logging.INFO, logger="undula.operators.intervals"):
        assert matched(spark, found, true, 10**9, least) == want and len(want) == 500
    rounds, joins = (int(x) for x in caplog.messages[-1].split() if x.isdigit())
    assert rounds <= 2 and joins <= 15


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_greedy(spark, seed):
    rng = random.Random(seed)

    def some():
        out = []
        for k in range(120):
            s, n = rng.randint(0, 400), rng.choice([10, 12, 12, 20, 40])
            out.append((rng.choice("ab"), k, s, s + n // 2, s + n))
        return out

    found, true = some(), some()
    want = greedy(found, true, 0.2, 15)
    assert matched(spark, found, true, 15, 0.2) == want and len(want) > 20
    assert matched(spark, found, [], 15, 0.2) == set()


def test_resamples_of_large_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in (("a", 31), ("b", 8), ("one", 1)) for x in rng.integers(-50, 50, n)] + [("a", None)]
    d = spark.createDataFrame(rows, "g string, difference double")
    small, large = (an.bootstrap(d.where("difference IS NOT NULL"), ["g"], 300, large=x).orderBy("g").collect() for x in (False, True))
    assert [tuple(r)[:2] for r in small] == [tuple(r)[:2] for r in large]
    for x, y in zip(small, large, strict=True):
        assert tuple(x)[2:] == pytest.approx(tuple(y)[2:])
    assert an.bootstrap(d, ["g"], 300, large=True).where("g = 'a'").first().pairs == 31
    plan = an.bootstrap(d, ["g"], 300, large=True)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_pixel_columns(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["u", "v", None]), float(rng.randint(0, 300)), rng.choice([None, float("nan"), float(rng.randint(-9, 9))])) for _ in range(800)] + [("u", None, 3.0)]
    made = {(r.g, r.pixel): r for r in an.pixel_columns(spark.createDataFrame(rows, "g string, t double, v double"), "t", "v", 16, ["g"], 20.0, 280.0).collect()}
    want = {}
    for g, t, v in rows:
        if t is not None and v is not None and v == v and 20 <= t <= 280:
            want.setdefault((g, min(int((t - 20) / 260 * 16), 15)), []).append((t, v))
    assert made.keys() == want.keys()
    for k, p in want.items():
        r = made[k]
        assert r.samples == len(p)
        assert (r.first_x, r.first_y) == min(p) and (r.last_x, r.last_y) == max(p, key=lambda q: (q[0], -q[1]))
        assert (r.least_y, r.least_x) == min((v, t) for t, v in p) and (r.greatest_y, r.greatest_x) == max(((v, t) for t, v in p), key=lambda q: (q[0], -q[1]))
    lone = an.pixel_columns(spark.createDataFrame([(5, 1.0), (5, 2.0)], "t long, v double"), "t", "v", 10).collect()
    assert [(r.pixel, r.samples) for r in lone] == [(0, 2)] and an.pixel_columns(spark.createDataFrame([], "t long, v double"), "t", "v", 10).count() == 0
    assert an.pixel_columns(spark.range(100).select("id", F.col("id").alias("v")), "id", "v", 10).count() == 10
