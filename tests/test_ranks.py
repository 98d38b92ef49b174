"""Order statistics and running counts of large groups, and regressions of many groups, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import analytics as an
from undula.operators import classify, measures, newton, ranks


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(3000):
        key = rng.choice(["a", "a", "a", "b", None])
        rows.append((key, rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(0, 1), rng.gauss(0, 1e12), float(rng.randint(-3, 3)), 5e-324, -1e308])))
    rows += [("one", 7.0), ("none", None), ("none", float("nan")), ("ties", 2.5), ("ties", 2.5)]
    return spark.createDataFrame(rows, "k string, x double").withColumn("n", F.lit("clash")).cache()


def test_radix_selection_is_percentile(spark, values):
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in ranks.quantiles(values.select("k", "x"), "x", ["k"], shares, "q").collect()}
    clean = F.nanvl("x", F.lit(None))
    want = {r.k: (r.n, r.q) for r in values.groupBy("k").agg(F.count(clean).alias("n"), F.percentile(clean, F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want and got["none"] == (0, None) and got["one"][1] == [7.0] * 6
    assert [r.median for r in ranks.medians(values.select("x"), "x", []).collect()] == [r[0] for r in values.select(F.median(clean)).collect()]
    assert ranks.quantiles(values.select("k", "x").limit(0), "x", ["k"], shares).count() == 0


def test_bits_keep_the_order(spark):
    x = [-float("inf"), -1e308, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, float("inf")]
    made = ranks.with_double(ranks.with_bits(spark.createDataFrame([(v,) for v in x], "x double"), F.col("x"), "u"), "u", "back").collect()
    assert [r.x for r in sorted(made, key=lambda r: r.u)] == x and all(r.back == r.x for r in made)


def test_no_task_holds_a_group(spark, values):
    made = plan_of(ranks.quantiles(values.select("k", "x"), "x", ["k"], [0.5]))
    assert "percentile" not in made.lower() and "median" not in made.lower()
    per = measures.group_transform(values.select("k", "x"), "x", "median", "k", "level", large=True)
    want = {r.k: r.m for r in values.groupBy("k").agg(F.median(F.nanvl("x", F.lit(None))).alias("m")).collect()}
    assert per.count() == values.count() and all(r.level == want[r.k] for r in per.distinct().collect())


def test_one_key_is_split(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 20_011).alias("x"), F.lit(1).cast("long").alias("one"))
    cut = ranks.ranges(rows.repartition(8), ["k"], ["x"], parts=8)
    assert cut.select("_range").distinct().count() > 1
    edges = cut.groupBy("_range").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("_range").collect()
    assert all(a.high < b.low for a, b in zip(edges, edges[1:], strict=False))
    got = ranks.running(rows, ["k"], "x", {"upto": F.col("one"), "total": F.col("x")}, parts=8).orderBy("x").collect()
    assert [r.upto for r in got] == list(range(1, 20_001)) and [r.total for r in got] == np.cumsum([r.x for r in got]).tolist()


def test_effect_sizes_and_curves_of_large_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.randint(0, 60) / 60) for _ in range(900)] + [("lone", 1, 0.5)]
    d = spark.createDataFrame(rows, "k string, label long, probability double").withColumn("side", F.col("label") == 1)
    both = [sorted(map(str, an.cliffs_delta(d, "probability", "side", ["k"], large=x).collect())) for x in (False, True)]
    assert both[0] == both[1]
    for large in (False, True):
        for r in classify.ranking_metrics(d, ["k"], large=large).collect():
            pos, neg = ([p for k, y, p in rows if k == r.k and y == side] for side in (1, 0))
            if not neg:
                assert r.roc_auc is None and r.average_precision == 1.0
                continue
            assert r.roc_auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
            ap, done = 0.0, 0.0
            for t in sorted({*pos, *neg}, reverse=True):
                tp, n = sum(p >= t for p in pos), sum(p >= t for p in [*pos, *neg])
                ap, done = ap + (tp / len(pos) - done) * tp / n, tp / len(pos)
            assert r.average_precision == pytest.approx(ap)


def brute_fit(x, y, c=1.0):
    """Gradient steps with line search on the balanced, penalised likelihood of scaled rows; no second derivatives."""
    n, p = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    x = np.column_stack([x, np.ones(n)])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    loss = lambda w: weight @ (np.logaddexp(0, x @ w) - y * (x @ w)) + 0.5 * penalty @ (w * w)
    step, last, speed = 1e-2, w.copy(), 0
    for _ in range(60_000):
        ahead = w + speed / (speed + 3) * (w - last)
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ ahead))) - y)) + penalty * ahead
        while loss(ahead - step * g) > loss(ahead) - 0.5 * step * g @ g + 1e-13:
            step /= 2
        last, w, speed = w, ahead - step * g, speed + 1
        if np.abs(g).max() < 1e-9:
            break
    return w


def test_regressions_of_all_groups_at_once(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in (1, 2, None):
        for _ in range(80):
            a, b, e = rng.normal(2, 3), rng.normal(-1, 0.5), rng.normal()
            rows.append((g, int(a + 3 * e > 2), int(b + e > -1), float(a) if rng.random() > 0.1 else None, float(b) if rng.random() > 0.1 else float("nan"), 4.0, None))
    train = spark.createDataFrame(rows, "g int, t int, u int, a double, b double, same double, none double").repartition(3).cache()
    sets = {"first": ["a"], "all": ["b", "a", "same", "none"]}
    made = newton.fit(train, "g", ["t", "u"], sets)
    assert len(made) == 3 * 2 * 2 and all(m.rounds < 20 for m in made)
    for m in made:
        mine = [r for r in rows if r[0] == m.group]
        y = np.array([r[1 if m.target == "t" else 2] for r in mine])
        x = np.array([[np.nan if r[3 + "a b same none".split().index(f)] is None else r[3 + "a b same none".split().index(f)] for f in m.features] for r in mine])
        middle = np.array([0.0 if np.isnan(c).all() else np.nanmedian(c) for c in x.T])
        x = np.where(np.isnan(x), middle, x)
        sd = x.std(axis=0)
        assert m.weights == pytest.approx(brute_fit((x - x.mean(axis=0)) / np.where(sd == 0, 1, sd), y), abs=1e-5)
    got = newton.scored(train, "g", made)
    assert got.count() == 80 * 3 * 4
    one = next(m for m in made if m.group == 2 and m.target == "u" and m.name == "all")
    middles, weights, added = one.terms(one.features)
    for r in got.where("g = 2 AND target = 'u' AND representation = 'all'").collect():
        x = [m if r[f] is None or r[f] != r[f] else r[f] for f, m in zip(one.features, middles, strict=True)]
        assert r.probability == pytest.approx(1 / (1 + np.exp(-(added + np.dot(x, weights)))))


def test_one_class_cannot_be_fitted(spark):
    with pytest.raises(ValueError, match="either class"):
        newton.fit(spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "g int, t int, a double"), "g", ["t"], {"x": ["a"]})


def test_lists_in_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(400)]
    got = measures.listed(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", 7).orderBy("part").collect()
    assert all(len(r["values"]) == r.n <= 7 for r in got)
    for key in ("a", "b", None):
        assert [v for r in got if r.k == key for v in r["values"]] == sorted({v for k, v in rows if k == key and v is not None})
