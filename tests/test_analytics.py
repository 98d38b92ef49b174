import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import analytics as an
from undula.operators import classify, intervals
from undula.operators.frame import OrderedFrame


def synthetic(spark, steady=False):
    rows = []
    shift = {1: (0, 2, 3), 2: (0, -1, -2)}
    for fault in (1, 2):
        for run in range(1, 6):
            k = 0
            for regime, offset in zip(an.REGIMES, shift[fault], strict=True):
                for within in range(3):
                    k += 1
                    rows.append((fault, run, k, regime, k * 10, k * 10 + 9, *(float(p + within + offset + 5) for p in range(len(an.OBJECT_PROPERTIES)))))
    return spark.createDataFrame(rows, "fault_number long, simulation_run long, oscillation_id long, regime string, start_index long, end_index long, " + ", ".join(f"{p} double" for p in an.OBJECT_PROPERTIES))


def test_cliffs_delta_by_pairs(spark):
    random.seed(1)
    rows = [(random.choice("ab"), random.random() < 0.5, float(random.randint(0, 9))) for _ in range(400)] + [("a", True, None), ("b", False, float("nan")), ("c", True, 1.0)]
    d = spark.createDataFrame(rows, "k string, side boolean, x double")
    got = {r.k: r.cliffs_delta for r in an.cliffs_delta(d, "x", "side", ["k"]).collect()}
    for k in "ab":
        c, r = ([x for g, s, x in rows if g == k and s is t and x is not None and not math.isnan(x)] for t in (True, False))
        assert got[k] == pytest.approx(sum((x > y) - (x < y) for x in c for y in r) / (len(c) * len(r)))
    assert got["c"] is None


@pytest.mark.parametrize("a, b, delta", [([1, 2], [3, 4], 1.0), ([3, 4], [1, 2], -1.0)])
def test_cliffs_delta_signs(spark, a, b, delta):
    d = spark.createDataFrame([(False, float(x)) for x in a] + [(True, float(x)) for x in b], "side boolean, x double")
    assert an.cliffs_delta(d, "x", "side").first()[0] == delta


def test_audit(spark):
    out = an.run_audit(synthetic(spark))
    rep = {(r.fault_number, r.regime, r["property"]): r for r in out["cross_run_reproducibility"].collect()}
    r = rep[1, "early_response", "amplitude"]
    assert (r.run_count, r.dominant_direction, r.direction_consistency, r.repeatable) == (5, "increase", 1.0, True)
    assert rep[2, "post_response", "amplitude"].dominant_direction == "decrease"
    assert out["object_coverage"].count() == 30 and out["object_coverage"].where("NOT covered").count() == 0
    assert out["behavioral_signatures"].count() == 12
    audit = {r.query_id: r for r in out["query_audit"].collect()}
    assert len(audit) == 10 and all(r.answered for r in audit.values()) and audit["Q03"].result_rows == 10


def test_coverage_fills_zero(spark):
    c = an.summarize_coverage(synthetic(spark).where("NOT (fault_number = 1 AND regime = 'early_response')"))
    assert c.where("object_count = 0").count() == 5 and c.count() == 30


def test_regimes(spark):
    d = spark.createDataFrame([(1, 500, 590), (1, 590, 650), (1, 650, 900), (1, 1250, 1400), (0, 1250, 1400)], "fault_number long, start_index long, end_index long")
    rows = d.withColumns(an.regime_labels(600, 1200)).collect()
    assert [r.regime for r in rows] == ["pre_injection", "early_response", "early_response", "post_response", "fault_free"]
    assert [(r.post_injection, r.early_response) for r in rows] == [(0, 0), (1, 1), (1, 1), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        an.regime_labels(5, 5)


def test_examples(spark):
    wave = [math.sin(i / 3) for i in range(200)]
    d = spark.createDataFrame([(f, 1, i, x) for f in (0, 1) for i, x in enumerate(wave)], "fault_number long, simulation_run long, i long, x double")
    e = an.construct_examples(d, "x", "i", 60, 120, 4, 2).orderBy("fault_number", "oscillation_id").collect()
    assert {r.regime for r in e if r.fault_number == 0} == {"fault_free"} and {r.regime for r in e if r.fault_number == 1} == set(an.REGIMES)
    for r in e:
        part = wave[r.start_index : r.end_index + 1]
        assert (r.raw_min, r.raw_max, r.raw_start, r.raw_end) == (min(part), max(part), part[0], part[-1])
        assert r.raw_mean == pytest.approx(sum(part) / len(part))


def test_overlap_join_is_a_nested_loop(spark):
    random.seed(2)
    spans = lambda n: [(random.choice("ab"), k, s, s + random.randint(0, 40)) for k, s in ((k, random.randint(-50, 200)) for k in range(n))]
    a, b = spans(60), spans(60)
    left, right = spark.createDataFrame(a, "g string, l long, ls long, le long"), spark.createDataFrame(b, "g string, r long, rs long, re long")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    for bucket in (1, 7, 64):
        got = intervals.overlap_join(left, right, ["g"], ("ls", "le"), ("rs", "re"), bucket)
        assert sorted((r.l, r.r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matching(spark):
    true = spark.createDataFrame([("s", 1, 0, 10, 20), ("s", 2, 20, 30, 40)], "g string, true_id long, true_start long, true_peak long, true_end long")
    found = spark.createDataFrame([("s", 1, 1, 12, 22), ("s", 2, 1, 9, 20), ("s", 3, 25, 60, 41)], "g string, found_id long, found_start long, found_peak long, found_end long")
    assert [(r.found_id, r.true_id) for r in intervals.match(found, true, ["g"]).collect()] == [(2, 1)]


def test_matching_of_long_chains(spark):
    # each interval overlaps the next of the other side, more so further on: one more pair is matched a round
    ends, edges = [0], []
    for k in range(14):
        ends.append(ends[-1] + 20 - k)
    edges = [(s, s + 60) for s in ends]
    true = [("s", k, a, (a + b) // 2, b) for k, (a, b) in enumerate(edges) if k % 2]
    found = [("s", k, a, (a + b) // 2, b) for k, (a, b) in enumerate(edges) if k % 2 == 0]
    columns = "g string, {0}_id long, {0}_start long, {0}_peak long, {0}_end long"
    iou = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1) / (max(a[4], b[4]) - min(a[2], b[2]) + 1)
    want: list = []
    for _, f, t in sorted((-iou(f, t), f[1], t[1]) for f in found for t in true if iou(f, t) >= 0.1):
        if f not in {x for x, _ in want} and t not in {y for _, y in want}:
            want.append((f, t))
    got = intervals.match(spark.createDataFrame(found, columns.format("found")), spark.createDataFrame(true, columns.format("true")), ["g"], 1000, 0.1)
    assert len(want) > 4 and sorted((r.found_id, r.true_id) for r in got.collect()) == sorted(want)


def test_episodes(spark):
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([5, 5, 0, 7, 0, 8, 9])], "g string, i long, x double")
    f = OrderedFrame.of(d, "i", "g", None, ["x"])
    e = intervals.episodes(f, F.col("x") > 4, {"total": F.sum("x")}).orderBy("episode_id").collect()
    assert [(r.first_index, r.last_index, r.samples, r.total) for r in e] == [(0, 1, 2, 10.0), (3, 3, 1, 7.0), (5, 6, 2, 17.0)]


def test_curves(spark):
    rows = [("raw", s, t, float(t) / 10) for s in (1, 2) for t in (0, 10)] + [("augmented", s, t, 3 * float(t) / 10) for s in (1, 2) for t in (0, 10)]
    areas = an.curve_areas(spark.createDataFrame(rows, "representation string, seed long, step long, mean_return double"), ["representation", "seed"])
    r = an.bootstrap(an.paired_differences(areas, []), ["representation"], 200).first()
    assert (r.pairs, r.mean_difference, r.ci_low, r.ci_high) == (2, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        an.paired_differences(areas.union(areas), [])


def test_ranking_metrics(spark):
    random.seed(3)
    rows = [("k", random.randint(0, 1), random.randint(0, 20) / 20) for _ in range(200)]
    m = classify.ranking_metrics(spark.createDataFrame(rows, "k string, label long, probability double"), ["k"]).first()
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    assert m.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    ap, tp, n, done = 0.0, 0, 0, 0.0
    for t in sorted({p for _, _, p in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for _, _, p in rows)
        ap += (tp / len(pos) - done) * tp / n
        done = tp / len(pos)
    assert m.average_precision == pytest.approx(ap)


def test_evaluation(spark):
    rows = []
    for run in range(1, 6):
        for k, (s, e) in enumerate([(500, 590), (590, 650), (650, 900), (1250, 1400)]):
            level = 10.0 * (e >= 600) + run / 10 + k / 100
            rows.append((1, run, k, s, s + 5, e, *(level for _ in (*an.RAW_FEATURES, *an.OBJECT_PROPERTIES))))
    schema = "fault_number long, simulation_run long, oscillation_id long, start_index long, peak_index long, end_index long, " + ", ".join(f"{c} double" for c in (*an.RAW_FEATURES, *an.OBJECT_PROPERTIES))
    examples = spark.createDataFrame(rows, schema)
    examples = examples.withColumns(an.regime_labels(600, 1200)).cache()
    control = examples.limit(4).withColumn("fault_number", F.lit(0))
    with pytest.raises(ValueError, match="either side"):
        classify.evaluate_fault(examples, control, (1, 2), (2, 3))
    with pytest.raises(ValueError, match="nothing to test on"):
        classify.evaluate_fault(examples, control, (1,), (9,))
    with pytest.raises(ValueError, match="nothing to learn from"):
        classify.evaluate_fault(examples.where("post_injection = 1"), control)
    evaluation, predictions = classify.evaluate_fault(examples, control)
    got = {(r.target, r.representation): r for r in evaluation.collect()}
    assert len(got) == 6 and got["post_injection", "combined"].roc_auc == 1.0 and got["post_injection", "combined"].feature_count == 19
    assert got["post_injection", "raw_context"].median_detection_delay_samples == 50 and predictions.count() == 2 * 4 * 6


def test_filling_and_scaling_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(40) < 0.2, np.nan, rng.normal(3, 2, 40))
    y = rng.normal(size=40)
    rows = spark.createDataFrame([(int(k % 2), float(a), float(b), 5.0, None) for k, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double, same double, none double")
    model = classify.fit(rows, "t", ["x", "y", "same", "none"])
    median = np.nanmedian(x)
    filled = np.where(np.isnan(x), median, x)
    assert model.medians == pytest.approx((median, np.median(y), 5, 0)) and model.means == pytest.approx((filled.mean(), y.mean(), 5, 0))
    assert model.deviations == pytest.approx((filled.std(), y.std(), 1, 1))
    # the optimum of the balanced, penalised likelihood: its gradient is zero
    z = np.stack([(filled - filled.mean()) / filled.std(), (y - y.mean()) / y.std()], axis=1)
    w = np.array(model.regression.coefficients.toArray())[:2]
    p = 1 / (1 + np.exp(-(z @ w + model.regression.intercept)))
    assert z.T @ (p - np.arange(40) % 2) + w == pytest.approx([0, 0], abs=1e-3)
    got = classify.predict(model, rows.withColumn("probability", F.lit("old")))
    assert got.columns == ["t", "x", "y", "same", "none", "probability", "prediction"] and sorted(r.probability for r in got.collect()) == pytest.approx(sorted(p))


def test_long_chains_are_matched(spark):
    # each found span overlaps the next true one better than its own, so one pair is settled a round
    spans = [(0, 40)]
    for k in range(12):
        a, b = spans[-1]
        spans.append((a + 5 + k // 4, b + 5 + k // 4))
    rows = lambda name, own: spark.createDataFrame([("s", k, a, (a + b) // 2, b) for k, (a, b) in own], f"g string, {name}_id long, {name}_start long, {name}_peak long, {name}_end long")
    found, true = list(enumerate(spans[::2])), list(enumerate(spans[1::2]))
    overlap = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]) + 1) / (max(x[1], y[1]) - min(x[0], y[0]) + 1)
    pairs = sorted(((-overlap(f, t), i, j) for i, f in found for j, t in true if overlap(f, t) >= 0.3 and abs(sum(f) // 2 - sum(t) // 2) <= 30))
    want, used = set(), set()
    for _, i, j in pairs:
        if ("f", i) not in used and ("t", j) not in used:
            want.add((i, j))
            used |= {("f", i), ("t", j)}
    got = {(r.found_id, r.true_id) for r in intervals.match(rows("found", found), rows("true", true), ["g"], 30, 0.3).collect()}
    assert got == want and len(want) >= 6


def test_recovery(spark):
    true = spark.createDataFrame([("s", k, k * 20, k * 20 + 10, k * 20 + 20) for k in range(4)], "g string, true_id long, true_start long, true_peak long, true_end long")
    found = spark.createDataFrame([("s", 1, 1, 11, 21), ("s", 2, 40, 50, 60), ("s", 3, 200, 210, 220)], "g string, found_id long, found_start long, found_peak long, found_end long")
    r = intervals.recovery_scores(found, true, ["g"], ["g"]).first()
    assert (r.true_objects, r.found_objects, r.matched, r.start_mae, r.duration_mae) == (4, 3, 2, 0.5, 0.0)
    assert r.precision == pytest.approx(2 / 3) and r.recall == 0.5 and r.f1 == pytest.approx(4 / 7)


def test_chains(spark):
    from undula.operators import chains

    t = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("a", "a", 0.25)], "source string, target string, probability double")
    assert {r.target: r.probability for r in chains.absorption(t).collect()} == pytest.approx({"b": 2 / 3, "c": 1 / 3})
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "source string, target string, probability double")
    with pytest.raises(ValueError):
        chains.absorption(loop)
