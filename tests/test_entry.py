"""The driver's contract, and every catalogued query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from undula.plans import catalogue

#: The driver compares every query; here those that differ in kind.
ALIKE = {f"catalog_q{k:02d}" for k in range(2, 11)} | {"acc_objects_max", "acc_objects_median", "acc_objects_first", "state_falling", "state_inactive", "preceding_event", "osc_two_signals", "box_plot_data", "property_matrix", "objects_in_window", "osc_longest_per_group", "acc_objects_median_blocked", "acc_objects_first_blocked", "fault_metrics", "box_plot_large", "group_transform_large"}
NAMES = sorted(set(catalogue.ORACLE) - ALIKE)


def plain(rows):
    return sorted((tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    made = catalogue.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = con.sql(catalogue.ORACLE[name])
    columns = sorted(made.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in made.collect()) == plain(tuple(r[k] for k in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"fault_evaluation", "causal_features_stream"}))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_lists_are_of_all_users(spark):
    sf = "/root/testdata/sf0.01"
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert users > 20 and catalogue.QUERIES["collected_types"](spark, sf).count() == users


def test_every_fault_is_evaluated(spark):
    """All 36 regressions, fitted; predictions are those of the held-out runs, and the metrics those of the predictions."""
    sf = "/root/testdata/sf0.01"
    got = {(r.fault_number, r.target, r.representation): r for r in catalogue.QUERIES["fault_evaluation"](spark, sf).collect()}
    assert len(got) == 36 and {k[0] for k in got} == set(range(1, 7)) and all(0 <= r.roc_auc <= 1 and r.train_objects > 0 for r in got.values())
    evaluation, predictions = catalogue.classify.run_comparison(catalogue.labelled(spark, sf), [3], fault_start=20)
    rows = predictions.where("target = 'early_response' AND representation = 'objects'").collect()
    assert {r.simulation_run for r in rows} == {4, 5} and evaluation.count() == 6
    pos, neg = ([r.probability for r in rows if r.label == side] for side in (1, 0))
    found = got[3, "early_response", "objects"]
    assert found.test_objects == len(rows) and found.roc_auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert found.sensitivity == pytest.approx(sum(p >= 0.5 for p in pos) / len(pos))


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "oscillation_id", "duration", "amplitude"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
