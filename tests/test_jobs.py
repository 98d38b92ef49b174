"""Both jobs: first and repeated runs, growing and late input, restarts, odd rows, and their command lines."""

import json
import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, monitor, queries, text_rhythm
from undula.sources import scratch
from undula.streaming.causal import FEATURES, Encoder

HERE = Path(__file__).resolve().parent.parent


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, sf, name):
    made = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(made.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    got = plain(tuple(r[c] for c in columns) for r in made.collect())
    assert got and got == plain(tuple(r[k] for k in at) for r in sql.fetchall())


# ---- texts ----

TEXTS = "doc_id long, source string, text string, lang string"
RISING = "one\none two three\none\none two three four\none\none two"


def test_texts_of_every_kind(spark, tmp_path):
    rows = [(1, "a", RISING, "en"), (2, "a", "x\ny\nz", "en"), (3, None, RISING, None), (4, "b", None, "en"), (None, "b", RISING, "en"), (5, "b", "", "en"), (6, "c/d =1", "one line", "de"), (7, "a", "w " * 50_000 + "\nw\nw w\nw", "en")]
    spark.createDataFrame(rows, TEXTS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (7, 0, 0), (7, None, 0), (6, 1, 0), (99, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    found = text_rhythm.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert found == {"read": 8, "documents": 6, "effects": 21} and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    got = {r.doc_id: r for r in text_rhythm.documents_at(spark, f"{tmp_path}/out").collect()}
    # rises to lines 1, 3 and 5; an oscillation is whole where it ends before the last rise
    assert (got[1].lines, got[1].words, got[1].source, got[1].label) == (6, 12.0, "a", 1) and got[1].objects > 0 and got[1].mean_amplitude > 0
    assert (got[3].source, got[3].objects) == ("(none)", got[1].objects) and (got[5].lines, got[5].words, got[5].label) == (1, 0.0, None)
    assert got[6].source == "c/d =1" and got[7].words == 50_004.0 and got[7].label == 0 and got[2].objects == 0 and got[2].mean_period is None
    effects = {(r.source, r.property): r for r in text_rhythm.effects_at(spark, f"{tmp_path}/out").collect()}
    every = effects["(all)", "lines"]
    assert (every.good, every.poor, every.good_median, every.poor_median, every.cliffs_delta) == (2, 2, 6.0, 3.5, 1.0)
    alone = effects["(none)", "words"]
    assert (alone.good, alone.poor, alone.poor_median, alone.cliffs_delta) == (1, 0, None, None) and {k[0] for k in effects} == {"(all)", "(none)", "a"}


def test_texts_again_and_less(spark, sf, tmp_path):
    paths = [f"{sf}/documents.parquet", f"{sf}/labels.parquet", f"{tmp_path}/out"]
    rows = lambda: (plain(text_rhythm.documents_at(spark, paths[2]).collect()), plain(text_rhythm.effects_at(spark, paths[2]).collect()))
    first, made = text_rhythm.run(spark, *paths), None
    made = rows()
    assert text_rhythm.run(spark, *paths) == first and rows() == made
    spark.read.parquet(paths[0]).where("source = 'src1'").write.parquet(f"{tmp_path}/some")
    text_rhythm.run(spark, f"{tmp_path}/some", *paths[1:])
    assert {r.source for r in text_rhythm.documents_at(spark, paths[2]).collect()} == {"src1"}
    spark.read.parquet(paths[0]).limit(0).write.parquet(f"{tmp_path}/none")
    assert text_rhythm.run(spark, f"{tmp_path}/none", *paths[1:]) == {"read": 0, "documents": 0, "effects": 0}


# ---- monitoring ----

START = datetime(2024, 3, 1)
SAMPLES = "event_id long, ts timestamp, user_id long, value double"


def samples(n, seed=1):
    rng = random.Random(seed)
    return [(k, START + timedelta(minutes=7 * k, seconds=rng.randint(0, 59)), rng.choice([1, 2, 3]), float(rng.randint(0, 400))) for k in range(n)]


def expected(rows, upto):
    """Features by key and sample, of the rows not after a time, one by one."""
    encoders, out = {}, {}
    for k, at, key, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if at <= upto:
            out[str(key), k] = encoders.setdefault(key, Encoder()).update(round(value * 100))
    return out


def found(spark, path):
    return {(r.key, r["sample"]): tuple(r[f] for f in FEATURES) for r in monitor.samples_at(spark, path).collect()}


def summed(spark, path):
    out = {}
    for r in monitor.samples_at(spark, path).collect():
        own = out.setdefault((r.key, r.day), [0, 0, 0, 0.0, None])
        own[:4] = own[0] + 1, own[1] + r.alarm, own[2] + int(r.reversal), max(own[3], r.running_amplitude)
        if r.alarm:
            own[4] = r["sample"] if own[4] is None else min(own[4], r["sample"])
    return {k: tuple(v) for k, v in out.items()}


def reported(spark, path):
    return {(r.key, r.day): (r.samples, r.alarms, r.reversals, r.greatest_swing, r.first_alarm) for r in monitor.report_at(spark, path).collect()}


def report_files(folder, day):
    return sorted(str(p) for p in (folder / "out" / "report").rglob("*.parquet") if day in str(p))


def test_growing_and_late_samples(spark, tmp_path):
    """Four runs over a folder that grows, then one over the same files. Samples late by less than the delay, in later files,
    take their place; one late by more is dropped."""
    rows = samples(240)
    events, out, state = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/state"
    late = [r for k, r in enumerate(rows[:150]) if k % 5 == 4]
    parts = [[r for r in rows[:80] if r not in late[-40:] or r[0] < 76], [], [], rows[225:]]
    held = [r for r in rows[:80] if r not in parts[0]]
    parts[1] = sorted([*held, *rows[80:160]], key=lambda r: random.Random(r[0]).random())
    lost = (9000, START + timedelta(minutes=1), 1, 5.0)
    parts[2] = [*rows[160:225], lost]
    taken = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(events)
        taken += part
        got = monitor.run(spark, events, out, state)
        upto = max(r[1] for r in taken) - timedelta(hours=1)
        kept = [r for r in taken if r != lost]
        assert got["read"] == len(part) and found(spark, out) == expected(kept, upto), k
        assert got["rows"] == len(expected(kept, upto)) and reported(spark, out) == summed(spark, out)
        if k == 2:
            first_day = report_files(tmp_path, "2024-03-01")
    # the last file has samples of the second day alone, so the first one's report isn't written again
    assert got["days"] == 1 and report_files(tmp_path, "2024-03-01") == first_day
    state_of = lambda: (plain(monitor.samples_at(spark, out).collect()), plain(monitor.report_at(spark, out).collect()))
    before, files = state_of(), report_files(tmp_path, "")
    again = monitor.run(spark, events, out, state)
    assert (again["read"], again["days"]) == (0, 0) and state_of() == before and report_files(tmp_path, "") == files
    # a run that ended before its report was made
    scratch.remove(spark, f"{out}/report/day=2024-03-01")
    assert monitor.run(spark, events, out, state)["days"] == 1 and state_of() == before
    assert held  # some came late
    days = monitor.samples_at(spark, out).select("day", F.date_format("time", "yyyy-MM-dd").alias("of")).distinct().collect()
    assert len(days) == 2 and all(r.day == r.of for r in days)
    assert all(r.alarm == (r.running_amplitude > 30000) for r in monitor.samples_at(spark, out).collect())


def test_many_triggers_are_one(spark, tmp_path):
    rows = samples(120, 2)
    for k in range(0, 120, 20):
        spark.createDataFrame(rows[k : k + 20], SAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    monitor.run(spark, f"{tmp_path}/events", f"{tmp_path}/one", f"{tmp_path}/c1")
    monitor.run(spark, f"{tmp_path}/events", f"{tmp_path}/many", f"{tmp_path}/c2", {"files_per_trigger": 1})
    assert spark.conf.get(setting) == before and found(spark, f"{tmp_path}/one") == found(spark, f"{tmp_path}/many") != {}


def test_samples_that_say_nothing(spark, tmp_path):
    rows = [(None, START, 1, 1.0), (1, None, 1, 1.0), (2, START, None, 1.0), (3, START, 1, None), (4, START, 1, 2.0), (5, START, 1, 3.0), (6, START + timedelta(hours=2), 2, 1.0)]
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/events")
    assert monitor.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/c")["rows"] == 2
    assert found(spark, f"{tmp_path}/out") == expected([r for r in rows[4:6]], START)
    spark.createDataFrame([], SAMPLES).write.parquet(f"{tmp_path}/none")
    assert monitor.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/c2") == {"read": 0, "rows": 0, "alarms": 0, "days": 0}


# ---- command lines and config files ----


def test_settings_are_checked():
    assert common.config("monitor", {"alarm": 5})["alarm"] == 5
    with pytest.raises(ValueError, match="unknown settings alarms"):
        common.config("monitor", {"alarms": 5})


def test_command_lines(spark, tmp_path):
    rows = samples(60, 3)
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/events")
    (tmp_path / "own.json").write_text(json.dumps({"alarm": 1.0, "delay": "10 minutes"}))
    env = {**os.environ, "PYTHONPATH": str(HERE), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    call = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    done = call("jobs.monitor", "--events", f"{tmp_path}/events", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/state", "--config", str(tmp_path / "own.json"))
    assert done.returncode == 0 and "read 60 new samples" in done.stderr, done.stderr[-2000:]
    assert found(spark, f"{tmp_path}/out") == expected(rows, max(r[1] for r in rows) - timedelta(minutes=10))
    spark.createDataFrame([(1, "a", RISING, "en")], TEXTS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, 1)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels")
    done = call("jobs.text_rhythm", "--documents", f"{tmp_path}/documents", "--labels", f"{tmp_path}/labels", "--output", f"{tmp_path}/rhythm")
    assert done.returncode == 0 and "read 1 documents" in done.stderr and "wrote 1 documents" in done.stderr, done.stderr[-2000:]
    assert text_rhythm.documents_at(spark, f"{tmp_path}/rhythm").count() == 1
