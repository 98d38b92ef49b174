"""Each job as a query: run twice into one new folder, its output as it stands after that; and the SQL of that output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import monitor, text_rhythm
from undula.plans import catalogue, oracle
from undula.sources import scratch
from undula.streaming.causal import FEATURES


def job1_text_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables under one another: report, source, doc_id, property, value."""
    folder = scratch.scratch(spark, "text_rhythm")
    for _ in range(2):
        text_rhythm.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    entries = lambda names: F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
    documents = text_rhythm.documents_at(spark, folder).select("source", "doc_id", entries((*text_rhythm.PROPERTIES, "label")).alias("e"))
    effects = text_rhythm.effects_at(spark, folder).select("source", "property", entries(("good", "poor", "good_median", "poor_median", "cliffs_delta")).alias("e"))
    value = (F.round("e.value", 5) + F.lit(0.0)).alias("value")
    return documents.select(F.lit("document").alias("report"), "source", "doc_id", F.col("e.name").alias("property"), value).unionByName(
        effects.select(F.col("e.name").alias("report"), "source", F.lit(None).cast("long").alias("doc_id"), "property", value)
    )


_LINES = r"SELECT doc_id, coalesce(source, '(none)') AS source, k - 1 AS line, len(regexp_extract_all(lines[k], '[^\x20\x09-\x0D]+'))::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))"
_MEANS = {"mean_duration": "duration", "mean_period": "period", "mean_amplitude": "amplitude", "mean_symmetry": "temporal_symmetry"}
_NAMES = (*text_rhythm.PROPERTIES, "label")
_RHYTHM = f"""
    WITH {oracle.waves(1, base=_LINES, g="doc_id", o="line")}{oracle.objects("doc_id")},
    totals AS (SELECT source, doc_id, count(*) AS lines, sum(x) AS words FROM ({_LINES}) GROUP BY ALL),
    means AS (SELECT doc_id, count(*) AS objects, {", ".join(f"avg({c}) AS {n}" for n, c in _MEANS.items())} FROM obj GROUP BY 1),
    labelled AS (SELECT doc_id, max(quality::INT) AS label FROM labels GROUP BY 1),
    made AS (SELECT t.source, t.doc_id, lines, words, coalesce(objects, 0) AS objects, {", ".join(_MEANS)}, label FROM totals t LEFT JOIN means USING (doc_id) LEFT JOIN labelled USING (doc_id)),
    long AS ({" UNION ALL ".join(f"SELECT source, doc_id, lines AS all_lines, label, '{n}' AS property, {n}::DOUBLE AS v FROM made" for n in _NAMES)}),
    known AS (
        SELECT source, property, label, v FROM long WHERE label IS NOT NULL AND all_lines >= 3 AND property <> 'label'
        UNION ALL SELECT '(all)', property, label, v FROM long WHERE label IS NOT NULL AND all_lines >= 3 AND property <> 'label'),
    deltas AS (
        SELECT a.source, a.property, sum(sign(a.v - b.v))::DOUBLE / count(*) AS d FROM known a JOIN known b ON a.source = b.source AND a.property = b.property
        WHERE a.label = 1 AND b.label = 0 AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
    sides AS (
        SELECT source, property, count(v) FILTER (label = 1) AS good, count(v) FILTER (label = 0) AS poor, median(v) FILTER (label = 1) AS good_median,
               median(v) FILTER (label = 0) AS poor_median FROM known GROUP BY ALL),
    effects AS (SELECT s.*, d AS cliffs_delta FROM sides s LEFT JOIN deltas USING (source, property))
    SELECT 'document' AS report, source, doc_id, property, round(v, 5) + 0.0 AS value FROM long
    {" ".join(f"UNION ALL SELECT '{n}', source, NULL, property, round({n}::DOUBLE, 5) + 0.0 FROM effects" for n in ("good", "poor", "good_median", "poor_median", "cliffs_delta"))}"""


def job2_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, each with its day's report beside it."""
    folder = scratch.scratch(spark, "monitor")
    for _ in range(2):  # the second finds nothing new
        monitor.run(spark, f"{sf_dir}/events.parque[t]", f"{folder}/output", f"{folder}/checkpoint")
    real = ("displacement_from_extremum", "running_amplitude", "running_signed_area", "previous_phase_amplitude", "previous_cycle_amplitude")
    features = ((F.col(f) + F.lit(0.0)).alias(f) if f in real else F.col(f).cast("long").alias(f) for f in FEATURES)
    report = monitor.report_at(spark, f"{folder}/output").withColumnsRenamed({c: f"day_{c}" for c in ("samples", "alarms", "reversals", "greatest_swing", "first_alarm")})
    return monitor.samples_at(spark, f"{folder}/output").select("key", "sample", "day", "alarm", *features).join(report, ["key", "day"], "full")


_MONITOR = f"""
    WITH features AS ({catalogue.ORACLE["causal_features"]}),
    due AS (SELECT *, epoch_us(ts) <= (max(epoch_us(ts)) OVER () // 1000 - 3600000) * 1000 AS out FROM events),
    s AS (SELECT user_id::VARCHAR AS key, event_id AS sample, strftime(ts, '%Y-%m-%d') AS day, running_amplitude > 30000 AS alarm, {", ".join(FEATURES)} FROM features JOIN due USING (user_id, event_id) WHERE out)
    SELECT *, count(*) OVER d AS day_samples, count(*) FILTER (alarm) OVER d AS day_alarms, (sum(reversal) OVER d)::BIGINT AS day_reversals,
           max(running_amplitude) OVER d AS day_greatest_swing, min(CASE WHEN alarm THEN sample END) OVER d AS day_first_alarm
    FROM s WINDOW d AS (PARTITION BY key, day)"""


QUERIES = {"job1_text_rhythm": job1_text_rhythm, "job2_monitor": job2_monitor}
ORACLE_SQL = {"job1_text_rhythm": _RHYTHM, "job2_monitor": _MONITOR}
