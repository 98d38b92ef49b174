"""Named queries over the driver's tables, each with the SQL that states its result.

Signals are whole hundredths, so that states that hang on sums and means don't hang on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.functions import events as ev
from undula.functions import states as st
from undula.operators import analytics, blocks, chains, classify, grid, intervals, measures
from undula.operators.accumulation import Accumulation
from undula.operators.frame import OrderedFrame
from undula.operators.oscillation import Oscillation
from undula.plans import eventql, oracle
from undula.plans.oracle import ACC_COLUMNS, CHARACTERIZED, EVENTS, EXACT, OBJECT_COLUMNS, ORDERS, REP_COLUMNS, REPRODUCED, STUDY, r
from undula.sources import simulate
from undula.streaming import causal
from undula.functions import text
from undula.sources import scratch

G, O = "user_id", "event_id"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, and no negative zero, so that two engines' last bits don't count."""
    return df.select(*((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(G, O, F.round(F.col("value") * 100).cast("double").alias("x"))


def frame(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    return OrderedFrame.of(events(spark, sf_dir), O, G, None, ["x"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("double").alias("x"))


def oscillation(lag: int = 2, **options) -> Oscillation:
    return Oscillation("x", O, G, diff_lag=lag, **options)


def table(spark: SparkSession, sf_dir: str, partial: bool = False, **options) -> DataFrame:
    return oscillation(**options).objects(events(spark, sf_dir), include_partial=partial).table


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir).select((F.col(G) % 7).alias("fault_number"), F.col(G).alias("simulation_run"), *oracle_properties())
    return t.withColumns(analytics.regime_labels(20, 40))


def oracle_properties() -> list[str]:
    from undula.operators.oscillation import PROPERTIES

    return list(PROPERTIES)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).where("regime <> 'fault_free'")


def characterized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.characterize_regimes(faulty(spark, sf_dir), EXACT)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = oscillation().objects(events(spark, sf_dir))
    return objects.query().where(duration__ge=3).order_by("amplitude", ascending=False).select(G, "oscillation_id", "duration", "amplitude").collect()


# ---- states and events ----

_W, _RUN = oracle.W.format(g=G, o=O), oracle.RUN.format(g=G, o=O)
_STATE = f"WITH s AS (SELECT *, x - lag(x, 2) OVER {_W} AS d FROM ({EVENTS}))"


def _state(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = frame(spark, sf_dir)
        return f.having({"state": make(F.col("x"), f.w)}).df.select(G, O, "state")

    return run


query("state_rising", f"{_STATE} SELECT user_id, event_id, coalesce(d > 500, false) AS state FROM s")(_state(lambda x, w: st.rising(x, w, 2, 500.0)))
query("state_falling", f"{_STATE} SELECT user_id, event_id, coalesce(d < -500, false) AS state FROM s")(_state(lambda x, w: st.falling(x, w, 2, 500.0)))
query("state_inactive", f"{_STATE} SELECT user_id, event_id, coalesce(abs(d) <= 500, false) AS state FROM s")(_state(lambda x, w: st.inactive(st.difference(x, 2, w), 500.0)))


@query("state_signs", f"SELECT user_id, event_id, x - 20000 > 0 AS positive, x - 20000 < 0 AS negative FROM ({EVENTS})")
def state_signs(spark, sf_dir):
    return events(spark, sf_dir).select(G, O, st.positive(F.col("x") - 20000).alias("positive"), st.negative(F.col("x") - 20000).alias("negative"))


_HIGH = f"s AS (SELECT *, x > 20000 AS state FROM ({EVENTS}))"


def high(spark, sf_dir) -> OrderedFrame:
    return frame(spark, sf_dir).having({"state": st.positive(F.col("x"), 20000.0)})


@query("enter_exit_events", f"WITH {_HIGH} SELECT user_id, event_id, state AND NOT lag(state, 1, true) OVER {_W} AS entered, NOT state AND lag(state, 1, false) OVER {_W} AS exited FROM s")
def enter_exit(spark, sf_dir):
    f = high(spark, sf_dir)
    return f.having({"entered": ev.enter(F.col("state"), f.w), "exited": ev.exit(F.col("state"), f.w)}).df.select(G, O, "entered", "exited")


@query("between_masks", f"WITH {_HIGH} SELECT user_id, event_id, state AND NOT lag(state, 1, false) OVER {_W} AS entered, NOT state AND lag(state, 1, false) OVER {_W} AS exited, state AS inside FROM s")
def between(spark, sf_dir):
    f = high(spark, sf_dir)
    f = f.having({"entered": ev.enter_mask(F.col("state"), f.w), "exited": ev.exit_mask(F.col("state"), f.w)})
    return f.having({"inside": ev.between(F.col("entered"), F.col("exited"), f.w)}).df.select(G, O, "entered", "exited", "inside")


@query("event_index_ffill", f"WITH {_HIGH}, t AS (SELECT *, row_number() OVER {_W} - 1 AS i, state AND NOT lag(state, 1, true) OVER {_W} AS entered FROM s) SELECT user_id, event_id, (sum(entered::INT) OVER {_RUN})::BIGINT AS object_id, max(CASE WHEN entered THEN i END) OVER {_RUN} AS event_index FROM t")
def event_index(spark, sf_dir):
    f = high(spark, sf_dir)
    f = f.having({"entered": ev.enter(F.col("state"), f.w)})
    return f.having({"object_id": ev.number(F.col("entered"), f.w), "event_index": ev.landmark(F.col("entered"), f.i, f.w)}).df.select(G, O, "object_id", "event_index")


@query("preceding_event", f"WITH {_HIGH}, t AS (SELECT *, state AND NOT lag(state, 1, true) OVER {_W} AS entered FROM s) SELECT user_id, event_id, lead(entered, 1, false) OVER {_W} AS before FROM t")
def preceding(spark, sf_dir):
    f = high(spark, sf_dir)
    f = f.having({"entered": ev.enter(F.col("state"), f.w)})
    return f.having({"before": ev.preceding(F.col("entered"), f.w)}).df.select(G, O, "before")


_FRAME = "(PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"


@query("rolling_smooth", f"SELECT user_id, event_id, round(CASE WHEN count(x) OVER {_FRAME.format(4, 0)} = 5 THEN avg(x) OVER {_FRAME.format(4, 0)} END, 6) + 0.0 AS smooth FROM ({EVENTS})")
def rolling(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(f.having({"smooth": ev.smooth(F.col("x"), 5, f.w)}).df.select(G, O, "smooth"))


@query("rolling_both_sides", f"WITH s AS (SELECT *, (x > 30000)::INT AS h FROM ({EVENTS})) SELECT user_id, event_id, coalesce(CASE WHEN count(h) OVER {_FRAME.format(4, 0)} = 5 THEN sum(h) OVER {_FRAME.format(4, 0)} END > 0 AND CASE WHEN count(h) OVER {_FRAME.format(0, 4)} = 5 THEN sum(h) OVER {_FRAME.format(0, 4)} END > 0, false) AS state FROM s")
def both_sides(spark, sf_dir):
    f = frame(spark, sf_dir).having({"h": (F.col("x") > 30000).cast("int")})
    return f.having({"state": ev.rolling_both(F.col("h"), 5, f.w)}).df.select(G, O, "state")


@query("change_gap_band", f"WITH {_HIGH}, t AS (SELECT *, row_number() OVER {_W} - 1 AS i, state AND NOT lag(state, 1, true) OVER {_W} AS entered FROM s), u AS (SELECT user_id, i, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM t WHERE entered) SELECT user_id, i AS event_index, gap FROM u WHERE gap BETWEEN 3 AND 6")
def gap_band(spark, sf_dir):
    f = high(spark, sf_dir)
    changes = f.having({"entered": ev.enter(F.col("state"), f.w)}).df.where("entered").select(G, F.col(f.index).alias("event_index"))
    gap = F.col("event_index") - F.lag("event_index").over(Window.partitionBy(G).orderBy("event_index"))
    return changes.withColumn("gap", gap).where(F.col("gap").between(3, 6))


@query("lagged_rate", f"{_STATE} SELECT user_id, event_id, round(d / 2.0, 6) + 0.0 AS rate FROM s")
def rate(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(f.having({"rate": st.difference(F.col("x"), 2, f.w) / F.lit(2.0)}).df.select(G, O, "rate"))


@query("sigma_bands", f"WITH s AS ({EVENTS}), m AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM s WHERE event_id % 2 = 0) SELECT user_id, event_id, x > mu + 2 * sd AS high, x < mu - 2 * sd AS low FROM s, m")
def sigma_bands(spark, sf_dir):
    e = events(spark, sf_dir)
    one = e.where(F.col(O) % 2 == 0).agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    both = e.join(F.broadcast(one))  # one row
    return both.select(G, O, st.above(F.col("x"), F.col("mu") + 2 * F.col("sd")).alias("high"), st.below(F.col("x"), F.col("mu") - 2 * F.col("sd")).alias("low"))


@query("control_exceedance", f"WITH s AS (SELECT *, row_number() OVER {_W} - 1 AS i FROM ({EVENTS})), c AS (SELECT i, max(x) AS hi, min(x) AS lo FROM s WHERE user_id % 7 = 0 GROUP BY i) SELECT user_id, s.i AS sample_index, coalesce(x > hi, false) AS above, coalesce(x < lo, false) AS below FROM s LEFT JOIN c ON s.i = c.i WHERE user_id % 7 <> 0")
def control_exceedance(spark, sf_dir):
    f = frame(spark, sf_dir)
    control = f.df.where(F.col(G) % 7 == 0).groupBy(f.index).agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    return f.df.where(F.col(G) % 7 != 0).join(control, f.index, "left").select(G, f.index, st.above(F.col("x"), F.col("hi")).alias("above"), st.below(F.col("x"), F.col("lo")).alias("below"))


# ---- oscillations ----


@query("wave_ids", f"WITH {oracle.waves(2)} SELECT user_id, event_id, wave AS wave_id, peak, trough, peak_index, trough_index FROM f")
def wave_ids(spark, sf_dir):
    d = oscillation().primitives(events(spark, sf_dir)).df
    return d.select(G, O, F.col("x_wave_id").alias("wave_id"), F.col("x_peak").alias("peak"), F.col("x_trough").alias("trough"), F.col("x_peak_index").alias("peak_index"), F.col("x_trough_index").alias("trough_index"))


@query("osc_features", f"""WITH {oracle.waves(2)},
    g AS (SELECT *, sum(rising::INT) OVER p AS rt, sum(falling::INT) OVER p AS ft, (max(s) OVER p - min(s) OVER p) / 2 AS amplitude, max(rate) OVER p AS up, min(rate) OVER p AS down,
                 coalesce(max(ent::INT) OVER p = 1 AND min(trough_index) OVER p < max(peak_index) OVER p AND max(peak_index) OVER p < max(trough_index) OVER p AND wave < max(wave) OVER (PARTITION BY user_id), false) AS complete
          FROM f WINDOW p AS (PARTITION BY user_id, wave))
    SELECT user_id, event_id, rt::BIGINT AS rising_time, ft::BIGINT AS falling_time, (rt + ft)::BIGINT AS duration, complete, {r("amplitude")},
           round(CASE WHEN rt > 0 THEN 2 * amplitude / rt END, 6) + 0.0 AS rising_mean_rate, round(CASE WHEN ft > 0 THEN 2 * amplitude / ft END, 6) + 0.0 AS falling_mean_rate,
           round(CASE WHEN up IS NOT NULL THEN greatest(up, 0.0) END, 6) + 0.0 AS peak_rise_rate, round(CASE WHEN down IS NOT NULL THEN greatest(-down, 0.0) END, 6) + 0.0 AS peak_fall_rate FROM g""")
def osc_features(spark, sf_dir):
    d = oscillation().fit_transform(events(spark, sf_dir))
    names = {"rising_time": "rising_time", "falling_time": "falling_time", "duration": "duration", "wave_complete": "complete"} | {k: k for k in ("amplitude", "rising_mean_rate", "falling_mean_rate", "peak_rise_rate", "peak_fall_rate")}
    return rounded(d.select(G, O, *(F.col(f"x_{k}").alias(v) for k, v in names.items())))


query("osc_objects", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, {OBJECT_COLUMNS} FROM obj")(lambda s, d: rounded(table(s, d)))
query("osc_objects_partial", f"WITH {oracle.waves(2)}{oracle.objects(partial=True)} SELECT user_id, {OBJECT_COLUMNS} FROM obj")(lambda s, d: rounded(table(s, d, True)))
query("osc_objects_smoothed", f"WITH {oracle.waves(3, 0.5, 4)}{oracle.objects()} SELECT user_id, {OBJECT_COLUMNS} FROM obj")(lambda s, d: rounded(table(s, d, lag=3, eps=0.5, smooth_signal=True, smooth_window=4)))


@query("osc_objects_blocked", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, {OBJECT_COLUMNS} FROM obj")
def osc_blocked(spark, sf_dir):
    """As osc_objects, a group's samples ordered in blocks of 16."""
    numbered = frame(spark, sf_dir).df
    return rounded(oscillation(index="sample_index", block=16).objects(numbered).table)


@query("osc_objects_orders", f"WITH {oracle.waves(1, base=ORDERS, g='o_custkey', o='o_orderdate, o_orderkey')}{oracle.objects('o_custkey')} SELECT o_custkey, {OBJECT_COLUMNS} FROM obj")
def osc_orders(spark, sf_dir):
    return rounded(Oscillation("x", ["o_orderdate", "o_orderkey"], "o_custkey", diff_lag=1).objects(orders(spark, sf_dir)).table)


@query("osc_two_signals", f"WITH {oracle.waves(2, base=EVENTS.replace(' FROM', ', 2 * round(value * 100)::DOUBLE AS y FROM'))} SELECT user_id, event_id, wave AS x_wave_id, wave AS y_wave_id FROM f")
def two_signals(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("y", 2 * F.col("x"))
    return Oscillation(["x", "y"], O, G, diff_lag=2).primitives(e).df.select(G, O, "x_wave_id", "y_wave_id")


@query("osc_query_long", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, oscillation_id, duration FROM obj WHERE duration >= 6 AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND period <> 7 OR (duration >= 6 AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND period IS NULL)")
def query_long(spark, sf_dir):
    q = oscillation().objects(events(spark, sf_dir)).query()
    return q.where(duration__ge=6, user_id__in=[1, 2, 3, 5, 8, 13, 21, 34], period__ne=7).select(G, "oscillation_id", "duration").collect()


@query("osc_topk_amplitude", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, oscillation_id, {r('amplitude')} FROM obj ORDER BY obj.amplitude DESC NULLS LAST, user_id, oscillation_id LIMIT 25")
def topk(spark, sf_dir):
    return rounded(oscillation().objects(events(spark, sf_dir)).query().order_by("amplitude", ascending=False).limit(25).select(G, "oscillation_id", "amplitude").collect())


@query("osc_period_stats", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, count(*) AS objects, count(period) AS periods, round(avg(period), 6) + 0.0 AS mean_period, round(median(period), 6) + 0.0 AS median_period FROM obj GROUP BY user_id")
def period_stats(spark, sf_dir):
    return rounded(table(spark, sf_dir).groupBy(G).agg(F.count("*").alias("objects"), F.count("period").alias("periods"), F.avg("period").alias("mean_period"), F.median("period").alias("median_period")))


@query("osc_longest_per_group", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, oscillation_id, duration FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, oscillation_id) AS n FROM obj) WHERE n = 1")
def longest(spark, sf_dir):
    return analytics.first_by(table(spark, sf_dir), [G], [F.col("duration").desc(), "oscillation_id"]).select(G, "oscillation_id", "duration")


@query("osc_summary_text", f"WITH {oracle.waves(2)}{oracle.objects()}, s AS (SELECT user_id, count(*) AS n, avg(period) AS p, avg(amplitude) AS a, avg(temporal_symmetry) AS y, max(end_index) - min(start_index) AS span FROM obj GROUP BY user_id) SELECT user_id, n AS object_count, round(CASE WHEN span > 0 THEN 60.0 * n / span END, 4) + 0.0 AS rate_per_minute, round(p, 4) + 0.0 AS mean_period, round(a, 4) + 0.0 AS mean_amplitude, round(y, 4) + 0.0 AS mean_symmetry FROM s")
def summary(spark, sf_dir):
    return rounded(analytics.summary_text(table(spark, sf_dir), [G]).drop("summary"), 4).select(G, "object_count", "rate_per_minute", "mean_period", "mean_amplitude", "mean_symmetry")


# ---- accumulations ----


def accumulation(spark, sf_dir, threshold, extra=None) -> tuple[Accumulation, DataFrame]:
    e = events(spark, sf_dir)
    features = oscillation().fit_transform(e.withColumns(extra()) if extra else e)
    a = Accumulation("x", O, G, threshold)
    return a, a.fit_transform(features)


def _acc(threshold, extra=None):
    def run(spark, sf_dir):
        a, features = accumulation(spark, sf_dir, threshold, extra)
        return rounded(a.summarize(features).table)

    return run


for _name, _threshold, _sql, _extra in (
    ("min", "min", "min(x) OVER (PARTITION BY user_id, wave)", None),
    ("max", {"x": "max"}, "max(x) OVER (PARTITION BY user_id, wave)", None),
    ("median", "median", "median(x) OVER (PARTITION BY user_id, wave)", None),
    ("first", "first", "first_value(x) OVER (PARTITION BY user_id, wave ORDER BY event_id)", None),
    ("const", 15000, "15000::DOUBLE", None),
    ("column", "level", "(100.0 * (event_id % 50))::DOUBLE", lambda: {"level": 100.0 * (F.col(O) % 50)}),
):
    query(f"acc_objects_{_name}", f"WITH {oracle.waves(2)}{oracle.accumulations(_sql)} SELECT user_id, {ACC_COLUMNS} FROM acc")(_acc(_threshold, _extra))


def blocked_accumulation(spark, sf_dir, threshold, block=16) -> tuple[Accumulation, DataFrame]:
    """As accumulation(), groups and waves in blocks."""
    numbered = blocks.numbered(events(spark, sf_dir), [O], [G])
    a = Accumulation("x", O, G, threshold)
    return a, a.blocked(oscillation(index="sample_index", block=block).blocked(numbered), block)


def _acc_blocked(threshold):
    def run(spark, sf_dir):
        a, features = blocked_accumulation(spark, sf_dir, threshold)
        return rounded(a.summarize(features).table)

    return run


for _name, _threshold in (("min", "min"), ("median", "median"), ("first", "first")):
    query(f"acc_objects_{_name}_blocked", ORACLE[f"acc_objects_{_name}"])(_acc_blocked(_threshold))


@query("acc_features", f"WITH {oracle.waves(2)}{oracle.accumulations('min(x) OVER (PARTITION BY user_id, wave)')} SELECT user_id, event_id, k AS accumulation_index, seen > 0 AS after_peak, cum >= total / 2 AS reached_half, half AS half_time, c > 0 AS is_accumulating, round(thr, 6) + 0.0 AS threshold, round(c, 6) + 0.0 AS contribution, round(cum, 6) + 0.0 AS accumulation FROM t4")
def acc_features(spark, sf_dir):
    _, d = accumulation(spark, sf_dir, "min")
    names = {"accumulation_index": "accumulation_index", "after_peak": "after_peak", "reached_half_auc": "reached_half", "half_accumulation_time": "half_time", "is_accumulating": "is_accumulating", "accumulation_threshold": "threshold", "accumulation_contribution": "contribution", "accumulation": "accumulation"}
    return rounded(d.select(G, O, *(F.col(f"x_{k}").alias(v) for k, v in names.items())))


@query("acc_features_blocked", ORACLE["acc_features"])
def acc_features_blocked(spark, sf_dir):
    """As acc_features, a group's samples in blocks of 16."""
    _, d = blocked_accumulation(spark, sf_dir, "min")
    names = {"accumulation_index": "accumulation_index", "after_peak": "after_peak", "reached_half_auc": "reached_half", "half_accumulation_time": "half_time", "is_accumulating": "is_accumulating", "accumulation_threshold": "threshold", "accumulation_contribution": "contribution", "accumulation": "accumulation"}
    return rounded(d.select(G, O, *(F.col(f"x_{k}").alias(v) for k, v in names.items())))


@query("parent_child_keys", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, oscillation_id AS object_id, 'both' AS found_in FROM obj")
def parent_child(spark, sf_dir):
    o = table(spark, sf_dir).select(G, F.col("oscillation_id").alias("object_id"), F.lit(1).alias("o"))
    a, features = accumulation(spark, sf_dir, "min")
    acc = a.summarize(features).table.select(G, F.col("accumulation_id").alias("object_id"), F.lit(1).alias("a"))
    both = o.join(acc, [G, "object_id"], "full")
    return both.select(G, "object_id", F.when(F.col("o").isNull(), "accumulation").when(F.col("a").isNull(), "oscillation").otherwise("both").alias("found_in"))


# ---- the study ----


@query("segment_stats", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT o.user_id, o.oscillation_id AS wave_id, round(avg(x), 6) + 0.0 AS raw_mean, round(stddev_pop(x), 4) + 0.0 AS raw_std, min(x) AS raw_min, max(x) AS raw_max, max(x) - min(x) AS raw_range, arg_min(x, i) AS raw_start, arg_max(x, i) AS raw_end, arg_max(x, i) - arg_min(x, i) AS raw_delta, abs(arg_max(x, i) - arg_min(x, i)) AS raw_abs_delta FROM obj o JOIN f ON f.user_id = o.user_id AND f.i BETWEEN o.start_index AND o.end_index GROUP BY ALL")
def segment_stats(spark, sf_dir):
    f = oscillation().primitives(events(spark, sf_dir))
    whole = oscillation().objects(events(spark, sf_dir)).table.select(G, F.col("oscillation_id").alias("wave_id"))
    s = analytics.segment_statistics(f, "x", "x_wave_id").withColumnRenamed("x_wave_id", "wave_id").join(whole, [G, "wave_id"], "left_semi")
    return rounded(s.withColumn("raw_std", F.round("raw_std", 4)))


query("regime_labels", f"WITH {STUDY} SELECT fault_number, simulation_run, oscillation_id, post_injection, early_response, regime FROM study")(lambda s, d: study(s, d).select("fault_number", "simulation_run", "oscillation_id", "post_injection", "early_response", "regime"))
query("regime_medians", f"WITH {STUDY} SELECT fault_number, regime, {', '.join(f'round(median({p}), 4) + 0.0 AS {p}' for p in EXACT)} FROM study GROUP BY ALL")(lambda s, d: rounded(analytics.regime_medians(study(s, d), EXACT)))
query("coverage_grid", f"WITH {STUDY}, k AS (SELECT DISTINCT fault_number, simulation_run FROM study WHERE regime <> 'fault_free'), n AS (SELECT fault_number, simulation_run, regime, count(*) AS n FROM study GROUP BY ALL) SELECT k.fault_number, k.simulation_run, t.regime, coalesce(n, 0) AS object_count, coalesce(n, 0) > 0 AS covered FROM k CROSS JOIN (VALUES ('pre_injection'), ('early_response'), ('post_response')) t(regime) LEFT JOIN n ON n.fault_number = k.fault_number AND n.simulation_run = k.simulation_run AND n.regime = t.regime")(lambda s, d: analytics.summarize_coverage(faulty(s, d)))
query("cliffs_delta", f"WITH {STUDY} SELECT a.fault_number, round(sum(sign(b.amplitude - a.amplitude))::DOUBLE / count(*), 6) + 0.0 AS cliffs_delta FROM study a JOIN study b USING (fault_number) WHERE a.regime = 'pre_injection' AND b.regime = 'early_response' GROUP BY 1")(lambda s, d: rounded(analytics.cliffs_delta(study(s, d).where("regime IN ('pre_injection', 'early_response')").withColumn("side", F.col("regime") == "early_response"), "amplitude", "side", ["fault_number"])))
query("regime_characterization", f"WITH {CHARACTERIZED} SELECT fault_number, simulation_run, regime, property, baseline_count, regime_count, direction, {r('baseline_median', 'regime_median', 'median_difference', 'median_ratio', 'cliffs_delta')} FROM chr")(lambda s, d: rounded(characterized(s, d)))
query("reproducibility", f"WITH {REPRODUCED} SELECT {REP_COLUMNS} FROM rep")(lambda s, d: rounded(analytics.summarize_reproducibility(characterized(s, d))))
query("signatures_top3", f"WITH {REPRODUCED} SELECT signature_rank, {REP_COLUMNS} FROM sig")(lambda s, d: rounded(analytics.build_signatures(analytics.summarize_reproducibility(characterized(s, d)))))

# the same of groups too large for one task: ranges of values, and radix selection
for _name, _of, _make in (
    ("cliffs_delta_large", "cliffs_delta", lambda s, d: analytics.cliffs_delta(study(s, d).where("regime IN ('pre_injection', 'early_response')").withColumn("side", F.col("regime") == "early_response"), "amplitude", "side", ["fault_number"], large=True)),
    ("regime_medians_large", "regime_medians", lambda s, d: analytics.regime_medians(study(s, d), EXACT, large=True)),
):
    query(_name, ORACLE[_of])(lambda s, d, make=_make: rounded(make(s, d)))

_ANSWERS = {
    "Q01": f"SELECT fault_number, simulation_run, oscillation_id, {r('amplitude')} FROM (SELECT *, row_number() OVER (PARTITION BY fault_number ORDER BY amplitude DESC, simulation_run, oscillation_id) AS n FROM study WHERE regime <> 'fault_free') WHERE n = 1",
    "Q02": "SELECT fault_number, simulation_run, oscillation_id, duration FROM (SELECT *, row_number() OVER (PARTITION BY fault_number ORDER BY duration DESC, simulation_run, oscillation_id) AS n FROM study WHERE regime <> 'fault_free') WHERE n = 1",
    "Q03": "SELECT fault_number, simulation_run, oscillation_id, start_index, end_index FROM (SELECT *, row_number() OVER (PARTITION BY fault_number, simulation_run ORDER BY end_index, oscillation_id) AS n FROM study WHERE regime = 'early_response') WHERE n = 1",
    "Q04": "SELECT fault_number, regime, count(*) AS object_count FROM study WHERE regime <> 'fault_free' GROUP BY ALL",
    "Q05": f"SELECT fault_number, {r('median_difference', 'direction_consistency')} FROM (SELECT * FROM rep WHERE regime = 'early_response' AND property = 'amplitude' ORDER BY median_difference DESC NULLS LAST, fault_number LIMIT 1)",
    "Q06": f"SELECT fault_number, {r('median_difference', 'direction_consistency')} FROM (SELECT * FROM rep WHERE regime = 'post_response' AND property = 'amplitude' ORDER BY median_difference DESC NULLS LAST, fault_number LIMIT 1)",
    "Q07": f"SELECT fault_number, regime, {r('direction_consistency', 'median_cliffs_delta')} FROM rep WHERE property = 'period' AND repeatable AND dominant_direction = 'increase'",
    "Q08": f"SELECT fault_number, regime, {r('direction_consistency', 'median_cliffs_delta')} FROM rep WHERE property = 'temporal_symmetry' AND repeatable AND dominant_direction = 'decrease'",
    "Q09": f"SELECT fault_number, property, dominant_direction, repeatable, {r('behavioral_strength')} FROM sig WHERE regime = 'early_response' AND signature_rank = 1",
    "Q10": f"SELECT fault_number, property, dominant_direction, repeatable, {r('behavioral_strength')} FROM sig WHERE regime = 'post_response' AND signature_rank = 1",
}


def _catalog(spark, sf_dir):
    rep = analytics.summarize_reproducibility(characterized(spark, sf_dir))
    return faulty(spark, sf_dir), rep, analytics.build_signatures(rep)


def _answer(q: str):
    return lambda spark, sf_dir: rounded(analytics.catalog(*_catalog(spark, sf_dir))[q][2])


for _q, _sql in _ANSWERS.items():
    query(f"catalog_{_q.lower()}", f"WITH {REPRODUCED} {_sql}")(_answer(_q))

_SOURCE = {"Q01": "objects", "Q02": "objects", "Q03": "objects", "Q04": "objects", "Q05": "reproducibility", "Q06": "reproducibility", "Q07": "reproducibility", "Q08": "reproducibility", "Q09": "signatures", "Q10": "signatures"}
_TABLE = {"objects": "(SELECT count(*) FROM study WHERE regime <> 'fault_free')", "reproducibility": "(SELECT count(*) FROM rep)", "signatures": "(SELECT count(*) FROM sig)"}
query("query_audit", f"WITH {REPRODUCED} " + " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{s}' AS source_table, {_TABLE[s]} AS source_rows, (SELECT count(*) FROM ({_ANSWERS[q]})) AS result_rows, true AS answered, (SELECT count(*) FROM ({_ANSWERS[q]})) = 0 AS empty_result" for q, s in _SOURCE.items()))(lambda s, d: analytics.audit(*_catalog(s, d)).drop("question"))


@query("box_plot_data", f"WITH {STUDY} SELECT fault_number, regime, {', '.join(f'round(quantile_cont(log10(1 + amplitude), {p}), 5) + 0.0 AS {n}' for n, p in (('whisker_low', 0.05), ('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('whisker_high', 0.95)))} FROM study WHERE amplitude IS NOT NULL GROUP BY ALL")
def box_plot(spark, sf_dir):
    return rounded(analytics.box_plot(study(spark, sf_dir)), 5)


query("box_plot_large", ORACLE["box_plot_data"])(lambda s, d: rounded(analytics.box_plot(study(s, d), large=True), 5))


_PIXEL = f"least(floor((event_id - (SELECT min(event_id) FROM events))::DOUBLE / (SELECT max(event_id) - min(event_id) FROM events) * 200), 199)::BIGINT"


@query("figure_pixels", f"SELECT event_type, {_PIXEL} AS pixel, count(*) AS samples, min(event_id)::DOUBLE AS first_x, arg_min(x, event_id) AS first_y, max(event_id)::DOUBLE AS last_x, arg_max(x, event_id) AS last_y, arg_min(event_id, (x, event_id))::DOUBLE AS least_x, min(x) AS least_y, arg_max(event_id, (x, -event_id))::DOUBLE AS greatest_x, max(x) AS greatest_y FROM (SELECT event_type, event_id, round(value * 100)::DOUBLE AS x FROM events) GROUP BY 1, 2")
def figure_pixels(spark, sf_dir):
    """A line of all events' values for each type, 200 pixels across."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", O, F.round(F.col("value") * 100).cast("double").alias("x"))
    return analytics.pixel_columns(e, O, "x", 200, ["event_type"])


@query("property_matrix", f"WITH {REPRODUCED} SELECT fault_number, {', '.join(f'''round(max(CASE WHEN property = '{p}' THEN CASE WHEN dominant_direction = 'decrease' THEN -behavioral_strength ELSE behavioral_strength END END), 6) + 0.0 AS {p}''' for p in EXACT)} FROM rep WHERE regime = 'early_response' GROUP BY 1")
def property_matrix(spark, sf_dir):
    return rounded(analytics.property_matrix(analytics.summarize_reproducibility(characterized(spark, sf_dir)), "early_response", EXACT))


query("objects_in_window", f"WITH {STUDY} SELECT fault_number, simulation_run, oscillation_id, start_index, end_index FROM study WHERE end_index >= 15 AND start_index <= 25")(lambda s, d: analytics.in_window(study(s, d), 15, 25).select("fault_number", "simulation_run", "oscillation_id", "start_index", "end_index"))


# ---- groups, joins, curves ----


@query("group_transform", f"SELECT user_id, event_id, round(median(x) OVER (PARTITION BY user_id), 6) + 0.0 AS level FROM ({EVENTS})")
def group_transform(spark, sf_dir):
    return rounded(measures.group_transform(events(spark, sf_dir), "x", "median", G, "level").select(G, O, "level"))


query("group_transform_large", ORACLE["group_transform"])(lambda s, d: rounded(measures.group_transform(events(s, d), "x", "median", G, "level", large=True).select(G, O, "level")))


@query("group_map_prev", f"WITH {oracle.waves(2)}, m AS (SELECT user_id, wave, max(x) AS top FROM f GROUP BY ALL), p AS (SELECT *, lag(top) OVER (PARTITION BY user_id ORDER BY wave) AS previous_top FROM m) SELECT f.user_id, event_id, p.previous_top FROM f JOIN p ON f.user_id = p.user_id AND f.wave = p.wave")
def group_map(spark, sf_dir):
    d = oscillation().primitives(events(spark, sf_dir)).df
    return measures.group_map(d, "x", "max", "x_wave_id", "previous_top", 1, [G]).select(G, O, "previous_top")


_EPISODES = f"n AS (SELECT *, state AND NOT lag(state, 1, false) OVER {_W} AS entered, row_number() OVER {_W} - 1 AS i FROM s), m AS (SELECT *, sum(entered::INT) OVER {_RUN} AS episode FROM n), ep AS (SELECT user_id, episode::BIGINT AS episode_id, min(i) AS first_index, max(i) AS last_index, count(*) AS samples, sum(x) AS total FROM m WHERE state GROUP BY ALL)"


def _episodes(spark, sf_dir) -> DataFrame:
    return intervals.episodes(frame(spark, sf_dir), st.positive(F.col("x"), 20000.0), {"total": F.sum("x")})


query("exceedance_episodes", f"WITH {_HIGH}, {_EPISODES} SELECT user_id, episode_id, first_index, last_index, samples, total FROM ep")(lambda s, d: _episodes(s, d))


@query("episode_wave_overlap", f"WITH {oracle.waves(2)}{oracle.objects()}, {_HIGH}, {_EPISODES} SELECT ep.user_id, episode_id, oscillation_id FROM ep JOIN obj ON ep.user_id = obj.user_id AND obj.start_index <= ep.last_index AND obj.end_index >= ep.first_index")
def overlap(spark, sf_dir):
    return intervals.overlap_join(_episodes(spark, sf_dir), table(spark, sf_dir), [G], ("first_index", "last_index"), ("start_index", "end_index"), 8).select(G, "episode_id", "oscillation_id")


@query("episode_wave_overlap_dyadic", ORACLE["episode_wave_overlap"])
def overlap_dyadic(spark, sf_dir):
    """As episode_wave_overlap, for spans of any length."""
    return intervals.overlap_join(_episodes(spark, sf_dir), table(spark, sf_dir), [G], ("first_index", "last_index"), ("start_index", "end_index")).select(G, "episode_id", "oscillation_id")


def _spans(lag: int, name: str) -> str:
    """SQL of the spans of objects made with a lag."""
    return f"SELECT * FROM (WITH {oracle.waves(lag)}{oracle.objects()} SELECT user_id, oscillation_id AS {name}_id, start_index AS {name}_start, peak_index AS {name}_peak, end_index AS {name}_end FROM obj)"


@query("lag_match", f"""WITH RECURSIVE found AS ({_spans(3, "found")}), true_ AS ({_spans(2, "true")}),
    near AS (SELECT *, greatest(least(found_end, true_end) - greatest(found_start, true_start) + 1, 0) / (greatest(found_end, true_end) - least(found_start, true_start) + 1) AS iou FROM found JOIN true_ USING (user_id) WHERE abs(found_peak - true_peak) <= 10),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, found_id, true_id) AS k FROM near WHERE iou >= 0.1),
    walk AS (
        SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS f, []::BIGINT[] AS t, NULL::BIGINT AS found_id, NULL::BIGINT AS true_id, NULL::DOUBLE AS iou, false AS ok FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT user_id, e.k, CASE WHEN free THEN list_append(f, e.found_id) ELSE f END, CASE WHEN free THEN list_append(t, e.true_id) ELSE t END, e.found_id, e.true_id, e.iou, free
        FROM (SELECT w.user_id, w.f, w.t, w.k, NOT list_contains(w.f, e.found_id) AND NOT list_contains(w.t, e.true_id) AS free FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1) n JOIN e USING (user_id) WHERE e.k = n.k + 1)
    SELECT user_id, found_id, true_id, round(iou, 6) + 0.0 AS iou FROM walk WHERE ok""")
def lag_match(spark, sf_dir):
    """Objects of one lag matched with those of another: chains of candidates."""
    span = lambda lag, name: table(spark, sf_dir, lag=lag).select(G, F.col("oscillation_id").alias(f"{name}_id"), *(F.col(f"{c}_index").alias(f"{name}_{c}") for c in ("start", "peak", "end")))
    return rounded(intervals.match(span(3, "found"), span(2, "true"), [G], least_iou=0.1).select(G, "found_id", "true_id", "iou"))


@query("interval_iou_match", f"WITH {oracle.waves(2)}{oracle.objects()} SELECT user_id, oscillation_id AS found_id, oscillation_id AS true_id, round((end_index - start_index) / (end_index - start_index + 2), 6) + 0.0 AS iou FROM obj WHERE (end_index - start_index) / (end_index - start_index + 2) > 0.5")
def iou_match(spark, sf_dir):
    t = table(spark, sf_dir)
    span = lambda name, by: t.select(G, F.col("oscillation_id").alias(f"{name}_id"), *((F.col(f"{c}_index") + by).alias(f"{name}_{c}") for c in ("start", "peak", "end")))
    found = intervals.match(span("found", 1), span("true", 0), [G], least_iou=0.5, bucket=8)
    return rounded(found.where("iou > 0.5").select(G, "found_id", "true_id", "iou"))


_CURVES = "SELECT CASE WHEN user_id % 2 = 0 THEN 'raw' ELSE 'augmented' END AS representation, user_id // 2 AS seed, event_id AS step, x AS mean_return FROM (" + EVENTS + ")"


def curves(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.when(F.col(G) % 2 == 0, "raw").otherwise("augmented").alias("representation"), F.expr("user_id div 2").alias("seed"), F.col(O).alias("step"), F.col("x").alias("mean_return"))


_AREAS = f"WITH c AS (SELECT *, (mean_return + lag(mean_return) OVER w) / 2 * (step - lag(step) OVER w) AS part FROM ({_CURVES}) WINDOW w AS (PARTITION BY representation, seed ORDER BY step)), a AS (SELECT representation, seed, CASE WHEN max(step) > min(step) THEN sum(part) / (max(step) - min(step)) END AS area FROM c GROUP BY ALL)"
query("curve_auc", f"{_AREAS} SELECT representation, seed, round(area, 4) + 0.0 AS area FROM a")(lambda s, d: rounded(analytics.curve_areas(curves(s, d), ["representation", "seed"]), 4))


@query("paired_auc_diff", f"{_AREAS} SELECT seed, round(b.area - a.area, 4) + 0.0 AS difference FROM a JOIN a b USING (seed) WHERE a.representation = 'raw' AND b.representation = 'augmented'")
def paired(spark, sf_dir):
    return rounded(analytics.paired_differences(analytics.curve_areas(curves(spark, sf_dir), ["representation", "seed"]), []).select("seed", "difference"), 4)


_PRIME = (1 << 31) - 1
_DRAWS = f"""{_AREAS}, p AS (SELECT b.representation, b.area - a.area AS d FROM a JOIN a b USING (seed) WHERE a.representation = 'raw' AND b.representation <> 'raw'),
    l AS (SELECT representation, list_sort(list(d)) AS v, count(*) AS pairs, avg(d) AS mean_difference, median(d) AS median_difference FROM p GROUP BY 1),
    z0 AS (SELECT representation, v, b, k, (b * 48271 + k * 69621 + 1729 * 39373) % {_PRIME} AS z FROM l, range(1, 1001) t(b), range(1, 100000) u(k) WHERE k <= len(v)),
    z1 AS (SELECT *, (z * z + k * 16807) % {_PRIME} AS y FROM z0),
    m AS (SELECT representation, b, avg(v[((y * y + b * 630360) % {_PRIME} % len(v) + 1)::INT]) AS mean FROM z1 GROUP BY ALL)
    SELECT representation, any_value(pairs) AS pairs, round(any_value(mean_difference), 3) + 0.0 AS mean_difference, round(any_value(median_difference), 3) + 0.0 AS median_difference,
           round(quantile_cont(mean, 0.025), 3) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 3) + 0.0 AS ci_high FROM m JOIN l USING (representation) GROUP BY 1"""


@query("bootstrap_interval", _DRAWS)
def bootstrap(spark, sf_dir):
    areas = analytics.curve_areas(curves(spark, sf_dir), ["representation", "seed"])
    return rounded(analytics.bootstrap(analytics.paired_differences(areas, []), ["representation"], 1000), 3)


query("bootstrap_interval_large", _DRAWS)(lambda s, d: rounded(analytics.bootstrap(analytics.paired_differences(analytics.curve_areas(curves(s, d), ["representation", "seed"]), []), ["representation"], 1000, large=True), 3))


# ---- causal features ----

_CAUSAL = f"""WITH base AS (SELECT *, row_number() OVER w - 1 AS t, x - lag(x) OVER w AS st, lag(x) OVER w AS last FROM ({EVENTS}) WINDOW w AS {_W}),
    a AS (SELECT *, CASE WHEN st > 0 THEN 1 WHEN st < 0 THEN -1 ELSE 0 END AS turn FROM base),
    b AS (SELECT *, coalesce(last_value(nullif(turn, 0) IGNORE NULLS) OVER {_RUN}, 0) AS dir FROM a),
    c AS (SELECT *, coalesce(lag(dir) OVER {_W}, 0) AS prev FROM b),
    d AS (SELECT *, turn <> 0 AND prev <> 0 AND turn <> prev AS rev FROM c),
    e AS (SELECT *, sum(rev::INT) OVER {_RUN} AS phase, coalesce(max(CASE WHEN rev THEN t - 1 END) OVER {_RUN}, 0) AS beg, coalesce(last_value(CASE WHEN rev THEN last END IGNORE NULLS) OVER {_RUN}, first_value(x) OVER {_RUN}) AS bv FROM d),
    g AS (SELECT *, x - bv AS moved, lag(beg) OVER {_W} AS b0, lag(bv) OVER {_W} AS v0 FROM e),
    h AS (SELECT *, sum(moved) OVER (PARTITION BY user_id, phase ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS area, CASE WHEN rev THEN t - 1 - b0 END AS pd, CASE WHEN rev THEN abs(last - v0) END AS pa FROM g),
    k AS (SELECT user_id, event_id, t - 1 - lag(t - 1, 2) OVER w AS cd, abs(lag(last, 1) OVER w - lag(last, 2) OVER w) AS ca FROM h WHERE rev WINDOW w AS {_W}),
    l AS (SELECT h.*, cd, ca FROM h LEFT JOIN k ON h.user_id = k.user_id AND h.event_id = k.event_id)
    SELECT user_id, event_id, dir::BIGINT AS direction, rev::INT::BIGINT AS reversal, (t - beg)::BIGINT AS phase_elapsed, moved AS displacement_from_extremum, abs(moved) AS running_amplitude,
           area AS running_signed_area, coalesce(last_value(pa IGNORE NULLS) OVER {_RUN}, 0.0) AS previous_phase_amplitude, coalesce(last_value(pd IGNORE NULLS) OVER {_RUN}, 0)::BIGINT AS previous_phase_duration,
           phase::BIGINT AS completed_phases, coalesce(last_value(ca IGNORE NULLS) OVER {_RUN}, 0.0) AS previous_cycle_amplitude, coalesce(last_value(cd IGNORE NULLS) OVER {_RUN}, 0)::BIGINT AS previous_cycle_duration,
           greatest(phase - 2, 0)::BIGINT AS completed_cycles FROM l"""


@query("causal_features", _CAUSAL)
def causal_batch(spark, sf_dir):
    d = causal.causal_features(events(spark, sf_dir), "x", O, G)
    real = ("displacement_from_extremum", "running_amplitude", "running_signed_area", "previous_phase_amplitude", "previous_cycle_amplitude")
    return d.select(G, O, *((F.col(c).cast("double") + F.lit(0.0)).alias(c) if c in real else F.col(c).cast("long").alias(c) for c in causal.FEATURES))


@query("causal_features_blocked", _CAUSAL)
def causal_blocked(spark, sf_dir):
    """As causal_features, a group's samples in blocks of 16."""
    d = causal.causal_features(events(spark, sf_dir), "x", O, G, block=16)
    real = ("displacement_from_extremum", "running_amplitude", "running_signed_area", "previous_phase_amplitude", "previous_cycle_amplitude")
    return d.select(G, O, *((F.col(c).cast("double") + F.lit(0.0)).alias(c) if c in real else F.col(c).cast("long").alias(c) for c in causal.FEATURES))


@query("causal_features_stream", f"SELECT user_id::VARCHAR AS user_id, * EXCLUDE (user_id) FROM ({_CAUSAL})")
def causal_stream(spark, sf_dir):
    """The stream's features, written to files by as many tasks as there are partitions, and read again."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]")
    rows = stream.select(F.col(G).cast("string").alias(G), O, F.round(F.col("value") * 100).cast("double").alias("x"))
    folder = scratch.scratch(spark, "causal")
    made = causal.stream_features(rows, G, O, "x").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    made.awaitTermination()
    real = ("displacement_from_extremum", "running_amplitude", "running_signed_area", "previous_phase_amplitude", "previous_cycle_amplitude")
    found = spark.read.schema(f"{G} string, {O} long, " + ", ".join(f"{f} double" for f in causal.FEATURES)).parquet(f"{folder}/rows")
    return found.select(G, O, *((F.col(c) + F.lit(0.0)).alias(c) if c in real else F.col(c).cast("long").alias(c) for c in causal.FEATURES))


query("raw_history", f"SELECT user_id, event_id, coalesce(lag(x) OVER {_W}, x) AS previous FROM ({EVENTS})")(lambda s, d: causal.history(events(s, d), "x", O, G).select(G, O, "previous"))
query("scaled_clipped", f"SELECT user_id, event_id, round(least(greatest((x - 20000) / 1000.0, -10.0), 10.0), 6) + 0.0 AS x FROM ({EVENTS})")(lambda s, d: rounded(causal.scaled(events(s, d).withColumn("x", F.col("x") - 20000), {"x": 1000.0}).select(G, O, "x")))


@query("carried_forward", f"WITH s AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN x END AS y FROM ({EVENTS})) SELECT user_id, event_id, last_value(y IGNORE NULLS) OVER {_RUN} AS carried FROM s")
def carried(spark, sf_dir):
    f = frame(spark, sf_dir).having({"y": F.when(F.col(O) % 3 == 0, F.col("x"))})
    return f.having({"carried": ev.carried(F.col("y"), f.w)}).df.select(G, O, "carried")


# ---- expressions, counts, grids, fits ----


@query("eventql_expr", f"WITH s AS (SELECT *, coalesce(x - lag(x) OVER {_W}, 0.0) AS d FROM ({EVENTS})), t AS (SELECT *, sum((d > 0)::INT::DOUBLE) OVER {_RUN} AS n FROM s) SELECT user_id, event_id, (d > 500 OR d < -500) AND n > 3 AS mask, n AS rises FROM t")
def eventql_expr(spark, sf_dir):
    f = frame(spark, sf_dir)
    mask, count = eventql.compile("(D(x) > 500 | D(x) < -500) & C(D(x) > 0) > 3"), eventql.compile("C(D(x) > 0)")
    return f.having({"mask": mask.build(f.w), "rises": count.build(f.w)}).df.select(G, O, "mask", "rises")


@query("failure_categories", "SELECT CASE WHEN contains(props, 'error') THEN 'error' WHEN contains(props, 'a') THEN 'with a' WHEN contains(props, '1') THEN 'with 1' WHEN props IS NOT NULL THEN 'other' END AS category, count(*) AS n FROM events GROUP BY 1")
def categories(spark, sf_dir):
    category = text.category(F.col("props"), {"error": "error", "a": "with a", "1": "with 1"})
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("value_counts_percent", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS percent FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return rounded(n.join(F.broadcast(total)).select("event_type", "n", (100.0 * F.col("n") / F.col("total")).alias("percent")))


@query("pivot_counts", f"WITH {STUDY} SELECT fault_number, " + ", ".join(f"count(*) FILTER (regime = '{x}') AS {x}" for x in ("pre_injection", "early_response", "post_response")) + " FROM study GROUP BY 1")
def pivot(spark, sf_dir):
    names = ["pre_injection", "early_response", "post_response"]
    return study(spark, sf_dir).groupBy("fault_number").pivot("regime", names).count().na.fill(0, names)


@query("collected_lists", "SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def lists(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col(G).cast("string").alias("u")).distinct()
    return e.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("u")), ",").alias("users"), F.count("*").alias("n"))


@query("collected_parts", "SELECT event_type, part, string_agg(u, ',' ORDER BY u) AS users, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY u) - 1) // 50 AS part FROM (SELECT DISTINCT event_type, user_id::VARCHAR AS u FROM events WHERE user_id IS NOT NULL)) GROUP BY 1, 2")
def parts(spark, sf_dir):
    """As collected_lists, in rows of at most 50 users, whatever their number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col(G).cast("string").alias("u"))
    return measures.listed(e, ["event_type"], "u", 50).select("event_type", "part", F.array_join("values", ",").alias("users"), "n")


@query("collected_types", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def types(spark, sf_dir):
    """The event types of each user: lists of all events, bounded by the number of types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(G, "event_type").distinct()
    return e.groupBy(G).agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types"), F.count("event_type").alias("n"))


@query("boolean_cooccurrence", f"WITH s AS (SELECT x > 10000 AS a, x > 20000 AS b, event_id % 2 = 0 AS c FROM ({EVENTS})) " + " UNION ALL ".join(f"SELECT '{p}' AS first, '{q}' AS second, count(*) FILTER ({p} AND {q}) AS both, count(*) FILTER ({p} OR {q}) AS either FROM s" for p in "abc" for q in "abc"))
def cooccurrence(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("x") > 10000).alias("a"), (F.col("x") > 20000).alias("b"), (F.col(O) % 2 == 0).alias("c"))
    return grid.cooccurrence(e, ["a", "b", "c"])


@query("linear_fit", f"SELECT user_id, round(regr_slope(x, event_id), 4) + 0.0 AS slope, round(regr_intercept(x, event_id), 2) + 0.0 AS intercept, round(regr_r2(x, event_id), 6) + 0.0 AS r2 FROM ({EVENTS}) GROUP BY 1")
def linear_fit(spark, sf_dir):
    d = events(spark, sf_dir).groupBy(G).agg(F.regr_slope("x", O).alias("slope"), F.regr_intercept("x", O).alias("intercept"), F.regr_r2("x", O).alias("r2"))
    return d.select(G, *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("slope", 4), ("intercept", 2), ("r2", 6))))


@query("running_sum", f"SELECT user_id, event_id, sum(x) OVER {_RUN} AS total FROM ({EVENTS})")
def running(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.having({"total": ev.running_sum(F.col("x"), f.w)}).df.select(G, O, "total")


query("running_sum_blocked", ORACLE["running_sum"])(lambda s, d: blocks.running(OrderedFrame(blocks.numbered(events(s, d), [O], [G]), [O], [G]), 16, {"total": ("sum", F.col("x"))}).df.select(G, O, "total"))


_OBJECT = "o AS (SELECT (k // 3)::INT AS row, (k % 3)::INT AS col, (k * 7 % 5)::INT AS v FROM range(6) t(k))"


@query("grid_blocks", f"WITH {_OBJECT}, c AS (SELECT (k // 6)::INT AS row, (k % 6)::INT AS col FROM range(24) t(k)), p AS (SELECT c.row, c.col, o.v AS orig, m.v AS mirr, c.row // 2 AS br, c.col // 3 AS bc FROM c JOIN o ON o.row = c.row % 2 AND o.col = c.col % 3 JOIN o m ON m.row = c.row % 2 AND m.col = 2 - c.col % 3), q AS (SELECT *, CASE WHEN br = 0 AND bc = 0 THEN orig WHEN br = bc THEN 0 ELSE mirr END AS v FROM p) SELECT br::INT AS block_row, bc::INT AS block_column, CASE WHEN bool_and(v = orig) THEN 'copy' WHEN bool_and(v = mirr) THEN 'reflect_horizontal' WHEN bool_and(v = 0) THEN 'fill_background' ELSE 'unknown' END AS instruction, count(*) AS cell_count FROM q GROUP BY 1, 2")
def grid_blocks(spark, sf_dir):
    small = grid.coordinates(spark, 2, 3)
    o = small.withColumn("value", (((F.col("row") * 3 + F.col("column")) * 7) % 5).cast("int"))
    layout = spark.createDataFrame([(0, 0, "copy"), (0, 1, "reflect_horizontal"), (1, 0, "reflect_horizontal"), (1, 1, "fill_background")], "block_row int, block_column int, instruction string")
    out = grid.block_compose(layout, o, 2, 3, 0)
    return grid.compare_blocks(grid.partition_blocks(o, out, 2, 3, 0)).select("block_row", "block_column", "instruction", "cell_count")


@query("grid_transforms", f"WITH {_OBJECT}, g AS (SELECT k // 3 AS r, k % 3 AS c FROM range(6) t(k)), m AS (SELECT 'copy' AS operator, r, c, r AS fr, c AS fc FROM g UNION ALL SELECT 'flip_horizontal', r, c, r, 2 - c FROM g UNION ALL SELECT 'flip_vertical', r, c, 1 - r, c FROM g UNION ALL SELECT 'rotate_180', r, c, 1 - r, 2 - c FROM g) SELECT operator, r::INT AS \"row\", c::INT AS \"column\", v AS value FROM m JOIN o ON o.row = fr AND o.col = fc UNION ALL SELECT 'background', r::INT, c::INT, 0 FROM g")
def grid_transforms(spark, sf_dir):
    o = grid.coordinates(spark, 2, 3).withColumns({"color": (((F.col("row") * 3 + F.col("column")) * 7) % 5).cast("int"), "grid_height": F.lit(2), "grid_width": F.lit(3)})
    return grid.transformed(o).select("operator", F.col("within_block_row").alias("row"), F.col("within_block_column").alias("column"), "value")


@query("coordinate_arrays", "SELECT (k // 6)::INT AS \"row\", (k % 6)::INT AS \"column\", (k // 6 // 2)::INT AS block_row, (k % 6 // 3)::INT AS block_column, (k // 6 % 2)::INT AS within_block_row, (k % 6 % 3)::INT AS within_block_column FROM range(24) t(k)")
def coordinate_arrays(spark, sf_dir):
    return grid.coordinates(spark, 4, 6, (2, 3))


@query("kronecker_product", f"WITH {_OBJECT} SELECT (a.row * 2 + b.row)::INT AS \"row\", (a.col * 3 + b.col)::INT AS \"column\", a.v * b.v AS value FROM o a CROSS JOIN o b")
def kronecker(spark, sf_dir):
    o = grid.coordinates(spark, 2, 3).withColumn("value", (((F.col("row") * 3 + F.col("column")) * 7) % 5).cast("int"))
    return grid.kronecker(o, o, 2, 3)


def grid_cells(spark: SparkSession) -> DataFrame:
    """Three tasks made here: a fixed layout, a layout by state, and one that no solver fits."""
    from undula.sources.tables import TASK, cells

    flip = lambda g: [row[::-1] for row in g]
    beside = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]

    def by_state(g):
        none = [[0] * len(g[0]) for _ in g]
        return [row for line in g for row in [sum(parts, []) for parts in zip(*((none if c == 0 else g) for c in line), strict=True)]]

    a, b, c = [[1, 2], [3, 4]], [[2, 0], [1, 5]], [[0, 7], [7, 7]]
    made = {
        "00000001": {"train": [{"input": g, "output": beside(g, flip(g))} for g in (a, b)], "test": [{"input": [[5, 6], [7, 8]], "output": [[5, 6, 6, 5], [7, 8, 8, 7]]}]},
        "00000002": {"train": [{"input": g, "output": by_state(g)} for g in (b, c)], "test": [{"input": [[3, 0], [0, 4]], "output": by_state([[3, 0], [0, 4]])}]},
        "00000003": {"train": [{"input": a, "output": [[9] * 4] * 2}], "test": [{"input": b, "output": [[9] * 4] * 2}]},
    }
    import json

    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in made.items()], "task_id string, j string")
    return cells(rows.select("task_id", F.from_json("j", TASK).alias("task")))


#: What the three tasks of grid_cells() have for answers: each is made so that one solver fits, or none.
_SOLVED = "SELECT task_id, pair_index::INT AS pair_index, exact, fixed_status, state_status, solver FROM (VALUES ('00000001', 0, true, 'ok', 'state_shape_mismatch', 'fixed'), ('00000002', 0, true, 'none_shared', 'ok', 'state'), ('00000003', 0, false, 'no_operator', 'state_shape_mismatch', 'fallback')) t(task_id, pair_index, exact, fixed_status, state_status, solver)"


@query("grid_solver", _SOLVED)
def grid_solver(spark, sf_dir):
    made = grid_cells(spark)
    predictions, tasks = grid.solve(made)
    return grid.evaluate(predictions, made).join(tasks, "task_id")


def labelled(spark, sf_dir) -> DataFrame:
    """The study's objects with their segments' statistics, users as five runs of each fault."""
    raw = analytics.segment_statistics(oscillation().primitives(events(spark, sf_dir)), "x", "x_wave_id").select(F.col(G).alias("simulation_run"), F.col("x_wave_id").alias("oscillation_id"), *analytics.RAW_FEATURES)
    return study(spark, sf_dir).join(raw, ["simulation_run", "oscillation_id"]).withColumn("simulation_run", (F.expr("simulation_run div 7") % 5) + 1)


@query("fault_evaluation")
def fault_evaluation(spark, sf_dir):
    return classify.run_comparison(labelled(spark, sf_dir), range(1, 7), fault_start=20)[0]


_SCORED = f"WITH {STUDY}, s AS (SELECT fault_number, simulation_run, end_index, post_injection AS label, duration AS score, (duration > 5)::INT AS prediction FROM study WHERE regime <> 'fault_free'), cn AS (SELECT fault_number, score, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL), u AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER f AS np, sum(n) OVER f AS nn FROM cn WINDOW w AS (PARTITION BY fault_number ORDER BY score DESC), f AS (PARTITION BY fault_number)), ap AS (SELECT fault_number, sum(p * tp / seen) / max(np) AS average_precision FROM u GROUP BY 1), auc AS (SELECT a.fault_number, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS roc_auc FROM s a JOIN s b ON a.fault_number = b.fault_number AND a.label = 1 AND b.label = 0 GROUP BY 1), th AS (SELECT fault_number, avg(prediction) FILTER (label = 1) AS sensitivity, avg(1 - prediction) FILTER (label = 0) AS specificity FROM s GROUP BY 1), dl AS (SELECT fault_number, median(d) AS median_detection_delay_samples FROM (SELECT fault_number, simulation_run, greatest(min(end_index) - 20, 0) AS d FROM s WHERE end_index >= 20 AND prediction = 1 GROUP BY ALL) GROUP BY 1) SELECT fault_number, round(roc_auc, 6) + 0.0 AS roc_auc, round(average_precision, 6) + 0.0 AS average_precision, round(sensitivity, 6) + 0.0 AS sensitivity, round(specificity, 6) + 0.0 AS specificity, round((sensitivity + specificity) / 2, 6) + 0.0 AS balanced_accuracy, median_detection_delay_samples FROM ap LEFT JOIN auc USING (fault_number) LEFT JOIN th USING (fault_number) LEFT JOIN dl USING (fault_number)"


def _metrics(large: bool):
    def run(spark, sf_dir):
        s = faulty(spark, sf_dir).select("fault_number", "simulation_run", "end_index", F.col("post_injection").alias("label"), F.col("duration").alias("score"), (F.col("duration") > 5).cast("int").alias("prediction"))
        keys = ["fault_number"]
        made = classify.ranking_metrics(s, keys, score="score", large=large).join(classify.threshold_metrics(s, keys), keys).join(classify.detection_delay(s, keys, 20), keys, "left")
        return rounded(made)

    return run


query("fault_metrics", _SCORED)(_metrics(False))
query("fault_metrics_large", _SCORED)(_metrics(True))


query("simulated_cartpole")(lambda s, d: simulate.cartpole(s, 3, 120))
query("simulated_mountaincar")(lambda s, d: simulate.mountaincar(s, 3, 120))


@query("noise_recovery")
def noise_recovery(spark, sf_dir):
    """Precision, recall and errors on seeded waves of 12 cycles of 80 samples, at two levels of noise."""
    out = None
    for noise in (0.0, 0.2):
        waves = simulate.noisy_waves(spark, 6, 12, 80, noise)
        found = Oscillation("value", "i", "signal_id", smooth_signal=True, smooth_window=9, diff_lag=10, eps=0.03).objects(waves).table
        found = found.select("signal_id", F.col("oscillation_id").alias("found_id"), *(F.col(f"{c}_index").alias(f"found_{c}") for c in ("start", "peak", "end")))
        true = spark.range(6 * 12).select(F.expr("id div 12").alias("signal_id"), (F.col("id") % 12).alias("true_id"))
        true = true.select("*", (F.col("true_id") * 80).alias("true_start"), (F.col("true_id") * 80 + 40).alias("true_peak"), (F.col("true_id") * 80 + 80).alias("true_end"))
        scores = intervals.recovery_scores(found, true, ["signal_id"], ["signal_id"]).withColumn("noise", F.lit(noise))
        out = scores if out is None else out.unionByName(scores)
    return out


@query("mean_interval", f"SELECT user_id, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 4) + 0.0 AS std, round(1.96 * stddev_samp(x) / sqrt(count(x)), 4) + 0.0 AS half_width FROM ({EVENTS}) GROUP BY 1")
def mean_interval(spark, sf_dir):
    d = intervals.mean_interval(events(spark, sf_dir), "x", [G])
    return rounded(d.withColumns({c: F.round(c, 4) for c in ("std", "half_width")}))


def walk(spark: SparkSession) -> DataFrame:
    """A walk on five states between two ends."""
    rows = [(f"s{k}", f"s{k + d}", 0.5) for k in range(1, 6) for d in (-1, 1)]
    return spark.createDataFrame(rows, "source string, target string, probability double")


@query("chain_absorption", "SELECT 's' || k AS source, e AS target, round(CASE e WHEN 's6' THEN k / 6 ELSE 1 - k / 6 END, 6) + 0.0 AS probability FROM range(1, 6) t(k), (VALUES ('s0'), ('s6')) u(e)")
def chain_absorption(spark, sf_dir):
    return rounded(chains.absorption(walk(spark)))


@query("chain_values", "SELECT 's' || k AS state, (CASE WHEN k BETWEEN 1 AND 5 THEN k * (6 - k) ELSE 0 END)::DOUBLE AS value FROM range(0, 7) t(k)")
def chain_values(spark, sf_dir):
    rewards = spark.createDataFrame([(f"s{k}", 1.0) for k in range(1, 6)], "state string, reward double")
    return rounded(chains.values(walk(spark), rewards))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
