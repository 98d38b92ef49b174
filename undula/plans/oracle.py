"""SQL that states the results of the catalogue's queries, in pieces that they share."""

from __future__ import annotations

W = "(PARTITION BY {g} ORDER BY {o})"
RUN = "(PARTITION BY {g} ORDER BY {o} ROWS UNBOUNDED PRECEDING)"
EVENTS = "SELECT user_id, event_id, round(value * 100)::DOUBLE AS x FROM events"
ORDERS = "SELECT o_custkey, o_orderdate, o_orderkey, round(o_totalprice * 100)::DOUBLE AS x FROM orders"


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def waves(lag: int = 2, eps: float = 0.0, smooth: int = 0, base: str = EVENTS, g: str = "user_id", o: str = "event_id", extra: str = "") -> str:
    """WITH clauses up to `f`: every sample with its states, events, landmarks and wave."""
    w, run = W.format(g=g, o=o), RUN.format(g=g, o=o)
    frame = f"(PARTITION BY {g} ORDER BY {o} ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW)"
    source = f"CASE WHEN count(x) OVER {frame} = {smooth} THEN avg(x) OVER {frame} END" if smooth else "x"
    return f"""
    base AS (SELECT *, {source} AS s, row_number() OVER {w} - 1 AS i FROM ({base})),
    a AS (SELECT *, s - lag(s, {lag}) OVER {w} AS d FROM base),
    b AS (SELECT *, coalesce(d > {eps}, false) AS rising, coalesce(d < {-eps}, false) AS falling, d / {float(lag)} AS rate FROM a),
    c AS (SELECT *, rising AND NOT lag(rising, 1, true) OVER {w} AS ent, NOT rising AND lag(rising, 1, false) OVER {w} AS ext FROM b),
    e AS (SELECT *, lead(ext, 1, false) OVER {w} AS peak, lead(ent, 1, false) OVER {w} AS trough, (sum(ent::INT) OVER {run})::BIGINT AS wave FROM c),
    f AS (SELECT *, max(CASE WHEN peak THEN i END) OVER {run} AS peak_index, max(CASE WHEN trough THEN i END) OVER {run} AS trough_index FROM e){extra}"""


def objects(g: str = "user_id", partial: bool = False) -> str:
    """After waves(): clauses up to `obj`, a row per object."""
    return f""",
    w0 AS (
        SELECT {g}, wave AS oscillation_id, max(ent::INT) AS started, min(trough_index) AS start_index, max(peak_index) AS peak_index,
               max(trough_index) AS end_index, max(s) - min(s) AS net, max(rate) AS up, min(rate) AS down
        FROM f WHERE {g} IS NOT NULL GROUP BY {g}, wave),
    w1 AS (SELECT *, coalesce(started = 1 AND start_index < peak_index AND peak_index < end_index AND oscillation_id < max(oscillation_id) OVER (PARTITION BY {g}), false) AS is_complete FROM w0),
    w2 AS (SELECT *, peak_index - start_index AS rise_duration, end_index - peak_index AS fall_duration, end_index - start_index AS duration FROM w1 {"" if partial else "WHERE is_complete"}),
    obj AS (
        SELECT *, peak_index - lag(peak_index) OVER (PARTITION BY {g} ORDER BY oscillation_id) AS period, net / 2 AS amplitude,
               CASE WHEN rise_duration > 0 THEN net / rise_duration END AS rising_mean_rate, CASE WHEN fall_duration > 0 THEN net / fall_duration END AS falling_mean_rate,
               CASE WHEN up IS NOT NULL THEN greatest(up, 0.0) END AS peak_rise_rate, CASE WHEN down IS NOT NULL THEN greatest(-down, 0.0) END AS peak_fall_rate,
               CASE WHEN duration > 0 THEN 1 - abs(rise_duration - fall_duration) / duration END AS temporal_symmetry
        FROM w2)"""


OBJECT_COLUMNS = "oscillation_id, is_complete, start_index, peak_index, end_index, rise_duration, fall_duration, duration, period, " + r("amplitude", "rising_mean_rate", "falling_mean_rate", "peak_rise_rate", "peak_fall_rate", "temporal_symmetry")


def accumulations(threshold: str) -> str:
    """After waves(): clauses up to `acc`, a row per accumulation. threshold: SQL of a sample's threshold."""
    p = "(PARTITION BY user_id, wave ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
    return f""",
    t1 AS (SELECT *, {threshold} AS thr FROM f),
    t2 AS (SELECT *, x - thr AS c, row_number() OVER (PARTITION BY user_id, wave ORDER BY event_id) - 1 AS k, sum(peak::INT) OVER {p} AS seen FROM t1),
    t3 AS (SELECT *, sum(c) OVER {p} AS cum, sum(c) OVER (PARTITION BY user_id, wave) AS total FROM t2),
    t4 AS (SELECT *, min(CASE WHEN round(cum, 6) >= round(total / 2, 6) THEN k END) OVER (PARTITION BY user_id, wave) AS half FROM t3),
    t5 AS (
        SELECT user_id, wave AS accumulation_id, max(ent::INT) AS started, min(trough_index) AS ts, max(peak_index) AS ps, max(trough_index) AS te,
               min(i) AS start_index, max(i) AS end_index, count(*) AS duration, arg_min(thr, i) AS baseline, sum(c) AS total_auc,
               max(CASE WHEN peak THEN cum ELSE 0.0 END) AS auc_at_peak, sum(CASE WHEN seen = 0 THEN c ELSE 0.0 END) AS accumulation_before_peak,
               sum(CASE WHEN seen > 0 THEN c ELSE 0.0 END) AS accumulation_from_peak, sum(k * c) AS moment, max(half) AS half_accumulation_time
        FROM t4 GROUP BY user_id, wave),
    t6 AS (SELECT *, coalesce(started = 1 AND ts < ps AND ps < te AND accumulation_id < max(accumulation_id) OVER (PARTITION BY user_id), false) AS is_complete FROM t5),
    acc AS (
        SELECT *, CASE WHEN duration > 0 THEN total_auc / duration END AS accumulation_rate,
               CASE WHEN accumulation_before_peak + accumulation_from_peak > 0
                    THEN 1 - abs(accumulation_before_peak - accumulation_from_peak) / (accumulation_before_peak + accumulation_from_peak) END AS accumulation_symmetry,
               CASE WHEN total_auc <> 0 THEN moment / total_auc END AS centroid_time
        FROM t6 WHERE is_complete)"""


ACC_COLUMNS = "accumulation_id, is_complete, start_index, end_index, duration, half_accumulation_time, " + r("baseline", "total_auc", "auc_at_peak", "accumulation_before_peak", "accumulation_from_peak", "accumulation_rate", "accumulation_symmetry", "centroid_time")

#: The stand-in study: users as runs of faults, regimes by the sample index.
STUDY = waves(2) + objects() + """,
    study AS (
        SELECT user_id % 7 AS fault_number, user_id AS simulation_run, * EXCLUDE (user_id),
               CASE WHEN user_id % 7 = 0 THEN 0 ELSE (end_index >= 20)::INT END AS post_injection,
               CASE WHEN user_id % 7 = 0 THEN 0 ELSE (end_index >= 20 AND start_index <= 40)::INT END AS early_response,
               CASE WHEN user_id % 7 = 0 THEN 'fault_free' WHEN end_index < 20 THEN 'pre_injection' WHEN start_index <= 40 THEN 'early_response' ELSE 'post_response' END AS regime
        FROM obj)"""
EXACT = ("rise_duration", "fall_duration", "duration", "period", "amplitude")
CHARACTERIZED = STUDY + f""",
    long AS ({" UNION ALL ".join(f"SELECT fault_number, simulation_run, regime, '{p}' AS property, {p}::DOUBLE AS v FROM study WHERE regime <> 'fault_free'" for p in EXACT)}),
    med AS (SELECT fault_number, simulation_run, regime, property, count(v) AS n, median(v) AS m FROM long GROUP BY ALL),
    pairs AS (
        SELECT r.fault_number, r.simulation_run, r.regime, r.property, avg(sign(r.v - b.v)) AS avg_sign, sum(sign(r.v - b.v))::DOUBLE / count(*) AS cliffs_delta
        FROM long r JOIN long b ON r.fault_number = b.fault_number AND r.simulation_run = b.simulation_run AND r.property = b.property
             AND b.regime = 'pre_injection' AND r.regime <> 'pre_injection' AND r.v IS NOT NULL AND b.v IS NOT NULL
        GROUP BY ALL),
    chr AS (
        SELECT r.fault_number, r.simulation_run, r.regime, r.property, b.n AS baseline_count, r.n AS regime_count, b.m AS baseline_median, r.m AS regime_median,
               r.m - b.m AS median_difference, CASE WHEN b.m <> 0 THEN r.m / b.m END AS median_ratio,
               CASE WHEN r.m - b.m > 0 THEN 'increase' WHEN r.m - b.m < 0 THEN 'decrease' ELSE 'unchanged' END AS direction, cliffs_delta
        FROM med r JOIN med b ON r.fault_number = b.fault_number AND r.simulation_run = b.simulation_run AND r.property = b.property
             AND b.regime = 'pre_injection' AND r.regime <> 'pre_injection'
        LEFT JOIN pairs p ON p.fault_number = r.fault_number AND p.simulation_run = r.simulation_run AND p.regime = r.regime AND p.property = r.property)"""
REPRODUCED = CHARACTERIZED + """,
    rep0 AS (
        SELECT fault_number, regime, property, count(DISTINCT simulation_run) AS run_count, median(median_difference) AS median_difference, median(median_ratio) AS median_ratio,
               median(cliffs_delta) AS median_cliffs_delta, count(*) FILTER (direction = 'increase') AS inc, count(*) FILTER (direction = 'decrease') AS dec,
               count(*) FILTER (direction = 'unchanged') AS unc
        FROM chr GROUP BY ALL),
    rep1 AS (SELECT *, CASE WHEN median_difference > 0 THEN 'increase' WHEN median_difference < 0 THEN 'decrease' ELSE 'unchanged' END AS dominant_direction FROM rep0),
    rep2 AS (SELECT *, (CASE dominant_direction WHEN 'increase' THEN inc WHEN 'decrease' THEN dec ELSE unc END) / run_count AS direction_consistency FROM rep1),
    rep AS (
        SELECT *, abs(median_cliffs_delta) * direction_consistency AS behavioral_strength,
               dominant_direction <> 'unchanged' AND direction_consistency >= 0.8 AND coalesce(abs(median_cliffs_delta) >= 0.33, false) AS repeatable
        FROM rep2),
    sig AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fault_number, regime ORDER BY repeatable DESC, behavioral_strength DESC NULLS LAST, property)::INT AS signature_rank FROM rep)
        WHERE signature_rank <= 3)"""
REP_COLUMNS = "fault_number, regime, property, run_count, dominant_direction, repeatable, " + r("median_difference", "median_ratio", "direction_consistency", "median_cliffs_delta", "behavioral_strength")
