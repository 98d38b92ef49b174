"""Analytics over object tables: regimes, segments, effect sizes, reproducibility, signatures, coverage, catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.operators import blocks, ranks
from undula.operators.frame import OrderedFrame
from undula.operators.oscillation import Oscillation
from undula.sources import scratch

#: Fixed names, in their order.
OBJECT_PROPERTIES = (
    "rise_duration", "fall_duration", "duration", "period", "amplitude", "rising_mean_rate", "falling_mean_rate", "peak_rise_rate", "peak_fall_rate", "temporal_symmetry",
)
RAW_FEATURES = ("raw_mean", "raw_std", "raw_min", "raw_max", "raw_range", "raw_start", "raw_end", "raw_delta", "raw_abs_delta")
REGIMES = ("pre_injection", "early_response", "post_response")
FAULT, RUN = "fault_number", "simulation_run"


def segment_statistics(frame: OrderedFrame, signal: str, wave_id: str) -> DataFrame:
    """The nine statistics of each wave's closed segment, that is its samples and the one before its first.

    Without a range join: each sample that begins a wave brings the value before it along."""
    g = frame.group
    with_before = frame.having({"_before": F.lag(signal).over(frame.w), "_wave_before": F.lag(wave_id).over(frame.w)})
    begins = F.col("_wave_before") != F.col(wave_id)
    x, i = F.col(signal), F.col(frame.index)
    entry = lambda at, value: F.struct(at.alias("i"), value.alias("x"))
    spread = with_before.keyed().withColumn("_values", F.when(begins, F.array(entry(i - 1, F.col("_before")), entry(i, x))).otherwise(F.array(entry(i, x))))
    values = spread.select(*g, wave_id, F.explode("_values").alias("v"))
    v, at = F.col("v.x"), F.when(F.col("v.x").isNotNull(), F.col("v.i"))
    stats = values.groupBy(*g, wave_id).agg(
        F.avg(v).alias("raw_mean"), F.stddev_pop(v).alias("raw_std"), F.min(v).alias("raw_min"), F.max(v).alias("raw_max"),
        F.min_by(v, at).alias("raw_start"), F.max_by(v, at).alias("raw_end"),
    )
    delta = F.col("raw_end") - F.col("raw_start")
    stats = stats.withColumns({"raw_range": F.col("raw_max") - F.col("raw_min"), "raw_delta": delta, "raw_abs_delta": F.abs(delta)})
    return stats.select(*g, wave_id, *RAW_FEATURES)


def regime_labels(fault_start: int, response_end: int, fault: Column | None = None) -> dict[str, Column]:
    """post_injection, early_response and regime of objects with start_index and end_index; fault 0 is fault-free."""
    if response_end <= fault_start:
        raise ValueError("response_end must be after fault_start")
    free = F.coalesce((F.col(FAULT) if fault is None else fault) == 0, F.lit(False))
    after, soon = F.col("end_index") >= fault_start, F.col("start_index") <= response_end
    regime = F.when(free, "fault_free").when(~after, REGIMES[0]).when(soon, REGIMES[1]).otherwise(REGIMES[2])
    return {"post_injection": (~free & after).cast("int"), "early_response": (~free & after & soon).cast("int"), "regime": regime}


def construct_examples(observations: DataFrame, signal: str, order_by, fault_start: int = 600, response_end: int = 1200, smooth_window: int = 20, diff_lag: int = 10, index: str | None = None) -> DataFrame:
    """Complete oscillations per fault and run with object and raw features, targets and regimes: all runs in one plan."""
    if response_end <= fault_start:
        raise ValueError("response_end must be after fault_start")
    o = Oscillation(signal, order_by, [FAULT, RUN], smooth_signal=True, smooth_window=smooth_window, diff_lag=diff_lag, index=index)
    frame = o.primitives(observations)
    raw = segment_statistics(frame, signal, f"{signal}_wave_id").withColumnRenamed(f"{signal}_wave_id", "oscillation_id")
    table = o._summary(frame, signal, False).table
    return table.join(raw, [FAULT, RUN, "oscillation_id"]).withColumns(regime_labels(fault_start, response_end))


def pooled_examples(tables: Sequence[DataFrame]) -> DataFrame:
    """All tables under one another, by column names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def cliffs_delta(df: DataFrame, value: str, side: str, keys: Sequence[str] = (), large: bool = False) -> DataFrame:
    """keys and delta = (pairs where comparison > reference, less those where it is <) over all pairs.

    side: true for the comparison. By mid-ranks, so no pairs are formed: distinct values are counted first and ranked
    by a running count. Nulls and NaN are left out; without rows on a side delta is null.
    large: groups have more distinct values than one task should order; they are ordered in ranges (see ranks)."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("_x")).agg(F.count_if(F.col(side)).alias("_c"), F.count_if(~F.col(side)).alias("_r"))
    n = F.col("_c") + F.col("_r")
    if large:
        rows = ranks.running(rows, keys, "_x", {"_upto": n})
    else:
        rows = rows.withColumn("_upto", F.sum(n).over(Window.partitionBy(*keys).orderBy("_x")))
    rank = F.col("_upto") - n + (n + 1) / 2
    sums = rows.withColumn("_rank", rank).groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_c")).alias("_s"), F.sum("_c").alias("_n"), F.sum("_r").alias("_m"))
    n, m = F.col("_n"), F.col("_m")
    return sums.select(*keys, F.when((n > 0) & (m > 0), (2 * F.col("_s") - n * (n + 1) - n * m) / (n * m)).alias("cliffs_delta"))


def unpivoted(objects: DataFrame, keys: Sequence[str], properties: Sequence[str]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("value")) for p in properties))
    return objects.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.property", "_e.value")


def characterize_regimes(objects: DataFrame, properties: Sequence[str] = OBJECT_PROPERTIES) -> DataFrame:
    """Per fault, run, response regime and property against the run's own pre_injection: counts, medians, difference,
    ratio (null over 0), direction (a missing difference is unchanged) and Cliff's delta. Runs lacking either side have
    no row. Null and NaN values aren't counted.

    Objects are read once: distinct values are counted by regime, and one running count of these over a run's property
    gives medians and mid-ranks of all regimes."""
    keys, base = [FAULT, RUN, "property"], REGIMES[0]
    long = unpivoted(objects.where(F.col("regime").isin(*REGIMES)), [FAULT, RUN, "regime"], properties).withColumn("value", F.nanvl("value", F.lit(None)))
    n = {r: F.col(f"_n_{r}") for r in REGIMES}
    counted = long.groupBy(*keys, "value").agg(*(F.count_if(F.col("regime") == r).alias(f"_rows_{r}") for r in REGIMES))
    counted = counted.withColumns({f"_n_{r}": F.when(F.col("value").isNotNull(), F.col(f"_rows_{r}")).otherwise(0) for r in REGIMES})
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumns({f"_upto_{r}": F.sum(n[r]).over(upto) for r in REGIMES} | {f"_all_{r}": F.sum(n[r]).over(whole) for r in REGIMES})

    def at(r: str, place: Column) -> Column:
        """The value in a place, from 0, of a regime's values in order."""
        return F.max(F.when((F.col(f"_upto_{r}") > place) & (F.col(f"_upto_{r}") - n[r] <= place), F.col("value")))

    def median(r: str) -> Column:
        last = F.col(f"_all_{r}") - 1
        return (0.5 * at(r, F.floor(last / 2)) + 0.5 * at(r, F.ceil(last / 2))).alias(f"_median_{r}")

    def wins(r: str) -> Column:
        """Twice the pairs in which the regime's value is greater than the baseline's, and ties once, over all pairs."""
        below = F.col(f"_upto_{base}") - n[base]
        return F.sum(n[r] * (2 * below + n[base])).alias(f"_wins_{r}")

    made = counted.groupBy(*keys).agg(
        *(F.sum(f"_rows_{r}").alias(f"_rows_{r}") for r in REGIMES), *(F.sum(n[r]).alias(f"_n_{r}") for r in REGIMES), *map(median, REGIMES), *map(wins, REGIMES[1:])
    )
    each = F.array(*(F.struct(F.lit(r).alias("regime"), F.col(f"_rows_{r}").alias("rows"), n[r].alias("regime_count"), F.col(f"_median_{r}").alias("regime_median"), F.col(f"_wins_{r}").alias("wins")) for r in REGIMES[1:]))
    both = made.where(F.col(f"_rows_{base}") > 0).select(*keys, n[base].alias("baseline_count"), F.col(f"_median_{base}").alias("baseline_median"), F.inline(each)).where("rows > 0")
    difference, pairs = F.col("regime_median") - F.col("baseline_median"), F.col("regime_count") * F.col("baseline_count")
    return both.select(
        FAULT, RUN, "regime", "property", "baseline_count", "regime_count", "baseline_median", "regime_median",
        difference.alias("median_difference"),
        F.when(F.col("baseline_median") != 0, F.col("regime_median") / F.col("baseline_median")).alias("median_ratio"),
        F.when(difference > 0, "increase").when(difference < 0, "decrease").otherwise("unchanged").alias("direction"),
        F.when(pairs > 0, (F.col("wins") - pairs) / pairs).alias("cliffs_delta"),
    )


def summarize_reproducibility(characterized: DataFrame, consistency: float = 0.80, effect: float = 0.33) -> DataFrame:
    """Per fault, regime and property over runs: dominant direction, how many runs agree, effect and strength."""
    keys = [FAULT, "regime", "property"]
    runs = characterized.groupBy(*keys).agg(
        F.count_distinct(RUN).alias("run_count"), F.median("median_difference").alias("median_difference"), F.median("median_ratio").alias("median_ratio"),
        F.median("cliffs_delta").alias("median_cliffs_delta"),
        *(F.count_if(F.col("direction") == d).alias(f"_{d}") for d in ("increase", "decrease", "unchanged")),
    )
    d = F.col("median_difference")
    runs = runs.withColumn("dominant_direction", F.when(d > 0, "increase").when(d < 0, "decrease").otherwise("unchanged"))
    agree = F.when(F.col("dominant_direction") == "increase", F.col("_increase")).when(F.col("dominant_direction") == "decrease", F.col("_decrease")).otherwise(F.col("_unchanged"))
    runs = runs.withColumn("direction_consistency", agree / F.col("run_count"))
    size = F.abs("median_cliffs_delta")
    repeatable = (F.col("dominant_direction") != "unchanged") & (F.col("direction_consistency") >= consistency) & F.coalesce(size >= effect, F.lit(False))
    return runs.select(*keys, "run_count", "median_difference", "median_ratio", "dominant_direction", "direction_consistency", "median_cliffs_delta", (size * F.col("direction_consistency")).alias("behavioral_strength"), repeatable.alias("repeatable"))


def build_signatures(reproducibility: DataFrame, properties_per_regime: int = 3) -> DataFrame:
    """The strongest properties of each fault and regime, repeatable ones first; ties by name."""
    w = Window.partitionBy(FAULT, "regime").orderBy(F.col("repeatable").desc(), F.col("behavioral_strength").desc_nulls_last(), "property")
    return reproducibility.withColumn("signature_rank", F.row_number().over(w)).where(F.col("signature_rank") <= properties_per_regime)


def summarize_coverage(objects: DataFrame, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Every fault, run and regime with its number of objects, 0 where there is none."""
    every = objects.select(FAULT, RUN).distinct().withColumn("regime", F.explode(F.array(*map(F.lit, regimes))))
    counts = objects.groupBy(FAULT, RUN, "regime").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.join(counts, [FAULT, RUN, "regime"], "left").select(FAULT, RUN, "regime", n.alias("object_count"), (n > 0).alias("covered"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group in an order that should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def catalog(objects: DataFrame, reproducibility: DataFrame, signatures: DataFrame) -> dict[str, tuple[str, str, DataFrame]]:
    """Ten questions: id -> question, source table, answer."""
    early = objects.where(F.col("regime") == REGIMES[1])
    order = [RUN, "oscillation_id"]

    def extreme(p: str) -> DataFrame:
        return first_by(objects.where(F.col(p).isNotNull()), [FAULT], [F.col(p).desc(), *order]).select(FAULT, *order, p)

    def greatest(regime: str) -> DataFrame:
        mine = reproducibility.where((F.col("regime") == regime) & (F.col("property") == "amplitude") & F.col("median_difference").isNotNull())
        return mine.orderBy(F.col("median_difference").desc(), FAULT).limit(1).select(FAULT, "median_difference", "direction_consistency")

    def repeatable(p: str, direction: str) -> DataFrame:
        mine = reproducibility.where((F.col("property") == p) & F.col("repeatable") & (F.col("dominant_direction") == direction))
        return mine.select(FAULT, "regime", "direction_consistency", "median_cliffs_delta")

    def strongest(regime: str) -> DataFrame:
        mine = signatures.where((F.col("regime") == regime) & (F.col("signature_rank") == 1))
        return mine.select(FAULT, "property", "dominant_direction", "behavioral_strength", "repeatable")

    return {
        "Q01": ("Which oscillation of each fault has the largest amplitude?", "objects", extreme("amplitude")),
        "Q02": ("Which oscillation of each fault lasts longest?", "objects", extreme("duration")),
        "Q03": ("Which object of each run is the first to end in the early response?", "objects", first_by(early, [FAULT, RUN], ["end_index", "oscillation_id"]).select(FAULT, RUN, "oscillation_id", "start_index", "end_index")),
        "Q04": ("How many objects has each fault in each regime?", "objects", objects.groupBy(FAULT, "regime").agg(F.count("*").alias("object_count"))),
        "Q05": ("Which fault's amplitude grows most in the early response?", "reproducibility", greatest(REGIMES[1])),
        "Q06": ("Which fault's amplitude grows most after the response?", "reproducibility", greatest(REGIMES[2])),
        "Q07": ("Where does the period grow repeatably?", "reproducibility", repeatable("period", "increase")),
        "Q08": ("Where does temporal symmetry fall repeatably?", "reproducibility", repeatable("temporal_symmetry", "decrease")),
        "Q09": ("What is each fault's strongest early signature?", "signatures", strongest(REGIMES[1])),
        "Q10": ("What is each fault's strongest lasting signature?", "signatures", strongest(REGIMES[2])),
    }


def audit(objects: DataFrame, reproducibility: DataFrame, signatures: DataFrame) -> DataFrame:
    """query_id, question, source_table, source_rows, result_rows, answered, empty_result, of the whole catalogue.

    The ten questions read the three tables some twenty times, so those are stored first, when this is called; then one
    plan counts everything."""
    sources = {"objects": scratch.stored(objects, "objects"), "reproducibility": scratch.stored(reproducibility, "reproducibility"), "signatures": scratch.stored(signatures, "signatures")}
    out = None
    for name, (question, source, answer) in catalog(*sources.values()).items():
        rows = sources[source].agg(F.count("*").alias("source_rows")).join(answer.agg(F.count("*").alias("result_rows")))  # one row each
        row = rows.select(F.lit(name).alias("query_id"), F.lit(question).alias("question"), F.lit(source).alias("source_table"), "source_rows", "result_rows", F.lit(True).alias("answered"), (F.col("result_rows") == 0).alias("empty_result"))
        out = row if out is None else out.unionByName(row)
    return out


def run_audit(objects: DataFrame) -> dict[str, DataFrame]:
    characterized = characterize_regimes(objects)
    reproducibility = summarize_reproducibility(characterized)
    signatures = build_signatures(reproducibility)
    return {
        "object_coverage": summarize_coverage(objects), "regime_characterization": characterized, "cross_run_reproducibility": reproducibility,
        "behavioral_signatures": signatures, "query_audit": audit(objects, reproducibility, signatures),
    }


# ---- what figures need ----


def box_plot(objects: DataFrame, value: str = "amplitude", keys: Sequence[str] = (FAULT, "regime"), large: bool = False) -> DataFrame:
    """Whiskers (5, 95 %), quartiles and median of log10(1 + value). large: by radix selection (see ranks)."""
    x, shares = F.log10(1 + F.col(value)), (0.05, 0.25, 0.5, 0.75, 0.95)
    there = objects.where(F.col(value).isNotNull())
    if large:
        made = ranks.quantiles(there.select(*keys, x.alias("_x")), "_x", keys, shares, "q")
    else:
        made = there.groupBy(*keys).agg(F.percentile(x, F.array(*map(F.lit, shares))).alias("q"))
    return made.select(*keys, *(F.col("q")[k].alias(n) for k, n in enumerate(("whisker_low", "q1", "median", "q3", "whisker_high"))))


def pixel_columns(df: DataFrame, x: str, y: str, columns: int, keys: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """What a line plot of any number of samples needs: for each of `columns` pixels across and each key the first, last,
    least and greatest sample, (x, y) each, and the number of samples. A plot of these has the pixels of a plot of all.

    low, high: the range across, by default that of x; samples beyond it are left out. Samples with a null or NaN are too.
    Ties go to the lesser x. One aggregate; its rows are as many as pixels and keys."""
    at, value = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*keys, F.nanvl(at, F.lit(None)).alias("_x"), F.nanvl(value, F.lit(None)).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    ends = rows.agg(F.coalesce(F.lit(low), F.min("_x")).cast("double").alias("_low"), F.coalesce(F.lit(high), F.max("_x")).cast("double").alias("_high"))
    rows = rows.join(F.broadcast(ends)).where("_x BETWEEN _low AND _high")  # ends is one row
    share = (F.col("_x") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    rows = rows.withColumn("pixel", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * columns), F.lit(columns - 1)).cast("long"))
    pick = {"first": F.min(F.struct("_x", "_y")), "last": F.max(F.struct("_x", (-F.col("_y")).alias("n"), "_y")), "least": F.min(F.struct("_y", "_x")), "greatest": F.max(F.struct("_y", (-F.col("_x")).alias("n"), "_x"))}
    made = rows.groupBy(*keys, "pixel").agg(F.count("*").alias("samples"), *(v.alias(f"_{k}") for k, v in pick.items()))
    return made.select(*keys, "pixel", "samples", *(F.col(f"_{k}._{c}").alias(f"{k}_{c}") for k in pick for c in ("x", "y")))


def property_matrix(reproducibility: DataFrame, regime: str, properties: Sequence[str] = OBJECT_PROPERTIES) -> DataFrame:
    """Signed strength per fault (rows) and property (columns), null where there is no row."""
    signed = F.when(F.col("dominant_direction") == "decrease", -F.col("behavioral_strength")).otherwise(F.col("behavioral_strength"))
    return reproducibility.where(F.col("regime") == regime).groupBy(FAULT).pivot("property", list(properties)).agg(F.first(signed))


def in_window(objects: DataFrame, low: int = 500, high: int = 1250) -> DataFrame:
    """Objects that overlap a closed window, by start."""
    return objects.where((F.col("end_index") >= low) & (F.col("start_index") <= high)).orderBy("start_index")


def regime_medians(objects: DataFrame, properties: Sequence[str], keys: Sequence[str] = (FAULT, "regime"), digits: int = 4, large: bool = False) -> DataFrame:
    """The median of each property by keys. large: by radix selection (see ranks), of all properties in one pass a digit."""
    if not large:
        return objects.groupBy(*keys).agg(*(F.round(F.median(p), digits).alias(p) for p in properties))
    each = ranks.medians(unpivoted(objects, keys, properties), "value", [*keys, "property"])
    return each.groupBy(*keys).pivot("property", list(properties)).agg(F.round(F.first("median"), digits))


def summary_text(objects: DataFrame, keys: Sequence[str], samples_per_second: float = 1.0) -> DataFrame:
    """Per group the number, rate, mean period, amplitude and symmetry of complete objects, and a sentence of them."""
    whole = objects.where("is_complete")
    s = whole.groupBy(*keys).agg(F.count("*").alias("object_count"), F.avg("period").alias("mean_period"), F.avg("amplitude").alias("mean_amplitude"), F.avg("temporal_symmetry").alias("mean_symmetry"), (F.max("end_index") - F.min("start_index")).alias("_span"))
    s = s.withColumn("rate_per_minute", F.when(F.col("_span") > 0, 60.0 * samples_per_second * F.col("object_count") / F.col("_span"))).drop("_span")
    text = F.format_string("%d complete oscillations; %.2f per minute; mean period %.2f samples, amplitude %.4f, symmetry %.3f", "object_count", *(F.coalesce(c, F.lit(0.0)) for c in ("rate_per_minute", "mean_period", "mean_amplitude", "mean_symmetry")))
    return s.withColumn("summary", text)


# ---- checks of object tables ----


def validate_object_tables(oscillations: DataFrame, accumulations: DataFrame, keys: Sequence[str]) -> None:
    """RuntimeError unless both tables have complete objects alone, ordered bounds, fitting durations and equal keys."""
    o = oscillations.agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_complete")).alias("partial"),
        F.count_if(~((F.col("start_index") < F.col("peak_index")) & (F.col("peak_index") < F.col("end_index")))).alias("order"),
        F.count_if((F.col("rise_duration") + F.col("fall_duration") != F.col("duration")) | (F.col("end_index") - F.col("start_index") != F.col("duration"))).alias("length"),
    ).first()
    a = accumulations.agg(F.count("*").alias("n"), F.count_if(~F.col("is_complete")).alias("partial"), F.count_if(F.col("start_index") > F.col("end_index")).alias("order")).first()
    for what, row in (("oscillation", o), ("accumulation", a)):
        if not row["n"]:
            raise RuntimeError(f"no {what} objects")
        if row["partial"]:
            raise RuntimeError(f"{row['partial']} partial {what} objects")
        if row["order"]:
            raise RuntimeError(f"{row['order']} {what} objects have bounds out of order")
    if o["length"]:
        raise RuntimeError(f"{o['length']} oscillations have durations that don't fit their bounds")
    if key_difference(oscillations, accumulations, keys).limit(1).count():
        raise RuntimeError("oscillations and accumulations have different keys")


def key_difference(oscillations: DataFrame, accumulations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ids that one of two tables lacks."""
    o = oscillations.select(*keys, F.col("oscillation_id").alias("object_id"))
    a = accumulations.select(*keys, F.col("accumulation_id").alias("object_id"))
    on = [*keys, "object_id"]
    return o.join(a, on, "left_anti").withColumn("only_in", F.lit("oscillation")).unionByName(a.join(o, on, "left_anti").withColumn("only_in", F.lit("accumulation")))


def representative(oscillations: DataFrame, frame: OrderedFrame, signal: str, tolerance: float = 1e-9) -> DataFrame:
    """The oscillation of the largest amplitude (ties: least id), checked against its samples; RuntimeError if its peak
    isn't the segment's maximum or an end isn't lower."""
    top = oscillations.orderBy(F.col("amplitude").desc_nulls_last(), *frame.group, "oscillation_id").limit(1)
    samples = frame.df.select(*frame.group, F.col(frame.index).alias("_i"), F.col(signal).alias("_x"))
    inside = samples.join(F.broadcast(top), frame.group) if frame.group else samples.join(F.broadcast(top))  # top is one row
    inside = inside.where(F.col("_i").between(F.col("start_index"), F.col("end_index")))
    at = lambda c: F.max(F.when(F.col("_i") == F.col(c), F.col("_x")))
    row = inside.agg(F.max("_x").alias("top"), at("peak_index").alias("peak"), at("start_index").alias("start"), at("end_index").alias("end")).first()
    if row["peak"] is None or abs(row["peak"] - row["top"]) > tolerance * abs(row["top"]) or row["start"] is None or row["end"] is None or not (row["start"] < row["peak"] and row["end"] < row["peak"]):
        raise RuntimeError("the representative oscillation doesn't fit its samples")
    return top


# ---- curves ----


def curve_areas(curves: DataFrame, keys: Sequence[str], x: str = "step", y: str = "mean_return") -> DataFrame:
    """Trapezoid area over span of each curve; null where the span is 0."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    span = F.max(x) - F.min(x)
    return curves.withColumn("_part", part).groupBy(*keys).agg(F.when(span > 0, F.sum("_part") / span).alias("area"))


def paired_differences(areas: DataFrame, keys: Sequence[str], baseline: str = "raw", pair: str = "seed", side: str = "representation") -> DataFrame:
    """Each candidate's area less the baseline's of the same seed; ValueError if a seed is there twice on a side."""
    twice = areas.groupBy(*keys, pair, side).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{pair} is not unique")
    base = areas.where(F.col(side) == baseline).select(*keys, pair, F.col("area").alias("baseline_area"))
    return areas.where(F.col(side) != baseline).join(base, [*keys, pair]).withColumn("difference", F.col("area") - F.col("baseline_area"))


def drawn_number(resample: Column, place: Column, seed: int) -> Column:
    """A number below 2**31 - 1 for each place of each resample."""
    prime = F.lit((1 << 31) - 1).cast("long")
    z = (resample * 48_271 + place * 69_621 + F.lit(seed).cast("long") * 39_373) % prime
    z = (z * z + place * 16_807) % prime
    return (z * z + resample * 630_360) % prime


def bootstrap(differences: DataFrame, keys: Sequence[str], samples: int = 10_000, seed: int = 1729, large: bool = False) -> DataFrame:
    """Per group: pairs, mean, median, and the 2.5 and 97.5 % of the means of `samples` resamples.

    A resample's draws are whole-number arithmetic on its number and the place drawn for (modulo the prime 2**31 - 1), so
    they are the same on every run and machine, and in SQL. A group is the seeds of an experiment, a few dozen, in one row.
    large: groups may be of any size; differences are numbered in ranges, each draw is a row and is joined to the difference
    in its place."""
    if large:
        return _bootstrap_of_rows(differences, list(keys), samples, seed)
    rows = differences.groupBy(*keys).agg(F.array_sort(F.collect_list("difference")).alias("_d"), F.count("*").alias("pairs"), F.avg("difference").alias("mean_difference"), F.median("difference").alias("median_difference"))
    drawn = rows.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    pick = F.transform(F.sequence(F.lit(1), F.size("_d")), lambda k: F.element_at("_d", (drawn_number(F.col("_b").cast("long"), k.cast("long"), seed) % F.size("_d") + 1).cast("int")))
    drawn = drawn.withColumn("_m", F.aggregate(pick, F.lit(0.0), lambda a, x: a + x) / F.size("_d"))
    firsts = [F.first(c).alias(c) for c in ("pairs", "mean_difference", "median_difference")]
    return _interval(drawn, keys, firsts)


def _interval(means: DataFrame, keys: Sequence[str], firsts: Sequence[Column]) -> DataFrame:
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(*firsts, q.alias("_q")).select(*keys, "pairs", "mean_difference", "median_difference", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def _bootstrap_of_rows(differences: DataFrame, keys: list[str], samples: int, seed: int) -> DataFrame:
    there = differences.where(F.col("difference").isNotNull()).select(*keys, "difference")
    placed = scratch.stored(blocks.numbered(there, ["difference"], keys, "_slot"), "placed")
    size = placed.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg("difference").alias("mean_difference"))
    size = scratch.stored(ranks.joined(size, ranks.medians(placed, "difference", keys, "median_difference").drop("n"), keys), "sizes")
    each = ranks.joined(placed.select(*keys, (F.col("_slot") + 1).alias("_k")), size.select(*keys, "pairs"), keys)
    each = each.withColumn("_b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(samples).cast("long"))))
    draws = each.select(*keys, "_b", (drawn_number(F.col("_b"), F.col("_k"), seed) % F.col("pairs")).alias("_slot"))
    means = ranks.joined(draws, placed, [*keys, "_slot"]).groupBy(*keys, "_b").agg(F.avg("difference").alias("_m"))
    firsts = [F.first(c).alias(c) for c in ("pairs", "mean_difference", "median_difference")]
    return _interval(ranks.joined(means, size, keys), keys, firsts)
