"""Quality rules with thresholds learnt from each language and source, in DataFrame functions alone.

Each document's counts give rates in thousandths. Their distribution per language and source is held in a sketch of
log-linear bins (whole numbers, 32 bins for each doubling, so a quantile is right to 1/32): a table of counts, that
merge by addition and don't depend on the order of rows. All limits are quantiles of those sketches: a rate's upper
limit leaves `tail` thousandths of the documents above it, and word length has a lower limit alike. Where the quartiles
lie apart, a limit is no farther out than `fence` times their distance, so that a source with much junk doesn't set its
limits by the junk. There are no fixed cutoffs; a limit is the outer end of its bin.
Sources with fewer than `least_rows` documents have their language's limits, and languages likewise those of all.
Documents are then filtered by a join with the limits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm import shared

_WS = r"[\x20\x09-\x0D]+"
#: Rates, in thousandths, that have an upper limit, and those that have a lower one too.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
LOWER = ("word_length",)
#: Quantiles that limits are made of, in thousandths; `tail` stands for the documents that a limit leaves out.
FENCE, TAIL, LEAST_ROWS = 3, 5, 100


def counts(docs: DataFrame) -> DataFrame:
    """docs with text -> its other columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    first = docs.select(
        *rest,
        F.array_remove(F.split(text, _WS), "").alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    shift = lambda k: F.slice("_words", F.lit(k + 1), F.greatest(n - 2, F.lit(0)))
    triples = F.arrays_zip(shift(0).alias("a"), shift(1).alias("b"), shift(2).alias("c"))
    hashed = F.transform(triples, lambda x, k: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), k.alias("k")))
    second = first.select(
        *rest,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(hashed).alias("_sorted"),
    )
    m = F.size("_sorted")
    none = F.array(F.lit(None).cast("struct<h:bigint,k:int>"))
    before = F.concat(none, F.slice("_sorted", F.lit(1), F.greatest(m - 1, F.lit(0))))
    after = F.slice("_sorted", F.lit(2), F.greatest(m - 1, F.lit(0)))
    near = F.arrays_zip(F.col("_sorted").alias("s"), before.alias("p"), after.alias("n"))
    same = F.filter(near, lambda x: (x["s"]["h"] == x["p"]["h"]) | (x["s"]["h"] == x["n"]["h"]))
    third = second.withColumn("_places", F.sort_array(F.transform(same, lambda x: x["s"]["k"]))).drop("_sorted")
    gaps = F.zip_with("_places", F.slice("_places", F.lit(2), F.greatest(F.size("_places") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)
    return third.withColumn("n_repeat_words", covered).drop("_places")


def rates() -> dict[str, Column]:
    share = lambda x, of: F.expr(f"CASE WHEN {of} > 0 THEN {x} * 1000 div {of} END")
    return {
        "symbol_rate": share("n_symbols", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def bin_of(value: str) -> Column:
    """The log-linear bin of a whole number: itself below 64, then 32 bins for each doubling."""
    e = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"CAST(32 * {e} + shiftright({value}, {e}) AS int)")


def bin_top(b: str) -> Column:
    """The largest number of a bin."""
    e = f"CAST(greatest({b} div 32 - 1, 0) AS int)"
    return F.expr(f"shiftleft(CAST({b} AS long) - 32 * {e} + 1, {e}) - 1")


def bin_bottom(b: str) -> Column:
    """The least number of a bin."""
    e = f"CAST(greatest({b} div 32 - 1, 0) AS int)"
    return F.expr(f"shiftleft(CAST({b} AS long) - 32 * {e}, {e})")


def sketch(rated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, bin, n: the mergeable sketches of all rates."""
    entries = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bin_of(r).alias("bin")) for r in RATES)))
    return rated.select(*keys, entries.alias("e")).select(*keys, "e.rate", "e.bin").where("bin IS NOT NULL").groupBy(*keys, "rate", "bin").agg(F.count("*").alias("n"))


def quantiles(sketched: DataFrame, keys: list[str], tail: int = TAIL) -> DataFrame:
    """keys, rate, rows, and of merged sketches q1, q3 (tops of the quartiles' bins), high (top of the bin that leaves at
    most `tail` thousandths above), low (bottom of the bin that leaves at most as many below)."""
    merged = sketched.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "rate")
    run = merged.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("rows", F.sum("n").over(by)).withColumn("top", bin_top("bin")).withColumn("bottom", bin_bottom("bin"))
    reach = lambda k: F.min(F.when(F.col("upto") * 1000 >= k * F.col("rows"), F.col("top")))
    low = F.min(F.when(F.col("upto") * 1000 > tail * F.col("rows"), F.col("bottom")))
    return run.groupBy(*keys, "rate").agg(F.max("rows").alias("rows"), reach(250).alias("q1"), reach(750).alias("q3"), reach(1000 - tail).alias("high"), low.alias("low"))


def limits(rated: DataFrame, fence: int = FENCE, tail: int = TAIL, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source and for each rate its upper (and word length's lower) limit, for every pair that there is."""
    fine = sketch(rated, ["lang", "source"])
    of = ("q1", "q3", "high", "low")
    own = quantiles(fine, ["lang", "source"], tail)
    lang = quantiles(fine, ["lang"], tail).select(F.col("lang").alias("l"), F.col("rate").alias("r"), *(F.col(c).alias(f"{c}_l") for c in ("rows", *of)))
    every = quantiles(fine, [], tail).select(F.col("rate").alias("ra"), *(F.col(c).alias(f"{c}_a") for c in of))
    joined = own.join(lang, own["lang"].eqNullSafe(F.col("l")) & (own["rate"] == F.col("r"))).join(every, F.col("rate") == F.col("ra"))
    pick = lambda q: F.when(F.col("rows") >= least_rows, F.col(q)).when(F.col("rows_l") >= least_rows, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    picked = joined.select("lang", "source", "rate", *(pick(q).alias(q) for q in of))
    width = F.when(F.col("q3") > F.col("q1"), fence * (F.col("q3") - F.col("q1")))  # null where quartiles are alike
    table = picked.select("lang", "source", "rate", F.least("high", F.col("q3") + width).alias("most"), F.greatest("low", F.col("q1") - width).alias("least"))
    values = [F.max(F.when(F.col("rate") == r, F.col("most"))).alias(f"most_{r}") for r in RATES]
    values += [F.max(F.when(F.col("rate") == r, F.col("least"))).alias(f"least_{r}") for r in LOWER]
    return table.groupBy("lang", "source").agg(*values)


def judge(docs: DataFrame, fence: int = FENCE, tail: int = TAIL, least_rows: int = LEAST_ROWS) -> DataFrame:
    """documents(doc_id, text, lang, source) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lang, source and the rates.

    Documents that fail the base rule (under 50 words, or over half of them in repeated windows) aren't kept and don't
    shape the limits. Null languages and sources are groups of their own. Repeated rows are judged alike; null text
    fails; an empty table gives no rows.
    """
    counted = counts(shared.text_only(docs, "doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rated = shared.stored(counted.withColumn("base_failed", failed).withColumns(rates()), "rates")
    found = limits(rated.where(~F.col("base_failed")), fence, tail, least_rows).withColumnsRenamed({"lang": "l", "source": "s"})
    both = rated.join(found, rated["lang"].eqNullSafe(F.col("l")) & rated["source"].eqNullSafe(F.col("s")), "left")
    good = [F.coalesce(F.col(r) <= F.col(f"most_{r}"), F.lit(True)) for r in RATES] + [F.coalesce(F.col(r) >= F.col(f"least_{r}"), F.lit(True)) for r in LOWER]
    kept = ~F.col("base_failed") & reduce(lambda a, b: a & b, good)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return both.select(*columns, kept.alias("kept"), "lang", "source", *RATES)
