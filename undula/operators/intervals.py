"""Interval joins by dyadic nodes or equal buckets, episodes, and one-to-one matching of intervals."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import events
from undula.operators.frame import OrderedFrame
from undula.sources import scratch

log = logging.getLogger(__name__)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: int | None = None) -> DataFrame:
    """Pairs with equal keys whose closed spans overlap, each once. Columns other than the keys must differ in name. Null
    ends overlap nothing, nor does a span that ends before it starts.

    Spans of whole numbers, of any length: of two spans that overlap, one begins within the other. A span is covered by
    dyadic nodes, at most two a level, and a beginning lies in one node a level, so begins meet the spans around them in an
    equi-join on keys, level and node, without a pair that doesn't overlap.
    bucket: spans, of about that length each, are spread over buckets of that width instead, which makes fewer rows where
    none is much longer; their ends may be any numbers."""
    (ls, le), (rs, re) = left_span, right_span
    if bucket is None:
        apart = right.withColumnsRenamed({k: f"_of_{k}" for k in on})
        same = [F.col(k) == F.col(f"_of_{k}") for k in on] + [F.col("_level") == F.col("_point_level"), F.col("_node") == F.col("_point_node")]
        left_around = nodes(left, ls, le).join(_begins(left, ls, le, apart, rs, re), same)
        right_around = nodes(apart, rs, re, 1).join(_begins(apart, rs, re, left, ls, le), same)
        columns = [*left.columns, *(c for c in right.columns if c not in on)]
        return left_around.select(*columns).unionByName(right_around.select(*columns))

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        cut = lambda c: F.floor(F.col(c) / F.lit(bucket))
        return df.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(cut(start), cut(end))))

    both = spread(left, ls, le).join(spread(right, rs, re), [*on, "_bucket"])
    meets = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))
    return both.where(meets & (F.col("_bucket") == F.floor(F.greatest(ls, rs) / F.lit(bucket)))).drop("_bucket")


def _levels(length: Column) -> Column:
    """The levels that nodes of a span of that many samples can have, from 0."""
    return F.sequence(F.lit(0), F.length(F.bin(length)) - 1)


def nodes(df: DataFrame, start: str, end: str, after: int = 0) -> DataFrame:
    """A row for each dyadic node (_level, _node) of the spans from start + after to end: node k of level n holds the
    samples from k * 2**n on, 2**n of them. The nodes of a span are apart and make it up."""
    first, length = F.col(start).cast("long") + after, F.col(end).cast("long") - F.col(start).cast("long") + 1 - after
    spans = df.withColumns({"_first": first, "_upto": F.col(end).cast("long") + 1}).where((F.col("_first") < F.col("_upto")) & (length > 0))
    each = spans.withColumn("_level", F.explode(_levels(length)))
    each = each.withColumns({"_l": F.expr("-shiftright(-_first, _level)"), "_r": F.expr("shiftright(_upto, _level)")}).where("_l < _r")
    own = F.array_compact(F.array(F.when(F.col("_l").bitwiseAND(1) == 1, F.col("_l")), F.when(F.col("_r").bitwiseAND(1) == 1, F.col("_r") - 1)))
    return each.withColumn("_node", F.explode(own)).drop("_first", "_upto", "_l", "_r")


def _begins(spans: DataFrame, start: str, end: str, points: DataFrame, at: str, upto: str) -> DataFrame:
    """points, spans themselves, with the node of each level that they begin in, up to the largest level that spans have."""
    most = spans.where(F.col(start) <= F.col(end)).agg(F.coalesce(F.max(F.col(end) - F.col(start)) + 1, F.lit(1)).cast("long").alias("_most"))
    each = points.where(F.col(at) <= F.col(upto)).join(F.broadcast(most)).withColumn("_point_level", F.explode(_levels(F.col("_most"))))  # most is one row
    return each.withColumn("_point_node", F.expr(f"shiftright(cast(`{at}` as bigint), _point_level)")).drop("_most")


def episodes(frame: OrderedFrame, state: Column, measures: dict[str, Column]) -> DataFrame:
    """Runs of a state: group, episode_id, first_index, last_index, samples and measures (aggregates of its samples)."""
    numbered = frame.having({"_on": state}).having({"_enter": events.enter_mask(F.col("_on"), frame.w)}).having({"episode_id": events.number(F.col("_enter"), frame.w)})
    on = numbered.keyed().where("_on")
    return on.groupBy(*frame.group, "episode_id").agg(F.min(frame.index).alias("first_index"), F.max(frame.index).alias("last_index"), F.count("*").alias("samples"), *(v.alias(k) for k, v in measures.items()))


def iou(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Shared over joint length of two closed spans of samples."""
    shared = F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1, F.lit(0))
    joint = F.greatest(a[1], b[1]) - F.least(a[0], b[0]) + 1
    return shared / joint


def match(found: DataFrame, true: DataFrame, on: Sequence[str], peak_tolerance: int = 10, least_iou: float = 0.5, bucket: int | None = None) -> DataFrame:
    """One-to-one matches of found(found_id, found_start, found_peak, found_end) and true(true_...): peaks at most
    peak_tolerance apart and IoU at least least_iou. Best pairs first, by IoU, then ids, until none is left.

    A pair is taken if no better pair of either side is. In each round pairs without a better one are taken; those with a
    single better one are taken or not as that one isn't or is, which is looked up along whole chains by doubling. So a
    chain of n pairs, each hanging on the next, is one round of about log2(n) joins. Rounds run when this is called; what
    they read again is stored in scratch tables, so plans don't grow."""
    pairs = overlap_join(found, true, on, ("found_start", "found_end"), ("true_start", "true_end"), bucket)
    pairs = pairs.withColumn("iou", iou(("found_start", "found_end"), ("true_start", "true_end")))
    pairs = scratch.stored(pairs.where((F.abs(F.col("found_peak") - F.col("true_peak")) <= peak_tolerance) & (F.col("iou") >= least_iou)), "pairs")
    order, ids = [F.col("iou").desc(), "found_id", "true_id"], [*on, "found_id", "true_id"]
    done, rounds, joins = None, 0, 0
    while True:  # the best pair of all has no better one, so each round takes one or more
        rounds += 1
        f, t = (Window.partitionBy(*on, side).orderBy(*order) for side in ("found_id", "true_id"))
        ranked = pairs.withColumns({"_f": F.row_number().over(f), "_t": F.row_number().over(t), "_before_f": F.lag("true_id").over(f), "_before_t": F.lag("found_id").over(t)})
        ranked = scratch.stored(ranked.withColumn("_better", F.col("_f") + F.col("_t") - 2).where("_better < 2"), "ranked")
        best = ranked.where("_better = 0").select(*ids)
        chain = ranked.where("_better = 1").select(*ids, F.coalesce("_before_t", "found_id").alias("_up_f"), F.coalesce("_before_f", "true_id").alias("_up_t"), F.lit(True).alias("_not"))
        chain, more = scratch.stored(chain, "chain"), not chain.isEmpty()
        while more:
            up = chain.select(*on, F.col("found_id").alias("_up_f"), F.col("true_id").alias("_up_t"), F.col("_up_f").alias("_far_f"), F.col("_up_t").alias("_far_t"), F.col("_not").alias("_far_not"))
            longer = chain.join(up, [*on, "_up_f", "_up_t"], "left")
            longer = longer.select(*ids, F.coalesce("_far_f", "_up_f").alias("_up_f"), F.coalesce("_far_t", "_up_t").alias("_up_t"), (F.col("_not") != F.coalesce("_far_not", F.lit(False))).alias("_not"), F.col("_far_f").isNotNull().alias("_went"))
            chain, joins = scratch.stored(longer, "chain"), joins + 1
            more = not chain.where("_went").isEmpty()
        roots = best.select(*on, F.col("found_id").alias("_up_f"), F.col("true_id").alias("_up_t"))
        alternate = chain.where("NOT _not").join(roots, [*on, "_up_f", "_up_t"], "left_semi").select(*ids)
        taken = scratch.stored(pairs.join(best.unionByName(alternate), ids, "left_semi"), "taken")
        done = taken if done is None else done.unionByName(taken)
        pairs = scratch.stored(pairs.join(taken.select(*on, "found_id"), [*on, "found_id"], "left_anti").join(taken.select(*on, "true_id"), [*on, "true_id"], "left_anti"), "pairs")
        if pairs.isEmpty():
            log.info("matched in %d rounds, %d joins along chains", rounds, joins)
            return done


def recovery_scores(found: DataFrame, true: DataFrame, on: Sequence[str], keys: Sequence[str], **options) -> DataFrame:
    """Per keys (some of on): true, found and matched objects, precision, recall, F1, mean IoU of matches, and mean
    absolute errors of start, peak, end and duration. Spans as in match()."""
    matched = match(found, true, on, **options)
    off = lambda c: F.avg(F.abs(F.col(f"found_{c}") - F.col(f"true_{c}"))).alias(f"{c}_mae")
    length = F.avg(F.abs((F.col("found_end") - F.col("found_start")) - (F.col("true_end") - F.col("true_start")))).alias("duration_mae")
    hits = matched.groupBy(*keys).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"), off("start"), off("peak"), off("end"), length)
    out = true.groupBy(*keys).agg(F.count("*").alias("true_objects")).join(found.groupBy(*keys).agg(F.count("*").alias("found_objects")), list(keys), "left").join(hits, list(keys), "left")
    out = out.fillna(0, ["found_objects", "matched"])
    p, q = F.col("matched") / F.nullif("found_objects", F.lit(0)), F.col("matched") / F.col("true_objects")
    out = out.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": q})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def mean_interval(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, n, mean, std (of the sample) and half the width of the 95 % interval, 1.96 std / sqrt(n)."""
    rows = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return rows.withColumn("half_width", 1.96 * F.col("std") / F.sqrt("n"))
