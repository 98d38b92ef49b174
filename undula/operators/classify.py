"""Held-out evaluation of representations by logistic regression, and exact ranking metrics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.operators import newton, ranks
from undula.operators.analytics import FAULT, OBJECT_PROPERTIES, RAW_FEATURES, RUN
from undula.sources import scratch

TARGETS = ("post_injection", "early_response")
REPRESENTATIONS: Mapping[str, Sequence[str]] = {"raw_context": RAW_FEATURES, "objects": OBJECT_PROPERTIES, "combined": (*RAW_FEATURES, *OBJECT_PROPERTIES)}
KEYS = (FAULT, RUN, "oscillation_id", "start_index", "peak_index", "end_index", "regime")


def ranking_metrics(scored: DataFrame, keys: Sequence[str], label: str = "label", score: str = "probability", large: bool = False) -> DataFrame:
    """keys, roc_auc and average_precision, exact: equal scores share a threshold. Null where a class is missing.

    large: groups have more distinct scores than one task should order; they are ordered in ranges (see ranks)."""
    keys = list(keys)
    by = scored.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    both = {"_tp": F.col("_p"), "_all": F.col("_n")}
    if large:
        up = ranks.running(by, keys, score, both)
    else:
        w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
        up = by.withColumns({k: F.sum(v).over(w) for k, v in both.items()})
    totals = by.groupBy(*keys).agg(F.sum("_p").alias("_positive"), F.sum("_n").alias("_rows"))
    up = ranks.joined(up, totals, keys)
    p, n = F.col("_positive"), F.col("_rows") - F.col("_positive")
    below = F.col("_all") - F.col("_tp") - (F.col("_n") - F.col("_p"))  # negatives of lower scores
    wins = F.sum(F.col("_p") * (below + (F.col("_n") - F.col("_p")) / 2))
    above, positive_above = F.col("_rows") - F.col("_all") + F.col("_n"), p - F.col("_tp") + F.col("_p")  # at this threshold
    made = up.groupBy(*keys).agg(wins.alias("_wins"), F.sum(F.col("_p") * positive_above / above).alias("_precision"), F.max("_positive").alias("_positive"), F.max("_rows").alias("_rows"))
    return made.select(*keys, F.when((p > 0) & (n > 0), F.col("_wins") / (p * n)).alias("roc_auc"), F.when(p > 0, F.col("_precision") / p).alias("average_precision"))


def threshold_metrics(scored: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """keys, balanced_accuracy, sensitivity and specificity."""
    positive, right = F.col(label) == 1, F.col(label) == F.col(prediction)
    made = scored.groupBy(*keys).agg(
        F.when(F.count_if(positive) > 0, F.count_if(positive & right) / F.count_if(positive)).alias("sensitivity"),
        F.when(F.count_if(~positive) > 0, F.count_if(~positive & right) / F.count_if(~positive)).alias("specificity"),
    )
    return made.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def detection_delay(predicted: DataFrame, keys: Sequence[str], fault_start: int = 600) -> DataFrame:
    """keys and the median over runs of the first detected end after fault_start, less fault_start, at least 0."""
    found = predicted.where((F.col("end_index") >= fault_start) & (F.col("prediction") == 1))
    runs = found.groupBy(*keys, RUN).agg(F.greatest(F.min("end_index") - fault_start, F.lit(0)).alias("_delay"))
    return runs.groupBy(*keys).agg(F.median("_delay").alias("median_detection_delay_samples"))


@dataclass(frozen=True)
class Fitted:
    """What is learnt of training rows: for each feature its median, mean and deviation, and the regression."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    regression: object

    def vectors(self, df: DataFrame) -> DataFrame:
        """df with _features: missing values filled, then scaled."""
        from pyspark.ml.functions import array_to_vector

        parts = zip(self.features, self.medians, self.means, self.deviations, strict=True)
        return df.withColumn("_features", array_to_vector(F.array(*((_filled(f, m) - F.lit(mean)) / F.lit(s) for f, m, mean, s in parts))))


def _filled(feature: str, median: float):
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(None)), F.lit(median))


def fit(train: DataFrame, target: str, features: Sequence[str], c: float = 1.0) -> Fitted:
    """Exact medians for missing values (0 where a feature has none), scaling by the population's deviation (1 where it
    is 0), and an L2 logistic regression with balanced classes."""
    from pyspark.ml.classification import LogisticRegression

    features = tuple(features)
    first = train.agg(F.count("*").alias("_n"), F.sum(target).alias("_p"), *(F.median(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f) for f in features)).first()
    n, p = first["_n"], first["_p"] or 0
    if p in (0, n):
        raise ValueError(f"{target}: rows of either class are needed to fit a model, here {p} of {n} are positive")
    medians = tuple(0.0 if first[f] is None else float(first[f]) for f in features)
    filled = [_filled(f, m) for f, m in zip(features, medians, strict=True)]
    second = train.agg(*(F.avg(x).alias(f"m{k}") for k, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(filled))).first()
    made = Fitted(features, medians, tuple(second[f"m{k}"] for k in range(len(features))), tuple(second[f"s{k}"] or 1.0 for k in range(len(features))), None)
    weight = F.when(F.col(target) == 1, F.lit(n / (2 * p))).otherwise(F.lit(n / (2 * (n - p))))
    rows = made.vectors(train).select("_features", F.col(target).cast("double").alias("_label"), weight.alias("_weight"))
    learner = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", standardization=False, regParam=1.0 / (c * n), maxIter=2000)
    return replace(made, regression=learner.fit(rows))


def predict(model: Fitted, df: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """df with probability and prediction (at 0.5)."""
    from pyspark.ml.functions import vector_to_array

    kept = df.drop("probability", "prediction")
    made = model.regression.transform(model.vectors(kept)).withColumn("_p", vector_to_array("probability")[1])
    return made.select(*kept.columns, F.col("_p").alias("probability"), (F.col("_p") >= 0.5).cast("int").alias("prediction"))


def run_comparison(examples: DataFrame, faults: Sequence[int], train_runs: Iterable[int] = (1, 2, 3), test_runs: Iterable[int] = (4, 5), fault_start: int = 600, control: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Evaluation (a row per fault, target and representation) and predictions on held-out runs, of each fault once.

    control: fault-free examples, by default those of fault 0. All faults' regressions are fitted together, when this is
    called: the examples are stored first, and read once for each of Newton's rounds."""
    train_runs, test_runs, faults = tuple(train_runs), tuple(test_runs), list(dict.fromkeys(faults))
    if not set(train_runs).isdisjoint(test_runs):
        raise ValueError(f"runs {sorted(set(train_runs).intersection(test_runs))} are asked for on either side of the split")
    kind = examples.schema[FAULT].dataType
    control = examples.where(F.col(FAULT) == 0) if control is None else control
    mine = scratch.stored(examples.where(F.col(FAULT).isin(*faults) & F.col(RUN).isin(*train_runs, *test_runs)), "examples")
    train, test = mine.where(F.col(RUN).isin(*train_runs)), mine.where(F.col(RUN).isin(*test_runs))
    sizes = {}
    for said, x in (("learn from", train), ("test on", test)):
        rows = {r[FAULT]: r for r in x.groupBy(FAULT).agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).collect()}
        for f in faults:
            n = rows[f]["n"] if f in rows else 0
            lacking = [t for t in TARGETS if (f not in rows) or (rows[f][t] or 0) in (0, n)]
            if lacking:
                raise ValueError(f"fault {f}: nothing to {said}: of {n} objects all or none are {' and '.join(lacking)}")
            sizes.setdefault(f, n)
    models = newton.fit(train, FAULT, TARGETS, REPRESENTATIONS)
    made = newton.scored(test, FAULT, models).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    label = F.when(F.col("target") == TARGETS[0], F.col(TARGETS[0])).otherwise(F.col(TARGETS[1]))
    predicted = scratch.stored(made.withColumn("label", label).select(*KEYS, "target", "representation", "feature_count", "label", "probability", "prediction"), "predictions")
    for_each = control.withColumn(FAULT, F.explode(F.array(*(F.lit(f).cast(kind) for f in faults))))  # every fault's models see it
    free = newton.scored(for_each, FAULT, models).groupBy(FAULT, "target", "representation").agg(F.avg((F.col("probability") >= 0.5).cast("int")).alias("faultfree_false_positive_rate"))
    by = [FAULT, "target", "representation", "feature_count"]
    learnt = examples.sparkSession.createDataFrame(list(sizes.items()), f"{FAULT} {kind.simpleString()}, train_objects long")
    out = predicted.groupBy(*by).agg(F.count("*").alias("test_objects"), F.sum("label").alias("positive_test_objects")).join(F.broadcast(learnt), FAULT)
    for table in (ranking_metrics(predicted, by), threshold_metrics(predicted, by)):
        out = out.join(table, by)
    out = out.join(detection_delay(predicted, by, fault_start), by, "left").join(free, [FAULT, "target", "representation"], "left")
    return out, predicted.drop("feature_count")


def evaluate_fault(examples: DataFrame, control: DataFrame, train_runs: Iterable[int] = (1, 2, 3), test_runs: Iterable[int] = (4, 5), fault_start: int = 600) -> tuple[DataFrame, DataFrame]:
    """run_comparison() of one fault's examples against a control."""
    train_runs, test_runs = tuple(train_runs), tuple(test_runs)
    if not set(train_runs).isdisjoint(test_runs):
        raise ValueError(f"runs {sorted(set(train_runs).intersection(test_runs))} are asked for on either side of the split")
    faults = [r[FAULT] for r in examples.select(FAULT).distinct().limit(2).collect()]
    if len(faults) != 1:
        raise ValueError("examples must be of one fault")
    return run_comparison(examples, faults, train_runs, test_runs, fault_start, control)
