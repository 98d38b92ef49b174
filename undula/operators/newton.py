"""Logistic regressions of many groups at once by Newton's method.

Every round is one pass over the stored rows: tasks add up, for each regression that isn't done, the gradient and the matrix
of second derivatives of their rows with NumPy; Spark adds the tasks' sums; the driver solves as many small systems as there
are regressions. So the number of jobs is that of one regression's rounds, however many there are.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass
class Regression:
    """What is learnt of one group's rows for one target: for each feature its median, mean and deviation, and weights of the
    scaled features, the last of which is the intercept."""

    group: object
    target: str
    name: str
    features: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    rows: int
    positives: int
    weights: np.ndarray = field(default=None)
    rounds: int = 0

    def terms(self, every: Sequence[str]) -> tuple[list[float], list[float], float]:
        """Medians and weights of every feature as it is measured (0 for those not used), and what is added."""
        own = dict(zip(self.features, zip(self.medians, self.weights[:-1] / self.deviations, strict=True), strict=True))
        added = float(self.weights[-1] - np.sum(self.weights[:-1] * self.means / self.deviations))
        return [float(own[f][0]) if f in own else 0.0 for f in every], [float(own[f][1]) if f in own else 0.0 for f in every], added


def number(feature: str):
    return F.nanvl(F.col(feature).cast("double"), F.lit(None))


def prepared(train: DataFrame, group: str, targets: Sequence[str], sets: Mapping[str, Sequence[str]]) -> list[Regression]:
    """A regression for each group, target and set of features, not yet fitted: exact medians for missing values (0 where a
    feature has none), means and population deviations of the filled features (1 where a deviation is 0)."""
    every = list(dict.fromkeys(f for s in sets.values() for f in s))
    first = train.groupBy(group).agg(F.count("*").alias("_n"), *(F.sum(t).alias(f"_t{k}") for k, t in enumerate(targets)), *(F.median(number(f)).alias(f"_m{k}") for k, f in enumerate(every))).collect()
    medians = {r[group]: [0.0 if r[f"_m{k}"] is None else float(r[f"_m{k}"]) for k in range(len(every))] for r in first}
    if not medians:
        return []
    kind = train.schema[group].dataType.simpleString()
    table = train.sparkSession.createDataFrame([(g, m) for g, m in medians.items()], f"_g {kind}, _m array<double>")  # a row a group
    filled = train.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_g")))
    x = [F.coalesce(number(f), F.col("_m")[k]) for k, f in enumerate(every)]
    second = {r[group]: r for r in filled.groupBy(group).agg(*(F.avg(c).alias(f"_a{k}") for k, c in enumerate(x)), *(F.stddev_pop(c).alias(f"_s{k}") for k, c in enumerate(x))).collect()}
    out = []
    for r in first:
        s = second[r[group]]
        for t, target in enumerate(targets):
            for name, features in sets.items():
                at = [every.index(f) for f in features]
                pick = lambda values: np.array([float(v) for v in values])
                out.append(Regression(r[group], target, name, tuple(features), pick(medians[r[group]][k] for k in at), pick(s[f"_a{k}"] for k in at), pick(s[f"_s{k}"] or 1.0 for k in at), r["_n"], r[f"_t{t}"] or 0))
    return out


def fit(train: DataFrame, group: str, targets: Sequence[str], sets: Mapping[str, Sequence[str]], c: float = 1.0, tolerance: float = 1e-9, rounds: int = 100) -> list[Regression]:
    """Fits every group, target and set: L2-penalised (not the intercept; c is the inverse strength), classes balanced.

    train is read once a round, so it should be a stored table. A step that makes the penalised likelihood worse is halved.
    Groups are few enough for the driver to hold their weights. ValueError where a group's target has one class alone."""
    made = prepared(train, group, targets, sets)
    for m in made:
        if m.positives in (0, m.rows):
            raise ValueError(f"{m.target}: rows of either class are needed to fit a model, here {m.positives} of {m.rows} are positive")
    every = list(dict.fromkeys(f for s in sets.values() for f in s))
    rows = train.select(F.col(group).alias("_g"), *(F.col(t).cast("double").alias(f"_t{k}") for k, t in enumerate(targets)), *(number(f).alias(f"_x{k}") for k, f in enumerate(every)))
    best = [(np.inf, np.zeros(len(m.features) + 1), np.zeros(len(m.features) + 1)) for m in made]  # loss, weights, step to go
    left = set(range(len(made)))
    for n in range(1, rounds + 1):
        tried = {k: best[k][1] + best[k][2] for k in left}
        for k, (loss, gradient, second) in _sums(rows, made, targets, every, tried).items():
            penalty = np.append(np.full(len(made[k].features), 1.0 / c), 0.0)
            w = tried[k]
            loss += 0.5 * float(penalty @ (w * w))
            if loss <= best[k][0] + 1e-12 * abs(loss):
                step = -np.linalg.solve(second + np.diag(penalty), gradient + penalty * w)
                best[k] = (loss, w, step)
            else:
                best[k] = (best[k][0], best[k][1], best[k][2] / 2)
            if np.abs(best[k][2]).max() <= tolerance * (1 + np.abs(best[k][1]).max()):
                made[k].weights, made[k].rounds = best[k][1], n
                left.discard(k)
        if not left:
            return made
    for k in left:
        made[k].weights, made[k].rounds = best[k][1], rounds
    log.warning("%d of %d regressions aren't settled after %d rounds", len(left), len(made), rounds)
    return made


def _sums(rows: DataFrame, made: list[Regression], targets: Sequence[str], every: Sequence[str], tried: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each regression tried: loss, gradient and second derivatives at its weights, without the penalty."""
    import pyarrow as pa

    jobs: dict[object, list] = {}
    for k, w in tried.items():
        m = made[k]
        share = (m.rows / (2 * m.positives), m.rows / (2 * (m.rows - m.positives)))
        jobs.setdefault(m.group, []).append((k, targets.index(m.target), np.array([every.index(f) for f in m.features]), m.medians, m.means, m.deviations, share, w))
    size = {k: len(w) for k, w in tried.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k, d in size.items()}
        for batch in batches:
            groups = np.array(batch.column("_g").to_pylist(), object)
            wide = np.stack([np.asarray(batch.column(f"_x{k}").fill_null(np.nan), float) for k in range(len(every))], axis=1)
            labels = [np.asarray(batch.column(f"_t{k}").fill_null(0.0), float) for k in range(len(targets))]
            for g in set(groups.tolist()) & set(jobs):
                mine = groups == g
                for k, t, at, medians, means, deviations, share, w in jobs[g]:
                    x = wide[np.ix_(mine, at)]
                    x = (np.where(np.isnan(x), medians, x) - means) / deviations
                    x = np.column_stack([x, np.ones(len(x))])
                    y = labels[t][mine] == 1
                    weight = np.where(y, share[0], share[1])
                    eta = x @ w
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    own = total[k]
                    own[0] += weight @ (np.logaddexp(0, eta) - y * eta)
                    own[1 : 1 + len(w)] += x.T @ (weight * (p - y))
                    own[1 + len(w) :] += ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["model", "sums"])

    parts = rows.mapInArrow(run, "model long, sums array<double>").select("model", F.posexplode("sums").alias("at", "v"))
    out = {k: np.zeros(1 + d + d * d) for k, d in size.items()}
    for r in parts.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():  # a few hundred numbers a regression
        out[r["model"]][r["at"]] = r["v"]
    return {k: (float(v[0]), v[1 : 1 + size[k]], v[1 + size[k] :].reshape(size[k], size[k])) for k, v in out.items()}


def scored(df: DataFrame, group: str, made: Sequence[Regression]) -> DataFrame:
    """df, a row for each of its group's regressions: with target, representation, feature_count and probability."""
    every = list(dict.fromkeys(f for m in made for f in m.features))
    kind = df.schema[group].dataType.simpleString()
    rows = [(m.group, m.target, m.name, len(m.features), *m.terms(every)) for m in made]
    table = df.sparkSession.createDataFrame(rows, f"_g {kind}, target string, representation string, feature_count int, _m array<double>, _w array<double>, _b double")
    both = df.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_g")))  # a row a regression
    eta = F.col("_b")
    for k, f in enumerate(every):
        eta = eta + F.coalesce(number(f), F.col("_m")[k]) * F.col("_w")[k]
    return both.withColumn("probability", 1 / (1 + F.exp(-eta))).drop("_g", "_m", "_w", "_b")
