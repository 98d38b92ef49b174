"""Finite chains given as tables of transitions (source, target, probability). A chain has at most MOST_STATES states,
so its matrices are solved on the driver, and results are tables again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

MOST_STATES = 2000


def _matrix(transitions: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = transitions.select("source", "target", "probability").limit(MOST_STATES * MOST_STATES + 1).collect()
    states = sorted({r.source for r in rows} | {r.target for r in rows})
    if len(states) > MOST_STATES:
        raise ValueError(f"at most {MOST_STATES} states")
    place = {s: k for k, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    for r in rows:
        p[place[r.source], place[r.target]] += r.probability
    return states, p


def absorption(transitions: DataFrame) -> DataFrame:
    """source, target, probability that a transient source ends in an absorbing target. A state without ways out, or
    that stays in itself for sure, absorbs. ValueError where a transient state never ends."""
    states, p = _matrix(transitions)
    ends = [k for k in range(len(states)) if p[k].sum() == 0 or p[k, k] == 1]
    rest = [k for k in range(len(states)) if k not in set(ends)]
    try:
        b = np.linalg.inv(np.eye(len(rest)) - p[np.ix_(rest, rest)]) @ p[np.ix_(rest, ends)]
    except np.linalg.LinAlgError as singular:
        raise ValueError("some states never end") from singular
    out = [(states[i], states[j], float(b[x, y])) for x, i in enumerate(rest) for y, j in enumerate(ends)]
    return transitions.sparkSession.createDataFrame(out, "source string, target string, probability double")


def values(transitions: DataFrame, rewards: DataFrame, discount: float = 1.0, tolerance: float = 1e-12, most: int = 100_000) -> DataFrame:
    """state and value, the fixed point of value = reward + discount * mean of the next values; rewards(state, reward)."""
    states, p = _matrix(transitions)
    given = {r.state: float(r.reward) for r in rewards.collect()}
    r, v = np.array([given.get(s, 0.0) for s in states]), np.zeros(len(states))
    for _ in range(most):
        after = r + discount * p @ v
        done = np.abs(after - v).max(initial=0.0) <= tolerance
        v = after
        if done:
            break
    return transitions.sparkSession.createDataFrame([(s, float(x)) for s, x in zip(states, v, strict=True)], "state string, value double")
