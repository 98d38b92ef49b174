"""Two seeded simulations of control: a pole on a cart and a car in a valley. Equal seeds give equal tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: the environments' published constants ----

GRAVITY, CART_MASS, POLE_MASS, HALF_POLE, FORCE, TIME_STEP = 9.8, 1.0, 0.1, 0.5, 10.0, 0.02
CART_LIMIT, POLE_LIMIT, HELD_STEPS = 2.4, 12 * 2 * math.pi / 360, 4
FEEDBACK = {"pole_angle": 1.0, "pole_angular_velocity": 0.25, "cart_position": 0.01, "cart_velocity": 0.05}
CAR_MIN, CAR_MAX, CAR_SPEED, CAR_GOAL, CAR_GOAL_SPEED, CAR_FORCE, CAR_GRAVITY, EXPLORATION = -1.2, 0.6, 0.07, 0.5, 0.0, 0.001, 0.0025, 0.4

_STATE = ("cart_position", "cart_velocity", "pole_angle", "pole_angular_velocity")
CARTPOLE = (
    "episode long, step long, time double, episode_start boolean, cart_position double, cart_velocity double, pole_angle double, pole_angular_velocity double, "
    "action long, control_score double, reward double, next_cart_position double, next_cart_velocity double, next_pole_angle double, "
    "next_pole_angular_velocity double, terminated boolean, truncated boolean, episode_end boolean"
)
MOUNTAINCAR = (
    "episode long, step long, time long, episode_start boolean, position double, velocity double, action long, momentum_action long, exploratory_action boolean, "
    "reward double, next_position double, next_velocity double, terminated boolean, truncated boolean, episode_end boolean"
)


def _checked(**values) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int):
            raise TypeError(f"{name}: a whole number is needed, not {v!r}")
        if v < (0 if name == "seed" else 1):
            raise ValueError(f"{name} is too small")


def _cart_step(state: tuple[float, ...], action: int) -> tuple[float, ...]:
    """One Euler step of the published equations of motion."""
    x, v, angle, turning = state
    total, moment = CART_MASS + POLE_MASS, POLE_MASS * HALF_POLE
    sin, cos = float(np.sin(angle)), float(np.cos(angle))
    push = ((FORCE if action else -FORCE) + moment * turning**2 * sin) / total
    angular = (GRAVITY * sin - cos * push) / (HALF_POLE * (4.0 / 3.0 - POLE_MASS * cos**2 / total))
    linear = push - moment * angular * cos / total
    return x + TIME_STEP * v, v + TIME_STEP * linear, angle + TIME_STEP * turning, turning + TIME_STEP * angular


def cart_episode(episode: int, state: tuple[float, ...], max_steps: int) -> list[tuple]:
    rows, action = [], 0
    for step in range(max_steps):
        now = dict(zip(_STATE, state, strict=True))
        score = sum(weight * now[name] for name, weight in FEEDBACK.items())
        if step % HELD_STEPS == 0:
            action = int(score > 0)
        after = _cart_step(state, action)
        fell = abs(after[0]) > CART_LIMIT or abs(after[2]) > POLE_LIMIT
        cut = step == max_steps - 1 and not fell
        rows.append((episode, step, step * TIME_STEP, step == 0, *state, action, score, 1.0, *after, fell, cut, fell or cut))
        state = after
        if fell:
            break
    return rows


def cartpole(spark: SparkSession, episodes: int = 10, max_steps: int = 500, seed: int = 1729) -> DataFrame:
    """Episodes under a fixed feedback policy. First states are drawn here, four numbers each; episodes run apart."""
    _checked(episodes=episodes, max_steps=max_steps, seed=seed)
    starts = np.random.default_rng(seed).uniform(-0.05, 0.05, size=(episodes, 4))
    table = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(starts)], "episode long, " + ", ".join(f"{c} double" for c in _STATE))
    columns = [x.split()[0] for x in CARTPOLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, *state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = cart_episode(k, tuple(state), max_steps)
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)))

    return table.repartition(min(episodes, spark.sparkContext.defaultParallelism)).mapInArrow(run, CARTPOLE)


def car_episodes(episodes: int, max_steps: int, seed: int) -> list[tuple]:
    first, policy = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(2))
    rows = []
    for episode in range(episodes):
        x, v = float(first.uniform(-0.6, -0.4)), 0.0
        for step in range(max_steps):
            momentum = 2 if v >= 0 else 0
            explores = bool(policy.random() < EXPLORATION)
            action = int(policy.integers(0, 3)) if explores else momentum
            speed = min(CAR_SPEED, max(-CAR_SPEED, v + (action - 1) * CAR_FORCE - float(np.cos(3 * x)) * CAR_GRAVITY))
            place = min(CAR_MAX, max(CAR_MIN, x + speed))
            if place == CAR_MIN and speed < 0:
                speed = 0.0
            there = place >= CAR_GOAL and speed >= CAR_GOAL_SPEED
            cut = step == max_steps - 1 and not there
            rows.append((episode, step, step, step == 0, x, v, action, momentum, explores, -1.0, place, speed, there, cut, there or cut))
            x, v = place, speed
            if there:
                break
    return rows


def mountaincar(spark: SparkSession, episodes: int = 10, max_steps: int = 200, seed: int = 1729) -> DataFrame:
    """Episodes under a policy that follows momentum and sometimes explores. One sequence of draws goes through all
    episodes, so they are made one after another, in one task."""
    _checked(episodes=episodes, max_steps=max_steps, seed=seed)
    columns = [x.split()[0] for x in MOUNTAINCAR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*car_episodes(episodes, max_steps, seed), strict=True)), strict=True)))

    return spark.range(1).coalesce(1).mapInArrow(run, MOUNTAINCAR)


def noisy_waves(spark: SparkSession, signals: int = 1, cycles: int = 12, period: int = 80, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """signal_id, i and value: a cosine from trough to trough, with seeded normal noise."""
    from pyspark.sql import functions as F

    n = cycles * period + 1
    rows = spark.range(signals * n).select(F.expr(f"id div {n}").alias("signal_id"), (F.col("id") % n).alias("i"))
    wave = -F.cos(F.lit(2 * math.pi) * F.col("i") / period)
    # two uniform numbers by hash make a normal one: the same whatever the partitions
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "signal_id", "i"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for k in (0, 1)]
    return rows.withColumn("value", wave + noise * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1]))
