"""What the jobs share: config files, settings that are put back, and the session of a command line."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def config(job: str, given: Mapping | None = None) -> dict:
    """The job's own config file, with what is given in place of its values; ValueError for a name it doesn't have."""
    own = json.loads(Path(__file__).with_name(f"{job}.json").read_text())
    unknown = sorted(set(given or {}) - set(own))
    if unknown:
        raise ValueError(f"unknown settings {', '.join(unknown)}; there are {', '.join(own)}")
    return own | dict(given or {})


def config_at(spark: SparkSession, path: str | None) -> dict:
    """A config file by any path that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """The session's settings, as wanted for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def started(name: str) -> Iterator[SparkSession]:
    """A session for a command line, stopped when it is done."""
    from undula.plans.session import session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session(name)
    try:
        yield spark
    finally:
        spark.stop()
