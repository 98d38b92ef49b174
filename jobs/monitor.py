"""Monitoring of many signals as their samples arrive: twelve causal features of each sample, and whether it is an alarm.

Files of samples land in a folder. A run takes the files that no run before has taken, goes on with each key's state where
that was left, and adds features to a table partitioned by day, output/samples. Samples may be late, or out of order, by
`delay`: the last of them wait in the state until a later run brings newer ones, which move the watermark on. An alarm is a
swing, since the last extremum, of more than `alarm`. Then output/report, a row for each key and day, also partitioned by
day, is made anew for the days that have gained samples, and for no others.

The checkpoint holds what was taken, the states and the watermark; the table's own log says which of its files count; and a
day whose report has another number of samples than the table is reported again. So a run that failed, wherever it did, is
taken up by the next, and one without new files changes nothing.

    python -m jobs.monitor --events FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from undula.streaming.causal import FEATURES
from undula.streaming.ordered import ordered_features

log = logging.getLogger("jobs.monitor")

NAME = "monitor"
REPORT = "key string, samples long, alarms long, reversals long, greatest_swing double, first_alarm long, day string"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def watched(samples: DataFrame, config: Mapping) -> DataFrame:
    """Features, alarm and day of a stream of samples; signals are rounded to 1 / scale and counted in that."""
    c = config
    signal = F.round(F.col(c["signal"]) * c["scale"]).cast("double")
    rows = samples.select(F.col(c["key"]).cast("string").alias("key"), F.col(c["time"]).alias("time"), F.col(c["order"]).cast("long").alias("sample"), signal.alias("x"))
    made = ordered_features(rows, "key", "time", "sample", "x", c["delay"], c["eps"])
    return made.select("key", "sample", "time", *FEATURES, (F.col("running_amplitude") > c["alarm"]).alias("alarm"), F.date_format("time", "yyyy-MM-dd").alias("day"))


def summary(samples: DataFrame) -> DataFrame:
    """REPORT of samples with features."""
    return samples.groupBy("key", "day").agg(
        F.count("*").alias("samples"), F.count_if("alarm").alias("alarms"), F.sum("reversal").cast("long").alias("reversals"),
        F.max("running_amplitude").alias("greatest_swing"), F.min(F.when(F.col("alarm"), F.col("sample"))).alias("first_alarm"),
    ).select("key", "samples", "alarms", "reversals", "greatest_swing", "first_alarm", "day")


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: Mapping | None = None) -> dict[str, int]:
    """Takes what is new in the files of `events` (a folder or a pattern), adds it to output/samples and brings
    output/report up to date; the numbers of rows read and had, of alarms, and of days reported."""
    config = common.config(NAME, config)
    schema = spark.read.parquet(events).schema
    with common.settings(spark, STORE):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_trigger"]).parquet(events)
        writer = watched(stream, config).writeStream.format("parquet").partitionBy("day").outputMode("append")
        query = writer.option("path", f"{output}/samples").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new samples from %s", read, events)
    days = report(spark, output)
    rows = samples_at(spark, output)
    found = {"read": read, "rows": rows.count(), "alarms": rows.where("alarm").count(), "days": len(days)}
    log.info("%s has %d samples, of them %d alarms; reported %d days", output, found["rows"], found["alarms"], found["days"])
    return found


def report(spark: SparkSession, output: str) -> list[str]:
    """Reports the days whose samples have become more since they were reported; which they are."""
    rows = samples_at(spark, output)
    count = lambda c: c.cast("long").alias("n")
    now = rows.groupBy("day").agg(count(F.count("*")))
    try:
        now = now.join(report_at(spark, output).groupBy("day").agg(count(F.sum("samples"))), ["day", "n"], "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise  # no report before the first
    days = sorted(r["day"] for r in now.select("day").collect())  # as many as there are days
    if days:
        with common.settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            summary(rows.where(F.col("day").isin(days))).write.mode("overwrite").partitionBy("day").parquet(f"{output}/report")
    return days


def samples_at(spark: SparkSession, output: str) -> DataFrame:
    """The samples' table as it stands. Times without a zone are in the session's."""
    return spark.read.schema(f"key string, sample long, time timestamp, {', '.join(f'{f} double' for f in FEATURES)}, alarm boolean, day string").parquet(f"{output}/samples")


def report_at(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output}/report")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("events", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file; what it leaves out is as in monitor.json")
    args = parser.parse_args()
    with common.started(NAME) as spark:
        run(spark, args.events, args.output, args.checkpoint, common.config_at(spark, args.config))


if __name__ == "__main__":
    main()
