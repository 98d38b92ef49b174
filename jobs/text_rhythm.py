"""The rhythm of texts: how the length of lines rises and falls, and which of it tells good documents from poor ones.

A document's lines are a signal (words a line); its oscillations are the objects. Two tables are written:

* documents, partitioned by source: a row a document with its lines, words, objects and their means, and its label;
* effects, partitioned by property: for each source, and for all together, how many good and poor documents there are, their
  medians, and Cliff's delta between them.

Effects are made from the documents as written. Both tables are written anew by each run, so a run after one that failed
leaves the same as one that didn't. Documents have an id of their own; rows without id or text are left out, a null source is
"(none)", and documents without a label or with too few lines are in the first table alone.

    python -m jobs.text_rhythm --documents DOCUMENTS --labels LABELS --output FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from undula.operators import analytics, ranks
from undula.operators.oscillation import Oscillation

log = logging.getLogger("jobs.text_rhythm")

NAME = "text_rhythm"
PROPERTIES = ("lines", "words", "objects", "mean_duration", "mean_period", "mean_amplitude", "mean_symmetry")
DOCUMENTS = "doc_id long, lines long, words double, objects long, mean_duration double, mean_period double, mean_amplitude double, mean_symmetry double, label int, source string"
EFFECTS = "source string, good long, poor long, good_median double, poor_median double, cliffs_delta double, property string"


def profile(documents: DataFrame, labels: DataFrame, config: Mapping) -> DataFrame:
    """DOCUMENTS of documents(doc_id, source, text) and labels(doc_id, the config's label)."""
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), F.posexplode(F.split("text", "\n")).alias("line", "said"))
    lines = texts.select("doc_id", "source", "line", F.regexp_count("said", F.lit(r"[^\x20\x09-\x0D]+")).cast("double").alias("words"))
    keys = ["source", "doc_id"]
    totals = lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum("words").alias("words"))
    objects = Oscillation("words", "line", keys, diff_lag=config["diff_lag"], eps=config["eps"]).objects(lines).table
    means = objects.groupBy(*keys).agg(
        F.count("*").alias("objects"), F.avg("duration").alias("mean_duration"), F.avg("period").alias("mean_period"),
        F.avg("amplitude").alias("mean_amplitude"), F.avg("temporal_symmetry").alias("mean_symmetry"),
    )
    label = labels.groupBy("doc_id").agg(F.max(F.col(config["label"]).cast("int")).alias("label"))
    made = totals.join(means, keys, "left").fillna(0, ["objects"]).join(label, "doc_id", "left")
    return made.select(*(c.split()[0] for c in DOCUMENTS.split(", ")))


def effects(documents: DataFrame, config: Mapping) -> DataFrame:
    """EFFECTS of the documents' table. The groups, all documents among them, may be of any size: values are counted before
    they are ranked, and ranked and halved in parts."""
    known = documents.where(F.col("label").isNotNull() & (F.col("lines") >= config["least_lines"]))
    both = known.withColumn("source", F.explode(F.array("source", F.lit(config["every_source"])))).withColumn("good", F.col("label") == 1)
    keys = ["source", "property"]
    long = analytics.unpivoted(both, ["source", "good"], PROPERTIES)
    delta = analytics.cliffs_delta(long, "value", "good", keys, large=True)
    halves = ranks.medians(long, "value", [*keys, "good"])
    of = lambda side, c: F.max(F.when(F.col("good") == side, F.col(c)))
    counted = halves.groupBy(*keys).agg(F.coalesce(of(True, "n"), F.lit(0)).alias("good"), F.coalesce(of(False, "n"), F.lit(0)).alias("poor"), of(True, "median").alias("good_median"), of(False, "median").alias("poor_median"))
    return counted.join(delta, keys, "left").select(*(c.split()[0] for c in EFFECTS.split(", ")))


def run(spark: SparkSession, documents: str, labels: str, output: str, config: Mapping | None = None) -> dict[str, int]:
    """Reads both tables, writes output/documents and output/effects; the numbers of rows read and written."""
    config = common.config(NAME, config)
    source = spark.read.parquet(documents).select("doc_id", "source", "text")
    found = {"read": source.count()}  # of the files' footers
    log.info("read %d documents from %s", found["read"], documents)
    with common.settings(spark, {"spark.sql.sources.partitionOverwriteMode": "static"}):
        profile(source, spark.read.parquet(labels), config).write.mode("overwrite").partitionBy("source").parquet(f"{output}/documents")
        made = documents_at(spark, output)
        effects(made, config).write.mode("overwrite").partitionBy("property").parquet(f"{output}/effects")
    found |= {"documents": made.count(), "effects": effects_at(spark, output).count()}
    log.info("wrote %d documents and %d effects to %s", found["documents"], found["effects"], output)
    return found


def documents_at(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{output}/documents")


def effects_at(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(EFFECTS).parquet(f"{output}/effects")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file; what it leaves out is as in text_rhythm.json")
    args = parser.parse_args()
    with common.started(NAME) as spark:
        run(spark, args.documents, args.labels, args.output, common.config_at(spark, args.config))


if __name__ == "__main__":
    main()
