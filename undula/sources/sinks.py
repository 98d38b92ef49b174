"""Tables and results written out, and their digests."""

from __future__ import annotations

import json
import platform
import re
from collections.abc import Mapping

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order_by=(), single: bool = True) -> str:
    """CSV with a header and line feeds; single: one file, for tables of results."""
    df = df.orderBy(*order_by) if order_by else df
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, lineSep="\n")
    return path


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object a line."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_mapping(df: DataFrame, key: str, value: str, path: str) -> str:
    """One JSON object from keys to values, in one file: the form of a submission."""
    one = df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
    return path


def records(df: DataFrame) -> DataFrame:
    """A row's JSON, missing values as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def content_hash(df: DataFrame) -> str:
    """SHA-256 of a table's rows whatever their order or partitions: a sum of row hashes, hashed with their number."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
    out = df.agg(F.count("*").alias("n"), *(p.alias(f"p{k}") for k, p in enumerate(parts)))
    return out.select(F.sha2(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in out.columns)), 256)).first()[0]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, folder: str, path: str, parameters: Mapping[str, object] | None = None) -> str:
    """One JSON object at path: the files below folder (name below it, size, SHA-256) and the environment."""
    names = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    files = file_hashes(spark, folder).select(F.struct(names.alias("name"), "size", "sha256").alias("file"))
    one = files.agg(F.sort_array(F.collect_list("file")).alias("files"))  # a row per file
    about = F.lit(json.dumps(environment(spark, parameters), sort_keys=True))
    text = F.concat(F.lit('{"environment":'), about, F.lit(',"files":'), F.to_json("files"), F.lit("}"))
    one.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def verify_manifest(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """name and problem (missing, unexpected or changed) of the files below folder that aren't those of a manifest."""
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "array<struct<name:string,size:long,sha256:string>>")).alias("f"))
    listed = listed.select("f.name", F.col("f.sha256").alias("listed"))
    names = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    there = file_hashes(spark, folder).select(names.alias("name"), F.col("sha256").alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").when(F.col("found") != F.col("listed"), "changed")
    return listed.join(there, "name", "full").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def environment(spark: SparkSession, parameters: Mapping[str, object] | None = None) -> dict[str, object]:
    return {"platform": platform.platform(), "python": platform.python_version(), "pyspark": pyspark.__version__, "master": spark.sparkContext.master, "parameters": dict(parameters or {})}
