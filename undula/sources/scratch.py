"""Scratch tables and files below spark.checkpoint.dir, where lineage ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, a folder that all executors share. Where that is unset a temporary folder
    stands in on one machine (local masters, as in tests); on a cluster it is an error.

    A folder without a scheme is one of Hadoop's default file system, and is named so for those who don't ask Hadoop."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="undula-"))
        root = _local_root[0]
    if "://" not in root:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = re.sub("^file:/(?!/)", "file:///", where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())
    return f"{root.rstrip('/')}/undula/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch table and read again: lineage ends there and lost executors cost nothing."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), and the table's path, for remove() once what was made of it is stored too."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables and files below this session's folder; results that are still read need them."""
    remove(spark, scratch(spark, "").rsplit("/", 1)[0])
