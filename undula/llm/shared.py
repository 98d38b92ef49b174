"""Scratch tables and Arrow helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.sources.scratch import clear, remove, scratch, stored, stored_at  # noqa: F401

#: Arrow batches handed to Python hold at most this much, so that long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that a Parquet reader decodes at once: Spark's 4096 texts of some KB are large objects, of which heaps grow.
READ_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow's and Parquet's batches, which Spark reads when a plan runs, so it holds for the session from
    here on."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """name, lengthened until no column has it (Spark compares names without case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column end to end as bytes, and where each begins (with the end of the last); null is empty."""
    parts = [x or b"" for x in raw(column)]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def parts(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of about `most` bytes of a column, or of one row that is longer."""
    for batch in batches:
        at = 0
        if batch.num_rows:
            upto = np.cumsum([len(x or b"") for x in raw(batch.column(column))])
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def released(run):
    """run (of batches), after which the memory that Arrow keeps for later goes back: workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def kept_fields(docs: DataFrame, without: Iterable[str], added: Iterable) -> list:
    """The fields of docs but those of `without`; ValueError if one has a name that is to be added."""
    clash = {c.lower() for c in docs.columns} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"columns {', '.join(sorted(clash))} are added here and must not be there; see shared.apart")
    return [f for f in docs.schema.fields if f.name not in without]


def text_only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns, whatever their names, don't matter."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def apart(docs: DataFrame, added: Iterable[str], apply) -> DataFrame:
    """apply(docs), which adds columns and may drop rows, for docs that may have columns of the names added: those are
    renamed before and have their names again after. Returns the columns of docs alone; `apply` has used the others."""
    added = {x.lower() for x in added}
    taken = {*docs.columns, *added}
    other = {c: fresh(taken, f"{c}_of_documents") for c in docs.columns if c.lower() in added}
    result = apply(docs.withColumnsRenamed(other))
    return result.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


#: A key is hot if it has more than this share of a table's rows, so there are fewer than 1 / HOT such keys.
HOT = 0.001


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """big joined (inner or left) with small, whose rows have distinct keys and in column n the number of big's rows with
    them; n is dropped. Rows of hot keys, however many, stay where they are: of small only those fewer than 1 / HOT keys
    are broadcast. The other rows are shuffled. Both tables are read twice, so they should be stored ones."""
    total = small.agg(F.sum(n).alias("n")).first()["n"] or 0
    hot = small.where(F.col(n) > total * HOT)
    if hot.isEmpty():
        return big.join(small.drop(n), keys, how)
    here = big.join(F.broadcast(hot.drop(n)), keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(n) <= total * HOT).drop(n), keys, how)
    return here.unionByName(rest)
