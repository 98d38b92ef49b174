"""Importance resampling towards a target's distribution of hashed n-grams.

Each partition's texts go through DuckDB in its Python worker: SQL takes the words, unnests them, makes runs of two by a
window, and counts buckets, which are a registered function of zlib's CRC. Counts by document and by partition are written
to Parquet by Spark; Spark adds the partitions' counts, makes a gain for each bucket, weighs documents and draws them.

A document's counts are at most BUCKETS numbers, however long its text, and long texts go through DuckDB in parts of PART
bytes. Scores are whole numbers of a bounded range, so ranks come from the number of documents at each score (some 10^5
rows at most, whatever the input) and a window over each score's documents: nothing is sorted as a whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm import shared

BUCKETS = 10_000
#: Bytes of text that DuckDB is given at once, about; a longer text is cut between words.
PART = 1 << 20
#: Bytes that DuckDB may use in each worker; it writes no temporary files.
MEMORY = "512MB"
COUNTED = "doc_id long, total boolean, n_words long, n_features long, buckets array<int>, counts array<long>"
#: Bytes of words: digits, letters of ASCII, and all beyond ASCII.
_OTHER = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Of parts(r, t): whose text it is, and the text in lower case. A part that goes on where another ended begins with that
#: one's last word, which counts in a run of two, but not alone (again).
_SQL = r"""
    WITH texts AS (SELECT r, again, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM parts),
    words AS (SELECT r, again, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
    runs AS MATERIALIZED (SELECT r, again AND i = 1 AS before, word, lead(word) OVER (PARTITION BY r ORDER BY i) AS next FROM words),
    features AS (
        SELECT r, word AS f FROM runs WHERE NOT before
        UNION ALL SELECT r, word || ' ' || next FROM runs WHERE next IS NOT NULL)
    SELECT r, crc32(f) % {buckets} AS b, count(*) AS n FROM features GROUP BY r, b"""


def _crc32(texts: pa.Array) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pa.array(list(map(zlib.crc32, texts.cast(pa.binary()).to_numpy(zero_copy_only=False))), pa.int64())


class Counter:
    """One worker's DuckDB, in memory and on one thread."""

    def __init__(self, buckets: int):
        import duckdb

        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.connection.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        self.buckets, self.sql = buckets, _SQL.format(buckets=buckets)

    def close(self) -> None:
        self.connection.close()

    def _run(self, rows: list[tuple[int, bool, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = (pa.int64(), pa.bool_(), pa.binary())
        r, again, t = (pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))
        self.connection.register("parts", pa.table({"r": r, "again": again, "t": t.cast(pa.string())}))
        found = self.connection.execute(self.sql).fetchnumpy()
        self.connection.unregister("parts")
        return tuple(np.asarray(found[c]).astype(np.int64) for c in ("r", "b", "n"))

    def count(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text (lower case) in order the number of words, its buckets, ascending, and their counts."""
        for k, text in enumerate(texts):
            if text and len(text) > PART:
                break
        else:
            k = len(texts)
        if k:
            rows = [(i, False, t) for i, t in enumerate(texts[:k]) if t]
            r, b, n = self._run(rows) if rows else (np.empty(0, np.int64),) * 3
            order = np.lexsort((b, r))
            r, b, n = r[order], b[order], n[order]
            edges = np.searchsorted(r, np.arange(k + 1))
            for i in range(k):
                own = slice(edges[i], edges[i + 1])
                yield self._words(int(n[own].sum())), b[own], n[own]
        if k < len(texts):
            total, last = np.zeros(self.buckets, np.int64), b""
            for part in split(texts[k], PART):
                for _, b, n in [self._run([(0, bool(last), last + b" " + part if last else part)])]:
                    total[b] += n
                words = _OTHER.split(part)
                last = next((w for w in reversed(words) if w), last)
            there = np.flatnonzero(total)
            yield self._words(int(total.sum())), there, total[there]
            yield from self.count(texts[k + 1 :])

    @staticmethod
    def _words(features: int) -> int:
        """n words have n features and n - 1 runs of two."""
        return (features + 1) // 2


def split(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about `most` bytes that end before a byte of no word, or at the text's end."""
    at = 0
    while at < len(text):
        found = _OTHER.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def counts(texts: DataFrame, key: str | None, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """COUNTED: a row for each text, and for each partition one (total) of all its texts' counts. key: a whole number."""
    shared.bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, total, some = Counter(buckets), np.zeros(buckets, np.int64), False
        try:
            for batch in batches:
                for part in shared.parts([batch], "text", PART):
                    some = True
                    raw = [None if x is None else x.translate(_LOWER) for x in shared.raw(part.column("text"))]
                    rows = list(counter.count(raw))
                    for _, b, n in rows:
                        total[b] += n
                    yield _rows(part.column("doc_id"), False, rows)
            if some:
                there = np.flatnonzero(total)
                yield _rows(pa.array([None], pa.int64()), True, [(0, there, total[there])])
        finally:
            counter.close()

    doc_id = F.lit(None) if key is None else F.col(f"`{key}`")
    rows = texts.select(doc_id.cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(shared.released(run), COUNTED)


def _rows(doc_id: pa.Array, total: bool, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = len(rows)
    ends = np.cumsum([0, *(len(b) for _, b, _ in rows)]).astype(np.int32)
    lists = lambda k, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]) if n else [], kind))
    features = [int(c.sum()) for _, _, c in rows]
    columns = [doc_id, pa.array([total] * n), pa.array([w for w, _, _ in rows], pa.int64()), pa.array(features, pa.int64()), lists(1, pa.int32()), lists(2, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "total", "n_words", "n_features", "buckets", "counts"])


def merged(counted: DataFrame, name: str) -> DataFrame:
    """bucket and its number in all texts: the partitions' counts, added."""
    each = counted.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("e"))
    return each.groupBy(F.col("e.buckets").alias("bucket")).agg(F.sum("e.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A whole number for each bucket: 1000 times the logarithm of its smoothed share in the target over that in the source.
    At most `buckets` rows of either come to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for own, counted in ((s, source), (t, target)):
        for r in merged(counted, "n").collect():
            own[r["bucket"]] = r["n"]
    s_all, t_all = float(s.sum()), float(t.sum())
    return [math.floor(1000 * math.log((a + 1.0) * (s_all + buckets) / ((b + 1.0) * (t_all + buckets)))) for a, b in zip(t.tolist(), s.tolist(), strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel number times 1000, floored, of the first 32 bits of sha256(seed:doc_id); a null doc_id is 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(counted: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each text."""
    spark = counted.sparkSession
    one = spark.createDataFrame([(gain,)], "gain array<long>")  # one row of as many numbers as there are buckets
    both = counted.where("NOT total").join(F.broadcast(one))
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda done, e: done + F.get("gain", e["buckets"]) * e["counts"])
    n = F.col("n_features")
    weight = F.when(n > 0, F.expr("(_total - pmod(_total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    made = both.withColumn("_total", total).withColumn("weight", weight)
    return made.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long").alias("score"))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Of documents(doc_id, text) those drawn, towards target(text): every document's doc_id, n_features, weight, score and
    rank (1 for the highest score; null if it isn't drawn).

    Of the documents with at least least_words words, share percent, floored, are drawn. Null and empty texts have no words,
    weight 0 and aren't drawn. Texts of any length count whole. Ties go to the lesser doc_id (null before all), then to fewer
    features, then to the lesser weight; rows that are equal in all of these are each a document, in any order. An empty table
    gives no rows; against an empty target gains are those of smoothing alone. Other columns are left aside."""
    spark = docs.sparkSession
    counted = shared.stored(counts(docs, "doc_id", "text", buckets), "counts")
    wanted = shared.stored(counts(target, None, "text", buckets), "target_counts")
    made = shared.stored(scored(counted, gains(counted, wanted, buckets), seed), "scores")
    able = F.col("n_words") >= least_words
    at = sorted(((r["score"], r["count"]) for r in made.where(able).groupBy("score").count().collect()), reverse=True)  # distinct scores: a bounded range
    drawn, before = sum(n for _, n in at) * share // 100, []
    done = 0
    for score, n in at:
        if done >= drawn:
            break
        before.append((score, done))
        done += n
    upto = before[-1][0] if before else None
    near = able & (F.col("score") >= upto) if upto is not None else F.lit(False)
    order = W.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    ranks = spark.createDataFrame(before, "score long, before long")
    chosen = made.where(near).join(F.broadcast(ranks), "score").withColumn("rank", (F.row_number().over(order) + F.col("before")).cast("long"))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = made.where(~near).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return chosen.select(*columns).unionByName(rest.select(*columns))
