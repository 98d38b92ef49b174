"""Packing by non-negative least squares, over a histogram of lengths.

A document is its tokens and an end id. It is cut into pieces of `capacity`, the last of which may be shorter. Pieces
differ for packing only by their length, so the plan is made from a histogram of at most `capacity` rows, however many
documents there are:

1. Mixes of up to DEPTH lengths that fill a sequence exactly are enumerated, of lengths that occur.
2. How often each mix is used solves least squares against the histogram, none less than zero; the numbers are rounded,
   and held to the pieces that are left.
3. Pieces over are packed best-fit, longest first. Sequences that this fills, or fills to a power of two, stay.
4. The pieces of the others are laid end to end and cut where a sequence is full. The rest, shorter than a sequence, is cut
   into powers of two. So no sequence needs padding, and only pieces of step 4 are cut.

The plan gives ranks within a length to runs of sequences (steps 2 and 3) or to places end to end (step 4). A length's
pieces are ranked in cells of some CELL rows, so that a length that a third of all rows have isn't gathered in one task, and
of the ids only those in cells where something may be cut are shuffled: at most capacity * CELL rows, whatever the input.
"""

from __future__ import annotations

import logging
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm import shared
from undula.llm.packing import Bins
from undula.llm.tokens import encoder

log = logging.getLogger(__name__)

#: Lengths in a mix at most: 1, 2 or 3 make some 87,000 mixes of a capacity of 1024.
DEPTH = 3
#: Rows of a length that are ranked together, about.
CELL = 100_000
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
RESULT = ", ".join(f"{c} long" for c in COLUMNS)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and ids (little-endian, of 2 or 4 bytes each; null for full pieces,
    which are never cut) of documents(doc_id, text). Null text is empty, and so one piece of end_id alone."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.parts(batches, "text", 4 << 20):
            ids, ends = encoder(vocabulary).encode(batch.column("text"), end_id)
            words, kept = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype(width(vocabulary, end_id)).tobytes())
            each = len(kept) // max(len(ids), 1)
            n = np.diff(ends, prepend=0)
            many = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            size = np.minimum(n[owner] - start, capacity)
            at = (ends - n)[owner] + start
            spans = list(zip(at.tolist(), size.tolist(), strict=True))
            crc = [zlib.crc32(words[4 * a : 4 * (a + s)]) for a, s in spans]
            rest = [bytes(kept[each * a : each * (a + s)]) if s < capacity else None for a, s in spans]
            columns = (batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[owner]), pa.array(rest, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = shared.text_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(shared.released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def width(vocabulary: str | None, end_id: int) -> str:
    """The type that ids are kept in: 2 bytes where they fit."""
    return "<u2" if max(encoder(vocabulary).library.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


# ---- the plan ----


def mixes(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of up to DEPTH of the lengths (distinct, ascending, below capacity) that add up to capacity: a row
    each of DEPTH lengths, longest first, 0 where there are fewer."""
    out = [np.empty((0, DEPTH), np.int64)]
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True  # a mix of fewer
    for a in lengths[lengths * DEPTH >= capacity]:
        b = np.arange((capacity - a + 1) // 2, min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = there[b] & there[c] & (b > 0)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def nonnegative_least_squares(rows: np.ndarray, demand: np.ndarray, together: int = 64, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the sums over the mixes, x times their lengths, closest to demand (by length; demand[0] counts
    for nothing).

    An active-set method: of the mixes that lower the error most, `together` with no length in common come in, those that
    would be used less than zero times go, and what is left is solved again. Where that doesn't lower the error, a round is
    taken back and the next one lets a single mix in and out at a time, which always does. It ends where no mix would bring
    its lengths nearer by half a piece, or by 1e-5 of the most frequent length's number. If `rounds` don't do, the log says
    so: x is then short of optimal, which the packing of what is over makes up for."""
    x = np.zeros(len(rows))
    goal = demand.astype(float)
    goal[0] = 0
    scale = goal.max() or 1.0
    if not len(rows):
        return x
    goal = goal / scale
    least = max(0.5 / scale, 1e-5)
    inside, single = np.empty(0, np.int64), False
    gram, error = np.zeros((0, 0)), goal.copy()

    def against(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        dense = np.zeros((len(others), len(goal)))
        np.add.at(dense, (np.repeat(np.arange(len(others)), DEPTH), rows[others].ravel()), 1.0)
        dense[:, 0] = 0
        return dense[:, rows[some]].sum(axis=2).T

    for _ in range(rounds):
        gain = error[rows].sum(axis=1)
        gain[inside] = 0
        best = np.argsort(-gain, kind="stable")[: 40 * together]
        taken, new = {0}, []
        for k in best[gain[best] > least].tolist():
            mine = set(rows[k].tolist())
            if mine & taken <= {0}:
                taken |= mine
                new.append(k)
                if single or len(new) == together:
                    break
        if not new:
            return x * scale
        old, new = (inside, gram, x, error), np.array(new)
        cross = against(inside, new)
        gram = np.block([[gram, cross], [cross.T, against(new, new)]])
        inside, x = np.append(inside, new), x.copy()
        wanted = goal[rows].sum(axis=1)
        while len(inside):
            found = np.linalg.solve(gram + 1e-9 * np.eye(len(inside)), wanted[inside])
            low = found <= 0
            if not low.any():
                x[inside] = found
                break
            if single:
                step = np.min(x[inside][low] / (x[inside][low] - found[low]))
                x[inside] += step * (found - x[inside])
                low &= x[inside] <= 1e-12
                if not low.any():  # as near as doubles go
                    break
            x[inside[low]] = 0
            inside, gram = inside[~low], gram[np.ix_(~low, ~low)]
        error = goal - np.bincount(rows[inside].ravel(), np.repeat(x[inside], DEPTH), len(goal))
        error[0] = 0
        if error @ error >= old[3] @ old[3]:
            if single:
                return old[2] * scale
            inside, gram, x, error = old
            single = True
        else:
            single = False
    log.warning("least squares stopped after %d rounds", rounds)
    return x * scale


class Plan:
    """Where pieces go. runs: for each length rows of first rank, first sequence, per sequence, offset; laid: for each
    length the first rank that is laid end to end and where; edges: where the sequences of that part begin, with its end;
    base: the first of those sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        left = np.zeros(capacity + 1, np.int64)
        for n, c in histogram.items():
            left[n] = c
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        given: dict[int, int] = defaultdict(int)

        def use(contents: list[tuple[int, int]], count: int) -> None:
            offset = 0
            for n, each in contents:
                self.runs[n].append((given[n], self.sequences, each, offset))
                given[n] += each * count
                offset += n * each
            self.sequences += count

        if left[capacity]:
            use([(capacity, 1)], int(left[capacity]))
            left[capacity] = 0
        rows = mixes(np.flatnonzero(left), capacity)
        x = nonnegative_least_squares(rows, left)
        for k in np.argsort(-x, kind="stable"):
            times = int(np.floor(x[k] + 0.5))
            if not times:
                break
            kinds, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
            times = int(min(times, (left[kinds] // each).min()))
            if times:
                use([(int(n), int(e)) for n, e in zip(kinds[::-1], each[::-1], strict=True)], times)
                left[kinds] -= times * each
        self.mixed = self.sequences
        bins = Bins(capacity)
        for n in np.flatnonzero(left)[::-1]:
            bins.fit(int(n), int(left[n]))
        rest: dict[int, int] = defaultdict(int)
        for contents, count in (x for classes in bins.classes.values() for x in classes):
            fill = sum(n * each for n, each in contents)
            if fill == capacity or not fill & (fill - 1):
                use(list(contents), count)
            else:
                for n, each in contents:
                    rest[n] += each * count
        self.laid: dict[int, tuple[int, int]] = {}
        total = 0
        for n in sorted(rest, reverse=True):
            self.laid[n] = (given[n], total)
            total += n * rest[n]
        whole, tail = total // capacity * capacity, total % capacity
        begins = [tail >> k + 1 << k + 1 for k in range(capacity.bit_length()) if tail >> k & 1]  # of its powers of two
        self.whole, self.edges, self.base = whole, whole + np.array(sorted({0, *begins, tail}), np.int64), self.sequences
        self.sequences += whole // capacity + len(self.edges) - 1
        self.tables = {n: np.array(v, np.int64) for n, v in self.runs.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces that aren't laid end to end."""
        runs = self.tables[length]
        k = np.searchsorted(runs[:, 0], ranks, "right") - 1
        within = ranks - runs[k, 0]
        return runs[k, 1] + within // runs[k, 2], runs[k, 3] + within % runs[k, 2] * length

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Parts of a piece that is laid end to end: start and length in the piece, sequence, offset."""
        first, at = self.laid[length]
        here = at + (rank - first) * length
        end, out, done = here + length, [], here
        while done < end:
            if done < self.whole:
                sequence, begin = done // self.capacity, done // self.capacity * self.capacity
                upto = begin + self.capacity
            else:
                k = int(np.searchsorted(self.edges, done, "right")) - 1
                sequence, begin, upto = self.whole // self.capacity + k, int(self.edges[k]), int(self.edges[k + 1])
            stop = min(end, upto)
            out.append((done - here, stop - done, self.base + sequence, done - begin))
            done = stop
        return out


# ---- over tables ----


def pack(spark: SparkSession, cut: DataFrame, capacity: int = 1024, kind: str = "<u2") -> DataFrame:
    """Places for a stored table of pieces(); RESULT."""
    by_length = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    plan = Plan(by_length, capacity)
    # cells: 1 + rows / CELL for each length, so at most capacity + rows / CELL of them
    cells = spark.createDataFrame([(n, 1 + c // CELL) for n, c in by_length.items()], "length long, cells long")
    salted = cut.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "cells")).drop("cells")
    firsts = spark.createDataFrame([(n, first) for n, (first, _) in plan.laid.items()], "length long, first_laid long")
    counted = salted.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("cell")) - F.col("n")
    counted = counted.withColumn("base", before).join(F.broadcast(firsts), "length", "left")
    counted = counted.select("length", "cell", "base", F.coalesce(F.col("base") + F.col("n") > F.col("first_laid"), F.lit(False)).alias("laid"))
    based = salted.join(F.broadcast(counted), ["length", "cell"]).withColumn("ids", F.when(F.col("laid"), F.col("ids")))
    rank = F.row_number().over(W.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - F.lit(1) + F.col("base")
    ranked = based.withColumn("rank", rank.cast("long")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids")
    sent = spark.sparkContext.broadcast(plan)  # a few numbers for each mix and length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        names = list(COLUMNS)
        for batch in batches:
            length, ranks = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            laid: list[np.ndarray] = []
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                late = ranks[mine] >= plan.laid[n][0] if n in plan.laid else np.zeros(len(mine), bool)
                laid.append(mine[late])
                mine = mine[~late]
                if len(mine):
                    sequence[mine], offset[mine] = plan.place(int(n), ranks[mine])
            late = np.sort(np.concatenate([np.empty(0, np.int64), *laid]))
            whole = np.delete(np.arange(len(ranks)), late)
            kept = batch.take(pa.array(whole))
            columns = [kept.column(c) for c in names[:5]] + [pa.array(sequence[whole]), pa.array(offset[whole])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            rows = []
            for r in batch.take(pa.array(late)).to_pylist():
                parts = plan.cut(r["length"], r["rank"])
                ids = np.frombuffer(r["ids"], kind).astype("<u4") if len(parts) > 1 else None
                for start, size, s, o in parts:
                    crc = r["ids_crc32"] if ids is None else zlib.crc32(ids[start : start + size].tobytes())
                    rows.append((r["doc_id"], r["start"] + start, size, crc, r["doc_tokens"], s, o))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(shared.released(run), RESULT)


def packed(spark: SparkSession, docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Packs documents(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty, which is one token, the end id. Repeated rows and rows without doc_id are all packed, those that are
    equal in any order. Texts of any length are encoded whole, and cut into as many pieces as they need. Other columns,
    whatever their names, are left aside. An empty table gives no sequence. Every sequence is full or a power of two."""
    cut = shared.stored(pieces(docs, capacity, end_id, vocabulary), "pieces")
    return pack(spark, cut, capacity, width(vocabulary, end_id))
