"""Best-fit packing by linear grouping, over a histogram of lengths.

Pieces differ for packing only by their length, 1 to `capacity`, so the whole plan is made from a histogram of at most
`capacity` rows, however many documents there are:

1. Lengths over `large` are put in descending order and cut into groups of equal cardinality; within a group every
   length counts as the group's largest.
2. The few sizes left are packed by configurations (how many of each size go in one sequence): a linear programme
   solved by column generation, its solution rounded down, the rest packed best-fit.
3. Actual lengths, by run-length, take the places of their group's size, which leaves each sequence its true room.
4. Small lengths are packed best-fit, longest first, into that room and then into new sequences.

Where `large` isn't given, the plan is made for each of SHARES of the capacity and the one of fewest sequences kept.

The plan gives ranks within a length to runs of sequences. Pieces get their rank by two counts, one salted, so that a
length that a third of all rows have isn't gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm import shared
from undula.llm.tokens import encoder

SHARES = (1 / 8, 1 / 4, 1 / 3, 2 / 5, 1 / 2)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of documents(doc_id, text). A document longer than capacity is cut into pieces of capacity, of
    which the first may be shorter. Null text is empty, and so one piece of end_id alone."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.parts(batches, "text", 4 << 20):
            columns: list[list] = [[] for _ in range(6)]
            ids, ends = encoder(vocabulary).encode(batch.column("text"), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            for doc_id, first, end in zip(batch.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                n, at = end - first, 0
                size = n % capacity or min(n, capacity)
                for piece in range(-(-n // capacity)):
                    part = data[4 * (first + at) : 4 * (first + at + size)]
                    for column, value in zip(columns, (doc_id, piece, at, size, zlib.crc32(part), bytes(part) if with_ids else None), strict=True):
                        column.append(value)
                    at, size = at + size, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])

    rows = shared.text_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(shared.released(run), PIECES + (", ids binary" if with_ids else ""))


# ---- the plan ----


def grouped_sizes(histogram: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cuts (length, count), longest first, into runs of about equal total count; a length may be shared by two."""
    total = sum(c for _, c in histogram)
    out: list[list[tuple[int, int]]] = []
    if len(histogram) <= groups:
        return [[x] for x in histogram]
    share, room = -(-total // groups), 0
    for length, count in histogram:
        while count:
            if not room:
                out.append([])
                room = share
            take = min(room, count)
            out[-1].append((length, take))
            room, count = room - take, count - take
    return out


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration worth most: an unbounded knapsack over capacity."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, size in enumerate(sizes):
        if values[k] > 1e-12:
            for _ in range(capacity // size):  # each pass allows one more of this size
                with_one = best[:-size] + values[k]
                better = with_one > best[size:] + 1e-12
                if not better.any():
                    break
                best[size:][better] = with_one[better]
                chosen[size:][better] = k
    pattern, at = np.zeros(len(sizes), np.int64), capacity
    # best is non-decreasing in room; walk down to where a size was taken
    while at > 0:
        if chosen[at] < 0:
            break
        pattern[chosen[at]] += 1
        at -= sizes[chosen[at]]
    return float(pattern @ values), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, to meet demand with the fewest sequences: the revised simplex method,
    columns made when priced. Stops early after `steps`, which costs optimality alone."""
    m = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.linalg.inv(basis)
    used = inverse @ np.array(demand, float)
    for step in range(steps):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        into = inverse @ pattern
        able = into > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = np.maximum(used[able], 0) / into[able]
        out = int(np.argmin(ratio))
        used = used - ratio[out] * into
        used[out] = ratio[out]
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ np.array(demand, float), 0)
        else:
            row = inverse[out] / into[out]
            inverse -= np.outer(into, row)
            inverse[out] = row
    return [(np.round(basis[:, k]).astype(np.int64), float(used[k])) for k in range(m)]


class Runs:
    """Lengths of one group waiting for places, by run-length, longest first."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = [list(x) for x in reversed(runs)]

    @property
    def left(self) -> int:
        return sum(c for _, c in self.runs)

    def peek(self) -> tuple[int, int]:
        return tuple(self.runs[-1])

    def take(self, count: int) -> None:
        self.runs[-1][1] -= count
        if not self.runs[-1][1]:
            self.runs.pop()


class Bins:
    """Sequences by room left, each class a count of sequences with the same contents."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # sorted, of classes that are open
        self.classes: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def add(self, contents: tuple[tuple[int, int], ...], count: int) -> None:
        room = self.capacity - sum(length * n for length, n in contents)
        if not self.classes[room]:
            bisect.insort(self.rooms, room)
        self.classes[room].append((contents, count))

    def fit(self, length: int, count: int) -> None:
        """Best fit: the fullest sequence that can take the length, filled with it as far as it goes, then the next."""
        while count:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = min(count, self.capacity // length)
                self.add(((length, each),), count // each)
                if count % each:
                    self.add(((length, count % each),), 1)
                return
            room = self.rooms[k]
            contents, n = self.classes[room].pop()
            if not self.classes[room]:
                self.rooms.pop(k)
            each = room // length
            whole = min(n, count // each)
            if whole:
                self.add((*contents, (length, each)), whole)
            rest = count - whole * each
            if n > whole:
                if rest and rest < each:
                    self.add((*contents, (length, rest)), 1)
                    n, rest = n - 1, 0
                if n > whole:
                    self.add(contents, n - whole)
            count = rest


def plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 64, large: int | None = None) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Contents (length, how many) and how many sequences have them, for a histogram of lengths up to capacity."""
    if large is None:
        tried = [plan(histogram, capacity, groups, int(share * capacity)) for share in SHARES]
        return min(tried, key=lambda x: sum(n for _, n in x))
    bins = Bins(capacity)
    if full := histogram.get(capacity, 0):
        bins.add(((capacity, 1),), full)
    order = sorted(((n, c) for n, c in histogram.items() if 0 < n < capacity and c), reverse=True)
    cut = grouped_sizes([x for x in order if x[0] > large], groups)
    if cut:
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for group in cut:
            by_size[group[0][0]].extend(group)
        sizes = sorted(by_size, reverse=True)
        waiting = [Runs(by_size[s]) for s in sizes]
        for pattern, times in sorted(configurations(sizes, [w.left for w in waiting], capacity), key=lambda x: -x[1]):
            slots = [k for k, n in enumerate(pattern) for _ in range(n)]
            left = min([int(times + 1e-6), *(waiting[k].left // n for k, n in enumerate(pattern) if n)], default=0)
            while left and slots:
                contents: dict[int, int] = defaultdict(int)
                runs = {k: waiting[k].peek() for k in set(slots)}
                alike = min(left, *(runs[k][1] // int(pattern[k]) for k in runs))
                if alike:
                    for k, (length, _) in runs.items():
                        contents[length] += int(pattern[k])
                        waiting[k].take(alike * int(pattern[k]))
                else:  # a run ends within this one sequence
                    alike = 1
                    for k in slots:
                        contents[waiting[k].peek()[0]] += 1
                        waiting[k].take(1)
                bins.add(tuple(sorted(contents.items(), reverse=True)), alike)
                left -= alike
        rest: dict[int, int] = defaultdict(int)
        for w in waiting:
            for length, count in w.runs:
                rest[length] += count
        for length in sorted(rest, reverse=True):
            bins.fit(length, rest[length])
    for length, count in order:
        if length <= large:
            bins.fit(length, count)
    return [x for classes in bins.classes.values() for x in classes]


def places(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks and where they go: columns first rank, first sequence, per sequence, offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for contents, count in planned:
        offset = 0
        for length, each in contents:
            out[length].append((given[length], sequence, each, offset))
            given[length] += each * count
            offset += each * length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(spark: SparkSession, cut: DataFrame, capacity: int = 2048, groups: int = 64, large: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (with doc_id, piece, length, ...), which must read alike every time."""
    rows = cut.groupBy("length").count().collect()  # at most capacity rows
    where = places(plan({r["length"]: r["count"] for r in rows}, capacity, groups, large))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank, salt, base = (shared.fresh(cut.columns, x) for x in ("rank", "salt", "base"))
    salted = cut.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    n = shared.fresh(cut.columns, "n")
    bases = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    bases = bases.withColumn(base, F.sum(n).over(W.partitionBy("length").orderBy(salt)) - F.col(n)).drop(n)
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy("length", salt).orderBy("doc_id", "piece")) - F.lit(1))
    ranked = ranked.join(bases, ["length", salt]).withColumn(rank, F.col(rank) + F.col(base)).drop(salt, base)
    sent = spark.sparkContext.broadcast(where)  # at most a few entries for each length and configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            ranks = np.asarray(batch.column(rank))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for size in np.unique(length):
                mine, runs = np.flatnonzero(length == size), sent.value[int(size)]
                k = np.searchsorted(runs[:, 0], ranks[mine], "right") - 1
                within = ranks[mine] - runs[k, 0]
                sequence[mine] = runs[k, 1] + within // runs[k, 2]
                offset[mine] = runs[k, 3] + within % runs[k, 2] * size
            kept = batch.drop_columns([rank])
            yield shared.with_columns(kept, {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    from pyspark.sql import types as T

    fields = [f for f in ranked.schema.fields if f.name != rank]
    return ranked.mapInArrow(shared.released(run), T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed(spark: SparkSession, docs: DataFrame, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Packs documents(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty; repeated rows are all packed; an empty table gives no sequence."""
    cut = shared.stored(pieces(docs, capacity, end_id), "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pack(spark, cut, capacity, **options).select(*order, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The token sequences themselves, from placed pieces that have ids: sequence_id, ids (little-endian unsigned
    32-bit integers), pieces. A sequence holds at most capacity pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    row = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return row.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"))
