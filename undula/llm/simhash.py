"""SimHash near-duplicates, links verified through pivot distance tables.

Fingerprints that differ in `bits` = 3 places or fewer are linked. Exact copies of a fingerprint are one node. Of four
16-bit blocks such a pair shares one, and of the other 48 bits' four 12-bit blocks one again, so it meets in at least
one of 16 tables keyed by 28 bits. In a bucket the Hamming distances of each fingerprint to PIVOTS reference
fingerprints are computed once; by the triangle inequality a pair whose distances to some pivot differ by more than 3
can't be linked and is discarded, and what survives is verified by its own distance. Buckets are walked in order of
the first pivot's distance, so that pairs too far apart there are never formed.

A bucket of more than TILE fingerprints is cut into tiles, each pair of tiles a task's work of its own. From a tile
come the edges of a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import shared
from undula.llm.components import components

BITS, PIVOTS, TILE = 3, 16, 2048
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included; 0 without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(digests), 65_536):  # a long text's bits, some at a time
        counts += np.unpackbits(digests[k : k + 65_536], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, column: str, shingle: int = 3) -> DataFrame:
    """docs (any columns, with text) and the fingerprint as a signed long in `column`."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, shingle) for x in shared.raw(batch.column("text"))], np.uint64).view(np.int64)
            yield shared.with_columns(batch.drop_columns(["text"]), {column: pa.array(made)})

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(shared.released(run), T.StructType([*kept, T.StructField(column, T.LongType())]))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from the splitmix64 sequence."""
    out = np.empty(n, np.uint64)
    state, mask = 0, (1 << 64) - 1
    for k in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out[k] = z ^ (z >> 31)
    return out


def keys(fp: str) -> list:
    """The 16 table keys of a fingerprint column: table, 16-bit block and 12-bit block of the rest."""
    out = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = F.col(fp).bitwiseAND(F.lit((1 << 16 * i) - 1))
        rest = low if i == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i).bitwiseOR(low)
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return out


def _find(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def forest(group: np.ndarray, fps: np.ndarray, side: np.ndarray | None, bits: int = BITS, table: np.ndarray | None = None, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places of rows) that connect what links of at most `bits` connect, within each group.

    side: where given, only rows of different sides (or of side -1) are compared. tally: gets how many pairs the first
    pivot's order has let through (formed), how many the other pivots have (verified), and how many link (linked).
    """
    table = pivots() if table is None else table
    distance = np.bitwise_count(fps[:, None] ^ table[None, :]).astype(np.int8)
    order = np.lexsort((distance[:, 0], group))
    group, fps, distance = group[order], fps[order], distance[order]
    side = None if side is None else side[order]
    n = len(fps)
    label = np.arange(n)
    alive = np.arange(n)
    lag = 0
    while True:
        lag += 1
        alive = alive[alive + lag < n]
        near = group[alive] == group[alive + lag]
        near &= distance[alive + lag, 0] - distance[alive, 0] <= bits
        alive = alive[near]  # sorted by the first pivot: what is too far stays so
        if not len(alive):
            break
        a = alive[label[alive] != label[alive + lag]]
        if side is not None:
            a = a[(side[a] != side[a + lag]) | (side[a] < 0)]
        formed = len(a)
        for k in range(1, distance.shape[1]):
            if not len(a):
                break
            a = a[np.abs(distance[a, k] - distance[a + lag, k]) <= bits]
        verified = len(a)
        a = a[np.bitwise_count(fps[a] ^ fps[a + lag]) <= bits]
        if tally is not None:
            for name, pairs in (("formed", formed), ("verified", verified), ("linked", len(a))):
                tally[name] = tally.get(name, 0) + pairs
        while len(a):
            x, y = label[a], label[a + lag]
            apart = x != y
            if not apart.any():
                break
            a, x, y = a[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            label = _find(label)
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def links(nodes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """nodes(fp long, distinct) -> links (u, v) whose components are those of all pairs at most `bits` apart."""
    if bits > 3:
        raise ValueError("the tables find pairs up to 3 bits apart")
    shared.bounded_batches(nodes.sparkSession)
    keyed = nodes.select("fp", F.explode(F.array(*keys("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = keyed.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)))
    found = found.withColumn("own", F.pmod(F.xxhash64("fp"), "tiles"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    found = found.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    dealt = found.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)
            group = np.concatenate(([0], np.cumsum(change)))
            side = np.where(rows[1] == rows[2], -1, rows[3] == rows[1])
            fps = np.ascontiguousarray(rows[4]).view(np.uint64)
            u, v = forest(group, fps, side, bits)
            return pa.RecordBatch.from_arrays([pa.array(rows[4][u]), pa.array(rows[4][v])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "a", "b", "own", "fp")])
            held.append(rows)
            rows = np.concatenate(held, axis=1) if len(held) > 1 else rows
            last = np.flatnonzero(np.any(rows[:3] != rows[:3, -1:], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held = [rows[:, cut:]]
            if cut:
                yield made(rows[:, :cut])
        if held and held[0].shape[1]:
            yield made(held[0])

    return dealt.mapInArrow(shared.released(run), "u long, v long").distinct()


def named(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """marked(doc_id, fp, ...) -> fp, root (one fingerprint of its component), component_id (its least doc_id), n (rows
    with that fingerprint). Fingerprints are distinct here, so copies, however many, are one row of each join."""
    nodes = shared.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "root", "component_id", "n")


def groups(docs: DataFrame, bits: int = BITS, shingle: int = 3) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fingerprint, component_id (the least doc_id reachable by links).

    Null and empty texts and texts of separators have fingerprint zero and are linked like others. A null doc_id is in
    its component but not its name, unless all are null. Repeated rows stay. An empty table gives no rows.
    """
    rows = shared.text_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = shared.stored(fingerprints(rows, "fp", shingle), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return shared.join_hot(marked, shared.stored(named(marked, bits), "named"), ["fp"], "n").select("doc_id", hexed.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS, shingle: int = 3) -> DataFrame:
    """docs (any columns) with one row of each component: that of the least doc_id (nulls last), of several such rows
    one. An empty table stays empty."""
    keys = [F.xxhash64("doc_id", "text"), F.hash("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", keys[0].alias("r"), keys[1].alias("s"))
    marked = shared.stored(fingerprints(rows, "fp", shingle), "fingerprints")
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r", "s")).alias("x"))
    kept = first.join(named(marked, bits), "fp").groupBy("root").agg(F.min("x").alias("x")).select("x.r", "x.s")
    r, s = shared.fresh(docs.columns, "r"), shared.fresh(docs.columns, "s")
    keyed = docs.withColumns({r: keys[0], s: keys[1]})
    return keyed.join(kept.withColumnsRenamed({"r": r, "s": s}), [r, s], "left_semi").dropDuplicates([r, s]).select(*(F.col(f"`{c}`") for c in docs.columns))
