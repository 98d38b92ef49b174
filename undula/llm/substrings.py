"""Removal of repeated passages by level-wise doubling.

Windows of a few words are counted first, then those of twice the length, up to the window asked for (9, 18 and 35 words
for 35). At each level only windows are counted that were repeated at the level below, and the loop ends as soon as no
candidates survive. Repeats longer than the window are covered by repeated windows, so nothing longer needs counting.

Not every short window stands for the longer one: of each window only its least half by hash is looked at, and of that
the least half again. Equal windows have the same ones, so no repeat is lost, and about a tenth of the places are
counted at the lower levels.

What the last level counts are runs: consecutive windows with the same least half window. Runs of the same words are
counted as one with their number, so a passage that a third of all documents have costs one row a task. A run that is
there more than once is repeated as a whole; of runs that are there once, the windows are counted apart, together with
those of all other runs.

The lower levels come back to the texts as bitmaps of fixed size. They may let windows through that aren't repeated,
more of them the larger the corpus, but they stop none that is, and the counts of the last level are exact (two hashes,
of 64 and 32 bits, made from different hashes of the words, must agree). Only texts with a repeat are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import shared, words

#: Windows of a run at most: their repeats are bits of a long.
RUN = 32
#: Words that the first level's windows have at least, unless the window asked for has fewer.
FIRST = 8
#: Bits of a bitmap for each hash, and at most.
BITS_EACH, MOST_BITS, LEAST_BITS = 32, 1 << 29, 1 << 16
_SECOND, _SECOND_GRAM = 0xA24BAED4963EE407, 0x9FB21C651E98DF25
_TEXT = ["r", "s"]  # the hashes that stand for a text


def levels(window: int) -> list[int]:
    """Window lengths, each about twice the next, from the one asked for down to the first level's."""
    out = [window]
    while (out[-1] + 1) // 2 >= FIRST:
        out.append((out[-1] + 1) // 2)
    return out if len(out) > 1 else [window, (window + 1) // 2]


class _Windows:
    """The windows of one level in joined texts: places, hashes, and for all levels but the lowest the hash of the least
    window of the level below."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lengths: list[int], level: int):
        starts, stops, self.before = words.spans(data, ends)
        hashed = words.hashes(data, starts, stops)
        counts = np.diff(self.before)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.data, self.starts, self.stops = data, starts, stops
        n, window = len(hashed), lengths[0]
        self.at, self.hash, self.below = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        if n < window:
            return
        chosen = self.owner[: n - window + 1] == self.owner[window - 1 :]  # windows of the level in hand that count
        gram = words.grams(hashed, window) if not level else None
        for upper, lower in zip(lengths, lengths[1:], strict=False):
            width = upper - lower + 1  # lower windows in an upper one
            under = words.grams(hashed, lower)
            least = words.sliding(under, width)
            if upper == lengths[level]:
                self.at = np.flatnonzero(chosen)
                self.hash, self.below = gram[self.at], least[self.at]
                return
            padded = np.zeros(len(under) + width - 1, np.uint64)
            padded[width - 1 : width - 1 + len(least)] = np.where(chosen, least, np.uint64(0))
            chosen, gram = words.sliding(padded, width, np.maximum) == under, under
        self.at = np.flatnonzero(chosen)
        self.hash = gram[self.at]

    def second(self, n: int) -> np.ndarray:
        """Another hash, of 32 bits, of the windows of n words at all places."""
        return (words.grams(words.hashes(self.data, self.starts, self.stops, base=_SECOND), n, _SECOND_GRAM) >> np.uint64(32)).astype(np.uint32)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - (bits - 1).bit_length())


def _in(passed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap."""
    place = _place(hashes, len(passed) * 8)
    return (passed[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated(docs: DataFrame, lengths: list[int], level: int, passed=None) -> DataFrame:
    """h (as a signed long) of the windows of a lower level that are there twice or more; passed: the broadcast bitmap of
    the level below, None at the lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.parts(batches, "text"):
            made = _Windows(*shared.joined(batch.column("text")), lengths, level)
            found, n = np.unique(made.hash if passed is None else made.hash[_in(passed.value, made.below)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = shared.text_only(docs, "text").mapInArrow(shared.released(run), "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of the leading bits of n hashes (h long), 2**k of them, at most MOST_BITS: made in slices by ranges."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << max(1, (n * BITS_EACH - 1)).bit_length()))
    slices = max(1, bits >> 22)
    each = bits // slices
    place = F.shiftrightunsigned("h", 64 - (bits - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column("place"))
            for k in np.unique(at // each).tolist():
                own = made.setdefault(k, np.zeros(each // 8, np.uint8))
                rest = at[at // each == k] % each
                np.bitwise_or.at(own, rest >> 3, np.left_shift(np.uint8(1), (rest & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(made), pa.int64()), "b": pa.array([x.tobytes() for x in made.values()], pa.binary())})

    placed = hashes.select(place.alias("place")).repartition(slices, (F.col("place") / F.lit(each)).cast("long"))
    out = np.zeros(bits // 8, np.uint8)
    for row in placed.mapInArrow(shared.released(run), "k long, b binary").toLocalIterator():  # together MOST_BITS at most
        out[row.k * (each // 8) :][: each // 8] |= np.frombuffer(row.b, np.uint8)
    return out


def candidate_runs(docs: DataFrame, lengths: list[int], passed) -> DataFrame:
    """Runs of candidate windows: r and s (the text's hashes), first (place of its first word), seg and seg2 (the run's
    hashes), windows (their hashes, of 8 and 4 bytes each)."""
    window = lengths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.parts(batches, "text"):
            w = _Windows(*shared.joined(batch.column("text")), lengths, 0)
            keep = _in(passed.value, w.below)
            at, full, least = w.at[keep], w.hash[keep], w.below[keep]
            if not len(at):
                continue
            second = w.second(window)[at]
            owner = w.owner[at]
            new = np.concatenate(([True], (np.diff(at) != 1) | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
            first = np.flatnonzero(new)
            since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            starts = np.flatnonzero(since % RUN == 0)
            size = np.diff(np.append(starts, len(at))).astype(np.uint64)
            up, _ = words.powers(0xA0761D6478BD642F, RUN + 1)
            seg = words.mix(np.add.reduceat(full * up[since % RUN], starts) + size)
            seg2 = (words.mix(np.add.reduceat(second.astype(np.uint64) * up[since % RUN], starts) + size) >> np.uint64(32)).astype(np.uint32)
            pairs = np.empty(len(at), [("h", "<u8"), ("g", "<u4")])
            pairs["h"], pairs["g"] = full, second
            offsets = (np.append(starts, len(at)) * pairs.itemsize).astype(np.int32)
            windows = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])
            owners = pa.array(owner[starts])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(owners) for c in _TEXT), pa.array(at[starts] - w.before[owner[starts]]), pa.array(seg.view(np.int64)), pa.array(seg2.view(np.int32)), windows],
                names=[*_TEXT, "first", "seg", "seg2", "windows"],
            )

    return docs.mapInArrow(shared.released(run), "r long, s int, first long, seg long, seg2 int, windows binary")


def _windows_of(runs: DataFrame, placed: bool) -> DataFrame:
    """A row per window of the runs (seg, seg2, windows): h, g, and where asked for seg, seg2 and k (its place in the run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, ends = shared.joined(batch.column("windows"))
                pairs = data.view([("h", "<i8"), ("g", "<i4")])
                hashes = [pa.array(np.ascontiguousarray(pairs[c])) for c in ("h", "g")]
                if not placed:
                    yield pa.RecordBatch.from_arrays(hashes, names=["h", "g"])
                    continue
                size = np.diff(ends) // pairs.itemsize
                row = np.repeat(np.arange(len(size)), size)
                k = np.arange(len(row)) - np.repeat(ends[:-1] // pairs.itemsize, size)
                yield pa.RecordBatch.from_arrays([*hashes, *(pa.array(np.asarray(batch.column(c))[row]) for c in ("seg", "seg2")), pa.array(k.astype(np.int8))], names=["h", "g", "seg", "seg2", "k"])

    return runs.mapInArrow(shared.released(run), "h long, g int, seg long, seg2 int, k byte" if placed else "h long, g int")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame | None:
    """r, s, found: of each text the places (first word of a run, bits of its windows) of its repeated windows; n: how
    many documents have the text, or more; stored. None: no candidates survived."""
    session = docs.sparkSession
    lengths = levels(window)
    passed = None
    for level in range(len(lengths) - 1, 0, -1):
        survivors, path = shared.stored_at(repeated(docs, lengths, level, passed), "level")
        n = survivors.count()
        if not n:
            return None
        passed = session.sparkContext.broadcast(bitmap(survivors, n))
        shared.remove(session, path)
    wide, path = shared.stored_at(candidate_runs(docs, lengths, passed), "runs")
    run = ["seg", "seg2"]
    segments, *paths = shared.stored_at(wide.groupBy(*run).agg(F.count("*").alias("n"), F.min("windows").alias("windows")), "segments")
    runs, places = shared.stored_at(wide.groupBy(*_TEXT, "first", *run).agg(F.count("*").alias("texts")), "places")  # copies are one
    shared.remove(session, path)
    many, once = segments.where("n > 1"), segments.where("n = 1")
    single = _windows_of(once, True)
    number = single.select("h", "g", F.lit(1).alias("n")).union(_windows_of(many, False).select("h", "g", F.lit(2).alias("n")))
    twice = number.groupBy("h", "g").agg(F.sum("n").alias("total")).where("total > 1").select("h", "g")
    marks = single.join(twice, ["h", "g"]).groupBy(*run).agg(F.bit_or(F.expr("shiftleft(1L, CAST(k AS int))")).alias("bits"))
    marks = marks.withColumn("n", F.lit(1).cast("long")).union(many.select(*run, F.expr("shiftleft(1L, CAST(octet_length(windows) div 12 AS int)) - 1"), "n"))
    marks, marked = shared.stored_at(marks, "marks")
    by_text = shared.join_hot(runs, marks, run, "n").groupBy(*_TEXT).agg(F.collect_list(F.struct("first", "bits")).alias("found"), F.max("texts").alias("n"))
    found = shared.stored(by_text, "found")
    for path in (*paths, places, marked):
        shared.remove(session, path)
    return found


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def _stripped(batch: pa.RecordBatch, found: pa.Array | None, window: int) -> pa.RecordBatch:
    """_RESULT of a batch with doc_id and text; found: as repeated_windows() has it, for each row."""
    out: list[tuple] = []
    for row, text in enumerate(shared.raw(batch.column("text"))):
        own = (text or b"").split()
        n = len(own)
        if found is not None and found[row].is_valid:
            places = found[row].values
            first, bits = np.asarray(places.field("first")), np.asarray(places.field("bits"))
            edge = np.zeros(n + 1, np.int64)
            for k in range(RUN):
                at = first[(bits >> k) & 1 == 1] + k
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            keep = np.cumsum(edge)[:n] == 0
            own = [x for x, k in zip(own, keep.tolist(), strict=True) if k]
        kept = b" ".join(own)
        out.append((n, n - len(own), hashlib.sha256(kept).hexdigest(), kept.decode()))
    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])


def strip(docs: DataFrame, window: int = 35) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, text (what is kept, joined by single spaces).

    A word goes if a window of `window` consecutive words over it starts anywhere else too, in the same document or
    another; repeated rows are elsewhere. Words are what white space (space, \\t to \\r) separates, compared as they
    are. Null text has no words; shorter texts than a window keep all. An empty table gives no rows.
    """
    shared.bounded_batches(docs.sparkSession)
    rows = shared.text_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.withColumns({"r": F.xxhash64("text"), "s": F.hash("text")})
    found, passed = repeated_windows(keyed, window), None
    if found is not None:
        passed = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(F.col("r").alias("h")), found.count()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch if passed is None else batch.filter(pa.array(~_in(passed.value, np.asarray(batch.column("r")).view(np.uint64))))
            if rest.num_rows:
                yield _stripped(rest, None, window)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(passed.value, np.asarray(batch.column("r")).view(np.uint64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _stripped(batch, batch.column("found"), window)

    if found is None:
        return keyed.mapInArrow(shared.released(whole), _RESULT)
    # a text without a repeat may be among these too: the join finds nothing for it
    some = keyed.mapInArrow(shared.released(touched), "doc_id long, text string, r long, s int")
    return keyed.mapInArrow(shared.released(whole), _RESULT).union(shared.join_hot(some, found, _TEXT, "n", "left").select("doc_id", "text", "found").mapInArrow(shared.released(cut), _RESULT))
