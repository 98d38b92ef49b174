"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words.

Texts are normalised byte by byte: A-Z in lower case, every other ASCII byte but 0-9 and a-z a separator, bytes of
other characters kept. Each word that the benchmark has becomes a few symbols of a small alphabet, another one for each
place, so that matches are of whole words and no node has many branches.

The automaton's patterns are an item's blocks of half a window (7 words of 13), one after another, at three nodes for
each word of the benchmark. Every window holds a whole block, so where a block is found, the few windows of the text
around it are looked up among the items' windows, each of which stands once, with all items that have it, in an array
sorted by hash; what is found is compared word by word. So a block that very many items share costs a text no more than
another. Items shorter than a window are patterns of their own. A text is scanned once; where there are matches, the
words' places are mapped back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import shared

_KEEP = re.compile(rb"[0-9a-z\x80-\xff]+")
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Words of the benchmark that are broadcast at once (they and their automaton take some 250 MB of a worker's memory at
#: most). A benchmark beyond that size is matched a part at a time, with the same results.
MOST_WORDS = 1_000_000
#: Symbols for each place of a word's symbols.
ALPHABET = 64
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def item_parts(benchmark: DataFrame, window: int, most: int = MOST_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id, words) in parts of at most `most` words, one part at a time on the driver. A longer item is cut into
    pieces that share window - 1 words, so every window of it is in a piece."""
    items = shared.text_only(benchmark, "item_id", "text").where("text IS NOT NULL")
    held: list[tuple[str, list[bytes]]] = []
    n = 0
    for item_id, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary")).toLocalIterator():
        own = words(bytes(text))
        for k in range(0, max(1, len(own) - window + 1) if own else 0, most):
            piece = own[k : k + most + window - 1] if len(own) > window else own
            if n and n + len(piece) > most + window:
                yield held
                held, n = [], 0
            held.append((item_id, piece))
            n += len(piece)
    if held:
        yield held


def symbols(vocabulary: int) -> Iterator[str]:
    """Different symbols for as many words."""
    places = 1
    while ALPHABET**places < vocabulary:
        places += 1
    digits = [[chr(1 + k * ALPHABET + d) for d in range(ALPHABET)] for k in range(places)]
    return map("".join, product(*digits))


def _numbers(line: str, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a line of symbols starts, and its number, from 1 on; 0: a word that the benchmark lacks."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.flatnonzero(codes <= ALPHABET)  # symbols of other places than a word's first are beyond that
    known = np.flatnonzero(codes[starts])
    numbers = np.zeros(len(starts), np.int64)
    for k in range(places):
        numbers[known] = numbers[known] * ALPHABET + codes[starts[known] + k] - 1 - k * ALPHABET
    numbers[known] += 1
    return starts, numbers


class Windows:
    """The distinct windows of items, each once, by its hash, with the items that have it."""

    def __init__(self, items: list[np.ndarray], window: int):
        self.each = np.arange(window)
        self.flat = np.concatenate([np.zeros(0, np.int64), *items])
        sizes = np.array([max(0, len(x) - window + 1) for x in items], np.int64)
        begins = np.cumsum([0, *map(len, items)])[:-1]
        owner = np.repeat(np.arange(len(items)), sizes)
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(owner))
        for seed in range(64):
            self.factors = np.random.default_rng(seed).integers(0, 1 << 64, window, np.uint64) | np.uint64(1)
            hashes = self._hashes(self.flat, at)
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], at[order]
            change = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), hashes[1:] != hashes[:-1])))
            if self._alike(places, np.repeat(places[change], np.diff([*change, len(at)]))):
                break
        else:
            raise RuntimeError("hashes don't tell the benchmark's windows apart")
        self.hashes, self.sample = hashes[change], places[change]
        self.owner, self.bounds = owner[order], np.append(change, len(at))

    def _hashes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of numbers that start at `at`."""
        mixed = numbers.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        out = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(self.factors):
            out += mixed[at + k] * factor
        return out

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        return all((self.flat[a + k] == self.flat[b + k]).all() for k in self.each)

    def found(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places `at` of a text those whose window an item has, and these windows."""
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        hashes = self._hashes(numbers, at)
        window = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.flatnonzero(self.hashes[window] == hashes)
        at, window = at[same], window[same]
        for k in self.each:  # and word by word
            same = np.flatnonzero(numbers[at + k] == self.flat[self.sample[window] + k])
            at, window = at[same], window[same]
        return at, window

    def owners(self, windows: np.ndarray) -> np.ndarray:
        """The items that have any of the windows."""
        own = [self.owner[self.bounds[w] : self.bounds[w + 1]] for w in np.unique(windows)]
        return np.unique(np.concatenate(own)) if own else windows[:0]


class Matcher:
    """The automaton of some items, and their windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        items = [(item_id, own) for item_id, own in items if own]
        vocabulary = dict.fromkeys(w for _, own in items for w in own)
        self.symbols = dict(zip(vocabulary, symbols(len(vocabulary)), strict=False))
        self.places = len(next(iter(self.symbols.values()), ""))
        #: of each pattern: words, whether it is a block of a window, and the items which it is the whole of
        patterns: dict[str, tuple[int, bool, list[str]]] = {}
        long: list[np.ndarray] = []
        self.names: list[str] = []
        for item_id, own in items:
            whole = len(own) < window
            size = len(own) if whole else self.block
            for at in range(0, len(own) - size + 1, size):
                pattern = "".join([self.symbols[w] for w in own[at : at + size]])
                _, block, names = patterns.get(pattern, (size, False, []))
                patterns[pattern] = (size, block or not whole, [*names, item_id] if whole and item_id not in names else names)
            if not whole:
                long.append(_numbers("".join([self.symbols[w] for w in own]), self.places)[1])
                self.names.append(item_id)
        self.windows = Windows(long, window)
        self.automaton = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            self.automaton.add_word(pattern, value)
        if patterns:
            self.automaton.make_automaton()

    def matches(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words (first, end) that windows cover, and the items whose windows occur."""
        if not own or not self.symbols:
            return [], set()
        line = "".join(map(self.symbols.get, own, repeat("\0")))
        found = list(self.automaton.iter(line))
        if not found:
            return [], set()
        starts, numbers = _numbers(line, self.places)
        ends = np.searchsorted(starts, [last for last, _ in found], "right")
        edge = np.zeros(len(own) + 1, np.int64)
        names: set[str] = set()
        for end, (_, (size, _, whole)) in zip(ends.tolist(), found, strict=True):
            if whole:
                edge[end - size] += 1
                edge[end] -= 1
                names.update(whole)
        blocks = ends[[block for _, (_, block, _) in found]]
        near = np.zeros(len(own) + 1, np.int64)  # places where a window that holds a block may start
        np.add.at(near, np.maximum(blocks - self.window, 0), 1)
        np.add.at(near, blocks - self.block + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[: max(0, len(own) - self.window + 1)])
        at, windows = self.windows.found(numbers, at)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        names.update(self.names[k] for k in self.windows.owners(windows).tolist())
        return runs(np.cumsum(edge)[:-1] > 0), names


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(change[::2], change[1::2], strict=True))


_matchers: dict[int, Matcher] = {}


def _matcher(key: int, sent, window: int) -> Matcher:
    """This process's matcher of a broadcast list of items; one is held at a time."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(sent.value, window)
    return _matchers[key]


def verdict(text: bytes | None, own: list[bytes], covered: list[tuple[int, int]], items: set[str], num: int, den: int) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated, and the covered words as code point spans of the text."""
    hits = sum(b - a for a, b in covered)
    spans: list[tuple[int, int]] = []
    if covered:
        at = [m.span() for m in _KEEP.finditer((text or b"").translate(NORMAL))]
        spans = characters(text or b"", [(at[a][0], at[b - 1][1]) for a, b in covered])
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(own), hits, len(items), digest, hits > 0 and den * hits >= num * len(own), [{"start": a, "end": b} for a, b in spans]


def characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as spans of code points."""
    if not spans:
        return spans
    first = np.frombuffer(text, np.uint8)
    before = np.concatenate(([0], np.cumsum((first & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b])) for a, b in spans]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, num: int = 1, den: int = 20, most: int = MOST_WORDS, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (any columns, with text; those named in `without` are left out) and: n_words, n_hit, n_items, items_sha256,
    contaminated, spans.

    A document is contaminated if words are hit and den * n_hit >= num * n_words. spans are code point offsets of runs
    of hit words in the original text. Null or empty text has no words, and isn't contaminated. Items are told apart by
    item_id (null: one item named "null"); items without words match nothing; an empty benchmark hits nothing.
    Repeated rows are judged alike. Columns of the names added are an error: ValueError.

    A benchmark of up to `most` words goes to the workers and texts are read once. A larger one is matched a part at a
    time; what a part hits is kept by the text's hashes, and joined to the documents at the end.
    """
    shared.bounded_batches(docs.sparkSession)
    fields = shared.kept_fields(docs, without, RESULT)
    parts = item_parts(benchmark, window, most)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _judged(docs, _sent(docs, first), window, num, den, without, fields)
    keys = [F.xxhash64("text").alias("r"), F.hash("text").alias("s")]
    found = None
    for k, part in enumerate(chain((first, second), parts)):
        hits = _hits(docs.select("text", *keys), _sent(docs, part), window).groupBy("r", "s").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("covered", "items")))
        hits = shared.stored(hits, f"hits-{k}")
        found = hits if found is None else found.union(hits)
    r, s, covered, items, n = (shared.fresh(docs.columns, x) for x in ("r", "s", "covered", "items", "n"))
    merged = found.groupBy(F.col("r").alias(r), F.col("s").alias(s)).agg(
        F.max("n").alias(n), F.flatten(F.collect_list("covered")).alias(covered), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items)
    )
    keyed = docs.withColumns({r: F.xxhash64("text"), s: F.hash("text")})
    both = shared.join_hot(keyed, shared.stored(merged, "hits"), [r, s], n, "left").select(*docs.columns, covered, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, names in zip(shared.raw(batch.column("text")), batch.column(covered).to_pylist(), batch.column(items).to_pylist(), strict=True):
                own = words(text)
                hit = np.zeros(len(own), bool)
                for x in spans or ():
                    hit[x["start"] : x["end"]] = True
                rows.append(verdict(text, own, runs(hit), set(names or ()), num, den))
            yield _with_result(batch.drop_columns([covered, items, *without]), rows)

    return both.mapInArrow(shared.released(run), T.StructType([*fields, *RESULT]))


def _sent(docs: DataFrame, items: list[tuple[str, list[bytes]]]):
    return docs.sparkSession.sparkContext.broadcast(items)


def _with_result(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    return shared.with_columns(batch, {f.name: pa.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(zip(RESULT, _KINDS, strict=True))})


def _judged(docs: DataFrame, sent, window: int, num: int, den: int, without: tuple[str, ...], fields: list) -> DataFrame:
    key = int(sent._jbroadcast.id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(key, sent, window)
            rows = []
            for text in shared.raw(batch.column("text")):
                own = words(text)
                rows.append(verdict(text, own, *matcher.matches(own), num, den))
            yield _with_result(batch.drop_columns(list(without)), rows)

    return docs.mapInArrow(shared.released(run), T.StructType([*fields, *RESULT]))


def _hits(keyed: DataFrame, sent, window: int) -> DataFrame:
    """r, s, covered, items of the texts that are hit."""
    key = int(sent._jbroadcast.id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(key, sent, window)
            made = [(k, *matcher.matches(words(text))) for k, text in enumerate(shared.raw(batch.column("text")))]
            made = [m for m in made if m[1]]
            places = pa.array([m[0] for m in made], pa.int64())
            covered = pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], _KINDS[-1])
            yield pa.RecordBatch.from_arrays([batch.column("r").take(places), batch.column("s").take(places), covered, pa.array([sorted(m[2]) for m in made], pa.list_(pa.string()))], names=["r", "s", "covered", "items"])

    return keyed.mapInArrow(shared.released(run), "r long, s int, covered array<struct<start:long,end:long>>, items array<string>")
