"""Language identification by interpolated Kneser-Ney character models.

Texts are put in lower case; letters stay, every run of other characters is one space. A 4-gram of characters is an
64-bit key of four 16-bit codes (exact up to U+FFFF; letters beyond share codes with others), so every lower order, its continuation counts
and its contexts follow from the counted 4-grams. Counts cover all training rows and are summed by Spark; every counted
n-gram is kept.

The model holds one sorted array of hashed keys per order, with an index by leading bits, and beside it an entry for
each language that has the n-gram: its interpolated log-probability; and the same for contexts with their back-off
weights. So its size is that of the languages' n-grams, however many languages there are. A text gets the language of
the lowest cross-entropy per character. On all of a calibration fold that wasn't counted two things are fitted, from
sums and histograms that Spark adds up: the score (probability that the answer is right) and, for each language and
length class, the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import shared
from undula.llm.words import mix

ORDER = 4
UNKNOWN = "und"
#: Characters looked at together; what is held for them is some 60 times as many bytes.
PIECE = 500_000
_SPACE = 0x20
_table: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """16-bit code of every code point: letters their own (folded beyond 16 bits), others a space."""
    if not _table:
        table = np.full(0x110000, _SPACE, np.uint16)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
        table[letters] = np.where(letters < 0x10000, letters, 0x8000 + letters % 0x7FF1)
        _table.append(table)
    return _table[0]


def keys(texts: list[str], carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all texts (in lower case) end to end, how many each text has, and how many letters; and the codes
    that a piece which goes on with the last text needs. carry: those of the piece that the first text goes on with."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _codes()[raw]
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    if carry is not None and sizes[0] and space[0] and carry[-1] == _SPACE:
        keep[0] = False
    letters = np.bincount(owner[~space], minlength=len(texts))
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    counts = np.bincount(owner, minlength=len(texts))
    padded = np.full(len(codes) + 3 * len(texts), _SPACE, np.uint64)
    at = np.arange(len(codes)) + 3 * (owner + 1)
    padded[at] = codes
    if carry is not None:
        padded[:3] = carry
    key = np.zeros(len(padded), np.uint64)
    for k in range(ORDER):
        key[3:] |= padded[3 - k : len(padded) - k] << np.uint64(16 * k)
    return key[at], counts, letters, padded[-3:]


def pieced(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' keys in groups of about PIECE characters: which text each piece is of, and keys() of the pieces. A
    longer text comes in pieces, each of which goes on where the one before it ended, so keys are those of whole texts."""
    held: list[str] = []
    owner: list[int] = []
    size = 0
    carry = None

    def made(goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nonlocal carry
        key, counts, letters, last = keys(held, carry)
        carry = last if goes_on else None
        return np.array(owner), key, counts, letters

    for k, text in enumerate(texts):
        text = " " + (text or "").lower()
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            if held and size + len(piece) > PIECE:
                yield made(at > 0)
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(k)
            size += len(piece)
    if held:
        yield made(False)


class HashArray:
    """Sorted hashes of keys; find() gives a key's place or -1, entries() the languages and values that it has."""

    def __init__(self, keyed: np.ndarray, langs: np.ndarray, values: np.ndarray):
        hashed = mix(keyed)
        order = np.lexsort((langs, hashed))
        hashed = hashed[order]
        first = np.flatnonzero(np.diff(hashed, prepend=~hashed[:1]))
        self.hashes, self.offsets = hashed[first], np.append(first, len(hashed)).astype(np.int64 if len(hashed) >> 31 else np.int32)
        self.langs, self.values = langs[order].astype(np.uint16), values[order].astype(np.float32)
        self.bits = max(1, int(len(first)).bit_length())
        heads = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))

    def find(self, keyed: np.ndarray) -> np.ndarray:
        hashed = mix(keyed)
        head = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        out = np.full(len(keyed), -1, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(left):
                break
            place = at[left]
            same = self.hashes[place] == hashed[left]
            out[left[same]] = place[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry of the keys at these places: which of the places it belongs to, its language and its value."""
        n = self.offsets[at + 1] - self.offsets[at]
        owner = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(owner)) + np.repeat(self.offsets[at] - (np.cumsum(n) - n), n)
        return owner, self.langs[place], self.values[place]


@dataclass
class Model:
    languages: list[str]
    grams: list[HashArray] = field(default_factory=list)  # by order, from 1
    contexts: list[HashArray] = field(default_factory=list)  # of orders 2 to 4
    unseen: np.ndarray | None = None
    power: float = 0.5
    slope: float = 1.0
    limits: dict[str, np.ndarray] = field(default_factory=dict)  # by language: the limit of each length class

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """The log-probability of each 4-gram's last character, a column for each language."""
        out = np.zeros((len(key), len(self.languages)), np.float32)
        open_ = np.ones(out.shape, bool)  # where the language hasn't had an n-gram yet

        def add(array: HashArray, own: np.ndarray, rows: np.ndarray, closes: bool) -> None:
            at = array.find(own)
            owner, langs, values = array.entries(at[at >= 0])
            rows = rows[at >= 0][owner]
            still = open_[rows, langs]
            rows, langs = rows[still], langs[still]
            out[rows, langs] += values[still]
            if closes:
                open_[rows, langs] = False

        for n in range(ORDER, 0, -1):
            left = np.flatnonzero(open_.any(axis=1))
            own = key[left] if n == ORDER else key[left] & np.uint64((1 << 16 * n) - 1)
            add(self.grams[n - 1], own, left, True)
            if n > 1:
                add(self.contexts[n - 2], own >> np.uint64(16), left, False)
        return np.where(open_, out + self.unseen, out)

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and the texts' characters and letters."""
        sums, chars, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owner, key, counts, found in pieced(texts):
            some = np.flatnonzero(counts)
            if len(some):
                starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
                distinct, back = np.unique(key, return_inverse=True)
                for k, p in enumerate(np.ascontiguousarray(self.log_probability(distinct).T)):
                    np.add.at(sums[:, k], owner[some], np.add.reduceat(p[back], starts[some], dtype=np.float64))
            np.add.at(chars, owner, counts)
            np.add.at(letters, owner, found)
        return -sums / np.maximum(chars, 1)[:, None], chars, letters

    def probabilities(self, entropy: np.ndarray, counts: np.ndarray, power: float | None = None, slope: float | None = None) -> np.ndarray:
        power, slope = self.power if power is None else power, self.slope if slope is None else slope
        logits = -slope * (entropy - entropy.min(axis=1, keepdims=True)) * (np.maximum(counts, 1) ** power)[:, None]
        raised = np.exp(logits)
        return raised / raised.sum(axis=1, keepdims=True)

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, counts, letters = self.cross_entropy(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        score = self.probabilities(entropy, counts)[np.arange(len(texts)), best]
        none = letters == 0
        limit = np.array([self.limits[self.languages[b]][c] if self.languages[b] in self.limits else np.inf for b, c in zip(best, _classes(counts), strict=True)])
        names = [UNKNOWN if x else self.languages[b] for x, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, 0.0, least), none | (least > limit)


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(float))[1], 31)


def count(rows: DataFrame) -> DataFrame:
    """rows(lang, text) -> lang, key, n: how often each language has each 4-gram."""
    shared.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def compact(parts):
            found, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return found, np.bincount(back, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)

        for batch in shared.parts(batches, "text"):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            lettered = np.array([any(map(str.isalpha, t or "")) for t in texts])
            for owner, key, counts, _ in pieced(texts):
                own = [langs[k] for k in owner]
                of = np.repeat(np.arange(len(own)), counts)
                for lang in sorted(set(own)):
                    mine = np.array([x == lang for x in own]) & lettered[owner]
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(key[mine[of]], return_counts=True))
                    if sum(len(k) for k, _ in parts[1:]) > max(500_000, len(parts[0][0])):
                        held[lang] = [compact(parts)]
        for lang, parts in held.items():
            found, n = compact(parts)
            for at in range(0, len(found), 100_000):
                size = len(found[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(found[at : at + size].view(np.int64)), pa.array(n[at : at + size])], names=["lang", "key", "n"])

    return rows.mapInArrow(shared.released(run), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def build(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of each language's 4-gram keys and counts."""
    languages = sorted(counted)
    model = Model(languages)
    if not languages:
        return model
    letters = np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in counted.values()]))
    model.unseen = np.zeros(len(languages), np.float32)
    grams: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
    contexts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]

    def entry(keyed: np.ndarray, k: int, values: np.ndarray) -> tuple[np.ndarray, ...]:
        return keyed, np.full(len(keyed), k, np.uint16), np.log(values).astype(np.float32)

    for k, lang in enumerate(languages):
        by_order = [counted[lang]]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
            by_order.append(np.unique(by_order[-1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True))
        lower_keys, lower = np.empty(0, np.uint64), np.empty(0)
        for order, (gram, n) in enumerate(reversed(by_order), 1):
            n = n.astype(np.float64)
            context, of = np.unique(gram >> np.uint64(16) if order > 1 else np.zeros(len(gram), np.uint64), return_inverse=True)
            d = _discount(n)
            total = np.bincount(of, n, len(context))
            value, weight = np.maximum(n - d, 0) / total[of], d * np.bincount(of, minlength=len(context)) / total
            if order == 1:
                base = weight[0] / (len(letters) + 1)
                value += base
                model.unseen[k] = np.log(base)
            else:
                value += weight[of] * lower[np.searchsorted(lower_keys, gram & np.uint64((1 << 16 * (order - 1)) - 1))]
                contexts[order - 1].append(entry(context, k, weight))
            grams[order - 1].append(entry(gram, k, value))
            lower_keys, lower = gram, value
    array = lambda parts: HashArray(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    model.grams, model.contexts = [array(x) for x in grams], [array(x) for x in contexts[1:]]
    return model


#: Powers and slopes of the score that are tried.
FITS = [(power, float(slope)) for power in (0.0, 0.25, 0.5, 0.75, 1.0) for slope in np.geomspace(0.02, 50, 40)]
#: Steps of a histogram of cross-entropies to the nat, and of summed log-likelihoods (whole numbers, so that the order
#: of adding doesn't matter).
STEPS, LIKELIHOOD_STEPS = 1024, 1 << 20
#: Rows that a class, or a language, must have for a limit of its own.
LEAST_ROWS = 20


def observed(model: Model, entropy: np.ndarray, counts: np.ndarray, truth: list[str]) -> tuple[np.ndarray, ...]:
    """What calibrate() needs of these texts, as columns to be added up: language's place, length class, step of the
    cross-entropy, and how many texts; language -1 has the summed log-likelihood of each of FITS, by its place."""
    place = {lang: k for k, lang in enumerate(model.languages)}
    own = np.array([place.get(x, -1) for x in truth], np.int64)
    entropy, counts, own = entropy[own >= 0], counts[own >= 0], own[own >= 0]
    rows = np.arange(len(own))
    cell = np.stack([own, _classes(counts), np.floor(entropy[rows, own] * STEPS).astype(np.int64)])
    (langs, classes, steps), n = np.unique(cell, axis=1, return_counts=True)
    likely = np.zeros(len(FITS), np.int64)
    for k, (power, slope) in enumerate(FITS):
        right = model.probabilities(entropy, counts, power, slope)[rows, own]
        likely[k] = np.rint(np.log(np.maximum(right, 1e-9)) * LIKELIHOOD_STEPS).astype(np.int64).sum()
    none = np.zeros(len(FITS), np.int64)
    return np.append(langs, none - 1), np.append(classes, np.arange(len(FITS))), np.append(steps, none), np.append(n, likely)


def calibrate(model: Model, langs: np.ndarray, classes: np.ndarray, steps: np.ndarray, n: np.ndarray, false_rejections: float, slack: float) -> None:
    """Fits the score by likelihood, and the limits as conformal quantiles of true texts by language and length class,
    from observed() added up. slack widens a limit by that share of the way to the entropy of equally likely characters.
    A class of under LEAST_ROWS has the limit of the next class of longer texts or, without one, of the longest class
    that has one; longer texts have no higher limit than they need. A language without such a class has one limit of all
    its texts or, if they are under LEAST_ROWS, the limits of all languages' texts together. Without any text of known
    language nothing is fitted."""
    if not (langs >= 0).any():
        return
    fits = np.zeros(len(FITS), np.int64)
    np.add.at(fits, classes[langs < 0], n[langs < 0])
    model.power, model.slope = max(zip(fits.tolist(), FITS, strict=True))[1]
    ceiling = -float(model.unseen.min())

    def quantile(mine: np.ndarray) -> float:
        order = np.argsort(steps[mine])
        below = np.cumsum(n[mine][order])
        rank = min(below[-1], int(np.ceil((1 - false_rejections) * (below[-1] + 1))))
        value = (steps[mine][order][np.searchsorted(below, rank)] + 1) / STEPS
        return value + slack * max(0.0, ceiling - value)

    def by_class(mine: np.ndarray) -> np.ndarray | None:
        limits = np.full(32, np.inf)
        for c in range(31, -1, -1):
            longer = limits[c + 1] if c < 31 and np.isfinite(limits[c + 1]) else -np.inf
            same = mine & (classes == c)
            if n[same].sum() >= LEAST_ROWS:
                limits[c] = max(quantile(same), longer)
            elif np.isfinite(longer):
                limits[c] = longer
        last = np.flatnonzero(np.isfinite(limits))
        if not len(last):
            return None
        limits[last[-1] + 1 :] = limits[last[-1]]
        return limits

    def limits(mine: np.ndarray) -> np.ndarray | None:
        own = by_class(mine)
        return np.full(32, quantile(mine)) if own is None and n[mine].sum() >= LEAST_ROWS else own

    pooled = limits(langs >= 0)
    if pooled is None:
        pooled = np.full(32, quantile(langs >= 0))
    for k, lang in enumerate(model.languages):
        own = limits(langs == k)
        model.limits[lang] = pooled if own is None else own


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null of null."""
    return F.crc32(F.col(column).cast("string")) % 5


def train(docs: DataFrame, false_rejections: float = 0.001, slack: float = 0.25) -> Model:
    """A model of documents(doc_id, text, lang): counted on folds 2 to 4, calibrated on fold 1.

    Fold 0 is never read. Rows without doc_id, lang or text teach nothing. Without any the model has no language."""
    rows = shared.text_only(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counted = count(rows.where(fold().isin(2, 3, 4)).select("lang", "text")).toArrow()  # the model's own n-grams
    langs = counted["lang"].combine_chunks().dictionary_encode()
    languages = sorted(langs.dictionary.to_pylist())
    model = build({})
    if languages:
        place = np.array([languages.index(x) for x in langs.dictionary.to_pylist()])
        k, key, n = place[langs.indices.to_numpy()], counted["key"].to_numpy().view(np.uint64), counted["n"].to_numpy()
        order = np.lexsort((key, k))
        ends = np.searchsorted(k[order], np.arange(len(languages) + 1))
        model = build({lang: (key[own], n[own]) for lang, own in zip(languages, np.split(order, ends[1:-1]), strict=True)})
    if model.languages:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in shared.parts(batches, "text"):
                entropy, counts, letters = sent.value.cross_entropy(batch.column("text").to_pylist())
                some = letters > 0
                if some.any():
                    truth = [x for x, y in zip(batch.column("lang").to_pylist(), some, strict=True) if y]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in observed(sent.value, entropy[some], counts[some], truth)], names=["lang", "class", "step", "n"])

        cells = rows.where(fold() == 1).select("text", "lang").mapInArrow(shared.released(run), "lang long, class long, step long, n long")
        found = cells.groupBy("lang", "class", "step").agg(F.sum("n").alias("n")).toArrow()
        sent.destroy()
        calibrate(model, *(found[c].to_numpy() for c in ("lang", "class", "step", "n")), false_rejections, slack)
    return model


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (any columns, with text; those named in `without` are left out) and: lang_pred, score, cross_entropy, rejected.

    Null text and text without a letter is `und`, score 0, rejected. Equal entropies give the first language by name.
    Repeated rows are judged alike; an empty table stays empty. Columns of the names added are an error: ValueError.
    """
    shared.bounded_batches(docs.sparkSession)
    fields = shared.kept_fields(docs, without, ADDED)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.parts(batches, "text"):
            names, score, entropy, rejected = sent.value.classify(batch.column("text").to_pylist())
            yield shared.with_columns(batch.drop_columns(list(without)), {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "cross_entropy": pa.array(entropy), "rejected": pa.array(rejected)})

    return docs.mapInArrow(shared.released(run), T.StructType([*fields, *ADDED]))
