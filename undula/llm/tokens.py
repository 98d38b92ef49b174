"""Byte-level BPE through the tokenizers library, with a memory of words already encoded.

A pre-token of this vocabulary holds a space or a line feed only at its start or alone. So where no two white
spaces touch and there are no others, a text may be cut before each space and each line feed, and its parts encoded
apart; a word at a text's start is encoded as after a line feed. Other texts, and those that hold an added token of the
vocabulary (<|endoftext|>), are encoded whole. Either way the ids are the library's.

Texts are cut and their words told apart by Arrow, so Python sees each distinct word of a part once; the words' ids are
put in place by NumPy.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Words one worker remembers. When it has more, those met in one call alone go, and of the others all beyond half of
#: this; only memory and speed depend on it.
REMEMBERED = 500_000
_ids = np.uint32
#: Signs that end a run of letters and are a run of their own (an apostrophe isn't one: it may open a suffix).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of Latin letters (which are letters whatever the version of Unicode), after a line feed or none.
LETTERS = "^\\n?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+$"
#: The vocabulary's characters for bytes: printable ones stand for themselves, others for those from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_OTHER_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """The runs of ids that begin at start, one after another; made `most` runs at a time."""
    out = []
    for k in range(0, len(start), most):
        own = size[k : k + most]
        ends = np.cumsum(own)
        out.append(ids[np.arange(ends[-1]) + np.repeat(start[k : k + most] - (ends - own), own)])
    return out[0] if len(out) == 1 else _joined(out, ids.dtype)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *arrays])


class Words:
    """Distinct words, and where each one's ids begin in an array, and how many they are."""

    def __init__(self, words: pa.Array | None = None, ids: np.ndarray | None = None, size: np.ndarray | None = None):
        self.words = pa.array([], pa.string()) if words is None else words
        self.ids = np.empty(0, _ids) if ids is None else ids
        self.size = np.empty(0, np.int64) if size is None else size
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def at(self, places: np.ndarray) -> Words:
        """The words of these places."""
        return Words(self.words.take(pa.array(places)), gather(self.ids, self.start[places], self.size[places]), self.size[places])

    def and_(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), np.concatenate([self.ids, other.ids]), np.concatenate([self.size, other.size]))


def _placed(words: pa.Array, store: Words, at: np.ndarray, more: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each word's ids, in the ids of both one after another. at: the place of each word in the store;
    words without one are in more."""
    start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    there, left = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    start[there], size[there] = store.start[at[there]], store.size[at[there]]
    if len(left):
        place = more.find(words.take(pa.array(left)))
        start[left], size[left] = len(store.ids) + more.start[place], more.size[place]
    return start, size, np.concatenate([store.ids, more.ids])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        how = about.get("pre_tokenizer") or {}
        #: Whether texts may be cut as said above; those of other vocabularies are encoded whole.
        self.cuts = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not about.get("normalizer")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Texts that can't be cut: white space that touches another, or stands at either end, or is another; added tokens.
        self.uncut = "|".join([r"^[ \n]", r"[ \n]$", r"[ \n][ \n]", f"[{_OTHER_SPACE}]", *(re.sub(r"(\W)", r"\\\1", t) for t in added)])
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = Split("Ċ", "isolated")
        size = self.library.get_vocab_size()
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.feed = self._whole("\n")[0] if self.cuts else 0
        self.store, self.twice = Words(), np.empty(0, bool)  # words met, and whether in two calls or more
        self.tails: dict[str, np.ndarray] = {}  # the ids of signs alone

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, _ids)

    def _block(self, words: list[str], fed: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words encoded in one text, cut again at the tokens that open them. fed: words begin with a
        line feed, else a space belongs before them. letters: words are runs of letters, so the model alone will do."""
        if letters:
            block = "".join(words) if fed else "\n " + "\n ".join(words)
            block = block.replace("\n", "Ċ").replace(" ", "Ġ") if block.isascii() else block.encode().decode("latin-1").translate(BYTES)
        else:
            block = "".join(words) if fed else " " + " ".join(words)
        ids = np.array((self.model if letters else self.library).encode_batch_fast([block], add_special_tokens=False)[0].ids, _ids)
        starts = np.flatnonzero(ids == self.feed if fed or letters else self.opens[ids])
        if len(starts) != len(words):
            raise AssertionError("a word was not cut where it should be")
        size = np.diff(starts, append=len(ids))
        return (ids[ids != self.feed], size - 1) if letters and not fed else (ids, size)

    def _encoded(self, words: pa.Array, letters: bool) -> Words:
        """The words (in another order) with their ids, some thousands encoded at a time."""
        fed = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        order, ids, sizes = [], [], []
        for f in (True, False):
            for a in (True, False):
                own = np.flatnonzero((fed == f) & (plain == a))
                listed = words.take(pa.array(own)).to_numpy(zero_copy_only=False)
                order.append(own)
                for at in range(0, len(own), 5000):
                    made, size = self._block(listed[at : at + 5000].tolist(), f, letters)
                    ids.append(made)
                    sizes.append(size)
        return Words(words.take(pa.array(np.concatenate(order))), _joined(ids, _ids), _joined(sizes, np.int64))

    def _learn(self, words: pa.Array, core: pa.Array, core_at: np.ndarray) -> Words:
        """The ids of words not met before; core: without the signs at their end, and where those are in the store. A run
        of letters is encoded by the model alone, once for all the words that it makes; other words by the whole library."""
        run = pc.match_substring_regex(core, LETTERS)
        tailed = pc.and_(run, pc.not_equal(pc.binary_length(words), pc.binary_length(core)))
        runs = pc.unique(core.filter(pc.and_(run, pa.array(core_at < 0))))
        out = self._encoded(runs, True).and_(self._encoded(words.filter(pc.invert(run)), False))
        ended, core, core_at = words.filter(tailed), core.filter(tailed), core_at[tailed.to_numpy(zero_copy_only=False)]
        if len(core):
            start, size, ids = _placed(core, self.store, core_at, out)
            lengths = pc.subtract(pc.binary_length(ended), pc.binary_length(core)).to_numpy()  # of signs, which are ASCII
            signs = pa.array([w[-n:] for w, n in zip(ended.to_numpy(zero_copy_only=False).tolist(), lengths.tolist(), strict=True)], pa.string())
            kinds = signs.dictionary_encode()
            for sign in kinds.dictionary.to_pylist():
                if sign not in self.tails:
                    self.tails[sign] = self._whole(sign)
            after = [self.tails[x] for x in kinds.dictionary.to_pylist()]
            n = np.array([len(x) for x in after])
            kind = kinds.indices.to_numpy()
            starts = np.stack([start, (len(ids) + np.cumsum(n) - n)[kind]], axis=1).ravel()
            sizes = np.stack([size, n[kind]], axis=1).ravel()
            out = out.and_(Words(ended, gather(_joined([ids, *after], _ids), starts, sizes), size + n[kind]))
        return out

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each word's ids in the ids returned; words are distinct."""
        core = pc.ascii_rtrim(words, SIGNS)
        found = self.store.find(pa.concat_arrays([words, core]))  # one look at the store for both
        at, core_at = np.split(found, 2)
        new = pa.array(at < 0)
        learnt = self._learn(words.filter(new), core.filter(new), core_at[at < 0])
        out = _placed(words, self.store, at, learnt)
        self.twice[found[found >= 0]] = True
        self.store, self.twice = self.store.and_(learnt), np.append(self.twice, np.zeros(len(learnt), bool))
        if len(self.store) > REMEMBERED:
            kept = np.flatnonzero(self.twice)[: REMEMBERED // 2]
            self.store, self.twice = self.store.at(kept), np.ones(len(kept), bool)
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of texts that can be cut."""
        fed = pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), "\n")  # a line feed before each
        split = pc.split_pattern(fed, " ")
        words = split.flatten().dictionary_encode()
        start, size, flat = self._ids_of(words.dictionary)
        code = words.indices.to_numpy()
        each = size[code]
        last = np.cumsum(each)[split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1]
        first = np.concatenate(([0], last[:-1]))
        return np.delete(gather(flat, start[code], each), first), last - np.arange(1, len(last) + 1)  # without the feeds

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text ends; null counts as empty. end_id: stands after each."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        uncut = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        uncut |= not self.cuts
        cut = np.flatnonzero(~uncut & ~empty)
        ids, ends = self._cut(texts.take(pa.array(cut))) if len(cut) else (np.empty(0, _ids), np.empty(0, np.int64))
        if len(cut) < len(texts):
            pieces = [np.empty(0, _ids)] * len(texts)
            for k, a, b in zip(cut, np.append(0, ends)[:-1], ends, strict=True):
                pieces[k] = ids[a:b]
            for k in np.flatnonzero(uncut & ~empty):
                pieces[k] = self._whole(texts[int(k)].as_py())
            ends = np.cumsum([len(x) for x in pieces], dtype=np.int64)
            ids = np.concatenate(pieces) if pieces else ids
        if end_id is not None:
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
        return ids, ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a vocabulary file; None: the public one, found on the machine that asks."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
