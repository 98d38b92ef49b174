"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is made by a keyed permutation of all values of its kind and shape (a Feistel network with cycle walking),
conjugated with a step by one, so that no value is its own surrogate. A permutation keeps different entities different
and equal ones equal, in all documents, without a table of them; it works on canonical forms, so the same number in two
layouts, or the same address in two cases, stays the same entity, each in its own layout.

    email      local part and own labels of the domain, letters by script, digits by digits; domains that aren't
               reserved for examples get the reserved suffix .example
    phone      digits after the country code; a first digit of 2 to 9 stays in that range
    card       all but the first digit; the check digit is as right or wrong as it was
    iban       account part by class; check digits made anew
    ssn, ip    digits; public addresses stay public, private ones in their network
    secret     access keys, and values given to password, token, key and the like: by class, hexadecimal as such
    name       word by word: given names of the lists by a permutation of the list of that gender and script; other
               words letter by letter, vowels by vowels and consonants by consonants of the script, so a surname is
               the same with a given name, after a title and alone

Where a text holds a name, its words are replaced wherever else they stand alone in that text, but for those that the text
also has in lower case, which are ordinary words. What is settled of a name are its words; given names of the lists are
not, as many people share each.

Every surrogate has its original's shape (shape()), and a permutation of a shape's values keeps entities distinct. Two
things can still go wrong, and are looked for: a surrogate may equal some other entity's original, and entities that had
different attempts may get one surrogate. Those found get another attempt, all others stay as they are, until none is
left. A shape that is so full that this has no end is closed: all of its entities keep their first surrogates, which are
distinct, though some equal another's original; settle() tells how many. A last check makes sure that no two entities
share a surrogate.

The entities (without repeats) are found once and kept in a scratch table, in the clear as in the documents, while they
are settled; then it is removed. Attempts other than the first go to the workers if they are few, else they are joined.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import logging
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import shared

# ---- fixed values: alphabets, titles and given names ----

VOWELS = {"latin": "aeiouy", "marked": "àáâäèéêëìíîïòóôöùúûü", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxz", "marked": "çñýÿ", "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
GIVEN = {
    ("female", "latin"): "Alice Amelia Anna Barbara Camille Carmen Charlotte Claire Elena Emily Emma Eva Hannah Helen Isabella Julia Karen Laura Linda Lisa Lucia Maria Martha Mary Nina Olivia Patricia Rosa Sandra Sarah Sofia Susan Teresa Ursula Victoria".split(),
    ("male", "latin"): "Adam Albert Alexander Antonio Benjamin Carlos Charles Daniel David Edward Felix Frank George Hans Henry Hugo Jack James John Jorge Joseph Karl Lucas Louis Manuel Martin Michael Oliver Oscar Paul Peter Pierre Robert Thomas William".split(),
    ("female", "cyrillic"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("male", "cyrillic"): "Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Сергей".split(),
}
TITLES = {"male": "Mr Herr Monsieur Señor Sr".split(), "female": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra".split(), "any": "Dr Prof".split()}
RESERVED = ("example.com", "example.org", "example.net", "example", "test", "invalid", "localhost")
KEYWORDS = "password passwd passphrase pwd secret token api_key api-key apikey access_key access-key auth_token private_key client_secret".split()

# ---- detection ----

_EMAIL = re.compile(r"[^\W_][\w.%+\-]*@[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)+")
_NUMBER = re.compile(r"\d[\d ().\-/]{5,}\d")
_CARD = re.compile(r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
_PHONE = re.compile(r"(?<!\w)(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-/]?\d{2,4}){1,4}(?!\w)")
_NANP = re.compile(r"(?<!\w)(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_ACCESS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_VALUE = re.compile(rf"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, KEYWORDS))})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?([^\s\"',;]{{6,}})")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.DOTALL)
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ]"
#: What goes on a name's word: O'Brien, Smith-Jones, but not Smith's.
_MORE = rf"(?:['’\-]{_CAPITAL}[^\W\d_]+)*"
_WORD = rf"(?:{_CAPITAL}['’])?{_CAPITAL}[^\W\d_]+{_MORE}"
#: A capitalised word that another follows; the second may begin a match of its own.
_PAIR = re.compile(rf"(?<!\w)({_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)*)(?=( {_WORD})(?!\w))")
_TITLED = re.compile(rf"(?<!\w)({'|'.join(t for x in TITLES.values() for t in x)})\.? (?={_CAPITAL})([^\W\d_]+{_MORE}(?: {_WORD})?)")
_ALONE = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_DATE = re.compile(r"(?:\d{4}([.\-/])\d{1,2}\1\d{1,2}|\d{1,2}([.\-/])\d{1,2}\2\d{4})(?!\d)")
_GENDER = {name: key for key, names in GIVEN.items() for name in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}


def luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _iban_valid(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _phones(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 15 and not _DATE.match(m.group()) and ("+" in m.group() or "(" in m.group() or len(re.findall(r"[ .\-/]", m.group())) >= 2):
            out.append(m.span())
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """Entities that don't overlap, as (start, end, kind), in order of place. Each kind is looked for in what the kinds
    before it have left, so neighbours don't run into one another."""
    out: list[tuple[int, int, str]] = []
    left = text

    def take(spans, kind: str) -> None:
        nonlocal left
        parts, at = [], 0
        for start, end in spans:
            if end > start >= at and "\0" not in left[start:end]:
                out.append((start, end, kind))
                parts += [left[at:start], "\0" * (end - start)]
                at = end
        left = "".join([*parts, left[at:]]) if parts else left

    if "\0" in text:
        left = text.replace("\0", " ")
    if "-----BEGIN" in text:
        take([m.span(2) for m in _PEM.finditer(left)], "secret")
    if "AKIA" in text or "ASIA" in text:
        take([m.span() for m in _ACCESS.finditer(left)], "secret")
    if "=" in text or ":" in text:
        take([m.span(1) for m in _VALUE.finditer(left)], "secret")
    if "@" in text:
        take([m.span() for m in _EMAIL.finditer(left)], "email")
    if _NUMBER.search(text):
        take([m.span() for m in _IBAN.finditer(left) if _iban_valid(m.group().replace(" ", ""))], "iban")
        take([m.span() for m in _IP.finditer(left)], "ip")
        take([m.span() for m in _NANP.finditer(left)], "phone")
        take([m.span() for m in _CARD.finditer(left)], "card")
        take([m.span() for m in _SSN.finditer(left)], "ssn")
        take(_phones(left), "phone")
    titled = list(_TITLED.finditer(left))
    for gender in TITLES:
        take([m.span(2) for m in titled if _TITLE[m.group(1)] == gender], "name:" + gender)
    take([(m.start(), m.end(2)) for m in _PAIR.finditer(left) if _given(m.group(1)) and not m.group(2)[1].islower()], "name:any")
    return sorted(out)


def _given(word: str) -> bool:
    """A given name of the lists, alone or as the first or last of a double name."""
    return word in _GENDER or ("-" in word and (word.split("-")[0] in _GENDER or word.rsplit("-", 1)[1] in _GENDER))


def mentions(text: str) -> list[tuple[int, int, str]]:
    """The entities of detect(), and the words of its names where they stand alone elsewhere in the text."""
    found = detect(text)
    known = {w for a, b, kind in found if kind.startswith("name") for w in text[a:b].split(" ") if len(w) > 1}
    if not known:
        return found
    ordinary = set(re.findall(r"[^\W\d_]+", text))
    known = {w for w in known if w == w.lower() or w.lower() not in ordinary}
    starts = [a for a, _, _ in found]
    more = []
    for m in _ALONE.finditer(text):
        if m.group() in known:
            k = bisect.bisect_right(starts, m.start())
            if (not k or found[k - 1][1] <= m.start()) and (k == len(found) or m.end() <= starts[k]):
                more.append((*m.span(), "name:any"))
    return sorted(found + more)


# ---- surrogates ----


class Cipher:
    """A keyed permutation of range(size) without fixed points, for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, value: int, bits: int) -> int:
        data = b"%d|%d|" % (k, value) + tweak
        out = hashlib.blake2b(data, key=self.key[:64], digest_size=max(8, (bits + 7) // 8 + 8)).digest() if bits <= 440 else hashlib.shake_256(self.key + data).digest(bits // 8 + 8)
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        half = max(1, (size - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for k in range(6):
                if back:
                    left, right = right ^ self._round(tweak, 5 - k, left, half), left
                else:
                    left, right = right, left ^ self._round(tweak, k, right, half)
            value = left << half | right
            if value < size:
                return value

    def step(self, value: int, size: int, tweak: bytes) -> int:
        """Another value of range(size), if there is one."""
        return self.permute((self.permute(value, size, tweak) + 1) % size, size, tweak, True) if size > 1 else value


def _letters(alphabets: list[dict[str, str]]) -> dict[str, str]:
    return {c: letters for alphabet in alphabets for letters in alphabet.values() for c in letters}


_BY_SCRIPT = {c: VOWELS[s] + CONSONANTS[s] for s in VOWELS for c in VOWELS[s] + CONSONANTS[s]}
_BY_SOUND = _letters([VOWELS, CONSONANTS])
_DIGITS = dict.fromkeys("0123456789", "0123456789")
_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


def shaped(cipher: Cipher, text: str, classes: dict[str, str], tweak: bytes, free: dict[int, str] | None = None) -> str:
    """text with each character of a class replaced within it; upper case stays. free: other alphabets at some places."""
    alphabets: list[str | None] = []
    for k, c in enumerate(text):
        low = c.lower()
        alphabet = (free or {}).get(k) or classes.get(low if len(low) == 1 else c)
        alphabets.append(alphabet if alphabet and (low in alphabet) else None)
    size = value = 1
    value = 0
    for c, alphabet in zip(text, alphabets, strict=True):
        if alphabet:
            value = value * len(alphabet) + alphabet.index(c.lower())
            size *= len(alphabet)
    shape = "".join("-" if a is None else a[0] for a in alphabets)
    value = cipher.step(value, size, tweak + b"|" + shape.encode())
    out = []
    for c, alphabet in zip(reversed(text), reversed(alphabets), strict=True):
        if alphabet:
            value, k = divmod(value, len(alphabet))
            c = alphabet[k].upper() if c.isupper() else alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def _laid_out(digits: str, like: str) -> str:
    """digits in the places of like's digits."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in like)


def _network(a: int) -> tuple[int, int]:
    """The first address and the number of addresses of the private network that a is in; (0, 0): public."""
    for first, bits in ((10 << 24, 24), (127 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (169 << 24 | 254 << 16, 16)):
        if first <= a < first + (1 << bits):
            return first, 1 << bits
    return 0, 0


def _ordinary(a: int) -> bool:
    return 1 << 24 <= a < 224 << 24 and not _network(a)[1]


def canonical(value: str, kind: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if value.startswith("+") else "") + "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


def shape(value: str, kind: str) -> str:
    """What a surrogate has in common with its original: a surrogate has the same shape, and equals no surrogate of
    another shape of its kind but by chance."""
    value = canonical(value, kind)
    if kind == "ip":
        return "%d" % _network(int.from_bytes(bytes(map(int, value.split("."))), "big"))[0]
    if kind == "card":
        return f"{value[:1]}{len(value)}{(int(value[-1]) - luhn(value[:-1])) % 10}"
    return re.sub(r"[^\W\d_]", lambda m: _BY_SOUND.get(m.group().lower(), "?")[0], re.sub(r"\d", "0", value))


def surrogate(cipher: Cipher, value: str, kind: str, attempt: int = 0) -> str:
    tweak = f"{kind.split(':')[0]}|{attempt}".encode()
    if kind == "email":
        local, _, domain = value.rpartition("@")
        suffix = next((r for r in RESERVED if domain.lower() == r or domain.lower().endswith("." + r)), None)
        own = domain[: len(domain) - len(suffix)] if suffix else domain.rpartition(".")[0]
        rest = domain[len(own) :] + ("" if suffix else ".example")
        classes = _BY_SCRIPT | _DIGITS
        return shaped(cipher, local, classes, tweak + b"|" + canonical(domain, kind).encode()) + "@" + shaped(cipher, own, classes, b"domain") + rest
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .\-(])|\+1(?=\d{10}$)", value)
        skip = sum(c.isdigit() for c in code.group()) if code else 0
        digits = "".join(c for c in value if c.isdigit())
        free = {k: "23456789" if digits[skip + k] in "23456789" else "01" for k in (0, 3) if len(digits) - skip == 10}
        return _laid_out(digits[:skip] + shaped(cipher, digits[skip:], _DIGITS, tweak, free), value)
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        body = digits[0] + shaped(cipher, digits[1:-1], _DIGITS, tweak + b"|" + digits[:1].encode() + b"%d" % off)
        return _laid_out(body + str((luhn(body) + off) % 10), value)
    if kind == "iban":
        compact = value.replace(" ", "")
        own = shaped(cipher, compact[4:].lower(), _DIGITS | dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"), tweak + compact[:2].encode()).upper()
        number = int("".join(str(int(c, 36)) for c in own + compact[:2] + "00"))
        left = iter(compact[:2] + f"{98 - number % 97:02d}" + own)
        return "".join(c if c == " " else next(left) for c in value)
    if kind == "ssn":
        return _laid_out(shaped(cipher, "".join(c for c in value if c.isdigit()), _DIGITS, tweak), value)
    if kind == "ip":
        a = int.from_bytes(bytes(map(int, value.split("."))), "big")
        first, size = _network(a)
        if size:
            a = first + cipher.step(a - first, size, tweak + b"|%d" % first)
        else:
            plain = _ordinary(a)
            a = cipher.step(a, 1 << 32, tweak)
            while _ordinary(a) != plain:
                a = cipher.step(a, 1 << 32, tweak)
        return ".".join(map(str, a.to_bytes(4, "big")))
    if kind == "secret":
        head = 4 if _ACCESS.fullmatch(value) else 0
        classes = _HEX if set(value) <= _HEX.keys() else _BY_SCRIPT | _DIGITS
        return value[:head] + shaped(cipher, value[head:], classes, tweak + b"|" + value[:head].encode())
    return " ".join(_name(cipher, word, tweak) for word in value.split(" "))


def _name(cipher: Cipher, word: str, tweak: bytes) -> str:
    """A name's word, the same wherever it stands; given names of the lists take no attempts."""
    if word in _GENDER:
        names = GIVEN[_GENDER[word]]
        return names[cipher.step(names.index(word), len(names), b"name|" + repr(_GENDER[word]).encode())]
    made = shaped(cipher, word, _BY_SOUND, tweak)
    while made in _GENDER:
        made = shaped(cipher, made, _BY_SOUND, tweak)
    return made


def settled_parts(value: str, kind: str) -> list[tuple[str, str]]:
    """What of an entity is settled, with its kind: all of it, of a name its words but given names of the lists."""
    return [(w, "name") for w in value.split(" ") if w not in _GENDER] if kind.startswith("name") else [(value, kind)]


def _settled(cipher: Cipher, value: str, kind: str, attempts: dict[bytes, int]) -> str:
    """The surrogate, with the attempts of what is settled of it."""
    if not attempts:
        return surrogate(cipher, value, kind)
    if not kind.startswith("name"):
        return surrogate(cipher, value, kind, attempts.get(token(cipher.key, value, kind), 0))
    return " ".join(surrogate(cipher, w, "name", attempts.get(token(cipher.key, w, "name"), 0)) for w in value.split(" "))


def token(key: bytes, value: str, kind: str) -> bytes:
    """A keyed name of an entity that doesn't tell it."""
    return hmac.new(key, f"{kind.split(':')[0]}|{canonical(value, kind)}".encode(), hashlib.sha256).digest()[:16]


def replace(text: str, cipher: Cipher, attempts: dict[bytes, int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and of each its kind and code points in the new text."""
    entities = mentions(text)
    if not entities:
        return text, []
    parts: list[str] = []
    out: list[dict] = []
    at = length = 0
    for start, end, kind in entities:
        value = text[start:end]
        new = _settled(cipher, value, kind, attempts)
        parts += [text[at:start], new]
        length += start - at
        out.append({"kind": kind.split(":")[0], "start": length, "end": length + len(new)})
        length += len(new)
        at = end
    parts.append(text[at:])
    return "".join(parts), out


ENTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Attempts that go to every worker at most (some 20 MB); more of them are joined to the texts that need them.
FEW = 100_000
#: Rounds that leave no fewer collisions than there were before, after which shapes are closed.
IDLE = 8


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """token, kind, value (one of an entity's spellings), shape, of all that is settled of docs(text), each once."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[bytes, tuple[str, str, str]] = {}
            for text in batch.column("text").to_pylist():
                for start, end, whole in detect(text) if text else ():  # mentions have no other words
                    for value, kind in settled_parts(text[start:end], whole):
                        name = token(key, value, kind)
                        if name not in rows:
                            rows[name] = (kind, value, shape(value, kind))
            columns = [pa.array([v[k] for v in rows.values()], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), *columns], names=["token", "kind", "value", "shape"])

    found = shared.text_only(docs, "text").mapInArrow(shared.released(run), "token binary, kind string, value string, shape string")
    least = F.min(F.struct("kind", "value", "shape")).alias("x")
    return found.groupBy("token").agg(least).select("token", "x.*")


def made(settled: DataFrame, key: bytes) -> DataFrame:
    """settled(token, kind, value, shape, attempt) and made, the token of each entity's surrogate."""
    shared.bounded_batches(settled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            new = [token(key, surrogate(cipher, value, kind, attempt), kind) for kind, value, attempt in rows]
            yield shared.with_columns(batch, {"made": pa.array(new, pa.binary())})

    return settled.mapInArrow(shared.released(run), T.StructType([*settled.schema.fields, T.StructField("made", T.BinaryType())]))


def check(found: DataFrame) -> DataFrame:
    """Of found(token, made) the tokens whose surrogate another entity has too (all but one of them: twice), or is
    another entity's original. Tokens tell kinds apart."""
    least = found.groupBy("made").agg(F.min("token").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = found.join(least, "made").where("token <> first").select("token", F.lit(True).alias("twice"))
    originals = found.join(found.select(F.col("token").alias("made")), "made", "left_semi").select("token", F.lit(False).alias("twice"))
    return twice.union(originals).groupBy("token").agg(F.max("twice").alias("twice"))


def settle(docs: DataFrame, key: bytes, idle: int = IDLE) -> tuple[DataFrame, int]:
    """The entities whose first surrogate won't do (token, attempt from 1 on), stored, and how many entities of closed
    shapes have a surrogate that is another's original. Empty and 0 as a rule. What is written in the clear on the way is
    removed, whether this ends well or not."""
    used: list[str] = []
    try:
        return _settle(docs, key, idle, used)
    finally:
        for path in used:
            shared.remove(docs.sparkSession, path)


def _settle(docs: DataFrame, key: bytes, idle: int, used: list[str]) -> tuple[DataFrame, int]:
    state, path = shared.stored_at(entities(docs, key).withColumns({"attempt": F.lit(0), "closed": F.lit(False)}), "entities")
    used.append(path)
    fewest, since, closings = None, 0, 0
    while True:
        found, path = shared.stored_at(made(state, key), "surrogates")
        used.append(path)
        again, path = shared.stored_at(check(found), "collisions")
        used.append(path)
        pending = found.join(again, "token").where("twice OR NOT closed")
        n = pending.count()
        if not n:
            break
        since = 0 if fewest is None or n < fewest else since + 1
        fewest = n if fewest is None else min(fewest, n)
        if closings == 3 and since == idle:
            raise ValueError(f"{n} entities share a surrogate with another: their shapes leave no other values")
        marked = found.drop("made").join(again, "token", "left").withColumn("k", F.regexp_extract("kind", "^[^:]*", 0))
        attempt = F.when(F.col("twice") | (F.col("twice").isNotNull() & ~F.col("closed")), F.col("attempt") + 1).otherwise(F.col("attempt"))
        closed = F.col("closed")
        if since == idle:  # the shapes of what is left have too few free values
            full = pending.select(F.regexp_extract("kind", "^[^:]*", 0).alias("k"), "shape").distinct().withColumn("full", F.lit(True))
            marked = marked.join(full, ["k", "shape"], "left")
            newly = F.coalesce("full", F.lit(False)) & ~closed
            attempt, closed = F.when(newly, F.lit(0)).otherwise(attempt), closed | newly
            fewest, since, closings = None, 0, closings + 1
        state, path = shared.stored_at(marked.select("token", "kind", "value", "shape", attempt.cast("int").alias("attempt"), closed.alias("closed")), "entities")
        used.append(path)
    left = again.where("NOT twice").count()
    return shared.stored(state.where("attempt > 0").select("token", "attempt"), "attempts"), left


_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting spark.undula.surrogates.key; where there is none, one drawn anew for each
    application, so that its surrogates can't be undone by anyone, and no other application makes the same."""
    given = spark.conf.get("spark.undula.surrogates.key", None)
    return given.encode() if given else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def anonymise(docs: DataFrame, key: bytes, checked: bool = True, few: int = FEW) -> DataFrame:
    """docs (any columns) with surrogates in text, and a column entities (kind, start, end in the new text).

    Null and empty text stays as it is and has none. Repeated rows change alike; an empty table stays empty. A column
    named entities is an error: ValueError. The key decides all surrogates; who lacks it can't go back.
    """
    fields = shared.kept_fields(docs, (), [T.StructField("entities", ENTITIES)])
    if not key:
        raise ValueError("surrogates need a key")
    shared.bounded_batches(docs.sparkSession)
    attempts, left = settle(docs, key) if checked else (None, 0)
    if left:
        logging.getLogger(__name__).warning("%d entities have a surrogate that is another's original: their shapes leave no other", left)
    n = attempts.count() if checked else 0
    own = shared.fresh(docs.columns, "attempts")
    if n > few:
        docs = _with_attempts(docs, attempts, key, own)
        sent = docs.sparkSession.sparkContext.broadcast({})
    else:
        sent = docs.sparkSession.sparkContext.broadcast({bytes(r["token"]): r["attempt"] for r in attempts.collect()} if n else {})  # `few` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = own in batch.schema.names
            rows = batch.column(own).to_pylist() if joined else [None] * batch.num_rows
            batch = batch.drop_columns([own]) if joined else batch
            done = [replace(t, cipher, {x["token"]: x["attempt"] for x in mine} if mine else sent.value) if t else (t, []) for t, mine in zip(batch.column("text").to_pylist(), rows, strict=True)]
            at = batch.schema.get_field_index("text")
            changed = batch.set_column(at, "text", pa.array([t for t, _ in done], batch.schema.field("text").type))
            yield shared.with_columns(changed, {"entities": pa.array([e for _, e in done], _ARROW)})

    return docs.mapInArrow(shared.released(run), T.StructType([*fields, T.StructField("entities", ENTITIES)]))


def _with_attempts(docs: DataFrame, attempts: DataFrame, key: bytes, own: str) -> DataFrame:
    """docs with a column `own` of the attempts (token, attempt) of the entities in their text, joined by the text's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [{token(key, *part) for a, b, kind in detect(t) for part in settled_parts(t[a:b], kind)} if t else set() for t in batch.column("text").to_pylist()]
            row = pa.array([k for k, x in enumerate(names) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("r").take(row), batch.column("s").take(row), pa.array([t for x in names for t in x], pa.binary())], names=["r", "s", "token"])

    hashes = {"r": F.xxhash64("text"), "s": F.hash("text")}
    held = docs.select("text").withColumns(hashes).mapInArrow(shared.released(run), "r long, s int, token binary")
    held = shared.stored(held.groupBy("r", "s", "token").agg(F.count("*").alias("texts")), "held")
    often = held.groupBy("token").agg(F.count("*").alias("n"))
    found = shared.join_hot(held, shared.stored(attempts.join(often, "token"), "attempts"), ["token"], "n")
    r, s, n = (shared.fresh([*docs.columns, own], x) for x in ("r", "s", "n"))
    by_text = found.groupBy(F.col("r").alias(r), F.col("s").alias(s)).agg(F.collect_list(F.struct("token", "attempt")).alias(own), F.max("texts").alias(n))
    keyed = docs.withColumns({r: hashes["r"], s: hashes["s"]})
    return shared.join_hot(keyed, shared.stored(by_text, "attempts"), [r, s], n, "left").select(*(F.col(f"`{c}`") for c in docs.columns), own)
