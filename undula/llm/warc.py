"""WARC archives: written with revisit records, read by splits of bytes.

Writer: one gzip member per record. Of records with equal payloads of at least `least` bytes the one with the largest
page_id is the response; the others are revisits without payload, whose HTTP header still tells its length.

Reader: a split scans its bytes for the gzip magic, takes the first candidate whose data starts with a whole WARC
header, and from there follows member after member. A split owns the records that start inside it, and reads past its
end for the last of them, so no record is read twice or missed however the bytes are cut. A header may be of any length.
Bytes that are no whole member with a WARC header (a corrupt or truncated one) are passed over, and the reader goes on
at the next member; who has a manifest compares the number of records with it, as archive_and_read() does.

Files have names that no other attempt uses and count only through the manifest that Spark commits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import shared

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:undula:page:"
BUFFER = 1 << 20
#: Tasks that read at most; with more splits than that, a task reads several.
MOST_TASKS = 100_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None, date: str) -> bytes:
    """A gzip member; leader: the response's page_id for a revisit, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if leader is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else "urn:undula:none"
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if leader is not None else "response"),
        f"WARC-Record-ID: <{URN}{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{leader}>"] if leader is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def write(pages: DataFrame, folder: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives pages(page_id, url, html) below folder; returns the manifest (path, size, n), stored.

    Null html is empty; a null url has a stand-in. Rows with the largest page_id of equal payloads are all responses,
    should there be several; a null page_id is never the largest, unless all are null: then all are responses.
    An empty table gives an empty manifest.
    """
    shared.bounded_batches(pages.sparkSession)
    rows = shared.text_only(pages, "page_id", "url", "html")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    alike = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies"))
    alike = shared.stored(alike.where("copies > 1"), "copies")
    rows = shared.join_hot(rows, alike, ["digest", "n"], "copies", "left")
    rows = rows.withColumn("leader", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))).select("page_id", "url", "html", "digest", "leader")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        n = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                files, base = pa.fs.FileSystem.from_uri(folder)
                files.create_dir(base)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                sink = files.open_output_stream(f"{base}/{name}", compression=None)
                info = b"software: undula\r\n"
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                first = _member(head.encode() + info + b"\r\n\r\n")
                sink.write(first)
                size = len(first)
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "leader")]
            for page_id, url, digest, leader, html in zip(*columns, shared.raw(batch.column("html")), strict=True):
                data = record(page_id, url, html, digest, leader, date)
                sink.write(data)
                n, size = n + 1, size + len(data)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "n": [n]})

    return shared.stored(rows.mapInArrow(shared.released(archive), "path string, size long, n long"), "warc-manifest")


class _Bytes:
    """A file's bytes from a place on, buffered."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def at(self, place: int, n: int = BUFFER) -> bytes:
        """Up to n bytes from place on; none at the end."""
        n = min(n, self.size - place)
        if n <= 0:
            return b""
        if not (self.start <= place and place + n <= self.start + len(self.data)):
            self.source.seek(place)
            self.start, self.data = place, self.source.read(max(n, BUFFER))
        return self.data[place - self.start :][:n]


def member(source: _Bytes, start: int) -> tuple[bytes, int] | None:
    """The data of the gzip member at start and the place after it; None if there is no whole member with a WARC header.
    What doesn't begin like a WARC header is given up after its first bytes."""
    decoder, out, place = zlib.decompressobj(31), bytearray(), start
    ended = searched = 0  # where the header ends, and how far it was looked for
    try:
        while not decoder.eof:
            data = source.at(place, BUFFER if ended else 4096)
            if not data:
                return None
            out += decoder.decompress(data)
            place += len(data)
            if ended:
                continue
            if not b"WARC/1.".startswith(out[:7]) and not out.startswith(b"WARC/1."):
                return None
            found = out.find(b"\r\n\r\n", max(0, searched - 3))
            searched = len(out)
            if found >= 0:
                ended, head = found + 4, bytes(out[:found])
                if not (re.search(rb"(?i)\r\nWARC-Type:", head) and re.search(rb"(?i)\r\nContent-Length:\s*\d+", head)):
                    return None
    except zlib.error:
        return None
    return (bytes(out), place - len(decoder.unused_data)) if ended else None


def members(source: _Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and data of the members with a WARC header that start in [start, end)."""
    at = start
    while at < end:
        found = member(source, at) if source.at(at, 3) == MAGIC else None
        if found:
            yield at, found[0]
            at = found[1]
            continue
        at += 1  # not a member: look for the next candidate
        while at < end:
            k = source.at(at, min(BUFFER, end - at + 2)).find(MAGIC)
            if k >= 0:
                at += k
                break
            at += max(1, min(BUFFER, end - at + 2) - 2)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, place long"


def _page(name: str) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", name)
    return int(found[1]) if found else None


def read(files: DataFrame, split: int = 64 << 20, with_payload: bool = False) -> DataFrame:
    """Responses and revisits of files(path, size), a task for some splits of `split` bytes: COLUMNS, and payload.

    payload_digest is computed from a response's payload, and read from a revisit's header."""
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    count = files.agg(F.sum(F.ceil(F.col("size") / F.lit(split))).alias("n")).first()["n"] or 1
    ranges = ranges.repartition(int(max(1, min(count, MOST_TASKS))))  # dealt in turn: a split a task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = "page_id url payload_bytes payload_digest record_type refers_to path place payload".split()[: 8 + with_payload]
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                where, place = pa.fs.FileSystem.from_uri(path)
                with where.open_input_file(place) as source:
                    for at, data in members(_Bytes(source, size), start, min(start + split, size)):
                        fields, block = parse(data)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "revisit":
                            length = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
                            n = int(length[1]) if length else None
                            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        else:
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        url = fields.get("warc-target-uri")
                        rows.append((_page(fields.get("warc-record-id", "")), url if url != "urn:undula:none" else None, n, digest, kind, _page(fields.get("warc-refers-to", "")), path, at, payload if with_payload else None))
                        held += len(payload) if with_payload else 0
                        if len(rows) >= shared.BATCH_ROWS or held > shared.BATCH_BYTES:
                            yield made()
                            rows, held = [], 0
        if rows:
            yield made()

    return ranges.mapInArrow(shared.released(scan), COLUMNS + (", payload binary" if with_payload else ""))


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 1000, split: int = 64 << 20) -> DataFrame:
    """What read() finds in the archives that write() makes; ValueError if an archive has other than its number of records."""
    folder = folder or shared.scratch(spark, "warc")
    manifest = write(pages, folder, least)
    found = shared.stored(read(manifest, split), "records")
    wrong = checked(manifest, found).limit(3).collect()
    if wrong:
        raise ValueError(f"records lost or made up: {', '.join(f'{r.path} has {r.found} of {r.n}' for r in wrong)}")
    return found


def checked(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, n, found of the archives whose number of records isn't that of the manifest."""
    counted = found.groupBy("path").agg(F.count("*").alias("found"))
    return manifest.select("path", "n").join(counted, "path", "left").select("path", "n", F.coalesce("found", F.lit(0)).alias("found")).where("n <> found")
