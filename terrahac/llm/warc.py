"""WARC archives: a writer with de-duplicated payloads and a splittable reader.

An archive is a file of gzip members, one WARC record each. Both directions go through
Spark's own file writer and reader, so any store that Spark reaches will do.

Writing: Spark's text writer ends every row with a fixed separator. A member ends in the
four bytes of its payload's length, of which the last is 0 below 16 MiB; a longer member is
followed by an empty one, which ends in 0 too. Rows leave that byte to the separator.

Reading: the text reader cuts byte ranges at the gzip magic, each task owning what starts in
its range. A piece is a member if it opens as gzip, its header decodes as a WARC record, and
it inflates to its end; where the magic occurs within compressed data, pieces are joined
until it does. A member cut by the end of a range is completed from the pieces that the next
range could not place; those few fragments, and nothing else, are shuffled by file. Files whose names
end in .gz are cut like any other: Hadoop takes a file's codec from the nearest known ending that sorts
before its name, read backwards, and the reader makes a longer ending known that sorts after .gz and that
no archive has, so no codec is found.

Records: of any type, one or more in a member. page_id and refers_to are numbers where ids are of the form
that the writer uses, else null; record_id and refers_to_id are the ids as they stand. payload_digest
is that of the header if it is a SHA-1, else null. A record whose digest or length does not
match, and bytes that belong to no member, raise ValueError; with strict=False they become rows of the
type 'damaged', whose payload_bytes are the bytes skipped, and what follows is read.

Defined results: a null payload is the empty one; rows with equal ids and payloads share
their role (all responses, or all revisits); a null id sorts below every other; an empty
table gives empty archives; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahac.llm.common import column_bytes, new_path, ship, small_batches, sorted_groups, table

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always written in full.
LEAST = 1000
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string"
#: Groups of equal payloads up to which all tasks get their digests and ids (about 60 bytes each).
SEND_GROUPS = 300_000


def member(data: bytes, level: int) -> bytes:
    """A gzip member without its last byte, which is 0."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        out += EMPTY_MEMBER
    return out[:-1]


def _line(value: str) -> str:
    """A header value: percent signs and line ends are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(name: str | None) -> int | None:
    """The page's number in an id as the writer makes them."""
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if name != number and number.lstrip("-").isdigit() else None


def _sha1(value: str | None) -> str | None:
    """A digest of a header as hexadecimal digits, if it is a SHA-1."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(text) == 40:
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def _record(data: bytes, start: int) -> tuple[tuple, int]:
    """The fields of RECORDS from the record that begins at start, and where it ends; raises ValueError if it is not whole."""
    end = data.find(b"\r\n\r\n", start)
    lines = data[start:end].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("a WARC header without length or type")
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("a record is cut off")
    kind = fields["warc-type"].lower()
    payload, n = block, size
    if fields.get("content-type", "").startswith("application/http"):
        http, mark, rest = block.partition(b"\r\n\r\n")
        payload = rest if mark else b""
        n = len(payload)
        if kind == "revisit":  # its payload is elsewhere, and its length in the HTTP header
            for x in http.split(b"\r\n")[1:]:
                k, _, v = x.partition(b":")
                if k.strip().lower() == b"content-length" and v.strip().isdigit():
                    n = int(v)
    digest = _sha1(fields.get("warc-payload-digest"))
    if kind != "revisit" and digest and "warc-truncated" not in fields and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    url = fields.get("warc-target-uri")
    own, other = fields.get("warc-record-id"), fields.get("warc-refers-to")
    return (_number(own), None if url is None else _unline(url), kind, _number(other), n, digest, None if kind == "revisit" else payload, own, other), end + 4 + size


def parse(data: bytes) -> list[tuple]:
    """The fields of RECORDS of each record in a member."""
    out, at = [], 0
    while at < len(data):
        row, at = _record(data, at)
        out.append(row)
        while data[at : at + 2] == b"\r\n":
            at += 2
    return out


def with_roles(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, payload, n, sha1 and refers_to (null for responses).

    Groups of equal payloads are counted before anything is shuffled by digest, and only
    groups of two or more are joined back. Up to SEND_GROUPS of them are sent to all tasks, so that no
    payload is shuffled; beyond, a large group is the many-rows side of a join, which Spark splits.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    last = base.filter(F.col("n") >= LEAST).groupBy("sha1").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).filter("copies > 1 and last_id is not null").select(F.col("sha1").alias("same"), "last_id")
    last = table(last, "copies")
    if last.count() <= SEND_GROUPS:
        last = F.broadcast(last)
    refers = F.when((F.col("n") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id"))
    return base.join(last, F.col("sha1") == F.col("same"), "left").select("page_id", "url", "payload", "n", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, level: int = 3) -> None:
    """Write a record per row of pages (page_id, url, html) below path."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "payload"):
            cols = [column_bytes(batch.column(i)) if n in ("url", "payload") else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)]
            out = [member(record(p, None if u is None else u.decode(), b, n, bytes.fromhex(s), r), level) for p, u, b, n, s, r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = with_roles(pages).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


NAMES = [x.split()[0] for x in RECORDS.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
#: An ending that hides .gz from Hadoop's choice of a codec, see above; no character in names sorts before its second.
HIDES = "a\x01.gz"
#: Options of the text reader under which names in .gz are read as they are; Spark's Hadoop client has its own name for one.
AS_IT_IS = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "io.compress.passthrough.extension": HIDES, "org.apache.hadoop.shaded.io.compress.passthrough.extension": HIDES}


class _Member:
    """A gzip member whose pieces are fed one after the other."""

    def __init__(self) -> None:
        self.z, self.raw, self.out, self.size = zlib.decompressobj(31), [], [], 0

    def feed(self, piece: bytes) -> str:
        """'whole' at its end, 'more' if it may go on, else 'no'."""
        self.raw.append(piece)
        try:
            part = self.z.decompress(piece)
        except zlib.error:
            return "no"
        if part:
            self.out.append(part)
            self.size += len(part)
        if self.size and len(self.out) > 1 and len(self.out[0]) < 5:
            self.out = [b"".join(self.out)]
        if self.z.eof:
            return "no" if self.z.unused_data else "whole"
        return "more" if not self.out or b"WARC/".startswith(self.out[0][:5]) else "no"

    def content(self) -> bytes:
        return b"".join(self.out)


class _Range:
    """The pieces of one byte range of a file, in their order."""

    def __init__(self, file: str, at: int, strict: bool = True):
        self.file, self.at, self.strict = file, at, strict
        self.orphan: list[bytes] = []
        self.now: _Member | None = None
        self.placed, self.lost = at == 0, 0

    def add(self, piece: bytes) -> bytes | None:
        """The content of a member that this piece completes."""
        fresh = self.now is None
        self.now = self.now or _Member()
        found = self.now.feed(piece)
        if found == "no" and not fresh:  # perhaps what was held is none, and this begins one
            self._drop(self.now.raw[:-1])
            self.now = _Member()
            found = self.now.feed(piece)
        if found == "no":
            self._drop([piece])
            self.now = None
        elif found == "whole":
            content, self.now, self.placed = self.now.content(), None, True
            return content
        return None

    def _drop(self, pieces: list[bytes]) -> None:
        if not self.placed:  # so far, all continues what began in an earlier range
            self.orphan += pieces
        elif self.strict:
            raise ValueError(f"{self.file} holds bytes that belong to no member")
        else:
            self.lost += sum(map(len, pieces))

    def fragments(self) -> list[tuple[str, int, bytes]]:
        held = self.now.raw if self.now else []
        return [(self.file, 2 * self.at + i, b"".join(x)) for i, x in enumerate((self.orphan, held)) if x]

    def damage(self) -> list[tuple]:
        lost, self.lost = self.lost, 0
        return [_damaged(lost)] if lost else []


def _damaged(size: int) -> tuple:
    return (None, None, "damaged", None, size, None, None, None, None)


def _rows(content: bytes, payload: bool, strict: bool) -> list[tuple]:
    try:
        found = parse(content)
    except ValueError:
        if strict:
            raise
        return [_damaged(len(content))]
    return found if payload else [(*r[:6], None, *r[7:]) for r in found]


def _batch(rows: list[tuple], fragments: list[tuple] | None = None) -> pa.RecordBatch:
    blank = (None,) * len(NAMES)
    every = [(*r, None, None, None) for r in rows] + [(*blank, *f) for f in fragments or ()]
    cols = list(zip(*every)) if every else [()] * (len(NAMES) + 3)
    made = [pa.array(c, k) for c, k in zip(cols, [*KINDS, pa.string(), pa.int64(), pa.binary()])]
    n = len(NAMES) + (0 if fragments is None else 3)
    return pa.RecordBatch.from_arrays(made[:n], names=[*NAMES, "file", "at", "fragment"][:n])


def _members(batches: Iterator[pa.RecordBatch], payload: bool, strict: bool) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    rows, size = [], 0
    for batch in batches:
        values, files, starts = column_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for value, file, at in zip(values, files, starts):
            if now is None or (file, at) != (now.file, now.at):
                if now is not None:
                    yield _batch(rows + now.damage(), now.fragments())
                    rows, size = [], 0
                now = _Range(file, at, strict)
                if at == 0:  # what stands before a file's first separator
                    if value and strict:
                        raise ValueError(f"{file} does not begin with a gzip member")
                    now.lost += len(value)
                    continue
            if content := now.add(MAGIC + value):
                rows += _rows(content, payload, strict)
                size += len(content) if payload else 200
                if size > 4_000_000:
                    yield _batch(rows, [])
                    rows, size = [], 0
    if now is not None:
        yield _batch(rows + now.damage(), now.fragments())


def _stitched(batches: Iterator[pa.RecordBatch], payload: bool, strict: bool) -> Iterator[pa.RecordBatch]:
    for (file,), group in sorted_groups(batches, ["file"], ["fragment"]):
        held, rows, lost = b"".join(group["fragment"]), [], 0
        while held:
            z = zlib.decompressobj(31)
            try:
                content = z.decompress(held)
                good = z.eof and (not content or content.startswith(b"WARC/"))
            except zlib.error:
                good = False
            if good:
                held = z.unused_data
                rows += _rows(content, payload, strict) if content else []
            elif strict:
                raise ValueError(f"{file} holds a broken member or ends within one")
            else:  # go on at the next place that may begin a member
                at = held.find(MAGIC, 1)
                at = len(held) if at < 0 else at
                lost, held = lost + at, held[at:]
        yield _batch(rows + ([_damaged(lost)] if lost else []))


def read(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records below path, by byte ranges: the columns of RECORDS, payload null if not asked for."""
    ship(spark)
    lines = spark.read.options(**AS_IT_IS).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    found = lines.mapInArrow(lambda b: _members(b, payload, strict), RECORDS + ", file string, at long, fragment binary")
    whole = found.filter(F.col("fragment").isNull()).select(*NAMES)
    cut = found.filter(F.col("fragment").isNotNull()).select("file", "at", "fragment")
    joined = cut.repartition("file").sortWithinPartitions("file", "at").mapInArrow(lambda b: _stitched(b, payload, strict), RECORDS)
    return whole.unionByName(joined)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read the archives back, without the payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
