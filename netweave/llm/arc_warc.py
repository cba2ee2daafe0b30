"""Legacy ARC archives to WARC, and WARC files written and read back.

An ARC file starts with a ``filedesc:`` record whose body names the version and
the fields of every header line that follows: five in version 1, ten in
version 2. Only the record that the file starts with is one; a page's address may
begin like it. Each header line ends with the declared length of the bytes that
follow. A WARC record takes its identifier from a name-based UUID of the archive's
digest and its place there, its date from the 14 digits, its type from address and
block, and its digests from the bytes themselves. WARC files have a gzip member for
each record, are closed at so many bytes, and are read as streams.

Defined results: a declared length beyond the end of the archive gives a
record marked ``WARC-Truncated: length``; a line that is no header is passed
over; an empty archive gives no record. An archive converted twice keeps its
identifiers; repeated rows are records of their own. A page without id has no capture id: it is a response, and nothing
refers to it. Null payloads are
empty ones, null addresses become ``urn:none``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from calendar import monthrange
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.shared_files import listed, opened

#: Header fields of the two ARC versions, as their filedesc records spell them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = b"\r\n\r\n"
#: Of gzip members.
LEVEL = 4
#: Revisits of one response are dealt over this many salts when they look it up.
SALTS = 64
SCHEMA = (
    "record_id string, warc_type string, warc_date string, target_uri string, ip string, content_type string, "
    "block binary, block_digest string, payload_bytes long, payload_digest string, capture_id long, truncated boolean"
)
CAPTURE = b"X-Capture-Id: "


# ---- ARC ---------------------------------------------------------------


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, offset: int, name: str, status: int = 200) -> bytes:
    url = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") or "urn:none"
    if version == 1:
        fields = (url, ip, date, kind, length)
    else:
        fields = (url, ip, date, kind, status, "-", "-", offset, name, length)
    return " ".join(map(str, fields)).encode() + b"\n"


def write_arc(captures: list[tuple[str | None, bytes]], version: int = 1, name: str = "segment.arc", date: str = "20240101000000", ip: str = "0.0.0.0") -> bytes:
    """An ARC file of (address, block) captures."""
    about = f"{version} 0 netweave\n{ARC_FIELDS[version]}\n".encode()
    out = [arc_header(version, f"filedesc://{name}", ip, date, "text/plain", len(about), 0, name), about, b"\n"]
    at = sum(map(len, out))
    for url, block in captures:
        head = arc_header(version, url or "", ip, date, "text/html", len(block), at, name)
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file: header fields by name, body, truncated, and
    about: whether it is the version block, which stands at the start."""
    fields, at = ARC_FIELDS[1].split(), 0
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    while at < len(content):
        about = at == 0 and content.startswith(b"filedesc:")
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line, at = content[at:end].rstrip(b"\r"), end + 1
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if about:
            parts = line.decode("utf-8", "replace").split(" ")
            fields = ARC_FIELDS[2 if len(parts) == 10 else 1].split()
        if len(parts) != len(fields) or not parts[-1].isdigit():
            continue
        length = int(parts[-1])
        body, at = content[at : at + length], at + length
        if about:
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0][:1].isdigit() else 1
            fields = lines[1].split() if len(lines) > 1 and lines[1].startswith("URL") else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
        yield dict(zip(ARC_FIELDS[2].split() if len(parts) == 10 else ARC_FIELDS[1].split(), parts, strict=False)) | {"body": body, "truncated": len(body) < length, "about": about}


def iso_date(digits: str) -> str:
    """14 digits (or the 12 of the first archives) as a WARC date; a part beyond
    its range becomes the nearest that exists."""
    d = (re.sub(r"\D", "", digits) + "00000000000000")[:14]
    year, month = max(1, int(d[:4])), max(1, min(12, int(d[4:6])))
    day = max(1, min(monthrange(year, month)[1], int(d[6:8])))
    return f"{year:04d}-{month:02d}-{day:02d}T{min(23, int(d[8:10])):02d}:{min(59, int(d[10:12])):02d}:{min(59, int(d[12:])):02d}Z"


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def convert(record: dict, ordinal: int, archive: str = "") -> tuple:
    """An ARC record as a row of SCHEMA. archive: a digest of the archive, which
    with the ordinal names the record."""
    url, block = record["URL"], record["body"]
    head, payload = split_block(block)
    if record["about"]:
        kind, content_type = "warcinfo", "application/warc-fields"
        block = b"software: netweave\r\nformat: WARC File Format 1.1\r\ndescription: " + b" / ".join(block.split(b"\n")).strip(b" /\r") + b"\r\n"
        payload = block
    elif head:
        kind, content_type = "response", "application/http; msgtype=response"
    else:
        kind, content_type = "resource", "text/dns" if url.startswith("dns:") else record["Content-type"]
    date, digest = iso_date(record["Archive-date"]), hashlib.sha256(payload).hexdigest()
    found = re.search(re.escape(CAPTURE) + rb"(-?\d+)\r\n", head)
    capture = int(found[1]) if found else None
    name = f"{url}\n{date}\n{digest}\n{archive}#{ordinal}"
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    return record_id, kind, date, url, record["IP-address"], content_type, block, hashlib.sha256(block).hexdigest(), len(payload), digest, capture, record["truncated"]


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in SCHEMA.split(", ")]
#: Bytes of records given to Spark at once.
FLUSH = 8 << 20


def _flushed(rows: Iterator[tuple], weigh: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about FLUSH bytes; weigh: the column that has the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[weigh]) if row[weigh] else 0)
        if size >= FLUSH:
            yield _rows(held, names, types)
            held, size = [], 0
    yield _rows(held, names, types)


def pages_to_arc(df: DataFrame, id_col: str, url_col: str, html_col: str, version: int = 1, per_segment: int = 500) -> DataFrame:
    """ARC archives of at most per_segment pages each, one a row: ``content``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (CAPTURE + b"%d\r\n" % key if key is not None else b"") + b"\r\n"
                    held.append((url, head + (html or "").encode()))
                    size += len(held[-1][1])
                    if len(held) >= per_segment or size >= FLUSH:
                        yield (write_arc(held, version),)
                        held, size = [], 0
            if held:
                yield (write_arc(held, version),)

        yield from _flushed(archives(), 0, ["content"], [pa.binary()])

    return df.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(build, "content binary")


def arc_to_warc(df: DataFrame, content_col: str = "content") -> DataFrame:
    """The records (SCHEMA) of the ARC archives in a binary column, such as
    that of Spark's ``binaryFile`` reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (c.as_py() for b in batches for c in b.column(0) if c.is_valid)
        rows = (convert(r, i, name) for content in contents for name in [hashlib.blake2b(content).hexdigest()] for i, r in enumerate(parse_arc(content)))
        yield from _flushed(rows, 6, _NAMES, _TYPES)

    return df.select(content_col).mapInArrow(run, SCHEMA)


# ---- WARC --------------------------------------------------------------


def mark_revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Adds ``refers_to`` and ``refers_to_id``: of responses with equal payloads
    of at least min_bytes, that with the smallest capture id stays a response
    and the others become revisits of it.

    Digests are summed up before they are shuffled; the look-up is salted, so a
    payload that a third of all captures share is dealt over SALTS tasks.
    """
    eligible = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes) & F.col("capture_id").isNotNull()
    first = (
        records.filter(eligible)
        .groupBy("payload_digest")
        .agg(F.min("capture_id").alias("refers_to"), F.min(F.struct("capture_id", "record_id"))["record_id"].alias("refers_to_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("payload_digest").alias("__digest"), "refers_to", "refers_to_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salt = F.when(eligible, F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    same = (F.col("payload_digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt"))
    joined = records.withColumn("salt", salt).join(first, same, "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("capture_id"))
    return joined.select(
        *[F.when(revisit, "revisit").otherwise(F.col(c)).alias(c) if c == "warc_type" else F.col(c) for c in records.columns],
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("refers_to_id")).alias("refers_to_id"),
    )


def warc_text(records: DataFrame) -> DataFrame:
    """One column ``value``: header and block of each record, without the end
    mark. Bytes pass through unchanged; a revisit keeps the HTTP header only. What
    describes the file has no address."""
    block = F.col("block").cast("string")
    http_end = F.locate("\r\n\r\n", block)
    block = F.when((F.col("warc_type") == "revisit") & (http_end > 0), F.substring(block, F.lit(1), http_end + 3)).otherwise(block)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit, info = F.col("warc_type") == "revisit", F.col("warc_type") == "warcinfo"
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("warc_date")),
        F.when(~info, F.concat(field("WARC-Target-URI", F.col("target_uri")), field("WARC-IP-Address", F.col("ip")))).otherwise(""),
        F.when(~revisit, field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("block_digest")))).otherwise(""),
        F.when(~info, F.concat(field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), field("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        F.when(F.col("truncated"), F.lit("WARC-Truncated: length\r\n")).otherwise(""),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", F.col("refers_to_id")), field("X-Refers-To-Capture", F.col("refers_to").cast("string")))).otherwise(""),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length("__block").cast("string")),
        F.lit("\r\n"),
    )
    return records.withColumn("__block", block).select(F.concat(header, F.col("__block")).alias("value"))


def write_warc(records: DataFrame, path: str, file_bytes: int = 256 << 20) -> None:
    """WARC files with a gzip member for each record, closed when they have that
    many bytes, and ``manifest``, a table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inside = opened(path)
        task, out, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, []
        for value in (v for batch in batches for v in batch.column(0)):
            if out is None:
                done.append([f"part-{task}-{len(done):05d}.warc.gz", 0, 0])
                out = files.open_output_stream(f"{inside}/{done[-1][0]}", compression=None)
            member = gzip.compress(value.as_buffer().to_pybytes() + RECORD_END, LEVEL, mtime=0)
            out.write(member)
            done[-1][1] += 1
            done[-1][2] += len(member)
            if done[-1][2] >= file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        yield _rows([tuple(d) for d in done], ["name", "n_records", "n_bytes"], [pa.string(), pa.int64(), pa.int64()])

    files, inside = opened(path)
    files.create_dir(inside, recursive=True)
    warc_text(records).select(F.col("value").cast("binary")).mapInArrow(run, "name string, n_records long, n_bytes long").write.parquet(f"{path}/manifest")


READ_SCHEMA = "record_id string, record_type string, warc_date string, target_uri string, capture_id long, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary"
_READ_NAMES = [part.split()[0] for part in READ_SCHEMA.split(", ")]
_READ_TYPES = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[part.split()[1]] for part in READ_SCHEMA.split(", ")]


def parse_warc(file: BinaryIO) -> Iterator[tuple]:
    """Rows of READ_SCHEMA by declared lengths, a record at a time; digests are of
    the bytes read, and only a revisit's are the recorded ones. Where a record
    names no payload digest there is nothing to compare."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while line := file.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            fields[name] = value
        head, payload = split_block(file.read(int(fields["Content-Length"])))
        found = re.search(re.escape(CAPTURE) + rb"(-?\d+)\r\n", head)
        recorded = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        kind = fields["WARC-Type"]
        if kind == "revisit":
            size, digest = int(fields["X-Payload-Length"]), recorded
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if recorded and digest != recorded and "WARC-Truncated" not in fields:
                raise ValueError(f"{fields['WARC-Record-ID']}: payload digest {digest}, recorded {recorded}")
        refers = fields.get("X-Refers-To-Capture")
        yield fields["WARC-Record-ID"], kind, fields["WARC-Date"], fields.get("WARC-Target-URI"), int(found[1]) if found else None, size, digest, int(refers) if refers else None, fields.get("WARC-Refers-To"), payload


def _stream(path: str) -> BinaryIO:
    """A file, inflated as it is read if it is compressed."""
    files, inside = opened(path)
    file = files.open_input_file(inside)
    packed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    return gzip.open(file) if packed else io.BufferedReader(file)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files in a folder, those of its manifest if it has
    one; without payloads the column is null, and only digests and lengths leave
    the workers."""
    files, inside = opened(path)
    if files.get_file_info(f"{inside}/manifest").type == FileType.Directory:
        names = spark.read.parquet(f"{path}/manifest").select("name")
    else:
        names = spark.createDataFrame([(n,) for n in listed(path, (".warc", ".warc.gz"))], "name string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r if payloads else (*r[:-1], None) for b in batches for name in b.column(0).to_pylist() for r in parse_warc(_stream(f"{path}/{name}")))
        yield from _flushed(rows, 9, _READ_NAMES, _READ_TYPES)

    return names.repartition(max(spark.sparkContext.defaultParallelism, names.count()), "name").mapInArrow(run, READ_SCHEMA)
