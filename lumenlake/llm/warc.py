"""WARC archives (ISO 28500) as a PySpark Python data source.

Reading plans whole files into partitions of bounded size. Predicates on the record type and on headers that are columns are
pushed down: a reader parses a record's headers first and seeks over the block of one that fails, without reading or
decoding its payload. Each write commits by a manifest of its own, so files of failed or repeated tasks are never read,
later writes add to earlier ones, and an overwrite takes the place of them only when it commits.
"""

from __future__ import annotations

import base64
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from . import _store

MANIFEST = "_manifest-"
PARTITION_BYTES = 32 << 20
#: Smaller payloads are never revisits.
LEAST_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, record_date string, payload_digest string, refers_to_id string, content_length long, headers map<string,string>, payload binary, path string, offset long"
_COLUMN_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "record_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to_id": "warc-refers-to", "content_length": "content-length"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def sha1_label(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def sha1_hex(label: str | None) -> str | None:
    """The bare lower-case hex digest of a label, base 32 or hex; None for other algorithms."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record(kind: str, headers: dict[str, Any], block: bytes) -> bytes:
    """One record. Line breaks in header values become blanks, as a header is one line; None leaves a header out."""
    named = {"WARC-Type": kind, **headers, "Content-Length": len(block)}
    lines = [f"{k}: {' '.join(str(v).splitlines())}" for k, v in named.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def http_block(payload: bytes | None) -> bytes:
    """An HTTP response with a gzip body, or the head of one alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        return head + b"\r\n"
    body = gzip.compress(payload, 1, mtime=0)
    return head + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message with its content coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if names.get(b"content-encoding") in (b"gzip", b"x-gzip"):
        return gzip.decompress(body)
    if names.get(b"content-encoding") == b"deflate":
        return zlib.decompress(body)
    return body


def _headers(stream: IO[bytes]) -> tuple[dict[str, str], int] | None:
    """The next record's headers by lower-case name and how many bytes they took; None at the end."""
    size, line = 0, stream.readline()
    while line in (b"\r\n", b"\n"):
        size, line = size + len(line), stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    last = ""
    while True:
        size += len(line)
        line = stream.readline()
        if line in (b"\r\n", b"\n", b""):
            return found, size + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a continued line
            found[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()


def _test(f: Filter):
    """A predicate on a record's columns, or None for what is not pushed down."""
    if isinstance(f, Not):
        inner = _test(f.child) if isinstance(f.child, (EqualTo, In)) else None
        return inner and (lambda row, name=f.child.attribute[0]: row[name] is not None and not inner(row))
    attribute = getattr(f, "attribute", ())
    if len(attribute) != 1 or attribute[0] not in _COLUMN_OF:
        return None
    name, value = attribute[0], getattr(f, "value", None)
    some = lambda test: lambda row: row[name] is not None and test(row[name])
    tests = {
        EqualTo: some(lambda x: x == value),
        EqualNullSafe: lambda row: row[name] == value,
        In: some(lambda x: x in value),
        GreaterThan: some(lambda x: x > value),
        GreaterThanOrEqual: some(lambda x: x >= value),
        LessThan: some(lambda x: x < value),
        LessThanOrEqual: some(lambda x: x <= value),
        StringStartsWith: some(lambda x: x.startswith(value)),
        StringEndsWith: some(lambda x: x.endswith(value)),
        StringContains: some(lambda x: value in x),
        IsNotNull: lambda row: row[name] is not None,
        IsNull: lambda row: row[name] is None,
    }
    if isinstance(f, In):
        value = set(f.value)
    return tests.get(type(f))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def read_records(stream: IO[bytes], path: str, tests: list, payload: bool = True) -> Iterator[dict[str, Any]]:
    """The records of one archive that pass all tests; blocks of the others are skipped unread."""
    offset = 0
    while (found := _headers(stream)) is not None:
        headers, size = found
        length = int(headers.get("content-length", 0))
        row = {c: headers.get(h) for c, h in _COLUMN_OF.items()} | {"content_length": length}
        if all(test(row) for test in tests):
            wanted = payload and row["record_type"] in ("response", "resource", "conversion")
            if wanted:
                block = stream.read(length)
                if len(block) < length:
                    raise ValueError(f"{path} ends inside a record")
                body = http_payload(block) if headers.get("content-type", "").startswith("application/http") else block
            else:
                body = None
                stream.seek(length, 1)
            yield row | {"headers": headers, "payload": body, "path": path, "offset": offset}
        else:
            stream.seek(length, 1)
        stream.read(4)
        offset += size + length + 4


def _manifests(fs: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    """The files that each committed write has named, by manifest."""
    found = {}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(MANIFEST):
            with fs.open_input_stream(f.path) as m:
                found[f.base_name] = json.loads(m.read())
    return found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            test = _test(f)
            if test:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Files((self.path,))]
        every = fs.get_file_info(pafs.FileSelector(root))
        files = [f for f in every if f.base_name.endswith((".warc", ".warc.gz"))]
        if manifests := _manifests(fs, root):
            named = {name for own in manifests.values() for name in own}
            files = [f for f in files if f.base_name in named]
        out: list[Files] = []
        held: list[str] = []
        size = 0
        for f in sorted(files, key=lambda f: f.base_name):
            held.append(f"{self.path.rstrip('/')}/{f.base_name}")
            size += f.size
            if size >= self.most:
                out.append(Files(tuple(held)))
                held, size = [], 0
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([*((c, pa.int64() if c == "content_length" else pa.string()) for c in _COLUMN_OF), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        rows: list[dict[str, Any]] = []
        size = 0
        for path in partition.paths:
            fs, at = _open(path)
            with fs.open_input_file(at) as raw:
                stream = gzip.open(raw, "rb") if path.endswith(".gz") else raw
                for row in read_records(_Buffered(stream), path, self.tests, self.payload):
                    rows.append(row | {"headers": list(row["headers"].items())})
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class _Buffered:
    """readline, read and relative seek over a file of any file system; seeks beyond the buffer do not read."""

    def __init__(self, raw: Any, step: int = 1 << 18):
        self.raw, self.step, self.held, self.at = raw, step, b"", 0

    def _more(self) -> bool:
        got = self.raw.read(self.step)
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                line, self.at = self.held[self.at : end + 1], end + 1
                return line
            if not self._more():
                line, self.at = self.held[self.at :], len(self.held)
                return line

    def read(self, n: int) -> bytes:
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out if len(out) == n else out + self.raw.read(n - len(out))

    def seek(self, n: int, _whence: int) -> None:
        rest = n - (len(self.held) - self.at)
        if rest <= 0:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.raw.seek(self.raw.tell() + rest)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_type, headers (list of name and value) and block, in files of one task each."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc", None
        for batch in iterator:
            for kind, headers, block in zip(batch["record_type"].to_pylist(), batch["headers"].to_pylist(), batch["block"].to_pylist(), strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}")
                out.write(record(kind, dict(headers), block or b""))
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = fs.get_file_info(pafs.FileSelector(root)) if self.overwrite else []
        names = [x.name for x in messages if x and x.name]
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as m:
            m.write(json.dumps(names).encode())
        for f in sorted(before, key=lambda f: not f.base_name.startswith(MANIFEST)):  # manifests first, so no file is named that is gone
            if f.type == pafs.FileType.File and f.base_name not in names:
                fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for x in messages:
            if x and x.name:
                fs.delete_file(f"{root}/{x.name}")


class WarcDataSource(DataSource):
    """Format "warc". Options: path, payload ("false" leaves payloads undecoded), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options)["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    for b in batches:
        for k in range(0, b.num_rows, 256):
            rows = []
            for r in b.slice(k, 256).to_pylist():
                name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"
                headers = {"WARC-Record-ID": name(r["page_id"]), "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": r["url"], "WARC-Payload-Digest": sha1_label(r["digest"]), "Content-Type": "application/http;msgtype=response", "X-Page-Id": r["page_id"]}
                if r["response_id"] is not None:
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": name(r["response_id"])}
                    rows.append(("revisit", headers, http_block(None)))
                else:
                    rows.append(("response", headers, http_block(r["html"] or b"")))
            yield pa.RecordBatch.from_pylist([{"record_type": a, "headers": [(x, str(y)) for x, y in h.items() if y is not None], "block": c} for a, h, c in rows], schema=kinds)


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive pages (page_id long, url, html) at path, a response or revisit record each, beside what is there already.

    Of pages with equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses too. Null html is an empty payload; a null url leaves
    its header out; a null page_id is never the response of others and its record names no page; an empty table writes
    no record; other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    same = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    same = _store.written(same.filter("copies > 1"), "copies")
    known = _store.lookup(rows, same, ["digest", "size"], "copies", "left")
    known = known.withColumn("response_id", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    records = known.select("page_id", "url", "html", "digest", "response_id").mapInArrow(_records, "record_type string, headers map<string,string>, block binary")
    register(pages.sparkSession)
    records.write.format("warc").mode("append").save(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and describe them from the archives read back, a row for each row of pages.

    Returns page_id, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to (the response's page_id, null for
    responses). Lengths and digests are those of decoded payloads: a revisit's are those of the record that its
    WARC-Refers-To names, whose page_id refers_to is. Null html is an empty payload; very long pages are archived and read
    whole; page_id may be null or repeated, and equal large payloads of which none has a page_id are all responses; an
    empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = _store.new_path(spark, "warc")
    with _store.scope():
        write_pages(pages, path)

    def records(kind: str, payload: str) -> DataFrame:
        # Scans of one loaded DataFrame share what was pushed down last, so each branch loads its own.
        return spark.read.format("warc").option("payload", payload).load(path).filter(F.col("record_type") == kind)

    def number(name: str) -> Column:
        return F.col("headers").getItem(name).cast("long")

    described = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")]
    responses = _store.written(records("response", "true").select(number("x-page-id").alias("page_id"), "record_id", *described), "responses")
    revisits = _store.written(records("revisit", "false").select(number("x-page-id").alias("page_id"), F.col("refers_to_id").alias("record_id")), "revisits")
    # What is revisited, with how often; a page that many revisit is looked up by broadcast.
    wanted = revisits.groupBy("record_id").agg(F.count("*").alias("copies"))
    first = responses.join(wanted, "record_id").groupBy("record_id").agg(*(F.first(c).alias(c) for c in ("payload_bytes", "payload_digest", "copies")), F.first("page_id").alias("refers_to"))
    found = _store.lookup(revisits, _store.written(first, "revisited"), ["record_id"], "copies", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    return responses.select(*columns).unionByName(found.withColumn("record_type", F.lit("revisit")).select(*columns))
