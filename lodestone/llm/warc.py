"""WARC archives: written from a table in parallel, read through a Python data source.

A record is a gzip member of its own whose extra field "sl" tells its compressed and full length, so a reader inflates
a record's headers alone and skips what it doesn't want. Files of other writers, without that field, with several
records in a member or not compressed, are read as well. A record whose payload repeats is a revisit without payload; it
names the response by record id, URI and date.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from lodestone.llm.common import pieces, scratch, small, tidied
from lodestone.session import saved
from lodestone.ship import ship
from lodestone.sources.files import filesystem, settle

LEAST = 100
#: Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = struct.Struct("<4sIBB")
_EXTRA = struct.Struct("<2sHII")
#: Header names as the format spells them; files may write them in any case.
_NAMES = {name.lower(): name for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Target-URI", "WARC-Truncated", "WARC-Warcinfo-ID", "WARC-Filename", "WARC-Profile", "WARC-Identified-Payload-Type", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length")}
#: Columns that are header fields as they stand: predicates on them need the headers only.
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
SCHEMA = "record_type string, record_id string, target_uri string, content_type string, payload_digest string, headers map<string,string>, payload binary"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the skip-length field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = _MEMBER.size + 2 + _EXTRA.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H", _EXTRA.size) + _EXTRA.pack(b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields.items() if v is not None)
    return _VERSION + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _urn(*parts: object) -> str:
    """Of the archive's path, which no other archive has, and what tells the record apart; a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([str(x) for x in parts]))}>"


def _page_record(archive: str, place: str, page, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """first: of a payload that repeats, the id and URL of the page whose response stands for it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None and first["id"] != page
    named = first is not None and (first["id"], first["url"]) == (page, url)  # revisits must be able to tell its id
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(archive, "first", page, url, digest) if named else _urn(archive, place, page, url, date, digest), "WARC-Date": date, "WARC-Target-URI": url or None, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": page, "X-Payload-Length": len(payload)}
    if not revisit:
        return record(fields, http + payload)
    to = {"WARC-Refers-To": _urn(archive, "first", first["id"], first["url"], digest), "WARC-Refers-To-Target-URI": first["url"] or None, "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": first["id"]}
    return record(fields | {"WARC-Profile": _PROFILE} | to, http)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> str:
    """A record per row; gives the path. Payload: the html in UTF-8, empty where null.

    Of equal payloads of `least` bytes or more the row with the smallest id is the response and the others revisit it;
    rows that repeat that id are responses, too. A null id never names a response; without any id, all are responses.
    A null url has no target URI. An empty table leaves a folder without records. A file per input partition, written
    under another name and renamed: a task that runs again leaves the same records. Record ids hash the path, the page
    and the record's place; rows that repeat a response with its id and URL share one.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    rows = rows.withColumn("_digest", F.sha2("_html", 256))
    # counts are summed before the shuffle, so a payload that fills a third of the rows is a row a task
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("id"), F.col("_url").alias("url"))))
    seen = rows.filter(F.octet_length("_html") >= least).groupBy("_digest").agg(first.alias("_to"), F.count("*").alias("_n"))
    copies = saved(seen.filter("_n > 1 and _to is not null").select("_digest", "_to"), "copies")
    n = copies.count()
    if n:
        rows = rows.join(F.broadcast(copies) if small(copies, 256, n) else copies, "_digest", "left")
    else:
        rows = rows.withColumn("_to", F.lit(None).cast("struct<id:long,url:string>"))
    rows = rows.select("_id", "_url", "_html", "_digest", "_to")

    rows.mapInArrow(tidied(_writer(path, date)), "part long, records long").write.format("noop").mode("overwrite").save()
    where, inner = filesystem(path)
    where.create_dir(inner, recursive=True)
    return path


def _writer(path: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        where, inner = filesystem(path)
        where.create_dir(inner, recursive=True)
        own = f"{inner}/part-{part:05d}.warc.gz"
        temp = f"{own}.{uuid.uuid4().hex}.tmp"
        with where.open_output_stream(temp) as out:
            for batch in pieces(batches):
                for page, url, html, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(member(_page_record(path, f"{part}/{n}", page, url, html.encode(), digest, to, date)))
                    n += 1
        settle(where, temp, own)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["part", "records"])

    return write


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path). Options: path (a file or a folder), payload (false: null, never inflated)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, str, object]] = []  # header, test, value

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = f.attribute if hasattr(f, "attribute") else ()
            header = _HEADERS.get(at[0]) if len(at) == 1 else at[1] if len(at) == 2 and at[0] == "headers" else None
            if header and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((header, "in", {f.value}))
            elif header and isinstance(f, In):
                self.wanted.append((header, "in", set(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.wanted.append((header, "starts", f.value))
            elif header and isinstance(f, IsNotNull):
                self.wanted.append((header, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        where, inner = filesystem(self.path)
        top = where.get_file_info(inner)
        found = [top] if top.is_file else where.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))] or [InputPartition(None)]

    def keeps(self, headers: dict[str, str]) -> bool:
        for name, test, value in self.wanted:
            got = headers.get(name)
            if got is None or test == "in" and got not in value or test == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        where, _ = filesystem(self.path)
        rows, n = [], 0
        with where.open_input_file(partition.value) as f:
            for headers, block in records(f, f.size(), self.keeps, self.payload):
                payload = None
                if block is not None:
                    payload = block.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").lower().startswith("application/http") else block
                rows.append((headers, payload))
                n += len(payload or b"") + 500
                if n > 8 << 20:
                    yield _rows(rows)
                    rows, n = [], 0
        if rows:
            yield _rows(rows)


_TYPE = pa.schema([*((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "content_type", "payload_digest")), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _rows(rows: list) -> pa.RecordBatch:
    columns = [[h.get(_HEADERS[c]) for h, _ in rows] for c in _TYPE.names[:5]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([list(h.items()) for h, _ in rows], _TYPE.field("headers").type), pa.array([p for _, p in rows], pa.binary())], schema=_TYPE)


def parse(head: bytes) -> dict[str, str]:
    """A record's headers: names in any case get the format's own spelling, folded lines are joined by a blank, and the
    values of a header that repeats by ", ", in their order."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].upper().startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields: list[list[str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] = f"{fields[-1][1]} {line.strip()}".strip()
        elif line:
            name, _, value = line.partition(":")
            fields.append([_NAMES.get(name.strip().lower(), name.strip()), value.strip()])
    out: dict[str, str] = {}
    for name, value in fields:
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _length(headers: dict[str, str], at: int) -> int:
    try:
        return int(headers["Content-Length"])
    except (KeyError, ValueError):
        raise ValueError(f"the record at {at} has no length") from None


class _Inflated:
    """A gzip member's content, inflated as far as it is asked for."""

    def __init__(self, f, at: int, start: bytes):
        self.f, self.at, self.piece, self.read = f, at, start, len(start)
        self.z, self.held = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflates another piece of bounded size; false at the member's end."""
        while not self.z.eof:
            if not self.piece:
                self.piece = self.f.read(1 << 18)
                self.read += len(self.piece)
                if not self.piece:
                    raise ValueError(f"the record at {self.at} is cut off")
            out = self.z.decompress(self.piece, 1 << 20)
            self.piece = self.z.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None where there is no more mark."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while n:
            if not self.held and not self.more():
                raise ValueError(f"the record at {self.at} is cut off")
            part = self.held[:n]
            del self.held[:n]
            n -= len(part)
            if keep:
                parts.append(bytes(part))
        return b"".join(parts)

    def pass_breaks(self) -> bool:
        """Passes the line breaks between records; false where nothing else comes."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return True
            if not self.more():
                return False

    def size(self) -> int:
        """Compressed bytes, once the end is reached."""
        return self.read - len(self.z.unused_data)


def records(f, size: int, keeps, payload: bool, chunk: int = 4096) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block or None) of the records of a file that keeps(headers) accepts; f: a file with seek and read."""
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(chunk)
        if start[:2] != b"\x1f\x8b":
            at = yield from _plain(f, at, start, keeps, payload)
            continue
        known, full = 0, 0
        if start[3] & 4 and len(start) >= 24 and start[12:14] == b"sl":
            known, full = struct.unpack_from("<II", start, 16)
        data, first = _Inflated(f, at, start), True
        while data.pass_breaks():
            head = data.until(b"\r\n\r\n")
            if head is None:
                raise ValueError(f"the record at {at} is cut off")
            headers = parse(head)
            n, wanted = _length(headers, at), keeps(headers)
            # the skip length holds if this record is all that the member says it has
            alone = first and known and (len(head) + 4 + n + 4) & 0xFFFFFFFF == full
            body = payload and wanted
            block = data.take(n, body) if body or not alone else None
            if wanted:
                yield headers, block if body else None
            if alone and not body:
                at += known
                break
            first = False
        else:  # inflated to the end, where the checksum is
            at += data.size()


def _plain(f, at: int, start: bytes, keeps, payload: bool):
    """A record that isn't compressed; gives where the next one starts."""
    while (end := (start := start.lstrip(b"\r\n")).find(b"\r\n\r\n")) < 0:
        more = f.read(4096)
        if not more:
            if start.strip():
                raise ValueError(f"no record at {at}")
            return f.tell()
        start += more
    head = f.tell() - len(start)
    headers = parse(start[:end])
    n = _length(headers, at)
    if keeps(headers):
        block = None
        if payload:
            f.seek(head + end + 4)
            block = f.read(n)
            if len(block) < n:
                raise ValueError(f"the record at {at} is cut off")
        yield headers, block
    return head + end + 4 + n


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below path. Filters on record_type, target_uri and the other header columns reach the reader.

    For that the session's spark.sql.python.filterPushdown.enabled becomes true; Spark reads it when a plan is made.
    """
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to the shared folder and reads them back: a row per record, from what the archives hold.

    A response's length and digest are those of the payload read; a revisit's come from its headers.
    """
    path = write_warc(pages, scratch(pages.sparkSession, "warc"), id_col, url_col, html_col)
    got = read_warc(pages.sparkSession, path)
    response = F.col("record_type") == "response"
    return got.select(
        F.col("headers")["X-Page-Id"].cast("long").alias(id_col),
        F.when(response, F.octet_length("payload")).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.col("headers")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"),
    )
