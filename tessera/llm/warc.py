"""WARC archives: a writer, and a Python data source that plans, pushes down and skips.

A record is a gzip member of its own.  Its header carries the "sl" extra field of the WARC standard's annex on
compression (compressed and uncompressed length), so that a reader can step over a member it has no use for.
The reader inflates a member's first KB or so, parses the record's headers, applies the pushed predicates, and
inflates the payload only of a record that passes, and only if payloads are asked for.  Members
without the field are inflated to find their end, but not kept.

Payloads that are equal and of at least ``least`` bytes are stored once: the record of the smallest page_id is a
response, the others are revisits that refer to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .support import BROADCAST_ROWS, materialize, sized

#: Equal payloads of fewer bytes are all stored.
LEAST = 100
#: WARC-Date of what is written; a parameter, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of a file that are read at once.
CHUNK = 1 << 20

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, content_type string, page_id long, refers_to_page long, payload binary"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns whose equality predicates are decided on the headers.
_PUSHED = {"record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "content_type", "page_id", "refers_to_page"}


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member with the "sl" extra field: compressed and uncompressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff"
    total = len(head) + 2 + 4 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(kind: str, fields: list[tuple[str, str]], content: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(content)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def _one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _written(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    store, root = fs.FileSystem.from_uri(folder)
    out, n, size = None, 0, 0
    for batch in batches:
        if out is None and batch.num_rows:
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(member(record("warcinfo", [("WARC-Record-ID", f"<urn:tessera:file:{task.partitionId()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tessera\r\nformat: WARC File Format 1.1\r\n")))
        html = batch.column(2).fill_null("").cast(pa.large_binary())
        for i, (page, url, payload, length, digest, refers) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            fields = [("WARC-Record-ID", f"<urn:tessera:page:{'' if page is None else page}:{task.partitionId()}:{n + i}>"), ("WARC-Date", date), ("Content-Type", "text/html; charset=utf-8")]
            fields += [("WARC-Target-URI", _one_line(url))] if url is not None else []
            fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length))]
            fields += [("WARC-Page-ID", str(page))] if page is not None else []
            if refers is None:
                raw = record("response", fields, payload.as_py())
            else:
                raw = record("revisit", [*fields, ("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:tessera:page:{refers}>"), ("WARC-Refers-To-Page-ID", str(refers))], b"")
            packed = member(raw)
            size += len(packed)
            out.write(packed)
        n += batch.num_rows
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def plan_records(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, length, digest, refers_to): what record each page gets; refers_to is null for a response.

    Null html is an empty payload.  Pages that share the smallest page_id of their payload are all responses; a null
    page_id is never the smallest, and payloads of null ids alone are all responses.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("length", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html"), 256))
    same = pages.where(F.col("length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    classes = sized(materialize(same.select("digest", "first"), "payloads"), BROADCAST_ROWS // 2)
    # only ids meet on a digest, which one payload may share with a third of all pages; payloads are joined by page, if at all
    revisits = pages.select("page_id", "digest").join(classes, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = sized(materialize(revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first").distinct(), "revisits"), BROADCAST_ROWS // 2)
    joined = pages.join(revisits, pages["page_id"].eqNullSafe(revisits["_page"]) & (pages["digest"] == revisits["_digest"]), "left")
    return joined.select("page_id", "url", "html", "length", "digest", F.col("first").alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, *, least: int = LEAST, date: str = DATE) -> list[str]:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``, a URI all executors reach.

    A file for each task; returns the names of those whose tasks ended well, which are what an archive is made of.
    No pages make no files.
    """
    rows = plan_records(pages, least=least).mapInArrow(lambda it: _written(it, folder, date), "file string, records long, bytes long").collect()
    return sorted(r["file"] for r in rows)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else old & values
            else:
                yield f

    def partitions(self):
        """A partition for each file: those named by the option ``files``, else all archives below ``path``."""
        store, root = fs.FileSystem.from_uri(self.options["path"])
        named = self.options.get("files")
        if named is not None:
            return [_File(f"{root}/{x}") for x in named.split(",") if x] or [_File("")]
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return [_File(x.path) for x in found if x.path.endswith((".warc.gz", ".warc"))] or [_File("")]

    def read(self, partition):
        if not partition.value:
            return
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        payloads = self.options.get("payload", "true").lower() == "true"
        rows, size = [], 0
        with store.open_input_file(partition.value) as f:
            for row in _records(f, self.wanted, payloads, partition.value.endswith(".gz")):
                rows.append(row)
                size += len(row[-1] or b"")
                if size > 4 << 20 or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_length", "page_id", "refers_to_page") else pa.string()) for n in _COLUMNS])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def parse_headers(head: bytes) -> dict[str, str]:
    """Named fields of a record, names in lower case; folded lines are joined; what isn't a field is passed over."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def _row(fields: dict[str, str]) -> dict[str, object]:
    digest = fields.get("warc-payload-digest")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "payload_digest": digest.rpartition(":")[2] if digest else None, "payload_length": _number(fields.get("warc-payload-length")), "refers_to": fields.get("warc-refers-to"),
        "content_type": fields.get("content-type"), "page_id": _number(fields.get("warc-page-id")), "refers_to_page": _number(fields.get("warc-refers-to-page-id")),
    }


class _Window:
    """A file's bytes from a moving place on."""

    def __init__(self, f) -> None:
        self.f, self.at, self.data = f, 0, b""

    def need(self, n: int) -> bytes:
        """At least ``n`` bytes from here, if the file has them."""
        while len(self.data) < n:
            more = self.f.read(max(CHUNK, n - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data

    def skip(self, n: int) -> None:
        if n <= len(self.data):
            self.data = self.data[n:]
        else:
            self.f.seek(self.f.tell() + n - len(self.data))
            self.data = b""


def _skip_length(head: bytes) -> int | None:
    """A member's compressed length by its "sl" field, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + size
    return None


def _records(f, wanted: dict[str, set], payloads: bool, packed: bool) -> Iterator[tuple]:
    """Rows of an archive that pass; the payload of a revisit, or one not asked for, is null."""
    window = _Window(f)
    while window.need(18):
        length = None
        z = zlib.decompressobj(31) if packed else None
        if packed:
            length = _skip_length(window.data)
            data = window.need(length) if length else window.need(CHUNK)
            source = data[:length] if length else data
            head = z.decompress(source, 2048)
            while b"\r\n\r\n" not in head and z.unconsumed_tail:
                head += z.decompress(z.unconsumed_tail, 2048)
        else:
            head = window.need(2048)
            while b"\r\n\r\n" not in head and len(more := window.need(len(head) + CHUNK)) > len(head):
                head = more
        cut = head.find(b"\r\n\r\n")
        if cut < 0:
            return
        fields = parse_headers(head[:cut])
        row = _row(fields)
        size = _number(fields.get("content-length")) or 0
        passes = all(row[k] in v for k, v in wanted.items())
        keep = passes and payloads and row["record_type"] != "revisit"
        if not packed:
            body = window.need(cut + 4 + size)[cut + 4 : cut + 4 + size] if keep else None
            window.skip(cut + 4 + size + 4)
        elif length:
            body = (head[cut + 4 :] + z.decompress(z.unconsumed_tail))[:size] if keep else None
            window.skip(length)
        else:
            parts, have = [head[cut + 4 :]], len(data)
            while not z.eof:
                source = z.unconsumed_tail
                if not source:
                    more = window.need(have + CHUNK)
                    source, have = more[have:], len(more)
                    if not source:
                        return
                piece = z.decompress(source, CHUNK)
                if keep:
                    parts.append(piece)
            body = b"".join(parts)[:size] if keep else None
            window.skip(have - len(z.unused_data))
        if passes:
            yield (*(row[c] for c in _COLUMNS[:-1]), body)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder): a row for each record.

    Options: ``files``, a comma-joined list of names below the folder, leaves all other files out; ``payload`` = false
    leaves payloads null.  Equality and IN predicates on header columns are decided before a payload is inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, folder: str, *, files: list[str] | None = None, payload: bool = True) -> DataFrame:
    """The records of the archives below ``folder``, or of the named ones."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return (reader if files is None else reader.option("files", ",".join(files))).load(folder)


def archived(spark: SparkSession, folder: str, files: list[str] | None = None) -> DataFrame:
    """Per page of an archive, from its records: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A response's figures are those of the payload that was read; a revisit's are its headers'.
    """
    rows = read_warc(spark, folder, files=files).where(F.col("record_type").isin("response", "revisit"))
    stored = F.col("payload").isNotNull()
    return rows.select(
        "page_id",
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
    )


