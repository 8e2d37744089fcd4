"""WARC archives as a Spark data source ("warc") and the writing of pages with revisit records for equal payloads.

Each record is a gzip member whose header has an extra field "SL" with the member's compressed length. The reader plans
partitions of files, takes record-type and header predicates, inflates a member's start for its headers, and skips
the rest of members that the predicates or the asked-for columns don't need. A file without such fields is read
through. The writer begins a new archive after maxFileBytes, so no file, which one task reads, grows with its partition. Files appear under their final names on commit only, so lost executors and second attempts leave no records.
Null html is an empty payload; rows with a null page_id have no such header and are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, len(body) + 28) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, level: int = 1) -> bytes:
    kind, payload = row["record_type"], row["payload"] or b""
    body = HTTP + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join((row["target_uri"] or "").splitlines()))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", row["payload_bytes"]), ("Content-Type", "application/http; msgtype=response")]
    head += [("X-Page-ID", row["page_id"])] * (row["page_id"] is not None)
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", row["refers_to"])]
    head.append(("Content-Length", len(body)))
    return member(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n", level)


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.uri, self.level, self.most = options["path"], int(options.get("level", 1)), int(options.get("maxfilebytes", options.get("maxFileBytes", 1 << 28)))

    def write(self, rows) -> Written:
        import os

        fs, base = store(self.uri)
        names, out, size = [], None, 0
        for row in rows:
            if out is None:
                names.append(f"{os.urandom(12).hex()}.warc.gz")
                fs.create_dir(base, recursive=True)
                out, size = fs.open_output_stream(f"{base}/_{names[-1]}", compression=None), 0
            data = record(row.asDict(), self.level)
            out.write(data)
            size += len(data)
            if size >= self.most:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, base = store(self.uri)
        fs.create_dir(base, recursive=True)
        for name in [n for m in messages if m for n in m.names]:
            fs.move(f"{base}/_{name}", f"{base}/{name}")

    def abort(self, messages) -> None:
        fs, base = store(self.uri)
        for name in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{base}/_{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.uri, self.most, self.wanted, self.filters = options["path"], int(options.get("maxPartitionBytes", 16 << 20)), schema.fieldNames(), []

    def pushFilters(self, filters):
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in HEADERS
            if known and isinstance(f, EqualTo):
                self.filters.append((HEADERS[f.attribute[0]], {str(f.value)}, False))
            elif known and isinstance(f, In):
                self.filters.append((HEADERS[f.attribute[0]], {str(v) for v in f.value if v is not None}, False))
            elif known and isinstance(f, StringStartsWith):
                self.filters.append((HEADERS[f.attribute[0]], f.value, True))
            elif known and isinstance(f, IsNotNull):
                self.filters.append((HEADERS[f.attribute[0]], "", True))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = store(self.uri)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        parts, held = [[]], 0
        for f in sorted((f for f in found if f.is_file and f.base_name.endswith((".warc.gz", ".warc")) and f.base_name[0] not in "_."), key=lambda f: f.path):
            if parts[-1] and held + f.size > self.most:
                parts.append([])
                held = 0
            parts[-1].append(f.path)
            held += f.size
        return [Files(p) for p in parts]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.uri)
        rows: dict[str, list] = {c: [] for c in self.wanted}
        kinds = {c: {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string()) for c, k in (x.split() for x in SCHEMA.split(", "))}
        size, n = 0, 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as src:
                for head, body in members(src, plain=path.endswith(".warc")):
                    if any(k not in head or (not head[k].startswith(v) if prefix else head[k] not in v) for k, v, prefix in self.filters):
                        continue
                    got = self.row(head, body)
                    for c in self.wanted:
                        rows[c].append(got.get(c))
                    n, size = n + 1, size + len(got.get("payload") or b"")
                    if n >= 2000 or size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in self.wanted], names=self.wanted)
                        rows, size, n = {c: [] for c in self.wanted}, 0, 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in self.wanted], names=self.wanted)

    def row(self, head: dict, body) -> dict:
        out: dict = {c: head.get(h) for c, h in HEADERS.items() if c in self.wanted}
        for c in ("page_id", "refers_to"):
            if out.get(c) is not None:
                out[c] = int(out[c])
        if head.get("warc-type") == "response" and {"payload", "payload_bytes", "payload_digest"} & set(self.wanted):
            whole = body()[: int(head["content-length"])]
            payload = whole.partition(b"\r\n\r\n")[2]
            return out | {"payload": payload if "payload" in self.wanted else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if d := head.get("warc-payload-digest"):
            out["payload_digest"] = base64.b32decode(d.removeprefix("sha1:")).hex()
        return out | {"payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None}


def headers(text: bytes) -> dict[str, str]:
    lines = text.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def members(src, plain: bool) -> Iterator[tuple[dict[str, str], object]]:
    """Headers of each record, and a function that gives its block; blocks that nobody asks for aren't inflated where the length field allows it."""
    if plain:
        left = b""
        while True:
            while b"\r\n\r\n" not in left and (more := src.read(1 << 16)):
                left += more
            if not left.strip():
                return
            head, _, left = left.lstrip().partition(b"\r\n\r\n")
            got = headers(head + b"\r\n\r\n")
            n = int(got["content-length"])
            while len(left) < n and (more := src.read(1 << 20)):
                left += more
            block, left = left[:n], left[n:]
            yield got, lambda block=block: block
    held = b""
    while True:
        if len(held) < 24:
            held += src.read(1 << 16)
        if not held:
            return
        if held[3] & 4 and held[12:14] == b"SL":
            length = struct.unpack("<I", held[16:20])[0]
            while len(held) < length and (more := src.read(max(1 << 16, length - len(held)))):
                held += more
            one, held = held[:length], held[length:]
            z = zlib.decompressobj(31)
            start = z.decompress(one, 4096)
            while b"\r\n\r\n" not in start:
                start += z.decompress(z.unconsumed_tail, 4096)
            yield headers(start), lambda z=z, start=start: (start + z.decompress(z.unconsumed_tail)).partition(b"\r\n\r\n")[2]
        else:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                parts.append(z.decompress(held))
                held = b"" if not z.eof else held
                if not z.eof and not (held := src.read(1 << 16)):
                    break
            held = z.unused_data
            whole = b"".join(parts)
            yield headers(whole), lambda whole=whole: whole.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Rows to write: of equal payloads of at least least bytes, that with the largest page_id (every row that has it) is
    response and others revisit it. Grouping is by digest and length; a frequent payload's rows are dealt out by the
    adaptive join, and what groups send is one row for each task."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    out = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    return out.select(
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.regexp_replace(F.md5(F.concat_ws("/", "page_id", "payload_digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("record_id"),
        "target_uri", "page_id", F.when(later, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest",
        F.when(~later, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_dir(spark, "warc")
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").load(path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
