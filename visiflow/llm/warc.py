"""WARC archives: write, normalise to one gzip member per record, read back by offset.

``write_monolithic`` writes one gzip stream per file with Spark's text writer.
``normalise`` inflates every file once from start to end, rewrites each record
as a gzip member of its own and writes a sidecar index (offset, length, record
id per line) beside the new file.  ``read_archives`` seeks each member by its
sidecar entry.  Files live in the folder given, which all executors share;
a task writes under a name of its own and then renames, so that a repeated
task leaves the same file.

Defined results: a null html is an empty payload; of rows with equal payloads
of at least ``min_payload`` bytes, those with the largest page_id are
responses and the others revisit it (null ids count as smallest; rows that
repeat the largest id stay responses); line breaks in a url become blanks and
a null url gives no target field; extra columns are ignored; an empty table
gives no records.  A task holds one file's compressed bytes and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow.llm.common import write_table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"
#: Compressed bytes inflated at a time, and payload bytes of one Arrow batch.
PIECE, BATCH_BYTES = 1 << 20, 8 << 20


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: every five hex digits are four characters."""
    hexed = F.sha1(data)
    out = []
    for k in range(8):
        value = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html (never null), digest, size, refers_to (null: a response)."""
    html = F.coalesce("html", F.lit("")).alias("html")
    sized = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html)
             .withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", sha1_base32(F.col("html").cast("binary"))))
    copies = write_table(sized.filter(F.col("size") >= min_payload).groupBy("digest", "size")
                         .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payload-copies")
    same = F.col("page_id").eqNullSafe(F.col("first_id")) | F.col("first_id").isNull()
    return sized.join(copies, ["digest", "size"], "left").withColumn("refers_to", F.when(~same, F.col("first_id"))).drop("first_id")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """One record of the table of ``with_revisits``, without the line break that ends it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    body = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)),
                                 line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        optional("X-Page-ID", F.col("page_id").cast("string")), line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n"))


def write_monolithic(records: DataFrame, folder: str) -> None:
    """One gzip stream per file: every record and its two line breaks, end to end."""
    records.select(record_text().alias("record")).write.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def inflate(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    view, at, z = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        piece = view[at:at + PIECE]
        out = z.decompress(piece)
        at += len(piece) - len(z.unused_data)
        if z.eof:
            z = zlib.decompressobj(31)
        if out:
            yield out


def records_in(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (header, block and the two closing line breaks) of an inflated stream."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record header")
                return
        size = head + 8 + int(fields(bytes(held[:head]))["content-length"])
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record block")
        yield bytes(held[:size])
        del held[:size]


def fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(": ") for x in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite every archive of ``source`` under ``target``; returns the manifest: archive, sidecar, records, bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                name = batch.column("path")[k].as_py().rpartition("/")[2].split(".")[0]
                fs, root = pafs.FileSystem.from_uri(target)
                fs.create_dir(root, recursive=True)
                own, final = f"{root}/_{name}-{uuid.uuid4().hex}", f"{root}/{name}.warc.gz"
                at, index = 0, []
                with fs.open_output_stream(own, compression=None) as out:
                    for record in records_in(inflate(batch.column("content")[k].as_buffer())):
                        member = gzip.compress(record, level, mtime=0)
                        out.write(member)
                        index.append(f"{at}\t{len(member)}\t{fields(record[:record.index(b'\r\n\r\n')])['warc-record-id']}\n")
                        at += len(member)
                with fs.open_output_stream(f"{own}.idx", compression=None) as out:
                    out.write("".join(index).encode())
                fs.move(own, final)
                fs.move(f"{own}.idx", f"{final}.idx")
                yield pa.RecordBatch.from_pylist([{"archive": f"{target}/{name}.warc.gz", "sidecar": f"{target}/{name}.warc.gz.idx", "records": len(index), "bytes": at}])

    return write_table(files.mapInArrow(run, "archive string, sidecar string, records long, bytes long"), "warc-manifest")


def parse(record: bytes, with_payload: bool) -> dict:
    head, _, block = record[:-4].partition(b"\r\n\r\n")
    field = fields(head)
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = field["warc-type"], field["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (found := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
        raise ValueError(f"payload digest {found} differs from the field {digest}")
    number = lambda name: int(field[name]) if name in field else None
    return {"page_id": number("x-page-id"), "url": field.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
            "refers_to": number("x-refers-to-page"), "payload_bytes": len(payload) if kind == "response" else number("x-payload-length"),
            "payload": payload if with_payload else None}


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records, each from its own member; a response's digest is checked against its payload.

    A revisit has no payload here: it is that of the page it refers to.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(archive)
                with fs.open_input_stream(pafs.FileSystem.from_uri(sidecar)[1], compression=None) as f:
                    index = [x.split("\t") for x in f.read().decode().splitlines()]
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for offset, length, _ in index:
                        f.seek(int(offset))
                        record = gzip.decompress(f.read(int(length)))
                        rows.append(parse(record, with_payload))
                        held += len(record) if with_payload else 1000
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())  # one task per archive
    return manifest.repartition(files).mapInArrow(run, RECORD)
