"""WARC archives: written as whole-file gzip, normalised to a gzip member a record, and read through a sidecar offset index.

1. `write_monolithic`: Spark's text writer makes one gzip stream a file (a record is text, and CRLF CRLF ends it). Of records
   with equal payloads the one with the largest id is the response, the others revisit it.
2. `normalise`: a file is read as a stream and inflated once, piece by piece, so that its size bounds no memory: a task holds one
   record and one piece. Every record is written again as a gzip member of its own, and its offset and length go to the index
   in bounded batches. A file that ends within a stream or a record is an error. Archives get a new name each attempt and count only once the index (a Parquet
   table that Spark commits) names them, so lost executors and second attempts do no harm.
3. `read_records`: reads the byte ranges that the index names, any of them alone, and hands payloads on in steps of some MB.

Nulls count as empty payloads and as absent URLs. Equal payloads of at least `least` bytes are revisits of one another, empty ones
too if least is 0. Rows that share the largest id are responses each; of a group without ids all are responses. Repeated rows
get a record each. An empty table gives an empty index. Columns other than the three used aren't stored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import STEP_BYTES, new_path

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
#: Index rows that a task hands on at once.
_INDEX_ROWS = 10_000
_INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string"


def base32_of(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits, a column of its own (it is read 32 times): 5 hex digits are 4 letters."""
    def letters(k):
        v = F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(7)), letters))


def records(pages: DataFrame, key: str, url: str, html: str, least: int, date: str) -> DataFrame:
    """A column `record`: the whole record but for the end that the writer adds."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body")).select(
        "*", F.octet_length("body").cast("long").alias("n"), F.sha1(F.col("body").cast("binary")).alias("digest"))
    same = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("id").alias("last"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(same, ["digest", "n"], "left")
    again = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    size = F.when(again, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", clean)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of(F.col("digest")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("last")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("record"))


def write_monolithic(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
                     date: str = "1970-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    (records(pages, key, url, html, least, date).write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path))


def inflated(stream, piece: int = 1 << 20):
    """The bytes of a gzip stream (members one after the other are one stream), in pieces of at most `piece` bytes; stream has read(n)."""
    left = b""
    while left := left.lstrip(b"\0") or stream.read(piece):  # zeros may pad a file
        if not left.strip(b"\0"):
            left = b""
            continue
        machine = zlib.decompressobj(31)
        left = left.lstrip(b"\0")
        while not machine.eof:
            made = machine.decompress(left, piece)
            left = machine.unconsumed_tail
            if made:
                yield made
            elif not left and not machine.eof and not (left := stream.read(piece)):
                raise ValueError("a gzip stream without an end")
        left = machine.unused_data


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    out = {}
    for x in head.split(b"\r\n")[1:]:
        name, _, value = x.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def split_records(pieces):
    """(header fields, bytes of the whole record) of a stream of pieces; holds one record and one piece."""
    buffer, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        try:
            buffer.extend(next(pieces))
            return True
        except StopIteration:
            return False

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a record without an end")
                return
        head = fields(bytes(buffer[:cut]))
        end = cut + 4 + int(head["content-length"]) + 4
        while len(buffer) < end:
            if not more():
                raise ValueError("a record shorter than its Content-Length")
        yield head, bytes(buffer[:end])
        del buffer[:end]


def normalise(spark: SparkSession, source: str, path: str, level: int = 6) -> None:
    """From the monolithic files below source: archives/ with a gzip member a record, and index/ below path."""
    archives = f"{path}/archives"

    def run(batches):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(archives)
        system.create_dir(base, recursive=True)

        def index(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _arrow())], [f.split()[0] for f in _INDEX.split(", ")])

        for b in batches:
            for place in b.column(0).to_pylist():
                name, rows, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
                origin, there = fs.FileSystem.from_uri(quote(place, safe="/:@"))  # Spark names files unescaped
                with origin.open_input_stream(there, compression=None) as whole, system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for head, record in split_records(inflated(whole)):
                        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = machine.compress(record) + machine.flush()
                        out.write(member)
                        rows.append((f"{archives}/{name}", at, len(member), head.get("warc-record-id"), head.get("warc-type")))
                        at += len(member)
                        if len(rows) == _INDEX_ROWS:
                            yield index(rows)
                            rows = []
                if rows:
                    yield index(rows)

    # the paths alone: no file is held whole as a row
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    files.mapInArrow(run, _INDEX).write.parquet(f"{path}/index")


def _arrow() -> list[pa.DataType]:
    return [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def read_records(index: DataFrame) -> DataFrame:
    """The index's rows with what their records say: page, payload_bytes, payload_digest, refers_to, and the payload (null for revisits).

    A response's bytes and digest are measured on its payload; a revisit has those of its headers.
    """
    def run(batches):
        from pyarrow import fs

        def found(rows):
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        opened = None, None
        for b in batches:
            rows, held = [], 0
            for archive, offset, length, _, _ in zip(*(c.to_pylist() for c in b.columns)):
                if archive != opened[0]:
                    system, place = fs.FileSystem.from_uri(archive)
                    opened = archive, system.open_input_file(place)
                member = opened[1].read_at(length, offset)
                (head, record), = split_records(inflated(io.BytesIO(member)))
                block = record.split(b"\r\n\r\n", 1)[1][:-4]
                http, _, payload = block.partition(b"\r\n\r\n")
                response = head["warc-type"] == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else head["warc-payload-digest"].removeprefix("sha1:")
                rows.append((_page(head["warc-record-id"]), len(payload) if response else int(fields(http)["content-length"]), digest, head["warc-type"],
                             _page(head.get("warc-refers-to")), payload if response else None))
                held += len(payload)
                if held > STEP_BYTES:
                    yield found(rows)
                    rows, held = [], 0
            if rows:
                yield found(rows)

    return index.select("archive", "offset", "length", "record_id", "record_type").mapInArrow(
        run, "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def _page(urn: str | None) -> str | None:
    name = urn and urn.strip("<>").removeprefix("urn:page:")
    return None if name in (None, "null") else name


def archive(pages: DataFrame, **options) -> DataFrame:
    """pages written, normalised and indexed in a new folder of the shared folder; the index."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_monolithic(pages, f"{path}/whole", **options)
    normalise(spark, f"{path}/whole", path)
    return spark.read.schema(_INDEX).parquet(f"{path}/index")
