"""WARC archives: monolithic gzip streams, normalised to one member per record with an offset index.

``write_archives`` writes one WARC record per page through Spark's text writer:
the line separator is the blank line that ends a WARC record and the whole part
file is one gzip stream, as carelessly made archives are.

``normalise`` mends such files.  Every file is inflated once, as a stream, in
bounded steps; records are found by their ``Content-Length`` (never by
separators, which payloads may contain), each is compressed again as a gzip
member of its own, and files of about ``archive_bytes`` are written together
with a sidecar index (archive, record number, offset, length and the main headers).
An archive file may end in one NUL byte, which gzip readers take as padding.

``read_records`` reads members back by the index alone.

Rules for ``page_records``: of records with equal payloads of at least
``min_bytes`` bytes, the one with the smallest page id is the response and the
others are revisits of it, without a body; smaller payloads are always
responses.

Defined cases: a null html is an empty payload; control characters in a url
are percent-encoded; a null url is ``urn:none``; rows with equal page id and
payload are the same record twice, both responses if that id is the smallest; a null
page id is the largest, and alone gives responses; an empty table gives an
empty archive set and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

END = "\r\n\r\n"
STEP = 1 << 18                 # bytes inflated at a time
SMALL_ROWS = 200_000           # a table of so few narrow rows (under 20 MB) is broadcast, a larger one is joined by shuffle

INDEX = "archive string, record long, offset long, length long, page_id long, record_type string"


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 100               # payloads below are never revisits
    archive_bytes: int = 8 << 20       # compressed bytes per normalised archive, about
    level: int = 6


def page_records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, record): the WARC record text of every page, without its closing blank line."""
    ensure_checkpoint_dir(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.encode("html", "UTF-8"), 256)})
    first = (base.filter(F.col("bytes") >= params.min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("known"))
             .filter("first < most or (n > known and known > 0)").select("digest", "first")).checkpoint()
    if first.count() <= SMALL_ROWS:                      # the pages then need no shuffle
        first = F.broadcast(first)
    joined = base.join(first, "digest", "left").withColumn("revisit", F.coalesce(
        (F.col("bytes") >= params.min_bytes) & (F.col("first") < F.coalesce("page_id", F.lit((1 << 63) - 1))), F.lit(False)))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    return joined.withColumn("body", body).select("page_id", F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"),
        F.lit(END), F.col("body")).alias("record"))


def write_archives(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Archives under ``path``; each file is one gzip stream over all its records."""
    records = page_records(pages, params)
    (records.select("record").write.option("compression", "gzip").option("lineSep", END).text(path))


def _inflated(data: bytes) -> Iterator[bytes]:
    """The decompressed bytes of one or more gzip members, in bounded steps."""
    at = 0
    while at < len(data):
        if data[at] == 0:                                # padding after a member
            at += 1
            continue
        stream = zlib.decompressobj(wbits=31)
        while not stream.eof:
            piece = data[at:at + STEP]
            at += len(piece)
            if not piece:
                rest = stream.decompress(b"", STEP)
                if not rest and not stream.eof:
                    raise EOFError("gzip stream ends inside a member")
                yield rest
            while piece:
                yield stream.decompress(piece, STEP)
                piece = stream.unconsumed_tail
            at -= len(stream.unused_data)


def split_records(steps: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of a WARC byte stream, by Content-Length."""
    buffer = bytearray()
    steps = iter(steps)

    def more() -> bool:
        for x in steps:
            if x:
                buffer.extend(x)
                return True
        return False
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("WARC stream ends inside a header")
                return
        header = bytes(buffer[:end])
        size = next((int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or not header.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        while len(buffer) < end + 8 + size:
            if not more():
                raise ValueError("WARC stream ends inside a block")
        yield header, bytes(buffer[end + 4:end + 4 + size])
        del buffer[:end + 8 + size]


def _headers(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}


def _page(name: str | None) -> int | None:
    x = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def _normalised(p: WarcParams):
    """Whole archives: one row per new archive with its bytes and the columns of its index."""
    def run(batches):
        for batch in batches:
            for path, cell in zip(batch.column(0), batch.column(1)):
                stem = hashlib.sha256(path.as_py().rsplit("/", 1)[-1].encode()).hexdigest()[:16]
                members, rows, size, number = [], [], 0, 0

                def done():
                    return pa.RecordBatch.from_pylist([{"archive": f"{stem}-{number:05d}", "content": b"".join(members), "index": rows}], schema=_ARCHIVE)
                for header, block in split_records(_inflated(cell.as_py())):
                    pack = zlib.compressobj(p.level, wbits=31)
                    member = pack.compress(header + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
                    head = _headers(header)
                    rows.append({"record": len(rows), "offset": size, "length": len(member),
                                 "page_id": _page(head.get("warc-record-id")), "record_type": head["warc-type"]})
                    members.append(member)
                    size += len(member)
                    if size >= p.archive_bytes:
                        yield done()
                        members, rows, size, number = [], [], 0, number + 1
                if rows:
                    yield done()
    return run


_ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(pa.struct([
    ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])))])


def normalise(spark: SparkSession, source: str, target: str, params: WarcParams = WarcParams()) -> None:
    """Rewrite the archives under ``source``: ``target/archive=NAME/...`` files and ``target-index`` (Parquet)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source).select("path", "content")
    made = files.mapInArrow(_normalised(params), "archive string, content binary, index array<struct<record: long, offset: long, length: long, "
                            "page_id: long, record_type: string>>").checkpoint()
    # a string column may hold any bytes; the NUL after an archive is gzip padding
    (made.select(F.col("content").cast("string").alias("value"), "archive")
     .write.option("lineSep", "\0").partitionBy("archive").text(target))
    made.select("archive", F.explode("index").alias("x")).select("archive", "x.*").write.parquet(f"{target}-index")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches):
    for batch in batches:
        out = []
        for cell, index in zip(batch.column("content"), batch.column("index")):
            data = memoryview(cell.as_py())
            for x in index.as_py():
                record = zlib.decompress(data[x["offset"]:x["offset"] + x["length"]], wbits=31)
                (header, block), = split_records(iter([record]))
                head = _headers(header)
                http, payload = block.split(b"\r\n\r\n", 1)
                full = int(next(v for k, v in (h.split(b":", 1) for h in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"))
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {head['warc-record-id']}: payload differs from its header")
                out.append({"page_id": _page(head["warc-record-id"]), "payload_bytes": full, "payload_digest": digest,
                            "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to"))})
        yield pa.RecordBatch.from_pylist(out, schema=_READ)


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Every record of the normalised archives, each inflated alone at its place in the index; payloads are verified."""
    records = spark.read.parquet(f"{target}-index")
    index = records.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("index"))       # bounded by archive_bytes
    if records.count() <= SMALL_ROWS:
        index = F.broadcast(index)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(target)
             .select(F.regexp_extract("path", "archive=([^/]+)/", 1).alias("archive"), "content"))
    return files.join(index, "archive").select("content", "index").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write, normalise and read back the pages' archives in a new folder under ``spark.checkpoint.dir``."""
    spark = pages.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{base}/raw", params)
    normalise(spark, f"{base}/raw", f"{base}/warc", params)
    return read_records(spark, f"{base}/warc")
