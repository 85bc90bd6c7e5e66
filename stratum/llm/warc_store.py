"""A content-addressed archive of WARC records, and WARC files written from it and read back.

Payload bytes are stored once, compressed, under their SHA-256 (``payloads``); exact record headers
are a table of their own (``headers``). Original records are rebuilt by a join on the digest and
written as .warc.gz files of one gzip member a record. Of records with equal payloads the one with
the largest page_id is the response and the others revisit it; only responses have a payload in the
files, so no digest of the rebuilding join is hot.

Equality is checked, not assumed: records that share a SHA-256 must share length and SHA-1 when
written, every stored payload is hashed again when it is put into a record, and a record read from a
file must have the payload that its header declares; a mismatch raises.

Spark's text writer ends every row with a fixed separator. Here that is the zero byte in which a
gzip member ends, taken off the row before: a member ends with its length in four bytes, the highest
last, and where that is not zero (from 16 MB on) an empty member follows. So files hold members and
nothing else. A file has at most ``FILE_RECORDS`` records and is read by one task.

Defined results: a null html is an empty payload; a null url is an empty target, and line ends in a
url are written as %0D and %0A; a null page_id sorts below all others and its identifier is empty; a
repeated row (same page_id and payload) is written again with the same type; an empty table makes an
empty archive and no records; other columns are not archived."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.shared import drop, materialize, new_path, release, small_batches

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
FILE_RECORDS = 4096
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def base32(sha1_hex: Column) -> Column:
    """The 32 upper-case base32 digits of the 160 bits written as 40 hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def identifier(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _agree(what: str, name: str) -> Column:
    return F.when(F.min(what) == F.max(what), F.max(what)).otherwise(F.raise_error(F.lit(f"payloads with one SHA-256 differ in {name}")))


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zipped = [zlib.compress(x.as_py().encode(), 6) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(zipped, pa.binary())], ["key", "digest", "zipped"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``headers`` and ``payloads`` under ``path``. Payloads under ``min_bytes`` are never revisited."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.sha2(html, 256).alias("digest"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"),
    )
    first = rows.groupBy("digest").agg(F.max("page_id").alias("owner"), _agree("sha1", "SHA-1").alias("sha1"), _agree("bytes", "length").alias("bytes"))
    first = materialize(first, "owners")  # a table, so a hot digest's partition of the join below can be split
    is_response = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("bytes") < min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        line("WARC-Record-ID", identifier(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(is_response, F.lit("")).otherwise(F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", identifier(F.col("owner"))),
        )),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(F.col("http")) + F.when(is_response, F.col("bytes")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
    )
    headers = rows.select("page_id", "url", "digest").join(first, "digest").withColumn("http", http)
    headers.select("page_id", "digest", is_response.alias("response"), head.alias("header"), "http").write.parquet(f"{path}/headers")
    payloads = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("key"), F.sha2(html, 256).alias("digest"), html.alias("html"))
    payloads = payloads.mapInArrow(_deflate, "key long, digest string, zipped binary")
    # joined by page and digest: copies of one payload spread over all tasks
    owners = first.select(F.coalesce("owner", F.lit(-1)).alias("key"), "digest")
    payloads.join(owners, ["key", "digest"]).dropDuplicates(["key", "digest"]).select("digest", "zipped").write.option("compression", "none").parquet(f"{path}/payloads")
    drop(first)


def rebuild(header: str, http: str, response: bool, digest: str, zipped: bytes | None) -> bytes:
    """The original bytes of a record."""
    payload = b""
    if response:
        payload = zlib.decompress(zipped) if zipped is not None else None
        if payload is None or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"a payload does not have the digest {digest}")
    return header.encode() + http.encode() + payload + END.encode()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array([rebuild(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows)], pa.binary())], ["record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records of an archive, as bytes, rebuilt by joining headers with payloads."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    # revisits have no payload to fetch: they are spread by page and meet none
    key = F.when(F.col("response"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")))
    joined = headers.withColumn("key", key).join(payloads.withColumnRenamed("digest", "key"), "key", "left")
    return joined.select("header", "http", "response", "digest", "zipped").mapInArrow(_records, "record binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(0):
            member = gzip.compress(x.as_py(), 6, mtime=0)
            out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def export_warc(spark: SparkSession, path: str, out: str, file_records: int = FILE_RECORDS) -> None:
    """Write the records of an archive as gzip-compressed WARC files, one member each."""
    members = records(spark, path).mapInArrow(_members, "member binary")
    # Spark's string is bytes too, and its text writer writes them as they are
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(out)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members in ``data``, without those that are empty."""
    view, at = memoryview(data), 0
    while at < len(data):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a file ends within a record")
            parts.append(one.decompress(view[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(one.unused_data)
        if any(parts):
            yield b"".join(parts)


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Header and block of each record of a .warc.gz file."""
    for record in members(data):
        end = record.index(END.encode()) + 4
        header = record[:end].decode("utf-8")
        size = int(re.search(r"(?mi)^Content-Length: *(\d+)\r$", header)[1])
        if record[end + size :] != END.encode():
            raise ValueError("a record does not have the length that its header declares")
        yield header, record[end : end + size]


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: header, http (the header of the block) and payload, the payload of a
    response checked against its header's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for header, block in parse_warc(data.as_py()):
                    http, _, payload = block.partition(END.encode())
                    want = re.search(r"(?m)^WARC-Payload-Digest: sha1:([A-Z2-7]{32})\r$", header)[1]
                    if "\r\nWARC-Type: response\r\n" in header and base64.b32encode(hashlib.sha1(payload).digest()).decode() != want:
                        raise ValueError("a header's digest is not its payload's")
                    held.append((header, http.decode() + END, payload))
                    size += len(block)
                    if size > 1 << 22:
                        yield _rows(held)
                        held, size = [], 0
                yield _rows(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, http string, payload binary")


def _rows(held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    kinds = (("header", pa.string()), ("http", pa.string()), ("payload", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def field(name: str) -> Column:
    """A field of a record's header; null where it is absent."""
    return F.nullif(F.regexp_extract("header", rf"(?dm)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def described(imported: DataFrame) -> DataFrame:
    """What the records of ``import_warc`` say. A revisit gets the length of the payload of the response
    that it refers to, which must be the one it declares."""
    page = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    rows = materialize(imported.select(
        page("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"),
    ), "records")
    responses = rows.where("record_type = 'response'")
    found = responses.select("page_id", F.col("payload_digest").alias("found"), F.col("bytes").alias("found_bytes"))
    found = materialize(found.dropDuplicates(["page_id", "found"]), "responses")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    r, f = rows.where("record_type <> 'response'").alias("r"), found.alias("f")
    revisits = r.join(f, F.expr("r.refers_to = f.page_id and r.payload_digest = f.found"), "left")
    length = F.when(F.col("f.found").isNotNull(), F.col("f.found_bytes")).otherwise(F.raise_error(F.lit("a revisit's response is not in the archive")))
    revisits = revisits.select("r.page_id", length.cast("long").alias("payload_bytes"), "r.payload_digest", "r.record_type", "r.refers_to", "r.url")
    return responses.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url").select(names).union(revisits.select(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, write the archive's records as WARC files, and describe them as read from there."""
    spark = pages.sparkSession
    path, files = new_path(spark, "warc"), new_path(spark, "warc-files")
    write_archive(pages, path)
    release(spark)
    export_warc(spark, path, files)
    release(spark)
    return described(import_warc(spark, files))
