import base64
import glob
import gzip
import hashlib
import zlib

import pyarrow as pa
import pytest

from stratum.llm import warc_store
from stratum.llm.shared import new_path

ROWS = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, "http://a/9", "<p>é</p>"), (3, None, None), (4, "http://b/", ""),
    (5, "x", "y" * 100_000), (6, "http://c/", "WARC/1.1\r\n\r\nbody"), (6, "http://c/", "WARC/1.1\r\n\r\nbody"), (None, "u", "lonely"), (None, "u", "<p>é</p>"),
]


def archive(spark, rows):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    warc_store.write_archive(pages, path)
    return path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def read_back(spark, path, **options):
    out = new_path(spark, "files")
    warc_store.export_warc(spark, path, out, **options)
    return out, warc_store.import_warc(spark, out)


def test_records(spark):
    path = archive(spark, ROWS)
    got = sorted((tuple(r)[:5] for r in warc_store.described(read_back(spark, path)[1]).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        owner = max((p for p, _, h in ROWS if (h or "") == (html or "")), key=lambda p: -1 if p is None else p)
        want.append((page, len((html or "").encode()), digest(html), "response" if page == owner else "revisit", None if page == owner else owner))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in ROWS})
    assert sorted(map(str, got)) == sorted(str(tuple(r)[:5]) for r in warc_store.round_trip(spark.createDataFrame(ROWS, "page_id long, url string, html string")).collect())


def test_files_hold_the_rebuilt_records_as_gzip_members(spark):
    """Members that other tools read, byte for byte the records that headers and payloads give."""
    path = archive(spark, ROWS)
    out, imported = read_back(spark, path, file_records=3)
    files = glob.glob(f"{out.removeprefix('file://')}/part-*")
    assert len(files) >= 4
    whole = b"".join(gzip.open(f).read() for f in files)
    want = [bytes(r[0]) for r in warc_store.records(spark, path).collect()]
    assert sorted(map(bytes, want)) == sorted(h.encode() + b for f in files for h, b in ((h, b + b"\r\n\r\n") for h, b in warc_store.parse_warc(open(f, "rb").read())))
    assert len(whole) == sum(map(len, want))
    rows = imported.collect()
    payloads = lambda kind: sorted(bytes(r.payload) for r in rows if f"WARC-Type: {kind}" in r.header)
    assert payloads("response") == sorted((h or "").encode() for h in ["<p>é</p>", "", "y" * 100_000, ROWS[6][2], ROWS[6][2], "lonely"])
    assert payloads("revisit") == [b""] * 4
    assert "WARC-Target-URI: a%0D%0Ab\r\n" in next(r.header for r in read_back(spark, archive(spark, [(1, "a\r\nb", "x")]))[1].collect())


def test_members_of_16_mb_and_more():
    """The last byte of a member is its length's highest; members for which it is not zero are followed by an empty one."""
    for size in (10, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        row = next(warc_store._members(iter([pa.record_batch([pa.array([b"x" * size])], ["record"])])))["member"][0].as_py() + b"\0"
        assert gzip.decompress(row + row) == b"x" * (2 * size)


def test_a_damaged_payload_is_found(spark):
    path = archive(spark, ROWS)
    bad = spark.createDataFrame([(r.digest, zlib.compress(b"other")) for r in spark.read.parquet(f"{path}/payloads").collect()], "digest string, zipped binary")
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="does not have the digest"):
        warc_store.records(spark, f"{path}-bad").collect()


def test_a_damaged_file_is_found(spark, tmp_path):
    record = next(bytes(r[0]) for r in warc_store.records(spark, archive(spark, ROWS)).collect() if b"lonely" in r[0])
    (tmp_path / "good.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    assert warc_store.import_warc(spark, f"file://{tmp_path}").count() == 2
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(record.replace(b"lonely", b"lovely")))
    with pytest.raises(Exception, match="digest is not its payload"):
        warc_store.import_warc(spark, f"file://{tmp_path}").collect()
    for wrong, why in ((gzip.compress(record)[:-9], "ends within"), (gzip.compress(record[:-5]), "the length")):
        with pytest.raises(ValueError, match=why):
            list(warc_store.parse_warc(wrong))


def test_small_payloads_are_not_revisited(spark):
    path = new_path(spark, "warc")
    warc_store.write_archive(spark.createDataFrame(ROWS[:3], "page_id long, url string, html string"), path, min_bytes=100)
    assert {r.record_type for r in warc_store.described(read_back(spark, path)[1]).collect()} == {"response"}


def test_empty_table(spark):
    assert warc_store.described(read_back(spark, archive(spark, []))[1]).count() == 0
