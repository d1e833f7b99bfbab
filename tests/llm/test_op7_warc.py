import gzip
import hashlib
import zlib

import pytest

from postsignal.llm.op7_warc import END, WarcParams, _inflated, normalise, read_records, round_trip, split_records, write_archives

BIG = "<p>" + "x" * 200 + "</p>"
ROWS = [(3, "http://a", BIG, 1), (1, "http://b\r\nX: y", BIG, 1), (2, None, None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1),
        (7, "u", "é" * 60 + END + "WARC/1.1" + END, 1), (8, "u", "é" * 49 + "a", 1), (9, "u", "é" * 49 + "a", 1), (10, "u", "é" * 50, 1), (11, "u", "é" * 50, 1),
        (None, "u", BIG, 1), (1, "http://b", BIG, 1), (12, "u", "y" * 3_000_000, 1)]
SCHEMA = "page_id long, url string, html string, digest int"


def _want(rows):
    out, first = [], {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h in first and (i is None or i > first[h])
        out.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else -1))
    return sorted(out)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for p in (WarcParams(), WarcParams(archive_bytes=400)):
        got = round_trip(pages, p).collect()
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                       -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == _want(ROWS)
    assert round_trip(pages.limit(0)).count() == 0


def test_files_are_gzip_and_members_stand_alone(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "warc")
    write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), raw)
    files = list((tmp_path / "raw").glob("part-*"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert len(list(split_records(iter([whole])))) == len(ROWS)
    normalise(spark, raw, out, WarcParams(archive_bytes=2000))
    texts = b""
    index = spark.read.parquet(out + "-index").collect()
    for f in sorted((tmp_path / "warc").glob("archive=*/part-*")):
        data = f.read_bytes()
        texts += gzip.decompress(data)                         # the NUL at the end is padding to gzip
        mine = sorted((r["offset"], r["length"]) for r in index if r["archive"] == f.parent.name.split("=")[1])
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(mine[-1]) == len(data) - 1
        for a, n in mine:
            assert zlib.decompress(data[a:a + n], wbits=31).startswith(b"WARC/1.1\r\n")
    assert sorted(split_records(iter([texts]))) == sorted(split_records(iter([whole])))
    assert read_records(spark, out).count() == len(ROWS) == len(index)


def test_stream_reader_is_stepwise_and_strict():
    record = b"WARC/1.1\r\nContent-Length: 4\r\n\r\na\r\n\r\r\n\r\n"
    assert list(split_records(iter([bytes([c]) for c in record * 3]))) == [(b"WARC/1.1\r\nContent-Length: 4", b"a\r\n\r")] * 3
    data = gzip.compress(record) + gzip.compress(b"") + gzip.compress(record) + b"\0"
    assert b"".join(_inflated(data)) == record * 2
    with pytest.raises(EOFError):
        list(_inflated(gzip.compress(b"x" * 100)[:-12]))
    for bad in (b"WARC/1.1\r\n\r\n", b"GET / \r\nContent-Length: 0\r\n\r\n\r\n\r\n", record[:-6], b"WARC/1.1\r\nConte"):
        with pytest.raises(ValueError):
            list(split_records(iter([bad])))
