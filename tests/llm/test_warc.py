import base64
import gzip
import hashlib
import pathlib
import random

import pytest

from codeloom.llm.warc import SEGMENT, Parser, archived, chunked, read_archives, unchunked, write_archives

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    out = []
    for i, _, h in rows:
        d = digest(h)
        f = first.get(d)
        same = f is None or i == f
        out.append((i if i is not None else -1, len((h or "").encode()), d, "response" if same else "revisit", -1 if same else f))
    return sorted(out)


def got(df):
    return sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in df.collect())


ROWS = [
    (2, "http://a/", "x"), (1, "http://b/", "x"), (3, None, None), (4, "a\r\nb", ""), (None, "u", "x"), (None, "u", "only here"), (5, "z", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3000),
    (6, "z", "é漢😀" * 20_000), (7, "z", "é漢😀" * 20_000), (7, "z", "é漢😀" * 20_000), (6, "z", "é漢😀" * 20_000), (8, "z", "\r\n" * 10_000), (9, "z", "\n\r\n\r"),
]


def test_round_trip(spark):
    assert got(archived(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as digest", "2 as first"))) == expected(ROWS)


def test_empty_table(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_are_written_and_joined_in_any_order(spark, tmp_path):
    page = [(1, "u", "".join(random.Random(1).choices("abcdef\r\n", k=5 * SEGMENT)))]
    write_archives(spark.createDataFrame(page, SCHEMA), str(tmp_path / "a"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("*.gz")))
    parser = Parser()
    records = [r for piece in data.split(b"\r\n\r\n")[:-1] for r in parser.feed(piece)]
    assert not parser.inside and len(records) > 4
    assert [r[0]["warc-type"] for r in records] == ["response"] + ["continuation"] * (len(records) - 1)
    head = lambda h, b: ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in h.items())).encode() + b"\r\n\r\n" + b + b"\r\n\r\n"
    (tmp_path / "b").mkdir()
    shuffled = records[::-1] + records[1:2]  # one segment twice
    pathlib.Path(tmp_path / "b" / "x.warc.gz").write_bytes(gzip.compress(b"".join(head(*r) for r in shuffled)))
    assert got(read_archives(spark, str(tmp_path / "b"))) == expected(page)
    pathlib.Path(tmp_path / "b" / "x.warc.gz").write_bytes(gzip.compress(b"".join(head(*r) for r in records[:-1])))
    with pytest.raises(Exception, match="segments"):
        read_archives(spark, str(tmp_path / "b")).collect()


def test_chunked_framing():
    for size in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(i % 251 for i in range(size))
        assert unchunked(chunked(data)) == data
    assert unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")
