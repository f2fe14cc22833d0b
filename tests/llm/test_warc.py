import gzip
import hashlib
import random

import pytest

from siftwire.llm import warc

SCHEMA = "page_id long, url string, html string, captured string"


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 4, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        got = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert got == sorted(x for run in runs for x in run)


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com/A/b?x=1#top") == "com,example)/a/b?x=1"
    assert warc.url_key("") == ")/" and warc.url_key("a.b.c") == "c,b,a)/"


def plain(rows, min_bytes=0):
    groups = {}
    for r in rows:
        data = (r[2] or "").encode()
        if len(data) >= min_bytes and r[0] is not None:
            groups[data] = max(groups.get(data, r[0]), r[0])
    out = []
    for r in rows:
        data = (r[2] or "").encode()
        top = groups.get(data)
        again = len(data) >= min_bytes and top is not None and top != r[0]
        digest = warc.base32(hashlib.sha1(data).digest())
        out.append((r[0], len(data), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.com/x", "same", "m"), (5, "http://a.com/x", "same", None), (3, None, "same", "n"), (4, "http://b.org", None, ""),
    (6, "http://b.org/ü?q=1 2", "", ""), (7, "http://c.net", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n", ""), (None, "x", "same", ""),
    (5, "http://a.com/x", "same", None), (8, "http://www.a.com/", "other   end\r\n", "z"),
]


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    warc.write_archives(pages, f"{tmp_path}/w", min_bytes=min_bytes, archive_bytes=30_000)
    entries = warc.read_archives(spark, f"{tmp_path}/w")
    got = entries.collect()
    fields = lambda rows: sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert fields(got) == plain(ROWS, min_bytes) and len({r.run for r in got}) > 1
    for r in got:
        with open(r.run.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            record = gzip.decompress(file.read(r.length))
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            file.seek(0)
            assert gzip.decompress(file.read()).count(b"WARC-Record-ID: ") == sum(x.run == r.run for x in got)
    merged = warc.merge_runs(entries, range_rows=4).collect()
    assert fields(merged) == fields(got)
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in sorted(merged, key=lambda r: (r.range, r.place))]
    assert order == sorted(order) and len({r.range for r in merged}) > 1


def test_histories_go_on_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['hot.com/', 'hot.com/', 'b.org/x', f'c{i % 7}.net'])}", f"page {i % 5}", "") for i in range(120)] + [(None, "http://hot.com/", "x", "")] * 2
    pages = spark.createDataFrame(rows, SCHEMA)
    seen, want = {}, []
    for position, (key, at, i) in enumerate(sorted((warc.url_key(u), i or 0, -1 if i is None else i) for i, u, _, _ in rows)):
        want.append((position, key, None if i < 0 else i, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    for size in (7, 1000):
        got = warc.capture_index(pages, range_rows=size, archive_bytes=2000).collect()
        assert sorted((r.position, r.url_key, r.page_id, r.capture) for r in got) == want


def test_records_of_sixteen_mebibytes(spark, tmp_path):
    rows = [(1, "a", "x" * (17 << 20), ""), (2, "b", "y", "")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w", archive_bytes=1 << 30)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()) == [(1, 17 << 20), (2, 1)]


def test_damage_is_seen():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_archive(gzip.compress(b"nonsense")))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse_archive(gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc")))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse_archive(gzip.compress(b"x" * 99)[:-9]))


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    out = warc.archive_digest(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str)
    assert got == plain(rows)
    assert warc.archive_digest(pages.limit(0)).count() == 0
