import base64
import hashlib
import random

import pytest

from tidewell.llm.warc import LoserTree, parse_record, read_archives, record, url_key, write_archives

PAGES = "page_id long, url string, html string, seq int, digest string"


def test_loser_tree_merges_as_sorted():
    for seed in range(60):
        rng = random.Random(seed)
        runs = [sorted((rng.randrange(9), i) for i in range(rng.randrange(6))) for _ in range(rng.randrange(9))]
        assert list(LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("https://www.Example.com:443/A/?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert url_key("about:blank") == "about:blank" and url_key("") == ""


def test_record_round_trip():
    r = parse_record(record(7, "http://x/", "é\r\n\r\nx".encode(), 5, "response", None))
    assert (r["page_id"], r["payload"], r["type"]) == (7, "é\r\n\r\nx".encode(), "response")
    r = parse_record(record(7, "http://x/", b"abc", 5, "revisit", 9))
    assert (r["payload_bytes"], r["payload"], r["refers_to"]) == (3, b"", 9)


def check(pages, spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    largest = {}
    for p, b in rows:
        if p is not None:
            largest[b] = max(p, largest.get(b, p))
    want = []
    for p, b in rows:
        again = p is not None and p < largest[b]
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", largest[b] if again else None))
    folder, index = write_archives(pages)
    out = read_archives(spark, folder, index)
    got = [tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ordered = [(r["url_key"], r["timestamp"]) for r in index.orderBy("range", "position").collect()]
    assert ordered == sorted(ordered)


def test_given_pages(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), spark)


def test_edges(spark):
    rows = [(1, None, None, 0, "d"), (2, "http://a/", "", 0, "d"), (3, "http://a/", "x", 0, "d"), (3, "http://a/", "x", 0, "d"), (4, "http://b/\r\nX: y", "x", 0, "d"), (None, "http://c", "x", 0, "d"), (5, "http://[bad", "y" * 300000, 0, "d"), (3, "http://a/", "other", 0, "d")]
    check(spark.createDataFrame(rows, PAGES), spark)


@pytest.mark.parametrize("n", [0])
def test_no_rows(spark, n):
    folder, index = write_archives(spark.createDataFrame([], PAGES))
    assert read_archives(spark, folder, index).collect() == []


def test_ranges_and_slices_of_any_size_give_one_order(spark, monkeypatch):
    import tidewell.llm.warc as W

    rng = random.Random(3)
    captures = [(f"k{rng.randrange(40)}", f"{rng.randrange(5)}", i if i % 7 else None, "u", "f", i, 1) for i in range(3000)]
    rows = []
    for run in range(5):
        own = sorted((c for i, c in enumerate(captures) if i % 5 == run), key=lambda c: (c[0], c[1], -1 if c[2] is None else c[2]))
        rows += [(*c, run, seq) for seq, c in enumerate(own)]
    runs = spark.createDataFrame(rows, f"{W.INDEX}, run int, seq long")
    want = sorted((c[0], c[1], -1 if c[2] is None else c[2]) for c in captures)
    for size, ahead in [(250_000, 2_000), (100, 7), (10_000, 1)]:
        monkeypatch.setattr(W, "RANGE_ROWS", size)
        monkeypatch.setattr(W, "AHEAD", ahead)
        got = sorted(W.merge_runs(runs).collect(), key=lambda r: (r["range"], r["position"]))
        assert [(r["url_key"], r["timestamp"], -1 if r["page_id"] is None else r["page_id"]) for r in got] == want
        assert sorted(r["offset"] for r in got) == list(range(3000))
        assert all(b["position"] == (a["position"] + 1 if a["range"] == b["range"] else 0) for a, b in zip(got, got[1:]))


def test_archives_are_read_in_stretches_not_by_record(spark, monkeypatch):
    from tidewell.llm import warc

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").coalesce(2)
    folder, index = write_archives(pages)
    files = index.groupBy("file").agg({"length": "sum"}).count()
    cols = index.select("file", "offset", "length", "url_key", "timestamp", "range", "position")
    assert pages.count() > 10 * files
    reads = []
    whole = warc._fs

    class Counted:
        def __init__(self, f):
            self.f = f

        def read_at(self, size, offset):
            reads.append(size)
            return self.f.read_at(size, offset)

        def close(self):
            self.f.close()

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            return Counted(self.fs.open_input_file(path))

    monkeypatch.setattr(warc, "_fs", lambda uri: (Files(whole(uri)[0]), whole(uri)[1]))
    batches = cols.orderBy("file", "offset").toArrow().to_batches()
    got = [b.num_rows for b in warc._read(folder)(iter(batches))]
    assert sum(got) == pages.count() and len(reads) <= files + len(batches)
    monkeypatch.setattr(warc, "READ_BYTES", 3000)
    reads.clear()
    assert sum(b.num_rows for b in warc._read(folder)(iter(batches))) == pages.count() and len(reads) > files + len(batches)
