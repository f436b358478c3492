import os
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.index import TextIndex
from tidewell.operators.segments import SegmentFamily, bitmaps, has_bit

SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def same(family, docs):
    """A full build of what should be live has the same rows and scores."""
    whole = TextIndex.of(docs, "doc_id", "text", max_positions=None)
    now = family.index()
    assert rows(now.postings) == rows(whole.postings)
    assert rows(now.pages) == rows(whole.pages)
    terms = ["the", "w1", "w2"]
    assert rows(search.bm25(now, terms)) == rows(search.bm25(whole, terms))


def written(path):
    return {f for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs) if f.endswith(".parquet") and "/postings/" in f}


def size(files):
    return sum(os.path.getsize(f) for f in files)


def test_bits(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 100_000, -1, -40_000, 10**12]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    asked = spark.createDataFrame([(i + d,) for i in ids for d in (-1, 0, 1)], "id long").distinct()
    found = asked.join(bitmaps(df, "id"), (F.bitmap_bucket_number("id") == F.col("bucket")) & has_bit(F.col("bits"), F.bitmap_bit_position("id")), "left_semi")
    assert {r["id"] for r in found.collect()} == set(ids)


def test_one_per_cent_more_writes_about_one_per_cent(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    few = ids[:: len(ids) // 10][:10]
    family = SegmentFamily.create(spark, str(tmp_path / "f"), "doc_id", "text")
    family.add(docs.where(~F.col("doc_id").isin(few)))
    before = written(tmp_path)
    family.add(docs.where(F.col("doc_id").isin(few)))
    assert size(written(tmp_path) - before) < 0.04 * size(before)
    same(family, docs)


def test_updates_deletes_and_merges(spark, tmp_path):
    rng = random.Random(4)
    live = {}
    family = SegmentFamily.create(spark, str(tmp_path / "f"), "doc_id", "text")

    def text():
        return "the " + " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 8)))

    def live_docs():
        return spark.createDataFrame(list(live.items()) or [], SCHEMA)

    for step in range(7):
        if step % 3 == 2:
            gone = rng.sample(sorted(live), min(5, len(live))) + [10**9]
            family.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in gone}
        else:
            batch = {rng.randrange(-5, 60): text() for _ in range(40 if step == 0 else 8)}
            family.add(spark.createDataFrame(list(batch.items()), SCHEMA))
            live |= batch
        if step in (2, 6):
            same(family, live_docs())
    assert len([s for s in family.segments if s["pages"]]) <= 5
    family = SegmentFamily.open(spark, family.path)
    same(family, live_docs())
    assert family.vacuum() > 0
    same(family, live_docs())


def test_deleted_pages_come_back_and_empty_families(spark, tmp_path):
    family = SegmentFamily.create(spark, str(tmp_path / "f"), "doc_id", "text")
    assert family.index().postings.collect() == [] and family.index().pages.collect() == []
    family.delete(spark.createDataFrame([(1,)], "doc_id long"))
    family.add(spark.createDataFrame([(1, "the w1"), (2, None), (3, "")], SCHEMA))
    family.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert rows(family.index().postings) == []
    family.add(spark.createDataFrame([(1, "the w2")], SCHEMA))
    same(family, spark.createDataFrame([(1, "the w2")], SCHEMA))
    for _ in range(20):
        family.delete(spark.createDataFrame([(5,)], "doc_id long"))
    assert len(family.segments) < 20
    same(family, spark.createDataFrame([(1, "the w2")], SCHEMA))


def test_a_lost_writer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    import tidewell.operators.segments as S

    family = SegmentFamily.create(spark, str(tmp_path / "f"), "doc_id", "text")
    family.add(spark.createDataFrame([(1, "the w1")], SCHEMA))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "publish_manifest", lost)
        with pytest.raises(RuntimeError):
            family.add(spark.createDataFrame([(2, "the w2")], SCHEMA))
    same(family, spark.createDataFrame([(1, "the w1")], SCHEMA))
    family.add(spark.createDataFrame([(2, "the w2")], SCHEMA))
    same(family, spark.createDataFrame([(1, "the w1"), (2, "the w2")], SCHEMA))


def test_change_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "content_id string, action string, changed_at timestamp"
    store = {1: "the w1", 2: "the w2", 3: "w1 w2"}

    def put(*changes):
        spark.createDataFrame([(str(i), a, at) for i, a, at in changes], "content_id string, action string, at int").select("content_id", "action", F.timestamp_seconds("at").alias("changed_at")).coalesce(1).write.mode("append").parquet(log)

    def items(batch):
        return spark.createDataFrame(list(store.items()), SCHEMA).join(batch.select(F.col("content_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")

    family = SegmentFamily.create(spark, str(tmp_path / "f"), "doc_id", "text")

    def run():
        family.stream(spark.readStream.schema(schema).parquet(log), str(tmp_path / "check"), items).trigger(availableNow=True).start().awaitTermination()

    put((1, "index", 1), (2, "index", 1), (3, "index", 1), (3, "delete", 2))
    run()
    same(family, spark.createDataFrame([(1, "the w1"), (2, "the w2")], SCHEMA))
    store[2] = "w5 the"
    put((2, "index", 3), (1, "delete", 3))
    run()
    run()
    same(family, spark.createDataFrame([(2, "w5 the")], SCHEMA))
    assert list(family.segments) and len(spark.read.text(f"{family.path}/manifests/*.json", wholetext=True).collect()) == 3
