import json
import os

import pytest

from tidewell.functions.register import describe, register
from tidewell.sources import maintenance as m
from tidewell.sources.datasource import FragmentSource
from tidewell.sources.sink import StaticFormat, fragment_json, html_document


def test_storage(tmp_path):
    s = m.LocalStorage(str(tmp_path))
    s.put("a/b.html", html_document({"id": "7", "title": "T & t", "url": "/a", "text": "x", "filters": {"k": ["v", "w"]}, "date": "2024"}).encode())
    s.put("c.txt", b"1")
    assert s.files() == ["a/b.html", "c.txt"] and m.count_html(s) == 1 and m.manifest(s) == {"a/b.html": "7"}
    s.move("c.txt", "d/c.txt")
    assert s.exists("d/c.txt") and m.delete_exported(s, ids={"7"}) == 1 and m.count_html(s) == 0
    for bad in ("../x", "s3://x/y"):
        with pytest.raises(ValueError):
            s.put(bad, b"")
    assert m.should_build("f", s)
    m.record_build("f", s)
    assert not m.should_build("f", s) and m.should_build("g", s)


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    lock = m.BuildLock(path)
    assert lock.acquire() and not m.BuildLock(path).acquire()
    json.dump({"pid": 2**22 + 5, "at": 0}, open(path, "w"))
    assert m.BuildLock(path).acquire()
    lock.release()
    assert not os.path.exists(path)


def test_stages_resume(spark, tmp_path):
    made = []
    stages = m.Stages(spark, f"file://{tmp_path}")
    for _ in range(2):
        assert stages.run("one", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]


def test_cache():
    now = [0.0]
    c = m.MemoryCache(lambda: now[0])
    c.set("a", 1, ttl=5)
    c.set("b", 2)
    now[0] = 6
    assert c.get("a") is None and c.get("b") == 2 and m.NoCache().get("b") is None


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT url_key('/A/b.html'), url_portable('https://x.org'), stem_word('running', 'en'), html_entities('a&amp;b'), fold_word('é')").first()[:] == ("/a/b", "/", "run", "a&b", "e")
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_tokens('Cafés run', 'en')").collect()] == [(0, "cafés", "cafe"), (1, "run", "run")]
    assert "stem_word" in describe()["functions"]


def test_fragment_source(spark, tmp_path):
    fmt = StaticFormat()
    (tmp_path / "fragment").mkdir()
    for i in range(3):
        (tmp_path / "fragment" / f"en_{i}.fragment").write_bytes(fmt.pack(fragment_json(f"/{i}", "text", i, {"k": ["v"]}, {})))
    spark.dataSource.register(FragmentSource)
    rows = spark.read.format("tidewell_fragments").load(str(tmp_path)).orderBy("url").collect()
    assert [(r["url"], r["word_count"], r["filters"]) for r in rows] == [(f"/{i}", i, '{"k": ["v"]}') for i in range(3)]


def test_a_stored_index_follows_its_table(spark, tmp_path):
    from tidewell.plans.catalogue import QUERIES
    from tidewell.plans.session import source_version

    path = str(tmp_path / "documents.parquet")
    rows = [(1, "the of and", "en"), (2, "the of", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    assert [r["doc_id"] for r in QUERIES["and_search"](spark, str(tmp_path)).collect()] == [1]
    version = source_version(spark.read.parquet(path))
    assert version == source_version(spark.read.parquet(path)) != source_version(spark.read.parquet(path), 0) == source_version(spark.read.parquet(path), 0)
    spark.createDataFrame([(3, "and of the", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(path)
    assert source_version(spark.read.parquet(path)) != version
    assert sorted(r["doc_id"] for r in QUERIES["and_search"](spark, str(tmp_path)).collect()) == [1, 3]
