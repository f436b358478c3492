import datetime
import os
import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import contracts, expansion, facets, index, merge, scoring, search, snippets
from tidewell.plans.config import SearchConfig, parse_bytes
from tidewell.plans.health import health
from tidewell.sources import sink
from tidewell.sources.content import TableSource, site_pages
from tidewell.streaming import incremental

ITEMS = [
    ("a", "Red Apple", "<p>The red apple falls far from the old tree. Café au lait.</p>", "https://x.org/fruit/red-apple.html", "2024-01-02", "site", "en", {"kind": ["fruit", "food"]}, {}, {"price": "3"}),
    ("b", "Green Pear", "<p>Pears and apples are green fruits; the pear tree is running wild.</p>", "/fruit/green-pear", "2023-05-01", "site", "en", {"kind": ["fruit"]}, {}, {"price": "10"}),
    ("c", "Short", "<p>tiny</p>", "/short", "", "", "en", {}, {}, {}),
    ("d", "", "<p>Nothing here is about that, but there is an apple too.</p>", "/other", "", "", "en", {"site": ["own"]}, {}, {}),
]


@pytest.fixture(scope="module")
def built(spark):
    items = spark.createDataFrame(ITEMS, index.ITEM)
    pages = index.prepare_pages(items)
    pages = pages.join(index.dense_numbers(pages, "id"), "id")
    toks = index.page_tokens(pages)
    forms = index.word_forms(toks)
    pages = pages.join(index.word_counts(toks), "page_no")
    return pages, toks, forms, index.postings(toks, forms), index.variants(toks, forms)


def test_build(built):
    pages, toks, _, postings, variants = built
    rows = {r["id"]: r for r in pages.collect()}
    assert sorted(rows) == ["a", "b", "d"] and sorted(r["page_no"] for r in rows.values()) == [0, 1, 2]
    assert rows["a"]["url"] == "/fruit/red-apple.html" and rows["a"]["content"].startswith("Red Apple. The red")
    assert rows["d"]["all_filters"] == {"site": ["own"], "language": ["en"]} and rows["a"]["all_sortable"] == {"price": "3", "date": "2024-01-02"}
    hits = {(r["term"], r["page_no"]): r for r in postings.collect()}
    n = rows["a"]["page_no"]
    assert hits["appl", n]["title_positions"] == [1] and len(hits["appl", n]["positions"]) == 2  # body and path
    assert ("cafe", n) in hits and hits["run", rows["b"]["page_no"]]["tf"] == 1
    assert [tuple(r) for r in variants.collect()] == [("cafe", "café", n)]
    assert [r["name"] for r in index.meta_fields(pages).orderBy("place").collect()] == ["title", "date", "price"]
    assert [r["page_no"] for r in index.sort_ranks(pages).where("field = 'price'").orderBy("rank").collect()] == [n, rows["b"]["page_no"]]


def test_partitions_do_not_matter(spark, built):
    pages = built[0]
    other = index.page_tokens(pages.repartition(7))
    again = index.postings(other, index.word_forms(other))
    same = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert same(again) == same(built[3])


def test_merged_parts_equal_the_whole(built):
    toks, forms, whole = built[1], built[2], built[3]
    parts = [index.postings(toks.where(f"page_no % 2 = {k}"), forms) for k in (0, 1)]
    same = lambda df: sorted(tuple(map(str, r)) for r in df.select(*whole.columns).collect())
    assert same(index.merge_postings(*parts)) == same(whole)


def test_static_files_round_trip(spark, built, tmp_path):
    pages, _, _, postings, variants = built
    built_dir, final = tmp_path / "new", tmp_path / "index"
    fmt = sink.StaticFormat(chunk_bytes=200)
    meta = [r["name"] for r in index.meta_fields(pages).orderBy("place").collect()]
    counts = sink.write_static(pages, postings, variants, index.sort_ranks(pages), meta, f"file://{built_dir}", fmt)
    assert counts["pages"] == 3 and counts["chunks"] > 1
    sink.publish(str(built_dir), str(final), fmt)
    sink_twice = sink.write_static(pages, postings, variants, index.sort_ranks(pages), meta, f"file://{built_dir}", fmt)
    assert sink_twice == counts
    sink.publish(str(built_dir), str(final), fmt)
    entries = {}
    for f in (final / "index").iterdir():
        for word in sink.decode_cbor(sink.read_file(str(f), fmt))[0]:
            entries[word[0]] = word
    want = {}
    for r in postings.collect():
        want.setdefault(r["term"], []).append((r["page_no"], r["positions"], r["title_positions"]))
    forms = {"cafe": [("café", [r["page_no"] for r in variants.collect()])]}
    assert entries == {t: json.loads(json.dumps(sink.word_entry(t, p, forms.get(t, [])))) for t, p in want.items()}
    fragments = [json.loads(sink.read_file(str(f), fmt)) for f in (final / "fragment").iterdir()]
    assert {f["url"] for f in fragments} == {r["url"] for r in pages.collect()}
    assert health(str(final), fmt)["status"] == "ok" and health(str(tmp_path / "none"))["status"] == "missing"


def test_cbor():
    vectors = [(0, "00"), (23, "17"), (24, "1818"), (255, "18ff"), (1000, "1903e8"), (65536, "1a00010000"), (-1, "20"), (-10, "29"), ("a", "6161"), ([1, [2]], "82018102")]
    for value, raw in vectors:
        assert sink.cbor(value).hex() == raw and sink.decode_cbor(sink.cbor(value)) == value
    with pytest.raises(TypeError):
        sink.cbor(1.5)


def test_positions(spark):
    df = spark.createDataFrame([({25: [5, 20, 35], 50: [10, 15]},), ({50: [10], 75: [30]},), ({25: [5], 50: []},), ({},)], "w map<int,array<int>>")
    assert [r[0] for r in df.select(index.weighted_positions(F.col("w"))).collect()] == [[5, 15, 15, -51, 10, 5], [-51, 10, -76, 30], [5], []]


def test_packing_of_terms():
    chunks = list(sink.pack_terms([("a", 1), ("b", 1), ("c", 10), ("d", 1)], 50))
    assert [[t for t, _ in c] for c in chunks] == [["a", "b"], ["c"], ["d"]]


def test_search_falls_back(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "pie of the red one")], "k int, t string")
    ix = index.TextIndex.of(docs, "k", "t")
    kind, hits = search.search_or_fallback(ix, ["apple", "green"])
    assert kind == "and" and [r["k"] for r in hits.collect()] == [2]
    kind, hits = search.search_or_fallback(ix, ["green", "pie"])
    assert kind == "or" and sorted(r["k"] for r in hits.collect()) == [1, 2, 3]
    assert [r["k"] for r in search.phrase_search(ix, ["red", "apple"]).collect()] == [1]
    assert search.search_or_fallback(ix, ["nothing"])[1].collect() == []
    parts = search.bm25(ix, ["apple"], verbose=True).collect()
    assert all(r["pages_containing_term"] == 2 and r["idf"] > 0 for r in parts)


def test_scores(spark):
    r = spark.createDataFrame([("Pasta Recipe", [1, 2]), ("pasta", [1, 4]), ("other", [1, 90]), ("x", None)], "title string, locations array<int>")
    assert [x[0] for x in r.select(scoring.phrase_factor(F.col("locations"))).collect()] == [2.5, 1.5, 1.0, 1.0]
    assert [x[0] for x in r.select(scoring.exact_title_factor(F.col("title"), "other words", " PASTA ")).collect()] == [1.0, 5.0, 1.0, 1.0]
    based = scoring.with_position_score(r, [F.col("title")]).orderBy("title").collect()
    assert [round(x["base"], 3) for x in based] == [1.0, 0.667, 0.333, 0.0]
    day = spark.createDataFrame([(datetime.date(2024, 1, 1),), (datetime.date(2023, 1, 1),), (datetime.date(2001, 1, 1),), (None,)], "d date")
    values = [round(x[0], 3) for x in day.select(scoring.recency(F.col("d"), F.lit("2024-01-01").cast("date"))).collect()]
    assert values[0] == 0.25 and values[1] == 0.125 and values[2] < 0 and values[3] == 0


def test_merging(spark):
    a = spark.createDataFrame([("/a.html", "A", 0.9), ("/b", "B", 0.5)], "url string, title string, score double")
    b = spark.createDataFrame([("/A/", "A", 0.4), ("/c", "C", 0.6)], "url string, title string, score double")
    got = {r["url_key"]: r["score"] for r in merge.merge_results([(a, 1.0), (b, 1.0)], exclude=["/c"]).collect()}
    assert got == {"/a": 0.95, "/b": 0.5}
    titles = spark.createDataFrame([("1", "big red dog", 0.9), ("2", "the big red dog", 0.8), ("3", "small cat", 0.7)], "url string, title string, score double")
    assert sorted(r["url"] for r in merge.title_dedupe(titles, 10).collect()) == ["1", "3"]
    rows = [(f"x{i}", "x", 1 - i / 100) for i in range(5)] + [(f"y{i}", "y", 0.5 - i / 100) for i in range(5)] + [("z", None, 0.1)]
    found = merge.summary_round_robin(spark.createDataFrame(rows, "url string, source_term string, score double"), 8, "typed").collect()
    assert [r["url"] for r in found] == ["x0", "x1", "x2", "y0", "y1", "y2", "z", "x3"]


def test_expansion(spark):
    lex = spark.createDataFrame([("common", 90), ("rare", 2)], "term string, df long")
    guard = lambda **k: {r["word"]: r["admitted"] for r in expansion.subword_guard(lex, ["common rare"], **k).collect()}
    assert guard(total=100, max_frequency=0.1) == {"common": False, "rare": True}
    assert guard(total=100, max_frequency=0) == {"common": False, "rare": False} == guard(total=0, max_frequency=0.5)
    assert guard(total=100, max_frequency=1) == {"common": True, "rare": True}
    assert guard(total=100, max_frequency=0.1, typed=["common"])["common"] and not guard(total=100, max_frequency=0.1, typed=["common"], denied=["common"])["common"]
    one = spark.createDataFrame([(12, 200)], "df long, n long")
    assert round(one.select(expansion.specificity(F.col("df"), F.col("n"))).first()[0], 2) == 0.53
    seeded = spark.createDataFrame([(1, 1.0), (2, 0.5)], "page_no int, score double")
    agree = spark.createDataFrame([(1, "t", 0.5), (9, "t", 0.5)], "page_no int, term string, specificity double")
    assert {r["page_no"]: r["score"] for r in expansion.agreement_bonus(seeded, agree).collect()} == {1: 1.1, 2: 0.5}


def test_facet_rules(spark):
    values = spark.createDataFrame([("color", "red"), ("color", "green (lime, moss)"), ("kind", "fruits"), ("site", "red")], "dim string, value string")
    assert {tuple(r) for r in facets.subject_filters(values, ["moss", "fruit", "to"]).collect()} == {("color", "green (lime, moss)", "moss"), ("kind", "fruits", "fruit")}
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 0), ("b", "only", 3), ("site", "s", 1), ("site", "t", 1)], "dim string, value string, count long")
    assert [r["value"] for r in facets.panel(counts, {}).collect()] == ["x"]
    assert [r["value"] for r in facets.panel(counts, {"a": ["y"]}).collect()] == ["x", "y"]
    assert facets.filtered_total(counts, {"a": ["x", "y"], "b": ["only"]}, 50) == 2 and facets.filtered_total(counts, {}, 50) == 50
    assert facets.automatic_language(None, "en-US", ["en", "de"]) == "en" and facets.automatic_language("fr", None, ["en", "de"]) is None


def test_snippets(spark):
    df = spark.createDataFrame([("a b the c d the of e f g", [2, 5, 6], [1.0, 1.0, 1.0])], "t string, l array<int>, s array<double>")
    start = snippets.excerpt_start(F.col("l"), F.col("s"), F.lit(10), 3)
    assert df.select(start).first()[0] == 4
    assert df.select(snippets.excerpt(F.col("t"), F.col("l"), F.lit(4), 3)).first()[0] == "d <mark>the</mark> <mark>of</mark>"
    assert df.select(snippets.excerpt(F.col("t"), F.col("l"), F.lit(9), 3)).first()[0] == "e f g"
    locs = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "page_no int, location int")
    marks = spark.createDataFrame([(1, 3, "h"), (1, 9, "k")], "page_no int, location int, anchor string")
    assert sorted((r["anchor"], r["locations"]) for r in snippets.sub_results(locs, marks).collect()) == [("", [0]), ("h", [5]), ("k", [9])]
    long = "x" * 3000 + " needle " + "y" * 9000
    text = spark.createDataFrame([(long,), ("short",)], "t string")
    got = [r[0] for r in text.select(snippets.extract_context(F.col("t"), ["needle"])).collect()]
    assert "needle" in got[0] and len(got[0]) < 3100 and got[1] == "short"


def test_contracts(spark):
    assert contracts.parse_expansion('```json\n{"terms": ["a", "b"], "sort": {"field": "price", "direction": "asc"}, "filters": {"kind": "x", "no": "y"}}\n```', "q", ("price",), ("kind",)) == {
        "terms": ["a", "b"], "sort_hint": {"field": "price", "direction": "asc"}, "subject_terms": None, "filter_hint": {"kind": "x"}
    }
    assert contracts.parse_expansion("nonsense", "q")["terms"] == ["q"] == contracts.parse_expansion('["one"]', "q")["terms"]
    calls = []
    ok = contracts.Expander(lambda p, q: calls.append(q) or '["a", "b"]')
    assert ok.expand("Query", "p")["terms"] == ["a", "b"] == ok.expand("query", "p")["terms"] and len(calls) == 1
    assert contracts.Expander(lambda p, q: 1 / 0).expand("x", "p")["terms"] == ["x"] and not ok.expand(" ", "p")["ok"]
    models = spark.createDataFrame([("fam-1-9",), ("fam-1-10",), ("fam-2",), ("other-3",)], "name string")
    newest = contracts.newest_of_family(models, F.regexp_extract("name", "^([a-z]+)", 1))
    assert {r["family"]: r["name"] for r in newest.collect()} == {"fam": "fam-2", "other": "other-3"}
    turns = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", "x" * 10) for i in range(9)], "conv_id string, turn int, role string, text string")
    assert sorted(r["turn"] for r in contracts.truncate_conversations(turns, max_length=45).collect()) == [0, 1, 8]
    assert tuple(contracts.follow_up_status(turns).first())[1:] == (9, 3, 429)
    sent = spark.createDataFrame([("mail me a.b@c.org or +1 (555) 123-4567 now",)], "q string")
    assert sent.select(contracts.sanitize_query(F.col("q"))).first()[0] == "mail me [EMAIL] or [PHONE] now"


def test_config():
    c = SearchConfig.of({"results_per_page": "25", "ai_enabled": "false", "unknown": 1, "title_match_boost": None, "expansion_per_term_top_k": 9}, preset="catalog")
    assert c.results_per_page == 25 and c.ai_enabled is True and c.title_match_boost == 3.0 and c.expansion_per_term_top_k == 3
    assert parse_bytes("512M") == 512 << 20 and parse_bytes("1g") == 1 << 30 and parse_bytes("77") == 77


def test_sources(spark):
    pages = spark.createDataFrame([(1, "http://x/a", '<html lang="de"><title>T</title><body><p data-index-filter="kind:a" data-index-meta="date:2024">x</p><i data-index-filter="kind:b"></i></body>')], "page_id int, url string, html string")
    r = site_pages(pages).first()
    assert (r["language"], r["url"], r["title"], r["date"], r["filters"]) == ("de", "/a", "T", "2024", {"kind": ["a", "b"]})
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    tracker = spark.createDataFrame([("a", "page", "index", datetime.datetime(2024, 1, 1)), ("a", "page", "delete", datetime.datetime(2024, 1, 2)), ("b", "page", "index", datetime.datetime(2024, 1, 1))], "content_id string, content_type string, action string, changed_at timestamp")
    source = TableSource(items, tracker)
    assert [r["id"] for r in source.changed().collect()] == ["b"] and [r["id"] for r in source.deleted_ids().collect()] == ["a"] and source.counts() == (2, 2)
    source.acknowledge()
    assert source.counts() == (2, 0)


def test_export_collisions(spark, tmp_path):
    two = spark.createDataFrame([("1", "/a"), ("2", "/a/"), ("3", "/b")], "id string, url string")
    assert [r["path"] for r in sink.path_collisions(two).collect()] == ["a/index.html"]
    items = spark.createDataFrame(ITEMS, index.ITEM)
    assert sink.export_items(items, f"file://{tmp_path}/out") == 3
    assert "<h1>Red Apple</h1>" in (tmp_path / "out/fruit/red-apple.html/index.html").read_text()


def test_reuse_tokenises_only_misses(spark):
    items = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "content_key string, text string")
    seen = []

    def tokenise(misses):
        seen.extend(r["content_key"] for r in misses.collect())
        return misses.withColumn("tokens", F.split("text", " "))

    cache = items.where("content_key <> 'k2'").withColumn("tokens", F.split("text", " "))
    assert incremental.reuse(items, cache, tokenise).count() == 3 and seen == ["k2"]
    assert incremental.resolve_references(items.select("content_key"), cache)[1] == 1


def test_change_stream(spark, tmp_path):
    table, changes = str(tmp_path / "table"), str(tmp_path / "changes")
    items = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    incremental.create_table(items, table)
    schema = "content_id string, content_type string, action string, changed_at timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)
    new = spark.createDataFrame([("a", 2), ("d", 2), ("b", 2)], "id string, v int")
    for batch in ([("a", "p", "index", day(1)), ("b", "p", "index", day(1)), ("b", "p", "delete", day(2))], [("d", "p", "index", day(3))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(changes)
        stream = spark.readStream.schema(schema).parquet(changes)
        q = incremental.stream_changes(stream, table, str(tmp_path / "check"), lambda b: new).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in incremental.read_table(spark, table).collect()) == [("a", 2), ("c", 1), ("d", 2)]


def test_changes_between_reading_and_acknowledging_are_left(spark, tmp_path):
    schema = "content_id string, content_type string, action string, changed_at timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", "p", "index", day(1))], schema).write.mode("append").parquet(log)
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    source = TableSource(items, spark.read.schema(schema).parquet(log))
    assert [r["id"] for r in source.changed().collect()] == ["a"]
    spark.createDataFrame([("b", "p", "index", day(2))], schema).write.mode("append").parquet(log)
    source.tracker = spark.read.schema(schema).parquet(log)
    assert source.counts() == (2, 1)
    source.acknowledge()
    assert source.since == day(1) and [r["id"] for r in source.changed().collect()] == ["b"]
    source.acknowledge()
    assert source.counts() == (2, 0)


def test_change_stream_survives_crashes_and_new_checkpoints(spark, tmp_path, monkeypatch):
    table, changes = str(tmp_path / "table"), str(tmp_path / "changes")
    schema = "content_id string, content_type string, action string, changed_at timestamp"
    incremental.create_table(spark.createDataFrame([(str(i), 0) for i in range(40)], "id string, v int"), table, buckets=8)

    latest = {}

    def run(rows, value, check):
        latest.update({i: value for i, _ in rows})
        spark.createDataFrame([(i, "p", a, datetime.datetime(2024, 1, value)) for i, a in rows], schema).coalesce(1).write.mode("append").parquet(changes)
        new = spark.createDataFrame(list(latest.items()), "id string, v int")
        stream = spark.readStream.schema(schema).parquet(changes)
        q = incremental.stream_changes(stream, table, str(tmp_path / check), lambda b: new).trigger(availableNow=True).start()
        q.awaitTermination()

    def rows():
        return dict(tuple(r) for r in incremental.read_table(spark, table).collect())

    run([("1", "index"), ("2", "delete")], 1, "one")
    assert rows() == {str(i): int(i == 1) for i in range(40) if i != 2}
    files = {x: sorted(os.listdir(f"{table}/data/{x}")) for x in os.listdir(f"{table}/data")}
    assert len(next(v for k, v in files.items() if k != "start")) < 8  # only the touched buckets
    publish = incremental._publish
    monkeypatch.setattr(incremental, "_publish", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        run([("3", "index")], 2, "one")
    assert rows()["3"] == 0 and len(rows()) == 39  # the version before is whole
    monkeypatch.setattr(incremental, "_publish", publish)
    run([("4", "index"), ("3", "index")], 3, "one")
    assert (rows()["3"], rows()["4"]) == (3, 3)
    run([(str(i), "delete") for i in range(5, 40)], 4, "two")  # a new checkpoint: its epochs count from 0 again
    assert set(rows()) == {"0", "1", "3", "4"}
    version = incremental.current_version(spark, table)
    with pytest.raises(RuntimeError):
        publish(spark, table, incremental._manifest(spark, table))
    assert incremental.current_version(spark, table) == version


def test_stored_index_prunes_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "pear")], "k int, t string")
    search.store_index(index.TextIndex.of(docs, "k", "t"), f"file://{tmp_path}", 2)
    ix = search.stored_index(spark, f"file://{tmp_path}", "k")
    hits = search.and_search(ix, ["apple", "red"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [apple,red])" in plan and "positions" not in plan.split("ReadSchema")[1]
    assert [r["k"] for r in hits.collect()] == [1]


def test_constant_dimension_and_clients(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_no int")
    none = spark.createDataFrame([], "page_no int, dim string, value string")
    assert facets.total_counts(facets.with_constant(none, pages, "index", "docs")).first()["count"] == 2
    ask = contracts.first_working(lambda p, t: 1 / 0, lambda p, t: t.upper())
    assert ask("", "x") == "X"
    with pytest.raises(ZeroDivisionError):
        contracts.first_working(lambda p, t: 1 / 0)("", "x")


def test_a_batch_scores_as_its_queries_do_one_by_one(spark):
    rows = [("Red apple pie", "an apple a day", datetime.date(2024, 1, 1), [1, 2]), ("apple", "pie and more", None, None), ("", None, None, [1, 9]), ("Pear", "apple pie", datetime.date(2015, 1, 1), [3])]
    base = spark.createDataFrame([(*r, 1.0 - i / 4) for i, r in enumerate(rows)], "title string, excerpt string, date date, locations array<int>, base double")
    day = F.lit("2024-06-01").cast("date")
    asked = {"a": (["apple", "pie"], "apple", {}), "b": (["pear"], " Pear ", {"exact_title_boost": 9.0, "content_match_boost": 1.0}), "c": ([], "", {})}
    queries = spark.createDataFrame([(k, t, q, o.get("exact_title_boost"), o.get("content_match_boost")) for k, (t, q, o) in asked.items()], "query_id string, terms array<string>, query string, exact_title_boost double, content_match_boost double")
    got = scoring.score_batch(base.withColumn("query_id", F.explode(F.array(*map(F.lit, asked)))), queries, as_of=day)
    for k, (terms, query, own) in asked.items():
        want = scoring.score_results(base, terms, query, scoring.ScoreConfig(**own), as_of=day)
        assert sorted((r["base"], r["score"]) for r in got.where(F.col("query_id") == k).collect()) == sorted((r["base"], r["score"]) for r in want.collect())


def test_places_without_a_query_are_ranked_in_ranges(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, n int").repartition(5)
    out = scoring.with_position_score(df, [F.desc("n"), F.col("id")])
    assert out.columns == ["id", "n", "base"]
    got = [(r["id"], round(r["base"], 9)) for r in out.orderBy(F.desc("base")).collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == [(i, round(1 - k / 999, 9)) for k, (i, _) in enumerate(want)]
    assert "SinglePartition" not in out.drop("base")._jdf.queryExecution().executedPlan().toString()
    assert [r["base"] for r in scoring.with_position_score(df.limit(1), [F.col("n")]).collect()] == [1.0]
    assert scoring.with_position_score(df.limit(0), [F.col("n")]).collect() == []


def test_citations_take_the_best_row_of_a_page(spark):
    rows = [("a", "A", "one", 1.0, {}), ("b", "B", "two", 3.0, {"url": "a"}), ("c", "C", "x", 2.0, None), ("c", "C", "y", 2.0, {}), ("d", None, None, None, {"url": "d"}), (None, "N", "n", 1.0, {})]
    found = merge.citations(spark.createDataFrame(rows, "url string, title string, content string, score double, meta map<string,string>"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", "B", "two", 3.0), ("c", "C", "y", 2.0), ("d", None, None, None), (None, "N", "n", 1.0)], key=repr)
    assert merge.citations(spark.createDataFrame([], "url string, title string, content string, score double, meta map<string,string>")).collect() == []


def test_round_robin_takes_the_best_of_each_task_first(spark):
    rows = spark.createDataFrame([(f"u{i}", "t" if i % 3 else None, float(i % 7)) for i in range(50)], "url string, source_term string, score double")
    plan = merge.summary_round_robin(rows, 4, "typed")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") and "Partial" in plan
