from tidewell.operators.page_search import PageIndex, query_terms

PAGES = "page_no long, language string, title_text string, clean string, url string"
ROWS = [
    (1, "en", "Running shoes", "what to wear on a long run in the hills", "/a"),
    (2, "en", "Hills", "running and runs are in the text of this page, running on", "/b"),
    (3, "en", "Other", "nothing of it", "/runs.html"),
    (4, "de", "Läufe", "das Running der anderen", "/d"),
    (5, "ja", "日本語の検索", "全文検索", "/e"),
    (6, "en", "camelCase", "parseHTML", "/f"),
]


def test_queries_and_pages_agree(spark):
    assert query_terms(spark, "Running, RUNS & the Cafés camelCase", "en") == ["run", "the", "cafe", "camel", "case"]
    assert query_terms(spark, "Running", stem=False) == ["running"] and query_terms(spark, "日本語 !") == ["日本", "本語"] and query_terms(spark, "") == []


def test_stems_fields_and_languages(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    PageIndex.of(pages).store(str(tmp_path / "p"), 2)
    index = PageIndex.stored(spark, str(tmp_path / "p"))
    found = {r["page_no"]: r["score"] for r in index.search("runs", "en").collect()}
    assert set(found) == {1, 2, 3} and found[3] < found[1]
    assert {r["page_no"] for r in index.search("running shoes", "en", every=True).collect()} == {1}
    assert {r["page_no"] for r in index.search("検索").collect()} == {5}
    assert {r["page_no"] for r in index.search("case").collect()} == {6}
    assert index.search("").collect() == [] and index.search("nowhere", "en").collect() == []
    heavy, light = ({r["page_no"]: r["score"] for r in index.search("hills", "en", title_weight=w).collect()} for w in (10.0, 0.0))
    assert heavy[2] > heavy[1] and light[1] > light[2] == 0
    plan = index.search("hills", "en")._jdf.queryExecution().executedPlan().toString()
    assert "term" in plan and ("EqualTo(term,hill)" in plan or "In(term, [hill])" in plan)
