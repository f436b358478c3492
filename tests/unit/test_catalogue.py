"""Every query with an oracle agrees with DuckDB; the others give rows."""

import math
import os

import duckdb
import pytest

from tidewell.functions.stem import stem
from tidewell.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        d.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return d


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cols = sorted(df.columns)
    found = duck.sql(ORACLES[name])
    names = list(found.columns)
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == want


#: A title that is cut off in a reference, before the same title; others before a form with diacritics and before a word that is asked for.
CUT_OFF = [
    ("The &amp;&amp", "<h1>The &amp;&amp</h1><p>The of &amp; it goes on</p>"),
    ("x", "<p>Some of&ampthé rest of the page</p>"),
    ("x", "<p>Some &ampthe other words here</p>"),
    ("x", "<p>A whole page &amp; nothing cut</p>"),
]


@pytest.mark.parametrize("name", ["clean_pages", "html_unescape", "merged_postings", "min_length_filter", "page_body_positions", "page_contents", "page_index_unstemmed", "page_token_streams", "page_variants", "page_word_counts", "weighted_positions", "scored_results", "sql_functions", "sql_html_clean"])
def test_pages_with_references_that_are_cut_off(spark, tmp_path, name):
    pages = [(i, f"https://x.org/a/{i}", f'<html lang="en"><head><title>{title}</title></head><body>{body}</body></html>') for i, (title, body) in enumerate(CUT_OFF)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    d = duckdb.connect()
    d.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = d.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


def test_postings_of_frequent_words_are_kept_with_their_first_positions(spark, tmp_path):
    text = " ".join(["often"] * 250 + ["once"])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["term"]: (r["tf"], r["places"].split(",")) for r in QUERIES["postings_first_200"](spark, str(tmp_path)).collect()}
    assert {k: (tf, len(places)) for k, (tf, places) in rows.items()} == {"often": (250, 200), "once": (1, 1)}
    first = [int(x) for x in rows["often"][1]]
    assert first == list(range(first[0], first[0] + 200)) and int(rows["once"][1][0]) == first[0] + 250


def test_stemmed_df_keeps_all_languages(spark, tmp_path):
    rows = [(1, "running dogs", "en"), (2, "running dogs", None), (3, "running dogs", "xx"), (4, "hundarna", "sv"), (5, "running", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["lang"], r["stem"]): r["df"] for r in QUERIES["stemmed_df"](spark, str(tmp_path)).collect()}
    assert got == {("en", "run"): 1, ("en", "dog"): 1, (None, "running"): 2, (None, "dogs"): 1, ("xx", "running"): 1, ("xx", "dogs"): 1, ("sv", stem("hundarna", "sv")): 1}
