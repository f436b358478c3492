"""Queries over single parts of the engine: the page build, encodings, search policies, scoring, sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import clean, hashing, tokens, urls
from ..functions.register import register
from ..operators import contracts, expansion, facets, index, merge, scoring, search, snippets
from ..operators.page_search import PageIndex
from ..sources import sink
from ..sources.content import TableSource, items_from_html, site_pages
from ..sources.datasource import FilterSource, FragmentSource, MetaSource, TermSource
from ..sources.static_writer import write_index
from ..streaming import incremental
from .catalogue import CLEAN, FACETS, IN3, PORTABLE, POST, TERMS, TITLE, TOK, _sortable, doc_facets, query, search_index, t
from .session import is_stored, shared_folder, source_version

_WORD = r"'[\p{L}\p{N}]+(?:''\p{L}+)*'"
_PLAIN_TITLE = f"replace(replace(replace(replace({TITLE}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
ITEMS = rf"""{CLEAN}, named AS (SELECT page_id, {PORTABLE} AS url, {_PLAIN_TITLE} AS title, coalesce(nullif(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), ''), 'en') AS lang FROM pages),
 items AS (SELECT page_id, n.url, title, lang, CASE WHEN title <> '' AND strpos(text, title) BETWEEN 1 AND 50 THEN ltrim(substr(text, strpos(text, title) + length(title)), ' ') ELSE text END AS clean FROM named n JOIN cleaned USING (page_id)),
 page AS (SELECT * FROM items WHERE length(clean) >= 10)"""
PAGE_TOKENS = rf"""{ITEMS}, field AS (SELECT page_id, 0 AS f, title AS text FROM page UNION ALL SELECT page_id, 1, clean FROM page
  UNION ALL SELECT page_id, 2, trim(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.\w+$', ''), '/+', ' ', 'g')) FROM page),
 word AS (SELECT page_id, f, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT page_id, f, regexp_extract_all(text, {_WORD}) AS l FROM field)),
 split AS (SELECT page_id, f, i, w, list_filter(list_transform(string_split(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2) AS p FROM word),
 part AS (SELECT page_id, f, i, generate_subscripts(p, 1) AS k, unnest(p) AS form FROM (SELECT page_id, f, i, CASE WHEN len(p) > 0 THEN p ELSE [lower(w)] END AS p FROM split)),
 ptok AS (SELECT page_id, f, form, strip_accents(form) AS term, row_number() OVER (PARTITION BY page_id ORDER BY f, i, k) - 1 AS position FROM part)"""


def built_pages(spark, sf_dir):
    pages = index.prepare_pages(site_pages(index.spread(t(spark, sf_dir, "pages"), "page_id")))
    return pages.withColumn("page_no", F.col("id").cast("long"))


# -- the page build --------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT page_id AS page_no, url, title, length(clean) AS n_chars, sha256(CASE WHEN title <> '' THEN title || '. ' || clean ELSE clean END) AS page_hash FROM page")
def page_contents(spark, sf_dir):
    """Cleaned titles and texts, titles at the beginning cut, short pages left out; the content string by its hash."""
    return built_pages(spark, sf_dir).select("page_no", "url", F.col("title_text").alias("title"), F.length("clean").cast("long").alias("n_chars"), "page_hash")


@query(f"WITH {ITEMS} SELECT 'language' AS dim, lang AS value, count(*) AS count FROM page GROUP BY lang")
def page_filters(spark, sf_dir):
    """Built-in filters of pages that have none of their own; an empty site gives none."""
    return facets.total_counts(index.facet_rows(built_pages(spark, sf_dir)))


@query(f"WITH {PAGE_TOKENS} SELECT page_id AS page_no, ['title', 'body', 'url'][f + 1] AS field, position, form AS original FROM ptok")
def page_token_streams(spark, sf_dir):
    """One counter over title, body and path; camel case split."""
    return index.page_tokens(built_pages(spark, sf_dir)).select("page_no", "field", F.col("position").cast("long").alias("position"), "original")


@query(f"WITH {PAGE_TOKENS} SELECT term, page_id AS page_no, count(*) AS tf, least(count(*) FILTER (f > 0), 200) AS body, count(*) FILTER (f = 0) AS in_title FROM ptok WHERE term <> '' GROUP BY term, page_id")
def page_index_unstemmed(spark, sf_dir):
    rows = index.page_postings(built_pages(spark, sf_dir), stem=False)
    return rows.select("term", "page_no", "tf", F.size("positions").cast("long").alias("body"), F.size("title_positions").cast("long").alias("in_title"))


@query(f"""WITH {PAGE_TOKENS}, n AS (SELECT term, page_id, position, row_number() OVER (PARTITION BY term, page_id ORDER BY position) AS n FROM ptok WHERE f > 0 AND term <> '')
 SELECT term, page_id AS page_no, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS places FROM n WHERE n <= 200 GROUP BY term, page_id""")
def page_body_positions(spark, sf_dir):
    toks = index.page_tokens(built_pages(spark, sf_dir))
    rows = index.postings(toks, index.word_forms(toks, stem=False)).where(F.size("positions") > 0)
    return rows.select("term", "page_no", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"))


@query(f"WITH {PAGE_TOKENS} SELECT page_id AS page_no, count(*) FILTER (f < 2) AS word_count FROM ptok GROUP BY page_id")
def page_word_counts(spark, sf_dir):
    return index.word_counts(index.page_tokens(built_pages(spark, sf_dir)))


@query(f"WITH {PAGE_TOKENS} SELECT DISTINCT term, form, page_id AS page_no FROM ptok WHERE term <> form AND term <> ''")
def page_variants(spark, sf_dir):
    toks = index.page_tokens(built_pages(spark, sf_dir))
    return index.variants(toks, index.word_forms(toks, stem=False))


@query(f"WITH {PAGE_TOKENS} SELECT term, page_id AS page_no, count(*) AS tf, least(count(*) FILTER (f = 1), 200) + least(count(*) FILTER (f = 2), 200) AS body, count(*) FILTER (f = 0) AS in_title FROM ptok WHERE term <> '' GROUP BY term, page_id")
def merged_postings(spark, sf_dir):
    """Postings of two partial builds, the bodies and the rest, united by term and page."""
    toks = index.page_tokens(built_pages(spark, sf_dir))
    forms = index.word_forms(toks, stem=False)
    parts = [index.postings(toks.where(f"{no} (field = 'body')"), forms) for no in ("", "not")]
    return index.merge_postings(*parts).select("term", "page_no", "tf", F.size("positions").cast("long").alias("body"), F.size("title_positions").cast("long").alias("in_title"))


@query(f"SELECT page_id, replace(replace(replace(replace(replace({TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;') AS escaped FROM pages")
def escaped_titles(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", clean.escape_attribute(clean.page_title(F.col("html"))).alias("escaped"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({PORTABLE}, '[?#].*$', ''), '\.\w+$', ''), '/+', ' ', 'g')) AS words FROM pages")
def url_path_words(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.path_words(F.col("url")).alias("words"))


# -- searches over pages -------------------------------------------------------------------------------------


def page_search_index(spark, sf_dir, stem: bool) -> PageIndex:
    """The stored index of the pages: made when it is first asked for or their files have changed."""
    path = f"{shared_folder(spark).rstrip('/')}/page-search/{source_version(t(spark, sf_dir, 'pages'))}-{int(stem)}"
    if not is_stored(spark, path):
        PageIndex.of(built_pages(spark, sf_dir), stem).store(path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return PageIndex.stored(spark, path, stem)


@query(f"""WITH {PAGE_TOKENS}, len AS (SELECT page_id, count(*) FILTER (f < 2) AS length FROM ptok GROUP BY page_id), st AS (SELECT count(*) AS n, avg(length) AS a FROM len),
 hit AS (SELECT term, page_id, count(*) FILTER (f > 0) + 3.0 * count(*) FILTER (f = 0) AS tf FROM ptok WHERE term IN {IN3} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)
 SELECT page_id AS page_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score, count(*) AS matched FROM hit JOIN df USING (term) JOIN len USING (page_id), st GROUP BY page_id""")
def page_search(spark, sf_dir):
    """Titles count three times; without stems, which SQL doesn't have."""
    return page_search_index(spark, sf_dir, False).search("The of AND")


@query()
def page_search_stemmed(spark, sf_dir):
    """English pages by stems, as the whole build has them."""
    return page_search_index(spark, sf_dir, True).search("the things", "en")


# -- encodings of the static format ----------------------------------------------------------------------------


@query(f"""WITH {TOK}, d AS (SELECT term, doc_id, position, position - coalesce(lag(position) OVER (PARTITION BY term, doc_id ORDER BY position), 0) AS step FROM tok WHERE term IN {IN3})
 SELECT term, doc_id, string_agg(CAST(step AS VARCHAR), ',' ORDER BY position) AS steps FROM d GROUP BY term, doc_id""")
def delta_positions(spark, sf_dir):
    hits = search.term_hits(search_index(spark, sf_dir), TERMS)
    return hits.select("term", "doc_id", F.array_join(index.delta(F.col("positions")).cast("array<string>"), ",").alias("steps"))


@query(f"""WITH {PAGE_TOKENS}, n AS (SELECT term, page_id, f = 0 AS title, position, row_number() OVER (PARTITION BY term, page_id, f = 0 ORDER BY position) AS n FROM ptok WHERE term <> ''),
 s AS (SELECT term, page_id, title, position, position - coalesce(lag(position) OVER (PARTITION BY term, page_id, title ORDER BY position), 0) AS step FROM n WHERE title OR n <= 200)
 SELECT term, page_id AS page_no, concat_ws(',', string_agg(CAST(step AS VARCHAR), ',' ORDER BY position) FILTER (NOT title), '-76,' || string_agg(CAST(step AS VARCHAR), ',' ORDER BY position) FILTER (title)) AS codes FROM s GROUP BY term, page_id""")
def weighted_positions(spark, sf_dir):
    """Body places plainly, title places (weight 75) behind their mark."""
    rows = index.page_postings(built_pages(spark, sf_dir), stem=False)
    by_weight = F.create_map(F.lit(25), F.col("positions"), F.lit(75), F.col("title_positions"))
    return rows.select("term", "page_no", F.array_join(index.weighted_positions(by_weight).cast("array<string>"), ",").alias("codes"))


@pandas_udf(StringType())
def _cbor_pair(text: pd.Series, number: pd.Series) -> pd.Series:
    return pd.Series([sink.cbor([a, int(b)]).hex() for a, b in zip(text, number)], dtype=object)


@query("""SELECT doc_id, '82' || format('{:02x}', 96 + length(source)) || lower(hex(encode(source))) || CASE WHEN n_chars < 24 THEN format('{:02x}', n_chars) WHEN n_chars < 256 THEN format('18{:02x}', n_chars)
 WHEN n_chars < 65536 THEN format('19{:04x}', n_chars) ELSE format('1a{:08x}', n_chars) END AS cbor FROM documents""")
def cbor_pairs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", _cbor_pair("source", "n_chars").alias("cbor"))


@query("""SELECT doc_id, true AS intact, sha256(unhex('373e252f' || repeat('5c', 60)) || unhex(sha256(unhex('5d544f45' || repeat('36', 60)) || encode(text)))) AS mac FROM documents""")
def record_macs(spark, sf_dir):
    """Keyed digests of records, and that each is what was signed (the key: 'kbys')."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text", F.crc32("text").alias("crc"), hashing.hmac_sha256(F.col("text"), b"kbys").alias("mac"))
    return docs.select("doc_id", hashing.intact(F.col("text"), F.col("crc"), F.col("mac"), b"kbys").alias("intact"), "mac")


# -- search ----------------------------------------------------------------------------------------------------


@query(f"WITH {POST} SELECT 'or' AS mode, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN ('the', 'zzzqqq') GROUP BY doc_id")
def or_fallback(spark, sf_dir):
    mode, hits = search.search_or_fallback(search_index(spark, sf_dir), ["the", "zzzqqq"])
    return hits.select(F.lit(mode).alias("mode"), "doc_id", "tf")


@query(f"WITH {FACETS} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM facet WHERE dim = 'source' AND value IN ('src1', 'src2')) AND doc_id IN (SELECT doc_id FROM facet WHERE dim = 'language' AND value = 'de')")
def filter_only(spark, sf_dir):
    """No terms: all pages that meet the filters."""
    return search.filter_pages(doc_facets(spark, sf_dir), {"source": ["src1", "src2"], "language": "de"}, "doc_id")


@query(f"""WITH {POST}, n AS (SELECT count(DISTINCT doc_id) AS n FROM post), idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n WHERE term IN {IN3} GROUP BY term, n),
 w AS (SELECT sum(idf) AS w FROM idf), c AS (SELECT doc_id, sum(idf) AS m FROM (SELECT DISTINCT doc_id, term FROM tok WHERE position < 10) JOIN idf USING (term) GROUP BY doc_id)
 SELECT doc_id, round(m, 6) AS matched_idf, round(m / w, 6) AS coverage, round(1 + 0.5 * m / w, 6) AS coverage_boost FROM c, w""")
def meta_coverage(spark, sf_dir):
    """The first ten words of a document stand for its title."""
    titles = index.text_tokens(t(spark, sf_dir, "documents"), "doc_id", "text").where("position < 10")
    rows = search.meta_coverage(search_index(spark, sf_dir), titles, TERMS, 0.5)
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in ("matched_idf", "coverage", "coverage_boost")])


@query(f"WITH {TOK} SELECT doc_id, 's' || (position // 100) AS anchor, count(*) AS n, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS places FROM tok WHERE term = 'the' GROUP BY ALL")
def sub_results(spark, sf_dir):
    """Every hundredth word stands for a heading."""
    toks = index.text_tokens(t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("position").alias("location"), "term")
    anchors = toks.where("location % 100 = 0").select("doc_id", "location", F.concat(F.lit("s"), F.floor(F.col("location") / 100).cast("string")).alias("anchor"))
    rows = snippets.sub_results(toks.where("term = 'the'"), anchors, "doc_id")
    return rows.select("doc_id", "anchor", "n", F.array_join(F.col("locations").cast("array<string>"), ",").alias("places"))


@query(f"WITH {FACETS} SELECT dim, value, count(DISTINCT doc_id) AS count FROM (SELECT * FROM facet UNION ALL SELECT doc_id, 'index', 'docs' FROM documents) GROUP BY dim, value")
def constant_facet(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return facets.total_counts(facets.with_constant(doc_facets(spark, sf_dir), docs, "index", "docs", "doc_id"), "doc_id")


@query(f"WITH {POST}, h AS (SELECT doc_id, max(tf) AS score FROM post WHERE term IN ('the', 'of') GROUP BY doc_id) SELECT 'field' AS mode, doc_id, score FROM h")
def sort_hinted(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    hits = [search.and_search(ix, [w]).select("doc_id", F.col("tf").alias("score")) for w in ("the", "of")]
    mode, rows = expansion.sort_hint(hits, index.sort_ranks(_sortable(spark, sf_dir), "doc_id"), {"field": "n_chars", "direction": "desc"}, "doc_id")
    return rows.select(F.lit(mode).alias("mode"), "doc_id", "score")


@query(f"""WITH {POST}, q(query_id, n) AS (VALUES ('a', 2), ('b', 1)), qt(query_id, term) AS (VALUES ('a', 'the'), ('a', 'of'), ('b', 'les'))
 SELECT query_id, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM qt JOIN post USING (term) JOIN q USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n""")
def batch_search(spark, sf_dir):
    queries = spark.createDataFrame([("a", ["the", "of", "the"]), ("b", ["les"])], "query_id string, terms array<string>")
    return search.batch_and_search(search_index(spark, sf_dir), queries)


@query("""WITH f AS (SELECT doc_id, 'source' AS dim, source AS value FROM documents UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels),
 c AS (SELECT dim, value, count(DISTINCT doc_id) AS count FROM f GROUP BY dim, value) SELECT dim, value, count FROM c WHERE dim IN (SELECT dim FROM c GROUP BY dim HAVING count(*) > 1)""")
def facet_panel(spark, sf_dir):
    """Dimensions that define what is searched aren't shown."""
    return facets.panel(facets.total_counts(doc_facets(spark, sf_dir), "doc_id"), {"source": ["src1"]})


@query("""SELECT CAST(least((SELECT count(*) FROM documents WHERE source IN ('src1', 'src2')), (SELECT count(*) FROM documents WHERE lang = 'en'), (SELECT count(*) FROM documents)) AS BIGINT) AS total""")
def filtered_denominator(spark, sf_dir):
    totals = facets.total_counts(doc_facets(spark, sf_dir), "doc_id")
    n = t(spark, sf_dir, "documents").count()
    return spark.createDataFrame([(facets.filtered_total(totals, {"source": ["src1", "src2"], "language": ["en"]}, n),)], "total long")


# -- scoring and merging ---------------------------------------------------------------------------------------

_HITS = r"len(list_intersect(list_distinct(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:''\p{{L}}+)*'), lambda x: strip_accents(lower(x)))), ['the', 'of', 'and'])) / 3.0"


@query(f"""WITH {CLEAN}, r AS (SELECT page_id, {TITLE} AS title, substr(text, 1, 300) AS excerpt, 1 - (row_number() OVER (ORDER BY page_id) - 1) / (count(*) OVER () - 1.0) AS base FROM pages JOIN cleaned USING (page_id)),
 s AS (SELECT page_id, base, {_HITS.format('title')} AS a, {_HITS.format('excerpt')} AS b FROM r)
 SELECT page_id, round(base + CASE WHEN a >= 1 THEN 3.0 * a ELSE 2.0 * a END + CASE WHEN b >= 1 THEN 0.48 * b ELSE 0.4 * b END, 6) AS score FROM s""")
def scored_results(spark, sf_dir):
    """Place, title and excerpt of every page, as one score."""
    pages = t(spark, sf_dir, "pages")
    rows = pages.select("page_id", clean.page_title(F.col("html")).alias("title"), F.substring(clean.html_clean(F.col("html")), 1, 300).alias("excerpt"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("array<int>").alias("locations"))
    placed = scoring.with_position_score(rows, [F.col("page_id")])
    return scoring.score_results(placed, TERMS, "the of and").select("page_id", "score")


@query(f"""WITH q(query_id, terms, boost) AS (VALUES ('a', ['the', 'of'], 2.0), ('b', ['les'], 3.5)), r AS (SELECT page_id, {TITLE} AS title FROM pages),
 s AS (SELECT query_id, page_id, boost, len(list_intersect(list_distinct(list_transform(regexp_extract_all(title, {_WORD}), lambda x: strip_accents(lower(x)))), terms)) / CAST(len(terms) AS DOUBLE) AS s FROM r, q)
 SELECT query_id, page_id, round(1 + boost * s * CASE WHEN s >= 1 THEN 1.5 ELSE 1 END, 6) AS score FROM s""")
def batch_scores(spark, sf_dir):
    """Two queries, one with a title boost of its own, over all pages in one plan."""
    queries = spark.createDataFrame([("a", ["the", "of", "the"], "the of", None), ("b", ["les"], "les", 3.5)], "query_id string, terms array<string>, query string, title_match_boost double")
    rows = t(spark, sf_dir, "pages").select("page_id", clean.page_title(F.col("html")).alias("title"), F.lit("").alias("excerpt"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("array<int>").alias("locations"), F.lit(1.0).alias("base"))
    both = rows.withColumn("query_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return scoring.score_batch(both, queries).select("query_id", "page_id", "score")


@query("SELECT doc_id, round(greatest(0.4, 0.5 - 0.05 * doc_id), 6) AS weight FROM documents")
def expansion_weights(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.round(merge.expansion_weight(F.col("doc_id")), 6).alias("weight"))


@query(f"""WITH r AS (SELECT CASE WHEN contains(url, '/fr/') THEN lower(url) ELSE url END AS cite_url, {TITLE} AS title, page_id % 97 AS score, url FROM pages)
 SELECT cite_url, arg_max(title, struct_pack(s := score, u := url)) AS title, max(score) AS score FROM r GROUP BY cite_url""")
def cited_pages(spark, sf_dir):
    """French pages name their own URL in their meta fields; the others are cited by the URL that was found."""
    own = F.when(F.col("url").contains("/fr/"), F.create_map(F.lit("url"), F.lower("url"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = t(spark, sf_dir, "pages").select("url", clean.page_title(F.col("html")).alias("title"), F.col("html").alias("content"), F.pmod("page_id", F.lit(97)).alias("score"), own.alias("meta"))
    return merge.citations(rows).select("cite_url", "title", "score")


@query(f"""WITH k AS (SELECT item_id, list_distinct(list_transform(string_split(text, ' '), lambda x: lower(x))) AS k FROM benchmark) SELECT CAST(item_id AS VARCHAR) AS url, CAST(len(list_intersect(k, ['the', 'of', 'and'])) AS INTEGER) AS matched FROM k WHERE len(list_intersect(k, ['the', 'of', 'and'])) >= 2""")
def priority_pages(spark, sf_dir):
    pages = t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("url"), F.lit("").alias("title"), F.split("text", " ").alias("keywords"))
    return contracts.match_priority_pages(pages, TERMS, 2).select("url", "matched")


@query(r"SELECT item_id, trim(regexp_replace(strip_accents(lower(regexp_replace(text, '[\p{Pd}\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}]', '', 'g'))), '\s+', ' ', 'g')) AS query, regexp_matches(text, '^\s*\".+\"\s*$') AS exact FROM benchmark")
def normalised_queries(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", tokens.normalise_query(F.col("text")).alias("query"), tokens.is_exact(F.col("text")).alias("exact"))


@query(rf"""WITH w AS (SELECT item_id, list_transform(regexp_extract_all(text, {_WORD}), lambda x: lower(x)) AS w FROM benchmark), k AS (SELECT item_id, w, list_filter(w, lambda x: x NOT IN {IN3}) AS k FROM w)
 SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS terms FROM k""")
def query_terms(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens.search_terms(F.col("text"), TERMS), " ").alias("terms"))


# -- sources and maintenance -----------------------------------------------------------------------------------

_CHANGES = """change AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'index' END AS action, ts FROM events),
 last AS (SELECT id, action FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, action DESC) AS n FROM change) WHERE n = 1)"""


def _source(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    least = events.agg(F.min("event_type")).first()[0]
    action = F.when(F.col("event_type") == least, "delete").otherwise("index")
    tracker = events.select(F.col("user_id").cast("string").alias("content_id"), F.lit("user").alias("content_type"), action.alias("action"), F.col("ts").alias("changed_at"))
    return TableSource(events.select(F.col("user_id").cast("string").alias("id")).distinct(), tracker)


@query(f"WITH {_CHANGES} SELECT id FROM last WHERE action = 'index'")
def source_changed(spark, sf_dir):
    return _source(spark, sf_dir).changed()


@query(f"WITH {_CHANGES} SELECT id FROM last WHERE action = 'delete'")
def source_deleted(spark, sf_dir):
    return _source(spark, sf_dir).deleted_ids()


@query("SELECT count(DISTINCT user_id) AS published, count(DISTINCT user_id) AS pending, CAST(0 AS BIGINT) AS after FROM events")
def source_counts(spark, sf_dir):
    """Before a build's acknowledgement, and the pending ones after it."""
    source = _source(spark, sf_dir)
    published, pending = source.counts()
    source.acknowledge()
    return spark.createDataFrame([(published, pending, source.counts()[1])], "published long, pending long, after long")


@query("SELECT count(*) AS lost FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src1', 'src2'))")
def lost_references(spark, sf_dir):
    keys = t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("content_key"))
    return spark.createDataFrame([(incremental.resolve_references(keys.select("content_key"), keys.where("source in ('src1', 'src2')"))[1],)], "lost long")


# -- the static index and the SQL surface ----------------------------------------------------------------------


@query(f"""WITH {PAGE_TOKENS}, n AS (SELECT page_id, count(*) FILTER (f < 2) AS word_count FROM ptok GROUP BY page_id)
 SELECT url, CAST(word_count AS INTEGER) AS word_count, sha256(CASE WHEN title <> '' THEN title || '. ' || clean ELSE clean END) AS content_hash, '{{"language": ["' || lang || '"]}}' AS filters FROM page JOIN n USING (page_id)""")
def static_fragments(spark, sf_dir):
    """A whole static build of the pages, and its fragments read back by the data source."""
    read = spark.read.format("tidewell_fragments").load(static_build(spark, sf_dir))
    return read.select("url", "word_count", F.sha2("content", 256).alias("content_hash"), "filters")


def static_build(spark, sf_dir) -> str:
    """The folder of the static build of the pages, without stems: made when it is first asked for or their files have changed."""
    for source in (FragmentSource, TermSource, FilterSource, MetaSource):
        spark.dataSource.register(source)
    base = f"{shared_folder(spark).rstrip('/')}/static/{source_version(t(spark, sf_dir, 'pages'))}"
    if not is_stored(spark, f"{base}/done"):

        def kept(df, name):
            df.write.mode("overwrite").parquet(f"{base}/{name}")
            return spark.read.parquet(f"{base}/{name}")

        pages = built_pages(spark, sf_dir)
        toks = kept(index.page_tokens(pages), "tokens")
        chars = F.create_map(F.lit("chars"), F.length("clean").cast("string"))
        whole = kept(pages.withColumn("all_sortable", chars).select("page_no", "url", "content", "all_filters", "meta", "all_sortable").join(index.word_counts(toks), "page_no"), "pages")
        forms = index.word_forms(toks, stem=False)
        postings = kept(index.postings(toks, forms), "postings")
        write_index(whole, postings, index.variants(toks, forms), index.sort_ranks(whole), ["title"], f"{base}/site", partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.range(1).write.mode("overwrite").parquet(f"{base}/done/pages")
    return f"{base}/site"


@query(f"""WITH {PAGE_TOKENS}, n AS (SELECT term, page_id, f = 0 AS title, position, row_number() OVER (PARTITION BY term, page_id, f = 0 ORDER BY position) AS n FROM ptok WHERE term <> '')
 SELECT term, page_id AS page_no, coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (NOT title AND n <= 200), '') AS places,
  coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (title), '') AS title_places FROM n GROUP BY term, page_id""")
def static_terms(spark, sf_dir):
    """The term chunks of the static build, read back whole."""
    rows = spark.read.format("tidewell_terms").load(static_build(spark, sf_dir)).where("form is null")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("term", "page_no", text("positions").alias("places"), text("title_positions").alias("title_places"))


@query(f"WITH {PAGE_TOKENS} SELECT DISTINCT term, form, page_id AS page_no FROM ptok WHERE term <> form AND term <> ''")
def static_forms(spark, sf_dir):
    return spark.read.format("tidewell_terms").load(static_build(spark, sf_dir)).where("form is not null").select("term", "form", "page_no")


@query(f"WITH {ITEMS} SELECT 'language' AS dim, lang AS value, page_id AS page_no FROM page")
def static_filters(spark, sf_dir):
    return spark.read.format("tidewell_filters").load(static_build(spark, sf_dir))


@query(f"""WITH {PAGE_TOKENS}, c AS (SELECT page_id, count(*) FILTER (f < 2) AS n FROM ptok GROUP BY page_id)
 SELECT 'page' AS kind, NULL AS name, row_number() OVER (ORDER BY page_id) - 1 AS place, n FROM c UNION ALL SELECT 'sort', 'chars', row_number() OVER (ORDER BY length(clean), page_id) - 1, page_id FROM page
 UNION ALL SELECT 'filter', 'language', 0, NULL UNION ALL SELECT 'field', 'title', 0, NULL UNION ALL SELECT 'version', '1.0', 0, NULL""")
def static_meta(spark, sf_dir):
    """Pages with their word counts, the sort order, the dimensions and fields, from the metadata file; names of pages and chunks are hashes."""
    rows = spark.read.format("tidewell_meta").load(static_build(spark, sf_dir)).where("kind <> 'chunk'")
    return rows.select("kind", F.when(F.col("kind") != "page", F.col("name")).alias("name"), "place", "n")


@query("SELECT 'source' AS dim, source AS value, count(*) AS count FROM documents GROUP BY source UNION ALL SELECT 'kind', 'text', count(*) FROM documents")
def attribute_filters(spark, sf_dir):
    """Filters in data attributes of HTML items, several to an item."""
    html = F.concat(F.lit('<p data-index-filter="source: '), "source", F.lit('">x</p><i data-index-filter="kind:text"></i>'))
    rows = t(spark, sf_dir, "documents").select("doc_id", html.alias("html"))
    items = items_from_html(rows, F.col("html"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("en"))
    return facets.total_counts(index.facet_rows(items, "id", "filters"), "id")


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'with') AS p FROM documents), s AS (SELECT doc_id, text, p, greatest(2001, p - 500) AS a, least(length(text), p + 500) AS b FROM p)
 SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN length(text) <= 6000 THEN text WHEN p > 2000 THEN substr(substr(text, 1, 2000) || chr(10) || '...' || chr(10) || substr(text, a, b - a + 1), 1, 6000) ELSE substr(text, 1, 2000) END AS context FROM s""")
def batch_contexts(spark, sf_dir):
    items = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("").alias("title"), F.col("text").alias("content"))
    return snippets.batch_extract_context(items, ["with"]).select("url", "context")


@query(f"SELECT page_id, regexp_replace(regexp_replace(lower(url), '\\.html$', ''), '/+$', '') AS key, strip_accents(lower({TITLE})) AS folded, {_PLAIN_TITLE} AS decoded FROM pages")
def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL."""
    register(spark)
    t(spark, sf_dir, "pages").select("page_id", "url", clean.page_title(F.col("html")).alias("title")).createOrReplaceTempView("tidewell_titles")
    return spark.sql("SELECT page_id, url_key(url) AS key, fold_word(lower(title)) AS folded, html_entities(title) AS decoded FROM tidewell_titles")


@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all(text, {_WORD}) AS w FROM benchmark) SELECT item_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS position, lower(unnest(w)) AS original, strip_accents(lower(unnest(w))) AS term FROM w""")
def sql_word_table(spark, sf_dir):
    """The table function over the benchmark's texts, without stems."""
    register(spark)
    t(spark, sf_dir, "benchmark").createOrReplaceTempView("tidewell_items")
    return spark.sql("SELECT item_id, position, original, term FROM tidewell_items, LATERAL word_tokens(text, '')")
