"""Queries over the driver's tables and the DuckDB SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, hashing, tokens, urls
from ..functions.stem import stem_column
from ..operators import contracts, expansion, facet_bitmaps, facets, index, merge, scoring, search, snippets
from ..sources import sink
from ..streaming import incremental
from .session import is_stored, shared_folder, source_version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "of", "and"]


def query(oracle: str | None = None):
    def add(of):
        QUERIES[of.__name__] = of
        if oracle:
            ORACLES[of.__name__] = oracle
        return of

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_index(spark: SparkSession, sf_dir: str, max_positions: int | None = index.MAX_POSITIONS) -> index.TextIndex:
    return index.TextIndex.of(t(spark, sf_dir, "documents"), "doc_id", "text", max_positions=max_positions)


def search_index_path(spark: SparkSession, sf_dir: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/search-index/{source_version(t(spark, sf_dir, 'documents'))}"


def search_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The stored index of the documents with all positions: built when it is first asked for, or their files have changed."""
    path = search_index_path(spark, sf_dir)
    if not is_stored(spark, path):
        search.store_index(docs_index(spark, sf_dir, None), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return search.stored_index(spark, path, "doc_id")


# SQL pieces that several oracles share
TOK = r"""tok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS position, strip_accents(lower(unnest(w))) AS term
 FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:''\p{L}+)*') AS w FROM documents))"""
POST = TOK + ", post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)"
LEN = "len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id)"
FACETS = """facet AS (SELECT doc_id, 'language' AS dim, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
 UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels)"""
IN3 = "('the', 'of', 'and')"
BM25 = f"""{POST}, {LEN}, st AS (SELECT count(*) AS n, avg(length) AS a FROM len), hit AS (SELECT * FROM post WHERE term IN {IN3}), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
 scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM hit JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id)"""
PORTABLE = r"""CASE WHEN contains(url, '://') THEN CASE WHEN regexp_replace(url, '^[a-zA-Z][^:]*://[^/?#]*', '') = '' THEN '/'
 WHEN regexp_matches(regexp_replace(url, '^[a-zA-Z][^:]*://[^/?#]*', ''), '^[?#]') THEN '/' || regexp_replace(url, '^[a-zA-Z][^:]*://[^/?#]*', '')
 ELSE regexp_replace(url, '^[a-zA-Z][^:]*://[^/?#]*', '') END ELSE url END"""
TRIMMED = rf"regexp_replace(regexp_replace({PORTABLE}, '[?#].*$', ''), '^/+|/+$', '', 'g')"
EXPORT = rf"CASE WHEN {TRIMMED} = '' THEN 'index.html' WHEN regexp_matches({TRIMMED}, '(^|/)index\.html$') THEN {TRIMMED} ELSE {TRIMMED} || '/index.html' END"


def _without(sql: str, pattern: str) -> str:
    return f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"


#: The given pages have no element that goes inside another, and none that only its id or class marks.
CLEAN = rf"""c0 AS (SELECT page_id, url, {_without('html', '(?s)<!--.*?-->')} AS h FROM pages),
 c1 AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE h END AS h FROM c0),
 c2 AS (SELECT page_id, url, {_without('h', '(?is)<(?:script|style|nav|footer)(?:[^>a-z][^>]*)?>.*?</(?:script|style|nav|footer)>')} AS h FROM c1),
 c4 AS (SELECT page_id, url, regexp_replace(h, '(?s)<[^\s>][^>]*(?:>|$)|<>', '', 'g') AS h FROM c2),
 c5 AS (SELECT page_id, url, replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS h FROM c4),
 cleaned AS (SELECT page_id, url, trim(regexp_replace(h, '[\t\n\f\r \x0b]+', ' ', 'g'), ' ') AS text FROM c5)"""
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.spread(t(spark, sf_dir, "pages"), "page_id").select("page_id", "url", clean.html_clean(F.col("html")).alias("text"))


def doc_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    return docs.select("doc_id", F.lit("language").alias("dim"), F.col("lang").alias("value")).unionByName(docs.select("doc_id", F.lit("source").alias("dim"), F.col("source").alias("value"))).unionByName(
        labels.select("doc_id", F.lit("quality").alias("dim"), F.col("quality").cast("string").alias("value"))
    )


def stored_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored facet bitmaps: built when they are first asked for, or the files of a table have changed."""
    versions = "-".join(source_version(t(spark, sf_dir, name))[:12] for name in ("documents", "labels"))
    path = f"{shared_folder(spark).rstrip('/')}/facet-bitmaps/{versions}"
    if not is_stored(spark, path):
        made = facet_bitmaps.build(doc_facets(spark, sf_dir), "doc_id")
        made.repartitionByRange("dim", "value").sortWithinPartitions("dim", "value", "bucket").write.mode("overwrite").parquet(f"{path}/pages")
    return spark.read.parquet(f"{path}/pages")


def hit_set(hits: DataFrame) -> DataFrame:
    return facet_bitmaps.page_set(hits, "doc_id")


# -- cleaning, URLs, hashes ------------------------------------------------------------------------------------


@query(f"WITH {CLEAN} SELECT page_id, text FROM cleaned")
def clean_pages(spark, sf_dir):
    return cleaned(spark, sf_dir).select("page_id", "text")


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", clean.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {PORTABLE} AS portable FROM pages")
def url_portable(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.portable(F.col("url")).alias("portable"))


@query(f"SELECT page_id, {EXPORT} AS path FROM pages")
def url_export_path(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.export_path(F.col("url")).alias("path"))


@query(f"SELECT path, count(DISTINCT page_id) AS n, min(page_id) AS first_id, max(page_id) AS last_id FROM (SELECT page_id, {EXPORT} AS path FROM pages) GROUP BY path HAVING count(DISTINCT page_id) > 1")
def path_collisions(spark, sf_dir):
    return sink.path_collisions(t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


@query(f"WITH {CLEAN} SELECT page_id, length(text) AS n_chars FROM cleaned WHERE length(text) >= 50")
def min_length_filter(spark, sf_dir):
    return cleaned(spark, sf_dir).where(F.length("text") >= 50).select("page_id", F.length("text").cast("long").alias("n_chars"))


@query("SELECT page_id, sha256(concat(url, chr(0), html)) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", hashing.content_hash(F.col("url"), F.col("html")).alias("content_hash"))


@query("SELECT doc_id, sha256(text) AS page_hash FROM documents")
def page_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", hashing.page_hash(F.col("text")).alias("page_hash"))


_PART = "CAST(sum(CAST(('0x' || substr(r, {at}, 8)) AS BIGINT)) AS VARCHAR)"


@query(
    "SELECT sha256(concat_ws(':', 'tidewell-v1:', CAST(count(*) AS VARCHAR), " + ", ".join(_PART.format(at=1 + 8 * i) for i in range(8)) + ")) AS fingerprint, count(*) AS items FROM (SELECT sha256(concat_ws(':', CAST(doc_id AS VARCHAR), sha256(text))) AS r FROM documents)"
)
def corpus_fingerprint(spark, sf_dir):
    return hashing.corpus_fingerprint(t(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT item_id, concat_ws('_', 'tidewell', 'expand', '3', sha256(lower(concat_ws('|', text, 'en')))) AS cache_key FROM benchmark")
def cache_key(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", hashing.cache_key(F.lit("expand"), F.lit(3), [F.col("text"), F.lit("en")]).alias("cache_key"))


# -- tokens, postings, directories -----------------------------------------------------------------------------


@query(f"WITH {TOK} SELECT doc_id, CAST(position AS INTEGER) AS position, term FROM tok")
def doc_tokens(spark, sf_dir):
    return index.text_tokens(t(spark, sf_dir, "documents"), "doc_id", "text")


#: A letter each stands for, so that given names make words of such a script.
_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丞両丢两严"


@query(r"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), j AS (SELECT p_partkey, array_to_string(list_transform(l, lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS w FROM w),
 p AS (SELECT p_partkey, w, list_filter(list_transform(string_split(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2) AS l FROM j)
 SELECT p_partkey, w AS word, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE [lower(w)] END, ' ') AS parts FROM p""")
def camel_split(spark, sf_dir):
    """Names of parts in camel case, and the words that the index makes of them."""
    words = t(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.initcap("p_name"), " ", "").alias("word"))
    return words.withColumn("parts", F.array_join(tokens.camel_parts(F.col("word")), " "))


@query(f"""WITH w AS (SELECT p_partkey, translate(replace(lower(p_name), ' ', ''), '{_LATIN}', '{_HAN}') AS w FROM part)
 SELECT p_partkey, w AS word, array_to_string(CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END, ' ') AS parts FROM w""")
def cjk_bigrams(spark, sf_dir):
    """Names of parts in Han letters without blanks, and their bigrams."""
    words = t(spark, sf_dir, "part").select("p_partkey", F.translate(F.regexp_replace(F.lower("p_name"), " ", ""), _LATIN, _HAN).alias("word"))
    return words.withColumn("parts", F.array_join(tokens.cjk_parts(F.col("word")), " "))


@query(f"WITH {TOK} SELECT term, count(*) AS cf FROM tok GROUP BY term")
def term_frequencies(spark, sf_dir):
    return index.text_tokens(t(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


@query(f"WITH {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def document_frequency(spark, sf_dir):
    return index.lexicon(docs_index(spark, sf_dir).postings)


@query(f"WITH {TOK} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS places FROM tok GROUP BY term, doc_id")
def postings(spark, sf_dir):
    """All postings with all positions, those of frequent words in long texts too."""
    return docs_index(spark, sf_dir, None).postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"))


@query(f"""WITH {TOK}, n AS (SELECT term, doc_id, position, row_number() OVER (PARTITION BY term, doc_id ORDER BY position) AS n FROM tok)
 SELECT term, doc_id, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (WHERE n <= 200) AS places FROM n GROUP BY term, doc_id""")
def postings_first_200(spark, sf_dir):
    """All postings, the frequent words of long texts too, each with its first 200 positions."""
    return docs_index(spark, sf_dir).postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"))


@query(f"WITH {TOK} SELECT term, doc_id, least(count(*), 200) AS kept, count(*) AS tf FROM tok GROUP BY term, doc_id")
def postings_capped(spark, sf_dir):
    return docs_index(spark, sf_dir).postings.select("term", "doc_id", F.size("positions").cast("long").alias("kept"), "tf")


@query(r"""WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:''\p{L}+)*'))) AS form FROM documents)
 SELECT DISTINCT strip_accents(form) AS term, form, doc_id FROM w WHERE strip_accents(form) <> form""")
def variants(spark, sf_dir):
    toks = _doc_fields(spark, sf_dir)
    return index.variants(toks, index.word_forms(toks, stem=False), "doc_id")


@query(f"WITH {TOK} SELECT doc_id, count(*) AS word_count FROM tok GROUP BY doc_id")
def word_counts(spark, sf_dir):
    return index.word_counts(_doc_fields(spark, sf_dir), "doc_id")


def _doc_fields(spark, sf_dir):
    """Tokens of the documents as the builder's page tokens: one body field."""
    docs = index.spread(t(spark, sf_dir, "documents"), "doc_id")
    places = F.posexplode(F.transform(tokens.words(F.coalesce("text", F.lit("")), emoji=False), F.lower)).alias("position", "original")
    return docs.select("doc_id", F.col("lang").alias("language"), F.lit("body").alias("field"), places)


@query(f"""WITH {POST}, d AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS step, doc_id FROM post WHERE term IN {IN3})
 SELECT term, doc_id, step FROM d""")
def delta_postings(spark, sf_dir):
    from pyspark.sql.window import Window

    hits = search.term_hits(docs_index(spark, sf_dir), TERMS)
    before = F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id"))
    return hits.select("term", "doc_id", (F.col("doc_id") - before).alias("step"))


@query(f"WITH {TOK}, v AS (SELECT DISTINCT term FROM tok), n AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS n FROM v) SELECT n // 500 AS chunk, min(term) AS first_term, max(term) AS last_term, count(*) AS terms FROM n GROUP BY 1")
def term_chunk_directory(spark, sf_dir):
    return index.term_ranges(index.lexicon(docs_index(spark, sf_dir).postings), 500)


@query()
def stemmed_df(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    places = F.explode(F.array_distinct(F.transform(tokens.words(F.coalesce("text", F.lit("")), emoji=False), lambda w: tokens.fold_latin(F.lower(w))))).alias("term")
    terms = index.spread(docs, "doc_id").select("doc_id", "lang", places)
    return terms.withColumn("stem", stem_column(F.col("term"), F.col("lang"))).groupBy("lang", "stem").agg(F.countDistinct("doc_id").alias("df"))


@query(f"WITH {CLEAN} SELECT page_id, text FROM cleaned")
def html_unescape(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", clean.html_clean(F.col("html")).alias("text"))


@query(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
 SELECT conv_id, turn, coalesce(array_to_string(list_transform(l, lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;') || '</p>'), ''), '') AS html FROM l""")
def markdown_render(spark, sf_dir):
    """The given turns have paragraphs only; lists, stars and links are held by unit tests."""
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", clean.render_markdown(F.col("text")).alias("html"))


@query()
def page_index(spark, sf_dir):
    """The whole build over pages: items, cleaning, tokens, folds, stems, postings."""
    from ..sources.content import site_pages

    pages = index.prepare_pages(site_pages(index.spread(t(spark, sf_dir, "pages"), "page_id"))).withColumn("page_no", F.col("id").cast("long"))
    return index.page_postings(pages).select("term", "page_no", "tf", F.size("positions").alias("body"), F.size("title_positions").alias("in_title"))


# -- facets and sort orders ------------------------------------------------------------------------------------


@query(f"WITH {FACETS} SELECT dim, value, count(DISTINCT doc_id) AS count FROM facet GROUP BY dim, value")
def facet_counts(spark, sf_dir):
    return facet_bitmaps.total_counts(stored_bitmaps(spark, sf_dir))


@query(f"WITH {FACETS} SELECT dim, value, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM (SELECT DISTINCT * FROM facet) GROUP BY dim, value")
def facet_index(spark, sf_dir):
    return doc_facets(spark, sf_dir).distinct().groupBy("dim", "value").agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))


def _sortable(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source")).alias("all_sortable"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS INTEGER) AS rank, true AS is_numeric FROM documents")
def sort_index_numeric(spark, sf_dir):
    return index.sort_ranks(_sortable(spark, sf_dir), "doc_id").where("field = 'n_chars'").select("doc_id", "rank", "is_numeric")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS INTEGER) AS rank, false AS is_numeric FROM documents")
def sort_index_string(spark, sf_dir):
    return index.sort_ranks(_sortable(spark, sf_dir), "doc_id").where("field = 'source'").select("doc_id", "rank", "is_numeric")


# -- search ----------------------------------------------------------------------------------------------------


@query(f"WITH {POST} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN {IN3} GROUP BY doc_id HAVING count(*) = 3")
def and_search(spark, sf_dir):
    return search.and_search(search_index(spark, sf_dir), TERMS)


@query(f"WITH {POST} SELECT doc_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN {IN3} GROUP BY doc_id")
def or_search(spark, sf_dir):
    return search.or_search(search_index(spark, sf_dir), TERMS)


@query(f"""WITH {TOK}, p AS (SELECT doc_id, position, term FROM tok WHERE term IN ('of', 'the'))
 SELECT a.doc_id, count(*) AS phrases FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id""")
def phrase_search(spark, sf_dir):
    return search.phrase_search(search_index(spark, sf_dir), ["of", "the"])


@query(f"WITH {POST}, {FACETS} SELECT doc_id, tf FROM post WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM facet WHERE dim = 'source' AND value IN ('src1', 'src2')) AND doc_id IN (SELECT doc_id FROM facet WHERE dim = 'language' AND value = 'en')")
def filter_search(spark, sf_dir):
    hits = search.and_search(search_index(spark, sf_dir), ["the"])
    return search.filtered(hits, doc_facets(spark, sf_dir), {"source": ["src1", "src2"], "language": "en"}, "doc_id")


@query(f"WITH {POST} SELECT doc_id, tf, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS place FROM post JOIN documents USING (doc_id) WHERE term = 'the'")
def sorted_search(spark, sf_dir):
    ranks = index.sort_ranks(_sortable(spark, sf_dir), "doc_id").where("field = 'n_chars'")
    ordered = search.sort_hits(search.and_search(search_index(spark, sf_dir), ["the"]), ranks, {"n_chars": "desc"}, "doc_id", keep_rank=True)
    place = index.dense_numbers(ordered.select((-F.col("rank")).alias("down")), "down", "place", 1)
    return ordered.join(place, -F.col("rank") == F.col("down")).select("doc_id", "tf", "place")


@query(f"WITH {BM25} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf_dir):
    return search.top_k(search.bm25(search_index(spark, sf_dir), TERMS), 50, "doc_id")


@query(f"""WITH {BM25}, l AS (SELECT doc_id, score, lang FROM scored JOIN documents USING (doc_id)), a AS (SELECT doc_id, score FROM l WHERE lang IS DISTINCT FROM 'fr' UNION ALL SELECT doc_id, score * 0.5 FROM l WHERE lang IS DISTINCT FROM 'en')
 SELECT doc_id, round(max(score), 6) AS score FROM a GROUP BY doc_id""")
def federated_search(spark, sf_dir):
    """Two indexes by language that share some; every document is in one of them at least."""
    hits = search.bm25(search_index(spark, sf_dir), TERMS).join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    parts = [hits.where(f"not lang <=> '{lang}'") for lang in ("fr", "en")]
    return search.federate((parts[0], 1.0), (parts[1], 0.5), key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT lang AS language, count(*) AS page_count FROM documents GROUP BY lang ORDER BY CASE WHEN lang = 'de-at' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END, count(*) DESC, lang LIMIT 1")
def language_index_pick(spark, sf_dir):
    sizes = t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("page_count"))
    return search.pick_language(sizes, "de-AT")


# -- scoring ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, round(1 - (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY source) - 1.0), 6) AS base FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)")
def position_base_score(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return scoring.with_position_score(docs, [F.desc("n_chars"), F.col("doc_id")], ["source"]).select("doc_id", F.round("base", 6).alias("base"))


_SHARE = r"len(list_intersect(list_distinct(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:''\p{{L}}+)*'), lambda x: strip_accents(lower(x)))), ['the', 'of', 'and'])) / 3.0"


@query(f"SELECT page_id, round(CASE WHEN s >= 1 THEN 2.0 * 1.5 * s ELSE 2.0 * s END, 6) AS boost FROM (SELECT page_id, {_SHARE.format(TITLE)} AS s FROM pages)")
def title_boost(spark, sf_dir):
    title = clean.page_title(F.col("html"))
    return t(spark, sf_dir, "pages").select("page_id", F.round(scoring.match_boost(title, TERMS, 2.0, 1.5), 6).alias("boost"))


@query(f"SELECT page_id, CASE WHEN lower(trim({TITLE})) = 'the of and' THEN CAST(5.0 AS DOUBLE) ELSE 1.0 END AS factor FROM pages")
def exact_title(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", scoring.exact_title_factor(clean.page_title(F.col("html")), "The of AND").alias("factor"))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, position, lag(position) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM tok WHERE term IN {IN3})
 SELECT doc_id, CASE WHEN count(*) < 2 THEN CAST(1.0 AS DOUBLE) WHEN min(position - before) <= 1 THEN 2.5 WHEN min(position - before) <= 5 THEN 1.5 ELSE 1.0 END AS factor FROM p GROUP BY doc_id""")
def phrase_proximity(spark, sf_dir):
    toks = index.text_tokens(t(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("term").isin(TERMS))
    places = toks.groupBy("doc_id").agg(F.collect_list("position").alias("places"))
    return places.select("doc_id", scoring.phrase_factor(F.col("places")).alias("factor"))


@query("""SELECT o_orderkey, round(0.25 * pow(2.0, -a / 365.0) - CASE WHEN a > 1825 THEN least(0.3, 0.3 * (a - 1825) / 1825.0) ELSE 0 END, 6) AS recency
 FROM (SELECT o_orderkey, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01'), 0) AS a FROM orders)""")
def recency_decay(spark, sf_dir):
    day = F.lit("2000-01-01").cast("date")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(scoring.recency(F.col("o_orderdate").cast("date"), day), 6).alias("recency"))


# -- merging ---------------------------------------------------------------------------------------------------

_LISTED = f"""listed AS (SELECT url, {TITLE} AS title, (page_id % 97) / 97.0 AS score, 0 AS list FROM pages WHERE NOT contains(url, '/fr/')
 UNION ALL SELECT url, {TITLE}, (page_id % 89) / 89.0 * 0.8, 1 FROM pages WHERE NOT contains(url, '/en/'))"""
_KEY = r"regexp_replace(regexp_replace(lower(url), '\.html$', ''), '/+$', '')"


def _lists(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select("page_id", "url", clean.page_title(F.col("html")).alias("title"))
    # lists by language that share some; every page is in one of them at least
    a = pages.where(~F.col("url").contains("/fr/")).select("url", "title", (F.pmod("page_id", F.lit(97)) / 97.0).alias("score"))
    b = pages.where(~F.col("url").contains("/en/")).select("url", "title", (F.pmod("page_id", F.lit(89)) / 89.0).alias("score"))
    return [(a, 1.0), (b, 0.8)]


@query(f"WITH {_LISTED} SELECT {_KEY} AS url_key, round(max(score) + CASE WHEN count(DISTINCT list) > 1 THEN 0.05 ELSE 0 END, 6) AS score, count(DISTINCT list) AS lists FROM listed GROUP BY 1")
def merge_results(spark, sf_dir):
    return merge.merge_results(_lists(spark, sf_dir)).select("url_key", "score", "lists")


@query(f"SELECT {_KEY} AS url_key, count(*) AS urls FROM pages GROUP BY 1")
def url_dedupe(spark, sf_dir):
    return t(spark, sf_dir, "pages").groupBy(urls.dedupe_key(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("urls"))


@query(rf"""WITH r AS (SELECT page_id, (page_id % 97) / 97.0 AS score, list_distinct(list_filter(regexp_split_to_array(lower({TITLE}), '[^0-9a-z_]+'), lambda x: length(x) >= 2)) AS w FROM pages ORDER BY score DESC, page_id LIMIT 100)
 SELECT page_id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE (b.score > a.score OR b.score = a.score AND b.page_id < a.page_id) AND len(list_intersect(a.w, b.w)) > 0
 AND len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) >= 0.6)""")
def title_jaccard_dedupe(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select("page_id", clean.page_title(F.col("html")).alias("title"), (F.pmod("page_id", F.lit(97)) / 97.0).alias("score"))
    return merge.title_dedupe(pages, 100, key="page_id").select("page_id")


def _scored(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("url"), "source", (F.pmod(F.col("doc_id") * 37, F.lit(1009)) / 1009.0).alias("score"))


@query("SELECT doc_id AS url, (doc_id * 37 % 1009) / 1009.0 AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def summary_union(spark, sf_dir):
    return merge.summary_union(_scored(spark, sf_dir), 20).select("url", "score")


@query("""WITH s AS (SELECT doc_id AS url, source, (doc_id * 37 % 1009) / 1009.0 AS score FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, url) AS place, max(score) OVER (PARTITION BY source) AS strength FROM s)
 SELECT url, source, place FROM p ORDER BY (place - 1) // 3, strength DESC, source, place LIMIT 20""")
def summary_round_robin(spark, sf_dir):
    return merge.summary_round_robin(_scored(spark, sf_dir), 20, "", term="source").select("url", "source", F.col("place").cast("long").alias("place"))


# -- expansion -------------------------------------------------------------------------------------------------


@query(f"""WITH {POST}, lex AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM post)
 SELECT phrase, word, coalesce(df, 0) AS df, coalesce(df, 0) / CAST(n AS DOUBLE) < 0.3 OR word IN ('the') AND word NOT IN ('of') AS admitted
 FROM (VALUES ('of the', 'of'), ('of the', 'the'), ('edst and zzz', 'edst'), ('edst and zzz', 'and'), ('edst and zzz', 'zzz')) v(phrase, word) LEFT JOIN lex ON term = word, n""")
def subword_guard(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    return expansion.subword_guard(ix.lexicon(), ["of the", "edst and zzz", "single"], ix.stats().first()[0], 0.3, typed=["the", "of"], denied=["of"])


@query(f"WITH {POST}, n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM post) SELECT term, round(greatest(0.15, ln(n / df) / ln(n)), 6) AS specificity FROM (SELECT term, count(*) AS df FROM post GROUP BY term), n")
def specificity(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    total = ix.stats().first()[0]
    return ix.lexicon().select("term", F.round(expansion.specificity(F.col("df"), F.lit(float(total))), 6).alias("specificity"))


@query(f"""WITH {BM25}, sp(term, specificity) AS (VALUES ('with', 0.6), ('from', 0.5)), ag AS (SELECT post.doc_id, specificity, row_number() OVER (PARTITION BY post.doc_id ORDER BY specificity DESC, sp.term) - 1 AS k FROM post JOIN sp ON post.term = sp.term JOIN scored ON scored.doc_id = post.doc_id),
 b AS (SELECT doc_id, sum(0.2 * pow(0.5, k) * specificity) AS bonus FROM ag GROUP BY doc_id) SELECT doc_id, round(score + coalesce(bonus, 0), 6) AS score FROM scored LEFT JOIN b USING (doc_id)""")
def agreement_bonus(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    agree = search.term_hits(ix, ["with", "from"]).select("doc_id", "term", F.when(F.col("term") == "with", 0.6).otherwise(0.5).alias("specificity"))
    return expansion.agreement_bonus(search.bm25(ix, TERMS), agree, page_col="doc_id").select("doc_id", "score")


# -- facet policies --------------------------------------------------------------------------------------------


@query(f"WITH {POST}, {FACETS} SELECT dim, value, count(DISTINCT doc_id) AS count FROM facet WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'the') AND doc_id IN (SELECT doc_id FROM facet WHERE dim = 'language' AND value = 'en') GROUP BY dim, value")
def facet_structural(spark, sf_dir):
    hits = search.and_search(search_index(spark, sf_dir), ["the"])
    return facet_bitmaps.structural_counts(hit_set(hits), stored_bitmaps(spark, sf_dir), {"language": ["en"], "source": ["src1"]}, facets.STRUCTURAL)


@query(f"WITH {POST}, {FACETS} SELECT dim, value, count(DISTINCT doc_id) AS count FROM facet WHERE doc_id IN (SELECT doc_id FROM post WHERE term IN ('der', 'les')) GROUP BY dim, value")
def facet_or_union(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    found = facet_bitmaps.union(*(hit_set(search.and_search(ix, [word])) for word in ("der", "les")))
    return facet_bitmaps.counts(found, stored_bitmaps(spark, sf_dir))


@query(f"WITH {POST}, {FACETS} SELECT dim, value, count(DISTINCT doc_id) AS count FROM facet WHERE doc_id IN (SELECT doc_id FROM post WHERE term IN ('with', 'from')) GROUP BY dim, value")
def facet_expansion_delta(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    typed, more = (hit_set(search.and_search(ix, [word])) for word in ("with", "from"))
    return facet_bitmaps.expansion_counts(typed, more, stored_bitmaps(spark, sf_dir))


@query("WITH f AS (SELECT DISTINCT doc_id, unnest([lang, source, lang]) AS value FROM documents) SELECT 'tag' AS dim, value, count(DISTINCT doc_id) AS count FROM f GROUP BY value")
def facet_multivalue(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("tag"), F.array("lang", "source", "lang")).alias("all_filters"))
    return facets.total_counts(index.facet_rows(docs, "doc_id"), "doc_id")


@query(f"""WITH {FACETS}, v AS (SELECT DISTINCT dim, value FROM facet WHERE dim <> 'language'), h AS (SELECT dim, value, CASE WHEN lower(value) = 'src12' THEN 0 WHEN length(value) > 2 AND (contains(lower(value), 'src12') OR contains('src12', lower(value))) THEN 1 END AS l FROM v)
 SELECT dim, value, 'src12' AS subject FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY l, value) AS n FROM h WHERE l IS NOT NULL) WHERE n = 1""")
def subject_filter_match(spark, sf_dir):
    return facets.subject_filters(doc_facets(spark, sf_dir), ["SRC12", "xy"])


@query(f"""WITH {POST}, {FACETS}, u AS (SELECT DISTINCT doc_id FROM post WHERE term IN {IN3}), c AS (SELECT value AS source, count(*) AS filtered FROM facet WHERE dim = 'source' AND doc_id IN (SELECT doc_id FROM u) GROUP BY value)
 SELECT source, filtered, filtered >= 5 AND filtered >= 0.1 * (SELECT count(*) FROM u) AS kept FROM c""")
def filter_recall_guard(spark, sf_dir):
    hits = search.or_search(search_index(spark, sf_dir), TERMS)
    union = hits.count()
    counts = facets.facet_counts(hits, doc_facets(spark, sf_dir), "doc_id").where("dim = 'source'")
    return counts.select(F.col("value").alias("source"), F.col("count").alias("filtered"), ((F.col("count") >= 5) & (F.col("count") >= 0.1 * union)).alias("kept"))


# -- excerpts and contracts ------------------------------------------------------------------------------------


@query(rf"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\s\x{{200B}}]+'), lambda x: x <> '') AS w FROM benchmark)
 SELECT item_id, array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) IN {IN3} THEN '<mark>' || x || '</mark>' ELSE x END), ' ') AS marked FROM w""")
def highlight(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", snippets.highlight(F.col("text"), TERMS).alias("marked"))


@query(f"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), p AS (SELECT item_id, unnest(range(len(w))) AS i, w FROM w), h AS (SELECT item_id, i, len(w) AS n, CASE WHEN lower(w[i + 1]) IN {IN3} THEN 1 ELSE 0 END AS s FROM p),
 a AS (SELECT x.item_id, x.i AS a, sum(y.s) AS s FROM h x JOIN h y ON x.item_id = y.item_id AND y.i >= x.i AND y.i < x.i + 8 WHERE x.i <= greatest(x.n - 8, 0) GROUP BY ALL), m AS (SELECT item_id, max(s) AS s FROM a GROUP BY item_id), b AS (SELECT a.item_id, min(a.a) AS first FROM a JOIN m ON a.item_id = m.item_id AND a.s = m.s GROUP BY ALL),
 g AS (SELECT a.item_id, a.a, a.a - row_number() OVER (PARTITION BY a.item_id ORDER BY a.a) AS g FROM a JOIN m ON a.item_id = m.item_id AND a.s = m.s)
 SELECT b.item_id, CAST((b.first + max(g.a)) // 2 AS INTEGER) AS start FROM b JOIN g ON g.item_id = b.item_id WHERE g.g = (SELECT min(g2.g) FROM g g2 WHERE g2.item_id = b.item_id) GROUP BY b.item_id, b.first""")
def excerpt_window(spark, sf_dir):
    items = t(spark, sf_dir, "benchmark").withColumn("w", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    places = F.filter(F.transform("w", lambda w, i: F.when(F.lower(w).isin(TERMS), i)), lambda i: i.isNotNull())
    items = items.withColumn("places", places)
    return items.select("item_id", snippets.excerpt_start(F.col("places"), F.transform("places", lambda p: F.lit(1.0)), F.size("w"), 8).alias("start"))


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'with') AS p FROM documents), s AS (SELECT doc_id, text, p, greatest(2001, p - 500) AS a, least(length(text), p + 500) AS b FROM p)
 SELECT doc_id, CASE WHEN length(text) <= 6000 THEN text WHEN p > 2000 THEN substr(substr(text, 1, 2000) || chr(10) || '...' || chr(10) || substr(text, a, b - a + 1), 1, 6000) ELSE substr(text, 1, 2000) END AS context FROM s""")
def extract_context(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", snippets.extract_context(F.col("text"), ["with"]).alias("context"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\+?\d[\d ().-]{7,}\d', '[PHONE]', 'g') AS text FROM conversations""")
def sanitize_query(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", contracts.sanitize_query(F.col("text")).alias("text"))


@query("""WITH n AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
 h AS (SELECT *, sum(CASE WHEN n < 2 THEN l ELSE 0 END) OVER (PARTITION BY conv_id) AS head, CASE WHEN n >= 2 THEN (n - 2) // 2 END AS unit FROM n)
 SELECT conv_id, turn FROM h a WHERE n < 2 OR head + (SELECT sum(l) FROM h b WHERE b.conv_id = a.conv_id AND b.unit >= a.unit) <= 600""")
def truncate_conversation(spark, sf_dir):
    return contracts.truncate_conversations(t(spark, sf_dir, "conversations"), max_length=600).select("conv_id", "turn")


@query("""SELECT conv_id, count(*) AS messages, CAST(CASE WHEN count(*) < 2 THEN 0 ELSE (count(*) - 2) // 2 END AS INTEGER) AS follow_ups,
 CASE WHEN NOT bool_and(role IN ('user', 'assistant') AND trim(text) <> '' AND length(text) <= 10000) OR arg_max(role, turn) <> 'user' THEN 400 WHEN CASE WHEN count(*) < 2 THEN 0 ELSE (count(*) - 2) // 2 END >= 3 THEN 429 ELSE 200 END AS status FROM conversations GROUP BY conv_id""")
def follow_up_validation(spark, sf_dir):
    return contracts.follow_up_status(t(spark, sf_dir, "conversations"))


@query("SELECT item_id, 'a ' || item_id || '|b' AS terms FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 1")
def parse_expansion(spark, sf_dir):
    items = t(spark, sf_dir, "benchmark")
    response = F.when(F.pmod("item_id", F.lit(2)) == 0, F.concat(F.lit('```json\n{"terms": ["a '), F.col("item_id").cast("string"), F.lit('", "b"]}\n```'))).otherwise('["one"]')
    return items.select("item_id", F.array_join(contracts.expansion_terms(response, F.col("text")), "|").alias("terms"))


# -- incremental -----------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def cdc_latest(spark, sf_dir):
    return incremental.latest_actions(t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT reused, count(*) AS items FROM (SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 > 0) AS reused FROM documents) GROUP BY reused")
def incremental_reuse(spark, sf_dir):
    items = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_key"))
    hits, misses = incremental.split_by_cache(items, items.where("doc_id % 3 > 0"))
    both = hits.withColumn("reused", F.lit(True)).unionByName(misses.withColumn("reused", F.lit(False)))
    return both.groupBy("reused").agg(F.count(F.lit(1)).alias("items"))


@query("SELECT count(*) AS kept FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE source IN ('src1', 'src2'))")
def cache_prune(spark, sf_dir):
    cache = t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("content_key"))
    return incremental.prune(cache, cache.where("source in ('src1', 'src2')"), "content_key").agg(F.count(F.lit(1)).alias("kept"))


from . import catalogue_index, catalogue_parts  # noqa: E402, F401  add their queries
