"""Queries over the index structures: segments, facet bitmaps, postings in blocks, and the SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.register import register
from ..operators import hash_tree, index, lattice, prefix, search, topk
from ..operators.segments import SegmentFamily
from ..streaming.change_log import ChangeLog
from ..streaming.incremental import latest_actions
from .catalogue import BM25, CLEAN, IN3, PORTABLE, POST, TERMS, TITLE, query, search_index, search_index_path, t
from .memo import memoised
from .session import is_stored, shared_folder, source_version

# -- segments --------------------------------------------------------------------------------------------------

#: What the family has seen: all documents, then those of two sources anew with one more word, then the deletion of a language's.
_LIVE = r"""live AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN coalesce(text, '') || ' anew' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'),
 tok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS position, strip_accents(lower(unnest(w))) AS term FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:''\p{L}+)*') AS w FROM live)),
 post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id)"""


def family(spark, sf_dir) -> SegmentFamily:
    """The stored family of the documents' files: three versions, made when they are first asked for or the files have changed."""
    docs = t(spark, sf_dir, "documents")
    path = f"{shared_folder(spark).rstrip('/')}/segments/{source_version(docs)}"
    fs, done = _path(spark, f"{path}/manifests/{3:012d}.json")
    if not fs.exists(done):
        fs.delete(_path(spark, path)[1], True)
        made = SegmentFamily.create(spark, path, "doc_id", "text")
        made.add(docs)
        made.add(docs.where("source in ('src1', 'src2')").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" anew")).alias("text")))
        made.delete(docs.where("lang = 'fr'"))
    return SegmentFamily.open(spark, path)


def _path(spark, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@query(f"WITH {_LIVE} SELECT doc_id, tf FROM post WHERE term = 'anew'")
def segment_search(spark, sf_dir) -> DataFrame:
    """A word that only replaced documents have, among those still live."""
    return search.and_search(family(spark, sf_dir).index(), ["anew"])


@query(f"""WITH {_LIVE}, st AS (SELECT count(*) AS n, avg(length) AS a FROM len), hit AS (SELECT * FROM post WHERE term IN {IN3}), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM hit JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id""")
def segment_bm25(spark, sf_dir) -> DataFrame:
    """Scores of all live documents: frequencies and lengths are those of a full build."""
    return search.bm25(family(spark, sf_dir).index(), TERMS)


@query(f"WITH {_LIVE} SELECT term, count(*) AS df FROM post GROUP BY term")
def segment_lexicon(spark, sf_dir) -> DataFrame:
    return family(spark, sf_dir).index().lexicon()


# -- postings in blocks ----------------------------------------------------------------------------------------


def impacts(spark, sf_dir) -> str:
    """The folder of the stored postings by impact: made when they are first asked for or the documents' files have changed."""
    path = f"{shared_folder(spark).rstrip('/')}/impacts/{source_version(t(spark, sf_dir, 'documents'))}"
    if not is_stored(spark, path):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # impacts have no positions, so the index with all of them is read if it is there, but not built for this
        is_there = is_stored(spark, search_index_path(spark, sf_dir))
        topk.store_impacts(search_index(spark, sf_dir) if is_there else _dealt(spark, sf_dir, partitions), path, partitions)
    return path


def _dealt(spark, sf_dir, partitions: int) -> index.TextIndex:
    """The documents' index by texts that are dealt out by their ids: postings and lengths need no shuffle of their own, nor to meet."""
    toks = index.text_tokens(t(spark, sf_dir, "documents").select("doc_id", "text").repartition(partitions, "doc_id"), "doc_id", "text")
    return index.TextIndex(toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("length")), index.term_postings(toks, "doc_id"), "doc_id")


_FOUR = "('der', 'with', 'les', 'and')"


@query(f"WITH {BM25} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 50")
def bm25_blockmax(spark, sf_dir) -> DataFrame:
    """The rows of ``bm25_topk``; blocks that can't have them aren't read."""
    return topk.best_pages(spark, impacts(spark, sf_dir), TERMS, 50)[0]


@query(f"WITH {BM25.replace(IN3, _FOUR)} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_blockmax_languages(spark, sf_dir) -> DataFrame:
    """Terms that hardly meet in a document."""
    return topk.best_pages(spark, impacts(spark, sf_dir), ["der", "with", "les", "and"], 20)[0]


@query(f"WITH {POST} SELECT doc_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN ('der', 'les') GROUP BY doc_id")
def memoised_search(spark, sf_dir) -> DataFrame:
    """A search asked for twice; the second time, its kept rows."""
    ask = lambda words: search.or_search(search_index(spark, sf_dir), words)
    memoised(ask(["der", "les"]))
    return memoised(ask(["les", "der"]))[0]


# -- prefixes and diacritics -----------------------------------------------------------------------------------


def form_index(spark, sf_dir) -> prefix.FormIndex:
    """The stored forms of the documents: made when they are first asked for or the documents' files have changed."""
    docs = t(spark, sf_dir, "documents")
    path = f"{shared_folder(spark).rstrip('/')}/forms/{source_version(docs)}"
    if not is_stored(spark, path):
        prefix.FormIndex.of(docs, "doc_id", "text").store(path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return prefix.FormIndex.stored(spark, path, "doc_id")


_FORMS = r"""w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:''\p{L}+)*'))) AS form FROM documents),
 fp AS (SELECT doc_id, form, strip_accents(form) AS term, count(*) AS tf FROM w GROUP BY ALL), len AS (SELECT doc_id, sum(tf) AS length FROM fp GROUP BY doc_id),
 st AS (SELECT count(*) AS n, avg(length) AS a FROM len), q(word, term, typed) AS (VALUES (0, 'la', 'la'), (1, 'el', 'él'), (2, 'ver', 'ver'), (3, 'thth', 'thth'))"""
_WEIGHTED = """m AS (SELECT doc_id, word, sum(tf * pow(length(q.term) / CAST(length(fp.term) AS DOUBLE), {ts}) * CASE WHEN {exact} THEN 1.0 ELSE 1 / (1 + {ds}) END) AS tf FROM fp JOIN q ON {match} GROUP BY ALL),
 d AS (SELECT word, count(*) AS df FROM m GROUP BY word)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM m JOIN d USING (word) JOIN len USING (doc_id), st GROUP BY doc_id"""
_TYPED = ["la", "él", "ver", "thth"]


@query(f"WITH {_FORMS}, {_WEIGHTED.format(ts=1.0, ds=0.8, exact='starts_with(form, typed)', match='starts_with(fp.term, q.term)')}")
def prefix_search(spark, sf_dir) -> DataFrame:
    """Nearer terms and the typed diacritics rank higher."""
    return prefix.prefix_bm25(form_index(spark, sf_dir), _TYPED)


@query(f"WITH {_FORMS}, {_WEIGHTED.format(ts=0.0, ds=3.0, exact='form = typed', match='fp.term = q.term')}")
def diacritic_search(spark, sf_dir) -> DataFrame:
    """Whole words; other diacritics count for a quarter."""
    return prefix.prefix_bm25(form_index(spark, sf_dir), _TYPED, search.Ranking(term_similarity=0.0, diacritic_similarity=3.0), whole=True)


# -- words in writing without blanks ---------------------------------------------------------------------------

_LATTICE = r"""RECURSIVE lex AS (SELECT w AS word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) WHERE length(w) <= 24 GROUP BY w),
 cost AS (SELECT word, CAST(round(1000 * ln(CAST((SELECT sum(df) FROM lex) AS DOUBLE) / df)) AS BIGINT) AS cost FROM lex), dear AS (SELECT max(cost) + 2000 AS u FROM cost),
 clause AS (SELECT page_id, generate_subscripts(l, 1) AS no, unnest(l) AS run FROM (SELECT page_id, list_transform(regexp_extract_all(lower(title), '[\p{L} ]+'), lambda x: replace(x, ' ', '')) AS l FROM (SELECT page_id, {TITLE} AS title FROM pages))),
 runs AS (SELECT DISTINCT run FROM clause WHERE run <> ''),
 cand AS (SELECT run, s, k, substr(run, s + 1, k) AS w FROM (SELECT run, unnest(range(0, length(run))) AS s FROM runs), range(1, 25) r(k) WHERE s + k <= length(run)),
 edges AS (SELECT run, s + k AS i, list({'s': s, 'c': cost, 'w': w}) AS e FROM cand JOIN cost ON word = w GROUP BY ALL),
 dp AS (SELECT run, CAST(0 AS BIGINT) AS i, [{'c': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'l': CAST(0 AS BIGINT), 'p': ''}] AS b FROM runs
  UNION ALL SELECT d.run, d.i + 1, list_append(d.b[-23:], list_sort(list_append(list_transform(coalesce(e.e, []), lambda x: {'c': d.b[len(d.b) - (d.i - x.s)].c + x.c, 'n': d.b[len(d.b) - (d.i - x.s)].n + 1,
   'l': -CAST(length(x.w) AS BIGINT), 'p': d.b[len(d.b) - (d.i - x.s)].p || ' ' || x.w}), {'c': d.b[-1].c + u, 'n': d.b[-1].n + 1, 'l': CAST(-1 AS BIGINT), 'p': d.b[-1].p || ' ' || substr(d.run, d.i + 1, 1)}))[1])
  FROM dp d LEFT JOIN edges e ON e.run = d.run AND e.i = d.i + 1, dear WHERE d.i < length(d.run))""".replace("{TITLE}", TITLE)


def word_lexicon(spark, sf_dir) -> DataFrame:
    """The stored lexicon of the documents' words: made when it is first asked for or the documents' files have changed."""
    docs = t(spark, sf_dir, "documents")
    path = f"{shared_folder(spark).rstrip('/')}/lexicon/{source_version(docs)}"
    if not is_stored(spark, path):
        own = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        lattice.lexicon(own, "doc_id").write.mode("overwrite").parquet(f"{path}/pages")
    return spark.read.parquet(f"{path}/pages")


def _segmented(spark, sf_dir, rows: DataFrame, *keys: str) -> DataFrame:
    """The clauses of texts with their blanks taken out, and the words that the documents' lexicon makes of them."""
    parts = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L} ]+"), F.lit(0)), lambda x: F.regexp_replace(x, " ", ""))
    clauses = rows.select(*keys, F.posexplode(parts).alias("no", "run")).withColumn("no", F.col("no").cast("long") + 1)
    words = lattice.segment_runs(clauses, word_lexicon(spark, sf_dir))
    return clauses.join(words, "run").select(*keys, "no", F.array_join("words", " ").alias("words"))


@query(f"WITH {_LATTICE} SELECT page_id, no, substr(b[-1].p, 2) AS words FROM clause JOIN dp USING (run) WHERE i = length(run)")
def lattice_words(spark, sf_dir) -> DataFrame:
    """The titles of all pages without blanks, in words again."""
    return _segmented(spark, sf_dir, t(spark, sf_dir, "pages").select("page_id", clean.page_title(F.col("html")).alias("text")), "page_id")


@query()
def lattice_clauses(spark, sf_dir) -> DataFrame:
    """The same of all conversations. The SQL of titles gives the same rows here, but takes minutes; tests hold the operator against all ways to cut."""
    return _segmented(spark, sf_dir, t(spark, sf_dir, "conversations"), "conv_id", "turn")


# -- the change log --------------------------------------------------------------------------------------------


@query("SELECT content_id, action, changed_at FROM (SELECT CAST(user_id AS VARCHAR) AS content_id, event_type AS action, ts AS changed_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events) WHERE n = 1")
def change_log_latest(spark, sf_dir) -> DataFrame:
    """All events as a log of segments, streamed by the data source; the last action of each user."""
    events = t(spark, sf_dir, "events")
    base = f"{shared_folder(spark).rstrip('/')}/change-log/{source_version(events)}"
    if not is_stored(spark, f"{base}/done"):
        fs, path = _path(spark, base)
        fs.delete(path, True)
        log = ChangeLog(spark, f"{base}/log")
        rows = events.select(F.col("user_id").cast("string").alias("content_id"), F.lit("user").alias("content_type"), F.col("event_type").alias("action"), F.col("ts").alias("changed_at"))
        for kinds in (F.col("action") == "view", F.col("action") == "click", ~F.coalesce(F.col("action").isin("view", "click"), F.lit(False))):
            log.append(rows.where(kinds))
        out = log.stream("catalogue").writeStream.format("parquet").option("path", f"{base}/read").option("checkpointLocation", f"{base}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
        spark.range(1).write.mode("overwrite").parquet(f"{base}/done/pages")
    return latest_actions(spark.read.parquet(f"{base}/read")).select("content_id", "action", "changed_at")


# -- the hash tree ---------------------------------------------------------------------------------------------

_SUMS = ", ".join(f"CAST(sum(CAST(('0x' || substr(r, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"""WITH r AS (SELECT doc_id, sha256(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(sha256(text), '-'))) AS r FROM documents),
 l AS (SELECT doc_id >> 4 AS node, sha256(concat_ws(':', {_SUMS}, CAST(count(*) AS VARCHAR))) AS hash, count(*) AS items FROM r GROUP BY 1)
 SELECT 0 AS level, node, hash, items FROM l UNION ALL SELECT 1, node >> 8, sha256(string_agg(node || '=' || hash, ',' ORDER BY node)), CAST(sum(items) AS BIGINT) FROM l GROUP BY node >> 8""")
def fingerprint_tree(spark, sf_dir) -> DataFrame:
    """Leaves of 16 ids and the level above them."""
    return hash_tree.hash_tree(t(spark, sf_dir, "documents"), "doc_id", "text", 16).where("level < 2")


@query("SELECT doc_id FROM documents WHERE doc_id >> 4 IN (SELECT doc_id >> 4 FROM documents WHERE source = 'src1' AND lang = 'en')")
def changed_ranges(spark, sf_dir) -> DataFrame:
    """The documents that a build reads again when some of a source's texts have changed: those of the leaves that differ."""
    docs = t(spark, sf_dir, "documents")
    now = docs.withColumn("text", F.when(F.expr("source = 'src1' and lang = 'en'"), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    base = f"{shared_folder(spark).rstrip('/')}/hash-tree/{source_version(docs)}"
    before, after = (hash_tree.stored(hash_tree.hash_tree(rows, "doc_id", "text", 16), f"{base}-{name}") for rows, name in ((docs, "before"), (now, "after")))
    leaves = hash_tree.changed(before, after, 16)
    return hash_tree.documents_of(now, "doc_id", leaves, 16).select("doc_id")


# -- SQL functions ---------------------------------------------------------------------------------------------


@query(f"WITH {CLEAN} SELECT page_id, text FROM cleaned")
def sql_html_clean(spark, sf_dir) -> DataFrame:
    register(spark)
    t(spark, sf_dir, "pages").createOrReplaceTempView("tidewell_pages")
    return spark.sql("SELECT page_id, html_clean(html, '') AS text FROM tidewell_pages")


@query(f"SELECT page_id, {PORTABLE} AS portable FROM pages UNION ALL SELECT page_id, {PORTABLE} FROM (SELECT page_id, regexp_replace(url, '^([a-z]+://[^/]*)/.*$', '\\1?page=' || page_id) AS url FROM pages)")
def sql_url_portable(spark, sf_dir) -> DataFrame:
    """URLs as they are, and hosts with nothing but a query behind them."""
    register(spark)
    t(spark, sf_dir, "pages").createOrReplaceTempView("tidewell_pages")
    return spark.sql(r"""SELECT page_id, url_portable(url) AS portable FROM tidewell_pages UNION ALL SELECT page_id, url_portable(concat(regexp_extract(url, r"^([a-z]+://[^/]*)/", 1), "?page=", page_id)) FROM tidewell_pages""")


_TOKENS = r"""word AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:''\p{L}+)*') AS l FROM documents)),
 split AS (SELECT doc_id, i, w, list_filter(list_transform(string_split(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2) AS p FROM word),
 part AS (SELECT doc_id, i, generate_subscripts(p, 1) AS k, unnest(p) AS token FROM (SELECT doc_id, i, CASE WHEN len(p) > 0 THEN p ELSE [lower(w)] END AS p FROM split))"""


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS position, token FROM part")
def sql_tokenize(spark, sf_dir) -> DataFrame:
    """The engine's tokens from SQL, camel case split."""
    register(spark)
    t(spark, sf_dir, "documents").createOrReplaceTempView("tidewell_documents")
    return spark.sql("SELECT doc_id, pos AS position, col AS token FROM (SELECT doc_id, tokenize(text) AS words FROM tidewell_documents) LATERAL VIEW posexplode(words) p AS pos, col")
