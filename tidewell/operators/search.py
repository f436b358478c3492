"""Retrieval: AND, OR fallback, phrase, filters, sort, BM25, federation, language choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import TextIndex


@dataclass(frozen=True)
class Ranking:
    """Weights of the BM25 form (the common published one; every number is a parameter)."""

    saturation: float = 1.2  # k1
    page_length: float = 0.75  # b
    meta_boost: float = 1.0
    index_weight: float = 1.0
    term_similarity: float = 1.0  # of prefixes, in ``prefix``: 0 lets longer words count in full
    diacritic_similarity: float = 0.8  # of forms with other diacritics: 0 lets them count in full


def term_hits(index: TextIndex, terms: list[str]) -> DataFrame:
    """Postings of the terms: the literals reach the scan of a stored index."""
    return index.postings.where(F.col("term").isin(sorted(set(terms))))


def and_search(index: TextIndex, terms: list[str]) -> DataFrame:
    """Pages with every term, and their total of occurrences."""
    wanted = sorted(set(terms))
    return term_hits(index, wanted).groupBy(index.page_col).agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("tf")).where(F.col("matched") == len(wanted)).select(index.page_col, "tf")


def or_search(index: TextIndex, terms: list[str]) -> DataFrame:
    """Pages with any term: how many different ones, and their total of occurrences."""
    return term_hits(index, terms).groupBy(index.page_col).agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("tf"))


def search_or_fallback(index: TextIndex, terms: list[str], exact: bool = False) -> tuple[str, DataFrame]:
    """AND; only if that finds nothing, there is more than one term and no quotes, OR."""
    if exact:
        return "phrase", phrase_search(index, terms)
    hits = and_search(index, terms)
    if len(set(terms)) > 1 and hits.isEmpty():
        return "or", or_search(index, terms).select(index.page_col, "tf")
    return "and", hits


def phrase_search(index: TextIndex, terms: list[str]) -> DataFrame:
    """Pages where the terms stand next to each other in order, and how often."""
    offsets = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.array(*[F.lit(i) for i, u in enumerate(terms) if u == t]))])
    hits = term_hits(index, terms).select(index.page_col, F.explode(F.element_at(offsets, F.col("term"))).alias("offset"), "positions")
    starts = hits.select(index.page_col, "offset", F.explode("positions").alias("p")).select(index.page_col, (F.col("p") - F.col("offset")).alias("start"), "offset")
    return starts.groupBy(index.page_col, "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).groupBy(index.page_col).agg(F.count(F.lit(1)).alias("phrases"))


def filter_pages(facets: DataFrame, wanted: dict[str, list[str] | str], page_col: str = "page_no") -> DataFrame:
    """Pages that meet all dimensions; values of one dimension are alternatives."""
    condition: Column = F.lit(False)
    for dim, values in wanted.items():
        condition = condition | ((F.col("dim") == dim) & F.col("value").isin([values] if isinstance(values, str) else list(values)))
    return facets.where(condition).groupBy(page_col).agg(F.countDistinct("dim").alias("dims")).where(F.col("dims") == len(wanted)).select(page_col)


def filtered(hits: DataFrame, facets: DataFrame, wanted: dict, page_col: str = "page_no") -> DataFrame:
    return hits.join(filter_pages(facets, wanted, page_col), page_col, "left_semi") if wanted else hits


def sort_hits(hits: DataFrame, ranks: DataFrame, sort: dict[str, str], page_col: str = "page_no", keep_rank: bool = False) -> DataFrame:
    """By the first named field; pages without it come last. An unknown direction is an error."""
    if not sort:
        return hits
    field, direction = next(iter(sort.items()))
    if direction not in ("asc", "desc"):
        raise ValueError(f"sort direction {direction!r} is neither asc nor desc")
    order = F.col("rank").asc_nulls_last() if direction == "asc" else F.col("rank").desc_nulls_last()
    ordered = hits.join(ranks.where(F.col("field") == field).select(page_col, "rank"), page_col, "left").orderBy(order, page_col)
    return ordered if keep_rank else ordered.drop("rank")


def bm25(index: TextIndex, terms: list[str], ranking: Ranking = Ranking(), verbose: bool = False) -> DataFrame:
    """Score of every page with a term. verbose: a row for each page and term with the parts of its score."""
    hits = term_hits(index, terms)
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("pages_containing_term"))  # a row for each query term
    rows = hits.join(spread, "term").join(index.pages, index.page_col)
    total, mean = index.stats().first()
    n, tf = F.col("pages_containing_term"), F.col("tf")
    idf = F.log(1 + (F.lit(total) - n + 0.5) / (n + 0.5))
    bonus = 1 - ranking.page_length + ranking.page_length * F.col("length") / F.lit(float(mean or 1))
    saturating = tf * (ranking.saturation + 1) / (tf + ranking.saturation * bonus)
    rows = rows.withColumns({"idf": idf, "length_bonus": bonus, "saturating_tf": saturating, "weighted": idf * saturating * ranking.index_weight})
    if verbose:
        return rows
    return rows.groupBy(index.page_col).agg(F.round(F.sum("weighted"), 6).alias("score"))


def top_k(hits: DataFrame, k: int, page_col: str = "page_no", score: str = "score") -> DataFrame:
    """The best k, ties by page."""
    return hits.orderBy(F.desc(score), page_col).limit(k)


def meta_coverage(index: TextIndex, titles: DataFrame, terms: list[str], boost: float = 1.0) -> DataFrame:
    """Share of the query's idf that a page's title has, and the factor that follows: 1 + boost * share."""
    found = titles.where(F.col("term").isin(sorted(set(terms)))).select(index.page_col, "term").distinct()
    total = index.stats().first()["total_pages"]
    idf = term_hits(index, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    whole = idf.agg(F.sum("idf")).first()[0] or 0.0
    covered = found.join(idf, "term").groupBy(index.page_col).agg(F.sum("idf").alias("matched_idf"))
    share = F.col("matched_idf") / F.lit(float(whole) or 1.0)
    return covered.select(index.page_col, "matched_idf", share.alias("coverage"), (1 + boost * share).alias("coverage_boost"))


def federate(*results: tuple[DataFrame, float], key: str = "url") -> DataFrame:
    """Hits of several indexes, each with its weight, best first; the best score stands for a key in two indexes."""
    parts = [hits.select(key, (F.col("score") * weight).alias("score"), F.lit(i).alias("source_index")) for i, (hits, weight) in enumerate(results)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(key).agg(F.max("score").alias("score"), F.max_by("source_index", F.struct("score", -F.col("source_index"))).alias("source_index")).orderBy(F.desc("score"), key)


def federate_counts(*counts: DataFrame) -> DataFrame:
    """Facet counts of several indexes added up."""
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("dim", "value").agg(F.sum("count").alias("count"))


def pick_language(indexes: DataFrame, wanted: str) -> DataFrame:
    """(language, page_count) rows: the exact language, else its primary part, else the largest."""
    order = F.when(F.lower("language") == wanted.lower(), 0).when(F.lower("language") == wanted.lower().split("-")[0], 1).otherwise(2)
    return indexes.orderBy(order, F.desc("page_count"), "language").limit(1)


def batch_and_search(index: TextIndex, queries: DataFrame, query_id: str = "query_id", terms: str = "terms") -> DataFrame:
    """AND for a table of queries: (query_id, page, tf)."""
    wanted = queries.select(query_id, F.explode(F.array_distinct(terms)).alias("term"), F.size(F.array_distinct(terms)).alias("n_terms"))
    return index.postings.join(wanted, "term").groupBy(query_id, index.page_col, "n_terms").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).where("n = n_terms").select(query_id, index.page_col, "tf")


def stored_index(spark: SparkSession, path: str, page_col: str = "page_no") -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/pages"), spark.read.parquet(f"{path}/postings"), page_col)


def store_index(index: TextIndex, path: str, partitions: int) -> None:
    """Postings ordered by term over files, so that a query's literals prune row groups."""
    index.postings.repartitionByRange(partitions, "term", index.page_col).sortWithinPartitions("term", index.page_col).write.mode("overwrite").parquet(f"{path}/postings")
    index.pages.write.mode("overwrite").parquet(f"{path}/pages")  # the last one: its commit says that the store is whole


def per_query_top_k(hits: DataFrame, k: int, query_id: str, page_col: str, score: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(score), page_col))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
