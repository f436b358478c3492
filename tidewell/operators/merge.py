"""Merging result lists: URL and title duplicates, cross-list bonus, candidates for summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import significant_words
from ..functions.urls import dedupe_key

#: Bonus for a page in several lists, title overlap of duplicates, picks of a bucket in a round.
CROSS_LIST_BONUS = 0.05
TITLE_JACCARD = 0.6
PER_ROUND = 3


def merge_results(lists: list[tuple[DataFrame, float]], exclude: list[str] | None = None, normalise: bool = True, bonus: float = CROSS_LIST_BONUS) -> DataFrame:
    """(url_key, url, title, score, lists): the best weighted score, plus the bonus if two lists or more have it."""
    whole: DataFrame | None = None
    for i, (rows, weight) in enumerate(lists):
        part = rows.select("url", "title", (F.col("score") * weight).alias("score"), F.lit(i).alias("list"))
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        raise ValueError("no lists to merge")
    return merge_scored(whole, exclude, normalise, bonus)


def merge_scored(rows: DataFrame, exclude: list[str] | None = None, normalise: bool = True, bonus: float = CROSS_LIST_BONUS) -> DataFrame:
    """The same for one table of (url, title, score, list)."""
    keyed = rows.withColumn("url_key", dedupe_key(F.col("url")) if normalise else F.col("url"))
    if exclude:
        keyed = keyed.where(~F.col("url_key").isin([_plain_key(u) if normalise else u for u in exclude]))
    best = F.max_by(F.struct("url", "title"), F.struct("score", -F.col("list"), "url"))
    merged = keyed.groupBy("url_key").agg(best.alias("b"), F.max("score").alias("top"), F.countDistinct("list").alias("lists"))
    score = F.round(F.col("top") + F.when(F.col("lists") > 1, bonus).otherwise(0.0), 6)
    return merged.select("url_key", "b.url", "b.title", score.alias("score"), "lists")


def _plain_key(url: str) -> str:
    url = url.lower()
    return (url[:-5] if url.endswith(".html") else url).rstrip("/")


def title_dedupe(results: DataFrame, limit: int, threshold: float = TITLE_JACCARD, key: str = "url", score: str = "score") -> DataFrame:
    """The best ``limit`` results without those whose title words overlap a better one's.

    Pairs are made among the first ``limit`` only, so the self-join has at most limit * limit rows.
    """
    ranked = results.orderBy(F.desc(score), key).limit(limit).withColumn("w", significant_words(F.coalesce(F.col("title"), F.lit(""))))
    a = ranked.select(F.col(key).alias("k1"), F.col(score).alias("s1"), F.col("w").alias("w1"), F.explode("w").alias("t"))
    b = ranked.select(F.col(key).alias("k2"), F.col(score).alias("s2"), F.col("w").alias("w2"), F.explode("w").alias("t"))
    pairs = a.join(b, "t").where((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("k1") > F.col("k2"))))
    jaccard = F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))
    worse = pairs.where(jaccard >= threshold).select(F.col("k1").alias(key)).distinct()
    return ranked.join(worse, key, "left_anti").drop("w")


def summary_union(results: DataFrame, n: int, key: str = "url") -> DataFrame:
    """The best n of all."""
    return results.orderBy(F.desc("score"), key).limit(n)


def summary_round_robin(results: DataFrame, n: int, original: str, term: str = "source_term", key: str = "url", per_round: int = PER_ROUND) -> DataFrame:
    """``per_round`` of each source term's bucket a round, the strongest bucket first, until n are picked."""
    bucket = F.coalesce(F.col(term), F.lit(original))
    rows = results.withColumn("bucket", bucket)
    own = Window.partitionBy("bucket").orderBy(F.desc("score"), key)
    rows = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= n)  # each task's best n of a bucket come first
    rows = rows.withColumn("strength", F.max("score").over(Window.partitionBy("bucket")))
    rows = rows.withColumn("round", F.floor((F.col("place") - 1) / per_round))
    return rows.orderBy("round", F.desc("strength"), "bucket", "place").limit(n).drop("strength")


def expansion_weight(term_number: Column, first: float = 0.5, decay: float = 0.05, floor: float = 0.4) -> Column:
    """Weight of the n-th expansion term (from 0): it decays to a floor."""
    return F.greatest(F.lit(floor), first - decay * term_number)


def citations(results: DataFrame) -> DataFrame:
    """(cite_url, title, content, score) once for each cited page: the page's own URL in its meta, else its URL.

    The best row of a page is picked by score and URL alone; its content is joined to the pick, so no other row's content is grouped. Rows that are
    equal in both count as one, that with the greatest title and content.
    """
    cited = results.withColumn("cite_url", F.coalesce(F.element_at("meta", "url"), F.col("url")))
    picks = cited.groupBy("cite_url").agg(F.max(F.struct("score", "url")).alias("b")).select(F.col("cite_url").alias("_cite"), F.col("b.score").alias("_score"), F.col("b.url").alias("_url"))
    same = F.col("cite_url").eqNullSafe(F.col("_cite")) & F.col("url").eqNullSafe(F.col("_url")) & F.col("score").eqNullSafe(F.col("_score"))
    best = cited.join(picks, same, "left_semi").groupBy("cite_url", "score").agg(F.max(F.struct("title", "content")).alias("b"))
    return best.select("cite_url", "b.title", "b.content", "score")
