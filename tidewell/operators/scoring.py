"""Relevance parts on result rows: position, title, content, phrase, recency.

Formulas that no public test fixes (title and content shares, recency) are documented defaults; every
number is a parameter of ``ScoreConfig``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import fold_latin, words
from ..plans.session import scratch_folder


@dataclass(frozen=True)
class ScoreConfig:
    recency_strategy: str = "exponential"  # exponential, linear, step, none, custom
    recency_boost_max: float = 0.25
    recency_half_life_days: float = 365
    recency_penalty_after_days: float = 1825
    recency_max_penalty: float = 0.3
    recency_curve: tuple[tuple[float, float], ...] = ()
    title_match_boost: float = 2.0
    title_all_terms_multiplier: float = 1.5
    content_match_boost: float = 0.4
    content_all_terms_multiplier: float = 1.2
    exact_title_boost: float = 5.0
    phrase_adjacent: float = 2.5
    phrase_near: float = 1.5
    phrase_near_window: int = 5


def position_score(rank: Column, total: Column) -> Column:
    """1 for the first of n, 0 for the last; 1 if it is alone. rank counts from 0."""
    return F.when(total <= 1, F.lit(1.0)).otherwise(1 - rank / (total - 1))


def with_position_score(results: DataFrame, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Base score by the place in the given order, by query if ``partition`` names one.

    Without one, rows are ranged by the order and written down, and each range is numbered on its own and offset by the
    counts of those before: no task has them all. A query's results are one task's; they are a list that someone looks at.
    """
    if not partition:
        return _ranked(results, order)
    by = Window.partitionBy(*partition)
    return results.withColumns({"_rank": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(by)}).withColumn("base", position_score(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")


def _ranked(results: DataFrame, order: list[Column]) -> DataFrame:
    spark = results.sparkSession
    path = scratch_folder(spark, "positions")
    ranged = results.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))  # a row a range
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = stored.withColumn("_rank", inner).join(F.broadcast(offsets), "_part")
    return placed.withColumn("base", position_score(F.col("_rank") + F.col("_before"), F.col("_n"))).select(*results.columns, "base")


def matched_share(text: Column, terms: list[str]) -> Column:
    """Share of the terms among the words of a text."""
    own = F.array_distinct(F.transform(words(F.coalesce(text, F.lit("")), emoji=False), lambda w: fold_latin(F.lower(w))))
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    return F.size(F.array_intersect(own, wanted)) / F.lit(float(max(1, len(set(terms)))))


def match_boost(text: Column, terms: list[str], boost: float, all_terms: float) -> Column:
    share = matched_share(text, terms)
    return F.when(share >= 1, boost * all_terms * share).otherwise(boost * share) if terms else F.lit(0.0)


def exact_title_factor(title: Column, query: str, primary_query: str = "", boost: float = 5.0) -> Column:
    """The boost if the title is the query (the primary one if there is one), case and outer blanks aside."""
    wanted = (primary_query or query).strip().lower()
    return F.when(F.lower(F.trim(title)) == wanted, F.lit(float(boost))).otherwise(1.0) if boost > 1 and wanted else F.lit(1.0)


def phrase_factor(locations: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    """By the smallest gap of two locations: next to each other, near, or neither."""
    sorted_ = F.array_sort(locations)
    gaps = F.transform(sorted_, lambda x, i: F.when(i > 0, x - F.get(sorted_, i - 1)))
    least = F.array_min(gaps)
    return F.when(F.coalesce(F.size(locations), F.lit(0)) < 2, 1.0).when(least <= 1, config.phrase_adjacent).when(least <= config.phrase_near_window, config.phrase_near).otherwise(1.0)


def recency(date: Column, as_of: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    """Boost for young and penalty for old documents, at a given day; 0 without a date."""
    age = F.greatest(F.datediff(as_of, date), F.lit(0)).cast("double")
    top, half = config.recency_boost_max, config.recency_half_life_days
    if config.recency_strategy == "none":
        boost = F.lit(0.0)
    elif config.recency_strategy == "linear":
        boost = F.greatest(F.lit(0.0), top * (1 - age / (2 * half)))
    elif config.recency_strategy == "step":
        boost = F.when(age <= half, F.lit(top)).otherwise(0.0)
    elif config.recency_strategy == "custom" and config.recency_curve:
        points = sorted(config.recency_curve)
        boost = F.lit(float(points[-1][1]))
        for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
            boost = F.when(age <= x1, y0 + (age - x0) * ((y1 - y0) / (x1 - x0))).otherwise(boost)
        boost = F.when(age <= points[0][0], F.lit(float(points[0][1]))).otherwise(boost)
    else:
        boost = top * F.pow(F.lit(2.0), -age / half)
    late = age - config.recency_penalty_after_days
    penalty = F.when(late > 0, F.least(F.lit(config.recency_max_penalty), config.recency_max_penalty * late / config.recency_penalty_after_days)).otherwise(0.0)
    return F.when(date.isNull(), 0.0).otherwise((boost - penalty) if config.recency_strategy != "none" else F.lit(0.0))


def score_results(results: DataFrame, query_terms: list[str], query: str, config: ScoreConfig = ScoreConfig(), primary_query: str = "", as_of: Column | None = None, source_weight: Column | None = None) -> DataFrame:
    """(base + recency + title + content) * weight * phrase * exact title.

    ``results``: base, title, excerpt, date, locations (array of int, may be null).
    """
    extra = [t for t in primary_query.lower().split() if t]
    title = match_boost(F.col("title"), query_terms, config.title_match_boost, config.title_all_terms_multiplier)
    content = match_boost(F.col("excerpt"), query_terms, config.content_match_boost, config.content_all_terms_multiplier)
    if extra:
        title = title + match_boost(F.col("title"), extra, config.title_match_boost, config.title_all_terms_multiplier)
        content = content + match_boost(F.col("excerpt"), extra, config.content_match_boost, config.content_all_terms_multiplier)
    young = recency(F.col("date"), as_of, config) if as_of is not None else F.lit(0.0)
    score = (F.col("base") + young + title + content) * (source_weight if source_weight is not None else F.lit(1.0))
    score = score * phrase_factor(F.col("locations"), config) * exact_title_factor(F.col("title"), query, primary_query, config.exact_title_boost)
    return results.withColumn("score", F.round(score, 6))


def batch_score_results(batches: list[tuple[str, DataFrame, list[str], str, dict]], default: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Several queries, each with what it overrides of the default: (query_id, result columns, score)."""
    out: DataFrame | None = None
    for query_id, results, terms, query, own in batches:
        scored = score_results(results, terms, query, replace(default, **own)).withColumn("query_id", F.lit(query_id))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no queries to score")
    return out.orderBy("query_id", F.desc("score"))


#: Fields of ``ScoreConfig`` that a query of a batch may have as columns of its own.
OVERRIDES = ("title_match_boost", "title_all_terms_multiplier", "content_match_boost", "content_all_terms_multiplier", "exact_title_boost")


def score_batch(results: DataFrame, queries: DataFrame, config: ScoreConfig = ScoreConfig(), as_of: Column | None = None) -> DataFrame:
    """``score_results`` for a table of queries in one plan, however many they are.

    ``results`` has query_id and what ``score_results`` reads; ``queries`` has query_id, terms (array) and query, and columns named
    as in ``OVERRIDES`` where queries differ from ``config`` (null: no difference).
    """
    own = [c for c in OVERRIDES if c in queries.columns]
    asked = queries.select("query_id", F.array_distinct("terms").alias("_terms"), F.lower(F.trim("query")).alias("_query"), *[F.col(c).alias(f"_{c}") for c in own])
    rows = results.join(asked, "query_id")
    value = {c: F.coalesce(F.col(f"_{c}"), F.lit(getattr(config, c))) if c in own else F.lit(getattr(config, c)) for c in OVERRIDES}

    def boost(text: str, kind: str) -> Column:
        found = F.transform(words(F.coalesce(F.col(text), F.lit("")), emoji=False), lambda w: fold_latin(F.lower(w)))
        share = F.size(F.array_intersect(found, "_terms")) / F.greatest(F.lit(1), F.size("_terms")).cast("double")
        return value[f"{kind}_match_boost"] * share * F.when(share >= 1, value[f"{kind}_all_terms_multiplier"]).otherwise(1.0)

    young = recency(F.col("date"), as_of, config) if as_of is not None else F.lit(0.0)
    exact = F.when((F.lower(F.trim("title")) == F.col("_query")) & (F.col("_query") != "") & (value["exact_title_boost"] > 1), value["exact_title_boost"]).otherwise(1.0)
    score = (F.col("base") + young + boost("title", "title") + boost("excerpt", "content")) * phrase_factor(F.col("locations"), config) * exact
    return rows.withColumn("score", F.round(score, 6)).select(*results.columns, "score")
