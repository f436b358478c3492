"""Facet counts, their denominators, panels, and subjects that name a filter value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dimensions that define what is searched, not what a user picks.
STRUCTURAL = ("site", "language", "content_type", "entity_type")


def facet_counts(hits: DataFrame, facets: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(dim, value, count): pages, each once for each of its values."""
    return facets.join(hits.select(page_col).distinct(), page_col, "left_semi").groupBy("dim", "value").agg(F.countDistinct(page_col).alias("count"))


def with_constant(facets: DataFrame, pages: DataFrame, dim: str, value: str, page_col: str = "page_no") -> DataFrame:
    """Facets with one more dimension that has the same value on every page: marks an index in a merged search."""
    return facets.unionByName(pages.select(page_col, F.lit(dim).alias("dim"), F.lit(value).alias("value")))


def total_counts(facets: DataFrame, page_col: str = "page_no") -> DataFrame:
    return facets.groupBy("dim", "value").agg(F.countDistinct(page_col).alias("count"))


def structural_counts(hits: DataFrame, facets: DataFrame, picked: dict[str, list[str]], page_col: str = "page_no") -> DataFrame:
    """Counts under the structural part of the picks only: a user's facet picks never change them."""
    from .search import filtered

    return facet_counts(filtered(hits, facets, {k: v for k, v in picked.items() if k in STRUCTURAL}, page_col), facets, page_col)


def or_union_counts(parts: list[DataFrame], facets: DataFrame, page_col: str = "page_no") -> DataFrame:
    """Counts over the distinct pages of several searches."""
    whole = parts[0].select(page_col)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(page_col))
    return facet_counts(whole, facets, page_col)


def expansion_counts(typed: DataFrame, expansion: DataFrame, facets: DataFrame, page_col: str = "page_no") -> DataFrame:
    """Counts of the typed query plus those of pages that only the expansion finds."""
    fresh = expansion.select(page_col).distinct().join(typed.select(page_col), page_col, "left_anti")
    both = facet_counts(typed, facets, page_col).unionByName(facet_counts(fresh, facets, page_col))
    return both.groupBy("dim", "value").agg(F.sum("count").alias("count"))


def filtered_total(totals: DataFrame, picked: dict[str, list[str]], all_pages: int) -> int:
    """Denominator under filters: for each dimension the sum of the picked values' totals, then the least of them."""
    if not picked:
        return all_pages
    condition: Column = F.lit(False)
    for dim, values in picked.items():
        condition = condition | ((F.col("dim") == dim) & F.col("value").isin(list(values)))
    sums = {r["dim"]: r["n"] for r in totals.where(condition).groupBy("dim").agg(F.sum("count").alias("n")).collect()}  # a row for each picked dimension
    return min([*sums.values(), all_pages])


def panel(counts: DataFrame, active: dict[str, list[str]], hide_zero: bool = True) -> DataFrame:
    """(dim, value, count) to show: picked or counted values of dimensions with two values or more, in order."""
    rows = counts.where(~F.col("dim").isin(list(STRUCTURAL)))
    rows = rows.withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy("dim"))).where("n_values > 1").drop("n_values")
    is_active: Column = F.lit(False)
    for dim, values in active.items():
        is_active = is_active | ((F.col("dim") == dim) & F.col("value").isin(list(values)))
    return (rows.where((F.col("count") > 0) | is_active) if hide_zero else rows).orderBy("dim", "value")


def subject_filters(values: DataFrame, subjects: list[str]) -> DataFrame:
    """(dim, value, subject): for each dimension the first value that a subject word names.

    A word of more than two letters names a value that it equals, contains or is contained in, or that has
    it in a description 'value (word, …)'.
    """
    words = [s.strip().lower() for s in subjects if len(s.strip()) > 2]
    if not words:
        return values.select("dim", "value", F.lit("").alias("subject")).limit(0)
    value = F.lower(F.trim(F.regexp_replace("value", r"\s*\(.*\)\s*$", "")))
    inner = F.split(F.lower(F.regexp_extract("value", r"\((.*)\)\s*$", 1)), r"\s*,\s*")

    def level(w: str) -> Column:
        return F.when(value == w, 0).when((F.length(value) > 2) & (value.contains(w) | F.lit(w).contains(value)), 1).when(F.array_contains(inner, w), 2)

    rows = values.where(~F.col("dim").isin(list(STRUCTURAL))).select("dim", "value").distinct()
    candidates = F.filter(F.array(*[F.struct(level(w).alias("level"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: x["level"].isNotNull())
    rows = rows.withColumn("hit", F.array_min(candidates)).where("hit is not null")
    first = F.row_number().over(Window.partitionBy("dim").orderBy("hit.level", "hit.i", "value"))
    return rows.withColumn("n", first).where("n = 1").select("dim", "value", F.col("hit.w").alias("subject"))


def recall_guard(filtered: int, union: int, least: int = 5, share: float = 0.1) -> bool:
    """Whether a hinted filter leaves enough: a least number, and a share of the unfiltered union."""
    return filtered >= least and filtered >= share * union


def automatic_language(configured: str | None, page: str | None, languages: list[str]) -> str | None:
    """The language to filter by: only with several languages, and only one of them."""
    wanted = (configured or (page or "").split("-")[0]).lower()
    return wanted if len(languages) > 1 and wanted in languages else None
