"""Facet counts from bitmaps of pages.

A facet value has a row for each bucket of ``BUCKET`` page ids: the words of 64 bits that aren't zero, with their places. A value on few
pages costs a word for each, one on most pages a bit for each, and a row never has more than ``BUCKET`` / 64 words. A set of pages (hits, or what filters
leave) is a table of words (bucket, word, bits); unions, intersections and differences are done on it. To count, a set becomes one array of words for
each bucket, which the values' rows are joined with: no row for a page and value is touched, and only counts are
shuffled on. Everything is built-in functions on 64-bit integers.

Page ids are whole numbers, negative ones too; null ids are in no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32_768
_WORDS = BUCKET // 64


def _words(rows: DataFrame, page: str, *by: str) -> DataFrame:
    """(*by, bucket, word, bits) of the pages."""
    at = F.pmod(page, F.lit(BUCKET))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    placed = rows.where(F.col(page).isNotNull()).select(*by, F.floor(F.col(page) / BUCKET).alias("bucket"), F.floor(at / 64).cast("int").alias("word"), bit.alias("bit"))
    return placed.groupBy(*by, "bucket", "word").agg(F.bit_or("bit").alias("bits"))


def build(facets: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(dim, value, bucket, words, pages) of rows (dim, value, page); a row that comes twice counts once."""
    words = _words(facets, page_col, "dim", "value")
    entry = F.struct("word", "bits")
    return words.groupBy("dim", "value", "bucket").agg(F.sort_array(F.collect_list(entry)).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("pages"))


def page_set(pages: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(bucket, word, bits) of a table of pages."""
    return _words(pages, page_col)


def union(*sets: DataFrame) -> DataFrame:
    whole = sets[0]
    for s in sets[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("bits", "_other"), ["bucket", "word"])
    return both.select("bucket", "word", F.col("bits").bitwiseAND(F.col("_other")).alias("bits")).where("bits <> 0")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("bits", "_other"), ["bucket", "word"], "left")
    return both.select("bucket", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_other", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")


def filtered(bitmaps: DataFrame, wanted: dict[str, list[str] | str]) -> DataFrame:
    """The set of pages that meet all dimensions; values of one dimension are alternatives."""
    condition: Column = F.lit(False)
    for dim, values in wanted.items():
        condition = condition | ((F.col("dim") == dim) & F.col("value").isin([values] if isinstance(values, str) else list(values)))
    words = bitmaps.where(condition).select("dim", "bucket", F.explode("words").alias("w")).select("dim", "bucket", F.col("w.word").alias("word"), F.col("w.bits").alias("bits"))
    by_dim = words.groupBy("bucket", "word", "dim").agg(F.bit_or("bits").alias("bits"))
    met = by_dim.groupBy("bucket", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("dims"))
    return met.where((F.col("dims") == len(wanted)) & (F.col("bits") != 0)).drop("dims")


def size(pages: DataFrame) -> Column:
    """Number of pages of a set, as an aggregate over its words."""
    return F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long")


def total_counts(bitmaps: DataFrame) -> DataFrame:
    """(dim, value, count) over all pages."""
    return bitmaps.groupBy("dim", "value").agg(F.sum("pages").alias("count"))


def counts(pages: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(dim, value, count): pages of the set that have the value; values without any are left out."""
    held = pages.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # 512 words at most
    dense = held.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias("held"))
    here = F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w["bits"].bitwiseAND(F.get("held", w["word"]))))
    joined = bitmaps.join(dense, "bucket").select("dim", "value", here.alias("n")).where("n > 0")
    return joined.groupBy("dim", "value").agg(F.sum("n").cast("long").alias("count"))


def structural_counts(hits: DataFrame, bitmaps: DataFrame, picked: dict[str, list[str]], structural: tuple[str, ...]) -> DataFrame:
    """Counts of a set under the structural part of the picks only."""
    wanted = {k: v for k, v in picked.items() if k in structural}
    return counts(intersect(hits, filtered(bitmaps, wanted)) if wanted else hits, bitmaps)


def expansion_counts(typed: DataFrame, expansion: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Counts of the typed query plus those of pages that only the expansion finds: as the sets don't meet, those of the union."""
    return counts(union(typed, minus(expansion, typed)), bitmaps)
