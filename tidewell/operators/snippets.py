"""Excerpts, highlights, sub-results and context for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excerpt_start(locations: Column, scores: Column, n_words: Column, length: int) -> Column:
    """First word of the window of ``length`` words with the largest sum of scores.

    A run of windows with that sum is taken in its middle. Windows begin at words 0 to n - length.
    """
    last = F.greatest(n_words - length, F.lit(0))
    weighted = F.arrays_zip(locations.alias("l"), scores.alias("s"))
    sums = F.transform(F.sequence(F.lit(0), last), lambda a: F.aggregate(F.filter(weighted, lambda x: (x["l"] >= a) & (x["l"] < a + length)), F.lit(0.0), lambda t, x: t + x["s"]))

    def middle(s: Column) -> Column:
        top = F.array_max(s)
        first = F.array_position(s, top) - 1
        run = F.aggregate(F.transform(s, lambda x, i: F.struct((x == top).alias("hit"), i.alias("i"))), first, lambda end, x: F.when(x["hit"] & (x["i"] == end + 1), end + 1).otherwise(end))
        return F.floor((first + run) / 2)

    return F.element_at(F.transform(F.array(sums), middle), 1).cast("int")


def words_of(content: Column) -> Column:
    return F.filter(F.split(content, r"[\s\x{200B}]+"), lambda w: w != "")


def excerpt(content: Column, locations: Column, start: Column, length: int) -> Column:
    """Words start to start + length, those at locations in <mark>; the window is moved back inside the text."""

    def build(w: Column) -> Column:
        marked = F.transform(w, lambda x, i: F.when(F.array_contains(locations, i), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
        at = F.greatest(F.lit(0), F.least(start, F.size(w) - length))
        return F.array_join(F.slice(marked, at + 1, length), " ")

    return F.element_at(F.transform(F.array(words_of(content)), build), 1)


def highlight(content: Column, terms: list[str]) -> Column:
    """Words equal to a term (case aside) in <mark>."""
    return F.array_join(F.transform(words_of(content), lambda w: F.when(F.lower(w).isin(terms or [""]), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def sub_results(locations: DataFrame, anchors: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(page, anchor, locations, n): each location under the last heading at or before it; '' before the first.

    A page's headings and locations are one ordered run, so the join is a window over their union.
    """
    from pyspark.sql.window import Window

    marks = anchors.select(page_col, "location", F.lit(0).alias("kind"), "anchor")
    hits = locations.select(page_col, "location", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("anchor"))
    upto = Window.partitionBy(page_col).orderBy("location", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.unionByName(hits).withColumn("anchor", F.coalesce(F.last("anchor", ignorenulls=True).over(upto), F.lit("")))
    return placed.where("kind = 1").groupBy(page_col, "anchor").agg(F.sort_array(F.collect_list("location")).alias("locations"), F.count(F.lit(1)).alias("n"))


def extract_context(content: Column, terms: list[str], max_length: int = 6000, intro: int = 2000, radius: int = 500) -> Column:
    """The beginning, then a snippet around the first place of each term behind it, cut at max_length.

    Snippets that touch the one before are joined to it.
    """
    low = F.lower(content)
    places = F.array_sort(F.array_distinct(F.filter(F.array(*[F.instr(low, F.lit(t.lower())) for t in terms] or [F.lit(0)]), lambda p: p > intro)))
    spans = F.transform(places, lambda p: F.struct(F.greatest(F.lit(intro + 1), p - radius).alias("a"), F.least(F.length(content), p + radius).alias("b")))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (last["b"] >= x["a"] - 1), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(merge(acc, x)))
    parts = F.transform(merged, lambda s: F.substring(content, s["a"], s["b"] - s["a"] + 1))
    whole = F.array_join(F.concat(F.array(F.substring(content, 1, intro)), parts), "\n...\n")
    return F.when(F.length(content) <= max_length, content).otherwise(F.substring(whole, 1, max_length))


def batch_extract_context(items: DataFrame, terms: list[str], **limits: int) -> DataFrame:
    return items.select("url", "title", extract_context(F.col("content"), terms, **limits).alias("context"))
