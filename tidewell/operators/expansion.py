"""Query expansion: which sub-words are rare enough, specificity, agreement, sort hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subword_guard(lexicon: DataFrame, terms: list[str], total: int, max_frequency: float, typed: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """(phrase, word, df, admitted) for the words of expansion phrases.

    A word is admitted if its share of pages is below the limit; a limit of 0 or less admits none, 1 or more
    admits all, and an empty index admits none. Words that the user typed are exempt, unless denied.
    """
    spark = lexicon.sparkSession
    pairs = [(t, w) for t in dict.fromkeys(terms) if len(t.split()) > 1 for w in dict.fromkeys(t.lower().split())]
    if not pairs:
        return spark.createDataFrame([], "phrase string, word string, df long, admitted boolean")
    words = spark.createDataFrame(pairs, "phrase string, word string")
    df = F.coalesce(F.col("df"), F.lit(0))
    if max_frequency <= 0 or total <= 0:
        rare: Column = F.lit(False)
    elif max_frequency >= 1:
        rare = F.lit(True)
    else:
        rare = df / F.lit(float(total)) < max_frequency
    exempt = F.col("word").isin([w.lower() for w in typed or []] or [""]) & ~F.col("word").isin([w.lower() for w in denied or []] or [""])
    found = lexicon.where(F.col("term").isin([w for _, w in pairs])).select(F.col("term").alias("word"), "df")
    return words.join(found, "word", "left").select("phrase", "word", df.alias("df"), (rare | exempt).alias("admitted"))


def specificity(df: Column, total: Column, floor: float = 0.15) -> Column:
    """ln(N / df) / ln(N), at least the floor; a term of no page has the floor."""
    value = F.log(total / df) / F.log(total)
    return F.when((df <= 0) | (total <= 1), F.lit(floor)).otherwise(F.greatest(F.lit(floor), value))


def agreement_bonus(seeded: DataFrame, agreement: DataFrame, weight: float = 0.2, decay: float = 0.5, page_col: str = "page_no") -> DataFrame:
    """Seeded pages with a bonus for agreement-only terms, which add no page of their own.

    The k-th agreeing term (from 0, by specificity) adds weight * decay ** k * specificity.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(page_col).orderBy(F.desc("specificity"), "term")) - 1
    inside = agreement.join(seeded.select(page_col).distinct(), page_col, "left_semi").withColumn("k", place)
    bonus = inside.groupBy(page_col).agg(F.sum(weight * F.pow(F.lit(decay), F.col("k")) * F.col("specificity")).alias("bonus"))
    return seeded.join(bonus, page_col, "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6)).drop("bonus")


def agreement_terms(lexicon: DataFrame, rejected: list[str], total: int, gate: float = 0.45) -> DataFrame:
    """(term, specificity) of rejected words that are specific enough to agree."""
    value = specificity(F.col("df"), F.lit(float(total)))
    return lexicon.where(F.col("term").isin(rejected or [""])).select("term", value.alias("specificity")).where(F.col("specificity") >= gate)


def sort_hint(hits: list[DataFrame], ranks: DataFrame, hint: dict | None, page_col: str = "page_no") -> tuple[str, DataFrame]:
    """Union of term hits, each page once; by the hinted field if the index has it, else by relevance."""
    whole = hits[0].select(page_col, "score")
    for h in hits[1:]:
        whole = whole.unionByName(h.select(page_col, "score"))
    whole = whole.groupBy(page_col).agg(F.max("score").alias("score"))
    if hint and not ranks.where(F.col("field") == hint["field"]).isEmpty():
        from .search import sort_hits

        return "field", sort_hits(whole, ranks, {hint["field"]: hint["direction"]}, page_col)
    return "relevance", whole.orderBy(F.desc("score"), page_col)
