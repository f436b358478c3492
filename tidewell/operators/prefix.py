"""Search by prefixes and diacritics over a store of forms.

The store has a row for each term, form and page: a form is a word as it stands, in lower case, its term what the fold makes of it. Rows are in
order of terms, so a prefix is a range of them, which prunes row groups. A word that is typed finds each form whose term begins with the typed word's fold. A
found form counts by its nearness: (length of what was typed / length of the term) to the power ``Ranking.term_similarity``, and, unless the form itself begins
with what was typed, diacritics and all, 1 / (1 + ``Ranking.diacritic_similarity``). A page's frequency for a typed word is the sum of what its
forms count; BM25 goes on from there, with the pages that have any of them as the word's document frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from .index import spread
from .search import Ranking

_END = chr(0x10FFFF)


@dataclass
class FormIndex:
    pages: DataFrame  # page, length
    forms: DataFrame  # term, form, page, tf
    page_col: str

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str) -> FormIndex:
        words = F.transform(tokens.words(F.coalesce(F.col(text), F.lit("")), emoji=False), F.lower)
        rows = spread(docs, key).select(key, F.explode(words).alias("form"))
        forms = rows.groupBy(key, "form").agg(F.count(F.lit(1)).alias("tf")).withColumn("term", tokens.fold(F.col("form"))).where("term <> ''")
        return cls(forms.groupBy(key).agg(F.sum("tf").alias("length")), forms.select("term", "form", key, "tf"), key)

    def store(self, path: str, partitions: int) -> None:
        self.forms.repartitionByRange(partitions, "term", "form", self.page_col).sortWithinPartitions("term", "form", self.page_col).write.mode("overwrite").parquet(f"{path}/forms")
        # the lengths come from what has been written: the texts are read once
        lengths = self.forms.sparkSession.read.parquet(f"{path}/forms").groupBy(self.page_col).agg(F.sum("tf").alias("length"))
        lengths.write.mode("overwrite").parquet(f"{path}/pages")  # the last one: its commit says that the store is whole

    @classmethod
    def stored(cls, spark: SparkSession, path: str, page_col: str) -> FormIndex:
        return cls(spark.read.parquet(f"{path}/pages"), spark.read.parquet(f"{path}/forms"), page_col)


def matches(index: FormIndex, typed: list[str], ranking: Ranking = Ranking(), whole: bool = False) -> DataFrame:
    """(page, word, weighted_tf): what each typed word (by its number) counts on each page. whole: no prefixes, only whole words."""
    asked = [(i, tokens.fold_text(w.lower()), w.lower()) for i, w in enumerate(dict.fromkeys(typed)) if tokens.fold_text(w.lower())]
    wanted: Column = F.lit(False)
    for _, term, _ in asked:
        wanted = wanted | ((F.col("term") == term) if whole else ((F.col("term") >= term) & (F.col("term") < term + _END)))
    words = F.array(*[F.struct(F.lit(i).alias("word"), F.lit(t).alias("term"), F.lit(w).alias("typed")) for i, t, w in asked]) if asked else F.array().cast("array<struct<word:int,term:string,typed:string>>")
    of_row = F.filter(words, lambda q: (F.col("term") == q["term"]) if whole else F.startswith(F.col("term"), q["term"]))
    hits = index.forms.where(wanted).withColumn("q", F.explode(of_row))
    near = F.pow(F.length("q.term") / F.length("term"), F.lit(float(ranking.term_similarity)))
    exact = F.when((F.col("form") == F.col("q.typed")) if whole else F.startswith(F.col("form"), F.col("q.typed")), 1.0).otherwise(1 / (1 + ranking.diacritic_similarity))
    return hits.groupBy(index.page_col, F.col("q.word").alias("word")).agg(F.sum(F.col("tf") * near * exact).alias("weighted_tf"))


def prefix_bm25(index: FormIndex, typed: list[str], ranking: Ranking = Ranking(), whole: bool = False) -> DataFrame:
    """Score of every page that any typed word finds."""
    rows = matches(index, typed, ranking, whole)
    spread_ = rows.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row for each typed word
    total, mean = index.pages.agg(F.count(F.lit(1)), F.avg("length")).first()
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bonus = 1 - ranking.page_length + ranking.page_length * F.col("length") / F.lit(float(mean or 1))
    tf = F.col("weighted_tf")
    scored = rows.join(F.broadcast(spread_), "word").join(index.pages, index.page_col)
    return scored.groupBy(index.page_col).agg(F.round(F.sum(idf * tf * (ranking.saturation + 1) / (tf + ranking.saturation * bonus) * ranking.index_weight), 6).alias("score"))
