"""Search over the page index: terms as the index has them, stems and all, with weights for titles and bodies.

A query goes through the same functions as the pages: words, camel case, bigrams, fold, and the stem of its language, so what is typed and what is indexed agree. A
page's frequency for a term is its body and path places and ``title_weight`` times its title places; BM25 goes on from there. Postings are stored in order of
terms, so the query's terms prune row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.stem import stem_column
from .index import page_postings, page_tokens, word_counts
from .search import Ranking


def query_terms(spark: SparkSession, query: str, language: str = "", stem: bool = True) -> list[str]:
    """Distinct terms of a query, in order."""
    word = spark.range(1).select(F.posexplode(tokens.tokenize(F.lit(query))).alias("at", "word")).withColumn("norm", tokens.fold(F.col("word")))
    term = stem_column(F.col("norm"), F.lit(language)) if stem else F.col("norm")
    return list(dict.fromkeys(r["term"] for r in word.select("at", term.alias("term")).orderBy("at").collect() if r["term"]))


@dataclass
class PageIndex:
    pages: DataFrame  # page_no, language, length
    postings: DataFrame  # term, page_no, tf, title_tf
    stem: bool

    @classmethod
    def of(cls, pages: DataFrame, stem: bool = True) -> PageIndex:
        """Index of prepared pages. Page_no, language, title_text, clean and url are read."""
        lengths = word_counts(page_tokens(pages)).withColumnRenamed("word_count", "length")
        rows = page_postings(pages, stem=stem).select("term", "page_no", "tf", F.size("title_positions").cast("long").alias("title_tf"))
        return cls(pages.select("page_no", "language").join(lengths, "page_no"), rows, stem)

    def store(self, path: str, partitions: int) -> None:
        self.postings.repartitionByRange(partitions, "term", "page_no").sortWithinPartitions("term", "page_no").write.mode("overwrite").parquet(f"{path}/postings")
        self.pages.write.mode("overwrite").parquet(f"{path}/pages")  # the last one: its commit says that the store is whole

    @classmethod
    def stored(cls, spark: SparkSession, path: str, stem: bool = True) -> PageIndex:
        return cls(spark.read.parquet(f"{path}/pages"), spark.read.parquet(f"{path}/postings"), stem)

    def search(self, query: str, language: str = "", ranking: Ranking = Ranking(), title_weight: float = 3.0, every: bool = False) -> DataFrame:
        """(page_no, score, matched) of pages with any term, or with every one; a language, if given, is that of the pages too."""
        spark = self.postings.sparkSession
        terms = query_terms(spark, query, language, self.stem)
        pages = self.pages.where(F.col("language") == language) if language else self.pages
        hits = self.postings.where(F.col("term").isin(terms)).join(pages, "page_no")
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        total, mean = pages.agg(F.count(F.lit(1)), F.avg("length")).first()
        tf = (F.col("tf") - F.col("title_tf")) + title_weight * F.col("title_tf")
        idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bonus = 1 - ranking.page_length + ranking.page_length * F.col("length") / F.lit(float(mean or 1))
        part = idf * tf * (ranking.saturation + 1) / (tf + ranking.saturation * bonus) * ranking.index_weight
        scored = hits.join(F.broadcast(df), "term").groupBy("page_no").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
        return scored.where(F.col("matched") == len(terms)) if every else scored
