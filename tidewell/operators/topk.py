"""The best k pages by BM25 without reading all postings: blocks in order of impact.

A posting's impact is what it adds to a page's score but for its term's weight: the saturating frequency under the page's length.
``store_impacts`` writes postings by term and falling impact, ``BLOCK`` of them to a block, and a small table of blocks with their
greatest and least impact. The columns of the order have statistics in every row group and page of the files, so an impact's lower
bound, as a filter, is a bound on what is read.

``best_pages`` looks at the blocks of its terms first, then reads the first blocks of each. Sums over what it has read are scores of pages from below, so the k-th
best of them, the threshold, is one that the k-th best page has at least. A page at the threshold has, for each term,
an impact of at least (threshold - what all other terms can add at most) / weight: postings below that bound can't belong
to it. If all postings from there on have been read, the sums of the best k pages are their scores. Else they are read, which
raises the threshold. Terms for which the bound is nothing are read whole. Blocks below are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import TextIndex
from .search import Ranking

BLOCK = 4096
#: First blocks are read until they have this many times k postings of a term.
AHEAD = 4
#: Scores are rounded to six digits, so two that differ by less are ties.
_SAME = 1e-6


def store_impacts(index: TextIndex, path: str, partitions: int, ranking: Ranking = Ranking(), block: int = BLOCK) -> None:
    """Postings in blocks, and the table of blocks, for one ranking. The last table written says that the store is whole.

    Terms are dealt out by ranges of (term, impact), so a frequent one is in many files. A block has postings of one term and file.
    """
    key = index.page_col
    index.pages.write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = index.pages.sparkSession.read.parquet(f"{path}/lengths")
    total, mean = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
    bonus = 1 - ranking.page_length + ranking.page_length * F.col("length") / F.lit(float(mean or 1))
    impact = F.col("tf") * (ranking.saturation + 1) / (F.col("tf") + ranking.saturation * bonus)
    rows = index.postings.join(lengths, key).select("term", (-impact).alias("down"), key)
    ranged = rows.repartitionByRange(partitions, "term", "down", key).sortWithinPartitions("term", "down", key).withColumn("part", F.spark_partition_id())
    # a row's place in its range, in the last 33 bits; blocks are cut by it, so that no shuffle is needed to number them
    nth = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / block).cast("int")
    placed = ranged.select("term", (-F.col("down")).alias("impact"), key, "part", nth.alias("nth"))
    small = {"parquet.block.size": 4 << 20, "parquet.page.row.count.limit": block, "compression": "zstd"}
    placed.write.options(**small).mode("overwrite").parquet(f"{path}/postings")
    stored = index.pages.sparkSession.read.parquet(f"{path}/postings")
    blocks = stored.groupBy("term", "part", "nth").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count(F.lit(1)).alias("postings"))
    blocks.withColumns({"total": F.lit(total), "page_col": F.lit(key)}).repartitionByRange(max(1, partitions // 8), "term", "most").sortWithinPartitions("term", F.desc("most")).write.mode("overwrite").parquet(f"{path}/pages")


@dataclass
class Read:
    """What a search has read of each term: the least impact, and its postings and blocks of all."""

    bounds: dict[str, float]
    blocks_read: int
    blocks: int
    rounds: int


def _from(bounds: dict[str, float]) -> Column:
    condition: Column = F.lit(False)
    for term, least in sorted(bounds.items()):
        own = F.col("term") == term
        condition = condition | (own & (F.col("impact") >= least) if least > 0 else own)
    return condition


def best_pages(spark: SparkSession, path: str, terms: list[str], k: int, ranking: Ranking = Ranking()) -> tuple[DataFrame, Read]:
    """(page, score) of the best k pages, ties by page, and what has been read for it."""
    table = spark.read.parquet(f"{path}/pages").where(F.col("term").isin(sorted(set(terms))))
    # a term of n postings has n / BLOCK rows here; of each, only as many as the threshold may need are looked at
    sizes = table.groupBy("term").agg(F.sum("postings").alias("df"), F.max("most").alias("most"), F.max("total").alias("total"), F.max("page_col").alias("page_col"), F.count(F.lit(1)).alias("blocks")).collect()
    if not sizes or k < 1:
        key = (spark.read.parquet(f"{path}/postings").columns)[2]
        kind = spark.read.parquet(f"{path}/postings").schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, score double"), Read({}, 0, 0, 0)
    key = sizes[0]["page_col"]
    weight = {r["term"]: math.log(1 + (r["total"] - r["df"] + 0.5) / (r["df"] + 0.5)) * ranking.index_weight for r in sizes}
    most = {r["term"]: weight[r["term"]] * r["most"] for r in sizes}
    upto = F.sum("postings").over(Window.partitionBy("term").orderBy(F.desc("most"), "part", "nth"))
    first = table.withColumn("upto", upto).where(F.col("upto") - F.col("postings") < AHEAD * k).groupBy("term").agg(F.min("least").alias("least")).collect()
    bounds = {r["term"]: r["least"] for r in first}
    weights = F.create_map(*[x for t, w in sorted(weight.items()) for x in (F.lit(t), F.lit(w))])
    rounds = 0
    while True:
        rounds += 1
        rows = spark.read.parquet(f"{path}/postings").where(_from(bounds))
        best = rows.groupBy(key).agg(F.round(F.sum(F.element_at(weights, F.col("term")) * F.col("impact")), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
        found = [r["score"] for r in best.collect()]  # k rows
        threshold = (found[-1] if len(found) == k else 0.0) - _SAME
        needed = {t: max((threshold - sum(m for u, m in most.items() if u != t)) / weight[t], 0.0) if weight[t] > 0 else 0.0 for t in weight}
        if all(bounds[t] <= needed[t] or bounds[t] <= 0 for t in weight):
            break
        bounds = {t: min(bounds[t], needed[t]) for t in weight}
    read = table.where(_block_from(bounds)).count()
    return best, Read(bounds, read, sum(r["blocks"] for r in sizes), rounds)


def _block_from(bounds: dict[str, float]) -> Column:
    condition: Column = F.lit(False)
    for term, least in sorted(bounds.items()):
        condition = condition | ((F.col("term") == term) & (F.col("most") >= least))
    return condition
