"""A hash tree over ranges of ids: two versions are compared from the top, and only the documents of changed ranges are read.

A leaf is ``width`` ids; its hash is over its documents' digests, added up so that their order doesn't matter. ``FAN`` neighbours make a node of the level
above, up to one root. ``changed`` goes down a level at a time and looks at the children of nodes that differ, no others; ``documents_of`` turns
leaves into ranges of ids, which prune the row groups of a table in order of ids; ``updated`` makes a tree anew for some ids from
their leaves' documents and the other leaves' hashes. Null ids have a leaf of their own. Repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_parts, row_digest
from ..plans.session import scratch_folder

WIDTH = 1024
FAN = 256
#: The id that stands for null.
NO_ID = -(1 << 62)
#: Leaves up to which ranges of ids are literals of a filter; beyond, they are a join.
LITERALS = 1000


def _leaf(key: str, width: int) -> Column:
    if width < 2 or width & (width - 1):
        raise ValueError("a leaf's width is a power of two")
    return F.shiftright(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), width.bit_length() - 1)


def _leaves(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    named = docs.select(_leaf(key, width).alias("node"), row_digest(F.col(key), F.col(text)).alias("digest"))
    added = named.groupBy("node").agg(F.count(F.lit(1)).alias("items"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(digest_parts(F.col("digest")))])
    return added.select(F.lit(0).alias("level"), "node", F.sha2(F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(8)], F.col("items").cast("string")), 256).alias("hash"), "items")


def _levels(width: int) -> int:
    """Levels above the leaves, until any id's node is the root or the one beside it, and the root."""
    bits = 64 - (width.bit_length() - 1)
    return -(-bits // (FAN.bit_length() - 1)) + 1


def _above(nodes: DataFrame, level: int, top: int) -> DataFrame:
    """Nodes of a level from those below: of ``FAN`` children at most, but for the root, which has two."""
    up = F.lit(0).cast("long") if level == top else F.shiftright("node", FAN.bit_length() - 1)
    child = F.struct("node", F.concat_ws("=", F.col("node").cast("string"), "hash").alias("h"))
    made = nodes.groupBy(up.alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.sum("items").alias("items"))
    return made.select(F.lit(level).alias("level"), F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: x["h"]), ","), 256).alias("hash"), "items")


def hash_tree(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(level, node, hash, items) of all nodes that have documents; the root is node 0 of the highest level."""
    return grown(_leaves(docs, key, text, width), width)


def grown(leaves: DataFrame, width: int = WIDTH) -> DataFrame:
    """A tree from its leaves."""
    whole = level = leaves
    top = _levels(width)
    for i in range(1, top + 1):
        level = _above(level, i, top)
        whole = whole.unionByName(level)
    return whole


def stored(tree: DataFrame, path: str) -> DataFrame:
    """A tree written down, a folder for each level: comparing it reads the levels and nothing that they were made of."""
    tree.write.mode("overwrite").partitionBy("level").parquet(path)
    return tree.sparkSession.read.schema("node long, hash string, items long, level int").parquet(path).select("level", "node", "hash", "items")


def changed(old: DataFrame, new: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node): leaves that differ, or that only one of two stored trees has. Equal trees are known by their roots alone."""
    top = _levels(width)
    nodes: DataFrame | None = None
    for level in range(top, -1, -1):
        sides = []
        for tree in (old, new):
            own = tree.where(F.col("level") == level).select("node", "hash")
            if nodes is not None and level < top - 1:
                own = own.join(nodes.withColumnRenamed("node", "up"), F.shiftright("node", FAN.bit_length() - 1) == F.col("up"), "left_semi")
            sides.append(own)
        a, b = sides
        nodes = _kept(a.join(b.withColumnRenamed("hash", "other"), "node", "full").where("not hash <=> other").select("node"))
        if level == top and nodes.isEmpty():
            break
    return nodes


def _kept(nodes: DataFrame) -> DataFrame:
    """Nodes of a level, made once: few of them in the driver, more in the shared folder. The next level down reads them twice."""
    spark = nodes.sparkSession
    some = nodes.limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        return spark.createDataFrame(some, "node long")
    path = scratch_folder(spark, "hash-tree")
    nodes.write.parquet(path)
    return spark.read.schema("node long").parquet(path)


def documents_of(docs: DataFrame, key: str, leaves: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents of some leaves."""
    some = [r["node"] for r in leaves.limit(LITERALS + 1).collect()]
    if len(some) > LITERALS:
        return docs.join(leaves, _leaf(key, width) == F.col("node"), "left_semi")
    condition: Column = F.lit(False)
    for node in sorted(some):
        first = node * width
        condition = condition | ((F.col(key) >= first) & (F.col(key) < first + width))
        if first <= NO_ID < first + width:
            condition = condition | F.col(key).isNull()
    return docs.where(condition)


def updated(tree: DataFrame, docs: DataFrame, key: str, text: str, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """The tree of ``docs``, which differ from what ``tree`` was made of by some ids only: their leaves' documents are read, no others."""
    touched = ids.select(_leaf(key, width).alias("node")).distinct()
    kept = tree.where("level = 0").join(touched, "node", "left_anti").select("level", "node", "hash", "items")
    return grown(kept.unionByName(_leaves(documents_of(docs, key, touched, width), key, text, width)), width)
