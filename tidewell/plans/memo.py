"""Results kept by what they are: the plan that makes them, and the version of the files that it reads.

A plan's key is its canonical form (names of columns and the order in which they were made don't matter) with the folders of its tables in the order of
its leaves. Below it, a result lies under the version of the files; when these change, the next search makes a new one and the old one goes. Plans
that have other sources than files, that aren't deterministic or that run Python code have no key: they are never kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .session import _status, is_stored, shared_folder, source_version


def plan_key(df: DataFrame) -> str | None:
    """A hash of what the plan computes; None if that can't be told from it."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    parts = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "OneRowRelation":
            continue
        if leaf.getClass().getSimpleName() != "LogicalRelation" or not hasattr(leaf.relation(), "location"):
            return None
        paths = leaf.relation().location().rootPaths()
        parts.append(",".join(sorted(paths.apply(k).toString() for k in range(paths.size()))))
    text = plan.canonicalized().treeString(True, False, 1 << 20, False, False)
    patterns = df.sparkSession._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    functions = any(plan.containsPattern(p) for p in (patterns.PYTHON_UDF(), patterns.SCALA_UDF(), patterns.CURRENT_LIKE()))
    if not parts or functions or not plan.deterministic() or any(word in text for word in ("MapInPandas", "MapInArrow", "InPandas", "InArrow")):
        return None
    return hashlib.sha256("\n".join([text, str(df.schema.json()), *parts]).encode()).hexdigest()[:32]


def memoised(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of a plan, kept or made now, and whether they were kept. They come in no order."""
    key = plan_key(df)
    if key is None:
        return df, False
    spark = df.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/memo/{key}"
    path = f"{base}/{source_version(df)}"
    kept = is_stored(spark, path)
    if not kept:
        fs, old = _status(spark, base)
        stale = [x.getPath() for x in fs.listStatus(old)] if fs.exists(old) else []
        df.write.mode("overwrite").parquet(f"{path}/pages")
        for folder in stale:
            fs.delete(folder, True)
    return spark.read.schema(df.schema).parquet(f"{path}/pages"), kept
