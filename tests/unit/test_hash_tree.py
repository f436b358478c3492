import random

from pyspark.sql import functions as F

from tidewell.operators.hash_tree import LITERALS, changed, documents_of, hash_tree, updated

SCHEMA = "doc_id long, text string"


def table(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


def nodes(df):
    return sorted(r["node"] for r in df.collect())


def tree(spark, docs, path=None):
    made = hash_tree(table(spark, docs), "doc_id", "text", 16)
    return spark.createDataFrame(made.collect(), made.schema)


def test_differences_are_found_by_descending(spark):
    rng = random.Random(1)
    docs = {rng.choice([i, -i, 10**15 + i, -(10**18) - i, 3 * i]): f"text {i}" for i in range(600)}
    old = tree(spark, list(docs.items()))
    assert nodes(changed(old, tree(spark, list(docs.items())[::-1]), 16)) == []
    new = dict(docs)
    ids = sorted(docs)
    new[ids[7]] += "!"
    del new[ids[300]]
    new[10**17 + 5] = "fresh"
    other = tree(spark, list(new.items()))
    assert nodes(changed(old, other, 16)) == sorted({i // 16 for i in (ids[7], ids[300], 10**17 + 5)})
    # an update reads the leaves of the changed ids and gives the same tree
    touched = spark.createDataFrame([(i,) for i in (ids[7], ids[300], 10**17 + 5)], "doc_id long")
    again = updated(old, table(spark, list(new.items())), "doc_id", "text", touched, 16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, other.collect()))


def test_one_edit_reads_one_leafs_documents(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.page.row.count.limit", 500).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    old = hash_tree(docs, "doc_id", "text")
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 5000, "new").otherwise(F.col("text")))
    leaves = changed(old, hash_tree(edited, "doc_id", "text"))
    assert nodes(leaves) == [5000 // 1024]
    got = documents_of(docs, "doc_id", leaves)
    plan = got._jdf.queryExecution().executedPlan()
    assert got.count() == 1024 and "GreaterThanOrEqual(doc_id,4096)" in plan.toString() and "LessThan(doc_id,5120)" in plan.toString()


def test_null_ids_repeats_and_empty_tables(spark):
    none = tree(spark, [])
    assert none.count() == 0
    a, b = tree(spark, [(None, "x"), (1, "a"), (1, "a")]), tree(spark, [(None, "y"), (1, "a"), (1, "a")])
    c = tree(spark, [(None, "x"), (1, "a")])
    assert len(nodes(changed(a, b, 16))) == 1 and nodes(changed(a, c, 16)) == [0] and len(nodes(changed(none, a, 16))) == 2
    docs = table(spark, [(None, "y"), (1, "a"), (40, "b")])
    assert [r["text"] for r in documents_of(docs, "doc_id", changed(a, b, 16), 16).collect()] == ["y"]
    many = spark.range(LITERALS + 5).select(F.col("id").alias("node"))
    assert documents_of(docs, "doc_id", many, 16).count() == 2
