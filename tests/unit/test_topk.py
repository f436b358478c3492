import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.index import TextIndex
from tidewell.operators.topk import best_pages, store_impacts

SCHEMA = "doc_id long, text string"


def pairs(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Few documents where the words are dense, very many where they are thin."""
    rng = random.Random(7)
    docs = []
    for i in range(6000):
        dense = i % 200 == 0
        n = rng.randrange(20, 60)
        docs.append((i, " ".join(rng.choice(["the", "of", "and"]) if rng.random() < (0.9 if dense else 0.08) else f"x{rng.randrange(500)}" for _ in range(n))))
    index = TextIndex.of(spark.createDataFrame(docs, SCHEMA), "doc_id", "text")
    path = str(tmp_path_factory.mktemp("impacts"))
    store_impacts(index, path, 4, block=64)
    return index, path


@pytest.mark.parametrize("terms,k", [(["the", "of", "and"], 10), (["the"], 25), (["the", "x1"], 5), (["x1", "x2", "x3"], 10), (["the", "of", "and"], 5500), (["the", "nowhere"], 3)])
def test_same_rows_as_scoring_all(spark, skewed, terms, k):
    index, path = skewed
    got, read = best_pages(spark, path, terms, k)
    assert pairs(got) == pairs(search.top_k(search.bm25(index, terms), k, "doc_id"))
    assert read.blocks_read <= read.blocks


def scanned(df):
    """Rows that the scans of a plan have given on, after row groups and pages were left out."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    out, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            out += node.metrics().get("numOutputRows").get().value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_blocks_below_the_threshold_are_not_read(spark, skewed):
    _, path = skewed
    best, read = best_pages(spark, path, ["the", "of", "and"], 10)
    assert read.blocks_read < read.blocks / 4 and read.rounds <= 3
    whole = spark.read.parquet(f"{path}/postings").where("term in ('the', 'of', 'and')").count()
    assert all(b > 0 for b in read.bounds.values())
    rows = spark.read.parquet(f"{path}/postings").where(" or ".join(f"(term = '{t}' and impact >= {b})" for t, b in read.bounds.items()))
    assert 0 < scanned(best) < whole / 2 and rows.count() < whole / 4


def test_nothing_to_find(spark, skewed, tmp_path):
    _, path = skewed
    got, read = best_pages(spark, path, ["nowhere"], 10)
    assert got.columns == ["doc_id", "score"] and got.collect() == [] and read.blocks == 0
    assert best_pages(spark, path, [], 10)[0].collect() == [] and best_pages(spark, path, ["the"], 0)[0].collect() == []
    empty = TextIndex.of(spark.createDataFrame([], SCHEMA), "doc_id", "text")
    store_impacts(empty, str(tmp_path / "none"), 2)
    assert best_pages(spark, str(tmp_path / "none"), ["the"], 5)[0].collect() == []


def test_ties_go_by_page(spark, tmp_path):
    docs = [(i, "the word") for i in range(300)] + [(1000 + i, "the the word") for i in range(3)]
    index = TextIndex.of(spark.createDataFrame(docs, SCHEMA), "doc_id", "text")
    store_impacts(index, str(tmp_path / "t"), 3, block=16)
    for k in (2, 3, 10, 303, 400):
        got, _ = best_pages(spark, str(tmp_path / "t"), ["the", "word"], k)
        assert pairs(got) == pairs(search.top_k(search.bm25(index, ["the", "word"]), k, "doc_id"))


def test_impacts_need_no_index_with_positions(spark, tmp_path):
    from tidewell.plans import catalogue
    from tidewell.plans.catalogue_index import impacts
    from tidewell.plans.session import is_stored

    spark.createDataFrame([(i, "der und " * (i % 3) + "les and") for i in range(40)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got, _ = best_pages(spark, impacts(spark, str(tmp_path)), ["der", "les"], 20)
    assert not is_stored(spark, catalogue.search_index_path(spark, str(tmp_path)))
    assert pairs(got) == pairs(search.top_k(search.bm25(catalogue.docs_index(spark, str(tmp_path)), ["der", "les"]), 20, "doc_id"))


def test_blocks_are_of_one_term_in_order(spark, skewed):
    _, path = skewed
    rows = spark.read.parquet(f"{path}/postings")
    blocks = {(r["part"], r["term"], r["nth"]): r for r in spark.read.parquet(f"{path}/pages").collect()}
    assert sum(b["postings"] for b in blocks.values()) == rows.count() and max(b["postings"] for b in blocks.values()) == 64
    by_part: dict[int, list] = {}
    for r in rows.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect():
        by_part.setdefault(r["part"], []).append((r["term"], -r["impact"], r["doc_id"], r["file"]))
    for found in by_part.values():
        assert [x[:3] for x in found] == sorted(x[:3] for x in found) and len({x[3] for x in found}) == 1
    # ranges follow each other, so a part is a file and a frequent term is in several
    firsts = [found[0][:3] for _, found in sorted(by_part.items())]
    assert firsts == sorted(firsts) and len(by_part) > 1
