from pyspark.sql import functions as F

from tidewell.operators.prefix import FormIndex, matches, prefix_bm25
from tidewell.operators.search import Ranking

DOCS = [(1, "Café"), (2, "cafe"), (3, "cafeteria"), (4, "CAFÉTERIA cafe"), (5, "tea"), (6, None), (7, "")]


def made(spark):
    return FormIndex.of(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", "text")


def test_prefixes_by_nearness_and_diacritics(spark):
    got = {(r["doc_id"], r["word"]): round(r["weighted_tf"], 6) for r in matches(made(spark), ["café", "te", "nothing"]).collect()}
    other = 1 / 1.8
    assert got == {(1, 0): 1.0, (2, 0): round(other, 6), (3, 0): round(4 / 9 * other, 6), (4, 0): round(4 / 9 + other, 6), (5, 1): round(2 / 3, 6)}
    plain = {r["doc_id"]: round(r["weighted_tf"], 6) for r in matches(made(spark), ["CAFE"], Ranking(term_similarity=0.0, diacritic_similarity=0.0)).collect()}
    assert plain == {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0}
    whole = {r["doc_id"]: round(r["weighted_tf"], 6) for r in matches(made(spark), ["café"], whole=True).collect()}
    assert whole == {1: 1.0, 2: round(other, 6), 4: round(other, 6)}


def test_order_and_stores(spark, tmp_path):
    made(spark).store(str(tmp_path / "f"), 2)
    index = FormIndex.stored(spark, str(tmp_path / "f"), "doc_id")
    scores = {r["doc_id"]: r["score"] for r in prefix_bm25(index, ["café"]).collect()}
    assert scores[1] > scores[2] > scores[3] and set(scores) == {1, 2, 3, 4}
    plan = matches(index, ["café"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,cafe)" in plan and "LessThan(term,cafe" in plan
    assert prefix_bm25(index, []).collect() == [] and prefix_bm25(index, ["", "zzz"]).collect() == []


def test_texts_are_read_once_for_a_store(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([*DOCS, (8, "cafe Ψωμί ψωμί")], "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    FormIndex.of(docs, "doc_id", "text").store(str(tmp_path / "f"), 2)
    assert read.value == len(DOCS) + 1
    index = FormIndex.stored(spark, str(tmp_path / "f"), "doc_id")
    assert {tuple(r) for r in index.pages.collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 1), (8, 3)}
    assert {tuple(r) for r in index.forms.where("doc_id = 8").collect()} == {("cafe", "cafe", 8, 1), ("ψωμι", "ψωμί", 8, 2)}
