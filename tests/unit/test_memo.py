import time

from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.index import TextIndex
from tidewell.plans.memo import memoised, plan_key


def rows(df):
    return sorted(map(tuple, df.collect()))


def stored(spark, tmp_path, docs):
    index = TextIndex.of(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    search.store_index(index, str(tmp_path / "index"), 2)
    return lambda: search.stored_index(spark, str(tmp_path / "index"), "doc_id")


def test_the_second_of_two_equal_searches_starts_no_scan(spark, tmp_path):
    index = stored(spark, tmp_path, [(1, "the of"), (2, "the"), (3, "of the of")])
    first, kept = memoised(search.and_search(index(), ["the", "of"]))
    assert not kept and rows(first) == [(1, 2), (3, 3)]
    tracker = spark.sparkContext.statusTracker()
    equal = search.and_search(index(), ["of", "the"])
    spark.sparkContext.setJobGroup("memo", "the second search")
    second, kept = memoised(equal)
    assert kept and not tracker.getJobIdsForGroup("memo")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all("/memo/" in f for f in second.inputFiles()) and rows(second) == rows(first)
    other, kept = memoised(search.and_search(index(), ["the"]))
    assert not kept and len(rows(other)) == 3


def test_changed_files_make_a_new_result_and_the_old_one_goes(spark, tmp_path):
    index = stored(spark, tmp_path, [(1, "the")])
    assert rows(memoised(search.and_search(index(), ["the"]))[0]) == [(1, 1)]
    time.sleep(0.01)
    index = stored(spark, tmp_path, [(1, "the"), (2, "the the")])
    again, kept = memoised(search.and_search(index(), ["the"]))
    assert not kept and rows(again) == [(1, 1), (2, 2)] and memoised(search.and_search(index(), ["the"]))[1]


def test_what_has_no_key(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    spark.range(20).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert plan_key(spark.createDataFrame([(1,)], "id long")) is None
    assert plan_key(a.withColumn("r", F.rand())) is None
    assert plan_key(a.withColumn("u", F.udf(lambda x: x, "long")("id"))) is None
    assert plan_key(a.mapInPandas(lambda x: x, "id long")) is None
    assert plan_key(a) == plan_key(spark.read.parquet(str(tmp_path / "a"))) != plan_key(b)
    assert plan_key(a.join(b, "id", "left")) != plan_key(b.join(a, "id", "left"))
    assert plan_key(a.where("id > 1")) != plan_key(a.where("id > 2"))
