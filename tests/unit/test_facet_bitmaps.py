import random

from pyspark.sql import functions as F

from tidewell.operators import facet_bitmaps, facets, search

ROWS = "page_no long, dim string, value string"


def made(seed=1, pages=4000):
    rng = random.Random(seed)
    ids = [rng.choice([i, i + 32_768 * 5, -i, 10**12 + i, 64 * i, 32_767 + i]) for i in range(pages)]
    rows = [(p, "language", rng.choice(["en", "fr"])) for p in ids] + [(p, "tag", f"t{min(rng.randrange(40), rng.randrange(40))}") for p in ids for _ in range(2)]
    return ids, rows + [(ids[0], "tag", None), (None, "tag", "t1"), *rows[:5], (2**40, "rare", "one")]


def rows(df):
    return sorted(map(tuple, df.select("dim", "value", "count").collect()), key=repr)


def test_counts_equal_those_of_joins(spark):
    ids, data = made()
    table = spark.createDataFrame(data, ROWS)
    known = table.where("page_no is not null")
    bitmaps = facet_bitmaps.build(table)
    rng = random.Random(2)
    hits = spark.createDataFrame([(p,) for p in rng.sample(ids, 900) + ids[:5] + ids[:5]] + [(None,), (77**7,)], "page_no long")
    other = spark.createDataFrame([(p,) for p in rng.sample(ids, 500)], "page_no long")
    s, o = facet_bitmaps.page_set(hits), facet_bitmaps.page_set(other)
    assert rows(facet_bitmaps.total_counts(bitmaps)) == rows(facets.total_counts(known))
    assert rows(facet_bitmaps.counts(s, bitmaps)) == rows(facets.facet_counts(hits, known))
    picked = {"language": ["en"], "tag": ["t1"]}
    assert rows(facet_bitmaps.structural_counts(s, bitmaps, picked, facets.STRUCTURAL)) == rows(facets.structural_counts(hits, known, picked))
    assert rows(facet_bitmaps.counts(facet_bitmaps.union(s, o), bitmaps)) == rows(facets.or_union_counts([hits, other], known))
    assert rows(facet_bitmaps.expansion_counts(s, o, bitmaps)) == rows(facets.expansion_counts(hits, other, known))
    wanted = {"language": "en", "tag": ["t1", "t2"]}
    kept = facet_bitmaps.intersect(s, facet_bitmaps.filtered(bitmaps, wanted))
    assert kept.agg(facet_bitmaps.size(kept)).first()[0] == search.filtered(hits.distinct(), known, wanted).count()
    assert rows(facet_bitmaps.counts(kept, bitmaps)) == rows(facets.facet_counts(search.filtered(hits, known, wanted), known))


def test_sets_and_empty_ones(spark):
    _, data = made(3, 50)
    bitmaps = facet_bitmaps.build(spark.createDataFrame(data, ROWS))
    none = facet_bitmaps.page_set(spark.createDataFrame([], "page_no long"))
    assert rows(facet_bitmaps.counts(none, bitmaps)) == [] and none.agg(facet_bitmaps.size(none)).first()[0] == 0
    assert facet_bitmaps.filtered(bitmaps, {"tag": ["no such"]}).collect() == []
    assert rows(facet_bitmaps.total_counts(facet_bitmaps.build(spark.createDataFrame([], ROWS)))) == []


def test_a_value_on_all_pages_is_a_bit_a_page_and_no_row_is_longer_than_a_bucket(spark):
    table = spark.range(100_000).select(F.col("id").alias("page_no"), F.lit("d").alias("dim"), F.lit("v").alias("value"))
    got = facet_bitmaps.build(table).select(F.size("words").alias("n"), "pages").collect()
    assert sorted(r["n"] for r in got) == [27, 512, 512, 512] and sum(r["pages"] for r in got) == 100_000
