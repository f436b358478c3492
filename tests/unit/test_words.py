from pyspark.sql import functions as F

from tidewell.functions.tokens import fold, is_exact, normalise_query, search_terms, significant_words, tokenize, words

TEXTS = {
    "Hello World": ["hello", "world"],
    "don't rock'n'roll": ["don't", "rock'n'roll"],
    "camelCase iPhone parseHTML XMLParser": ["camel", "case", "phone", "parse", "html", "xmlparser"],
    "mother-in-law": ["mother", "in", "law"],
    "日本語 検索x": ["日本", "本語", "検索", "x"],
    "2024 v2": ["2024", "v2"],
    "a 🎉 b": ["a", "🎉", "b"],
    "": [],
    "...": [],
}


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert {r[0]: r[1] for r in df.select("t", tokenize(F.col("t"))).collect()} == TEXTS


def test_fold(spark):
    df = spark.createDataFrame([("café",), ("naïve",), ("ピ",), ("ärger",), ("plain",), ("ø",)], "t string")
    assert [r[0] for r in df.select(fold(F.col("t"))).collect()] == ["cafe", "naive", "ヒ", "arger", "plain", "ø"]


def test_queries(spark):
    df = spark.createDataFrame([('"exact phrase"', "C++ & Café,  now!"), ("plain", "x")], "a string, b string")
    r = df.select(is_exact(F.col("a")), normalise_query(F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(True, "c++ cafe now"), (False, "x")]
    one = spark.createDataFrame([("The art of the deal", "the of")], "a string, b string")
    assert one.select(search_terms(F.col("a"), ["the", "of"]), search_terms(F.col("b"), ["the", "of"])).first() == (["art", "deal"], ["the", "of"])
    assert one.select(significant_words(F.lit("A big, BIG dog"))).first()[0] == ["big", "dog"]


def test_keyed_digests(spark):
    import hmac

    from tidewell.functions.hashing import hmac_sha256, intact

    for key in (b"", b"k", b"x" * 64, b"y" * 100):
        df = spark.createDataFrame([("",), ("abc",), ("日本語" * 50,)], "m string")
        got = {r["m"]: r["d"] for r in df.select("m", hmac_sha256(F.col("m"), key).alias("d")).collect()}
        assert got == {m: hmac.new(key, m.encode(), "sha256").hexdigest() for m in got}
    row = spark.createDataFrame([("abc", "abd")], "a string, b string").select(*[intact(F.col(c), F.crc32(F.lit("abc")), hmac_sha256(F.lit("abc"), b"k"), b"k") for c in "ab"]).first()
    assert tuple(row) == (True, False)


def test_words_with_quotes_equal_a_pattern_with_a_repeated_group(spark):
    import itertools

    import regex

    texts = ["".join(x) for n in range(1, 7) for x in itertools.product("a1' ", repeat=n)] + ["é'ü'🎉a", "🎉'a'b🎉'c", "a'b𠀀'c1'd", "''a''b''", "日'本1"]
    want = {t: regex.findall(r"[\p{L}\p{N}🎉]+(?:'\p{L}+)*", t) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", words(F.col("t")).alias("w")).collect()} == want
    plain = {t: regex.findall(r"[\p{L}\p{N}]+(?:'\p{L}+)*", t) for t in texts}
    assert {r["t"]: r["w"] for r in df.select("t", words(F.col("t"), emoji=False).alias("w")).collect()} == plain


def test_hostile_words_of_a_megabyte(spark, tmp_path):
    from tidewell.plans.catalogue import QUERIES

    n = 500_000
    hostile = ["a'" * n, "a'b1" * (n // 2), "'" * (2 * n), "1'" * n, "a" * (2 * n), "日" * 300_000]
    spark.createDataFrame([(i, t) for i, t in enumerate(hostile)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n"] for r in QUERIES["doc_tokens"](spark, str(tmp_path)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 1, 1: n // 2 + 1, 3: n, 4: 1, 5: 1}
    pages = [(i, f"https://x.org/{i}", f"<html><body>{t}</body></html>") for i, t in enumerate(hostile[:2])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["page_index"](spark, str(tmp_path)).count() >= 2
