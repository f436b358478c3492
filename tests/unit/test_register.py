from pyspark.sql import functions as F

from tidewell.functions import clean, tokens, urls
from tidewell.functions.register import describe, register

TEXTS = ["Hello World", "camelCase iPhone XMLParser aB", "don't rock'n'roll a'b1'c ''x''", "日本語 検索x 字 Hello人工智能World", "a 🎉 b🎉c", "naïve CAFÉ", "2024 v2", "", "...", None, "İstanbul", "back\\slash \"quoted\" $1"]
URLS = ["https://x.org/a/b.html?q=1#f", "https://x.org", "/docs/", "http://x.org?q", "http://x.org#f", "", None, "mailto:x", "ftp://h/", "http:///a", "x://", "//h/p", "HTTP://H/P"]


def test_sql_functions_equal_column_functions(spark):
    register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", F.expr("tokenize(t)").alias("a"), tokens.tokenize(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for r in df.select("u", F.expr("url_portable(u)").alias("a"), urls.portable(F.col("u")).alias("b"), F.expr("url_key(u)").alias("c"), urls.dedupe_key(F.col("u")).alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), r["u"]
    pages = [("<body><nav>x</nav> <h1>Title</h1> a &amp; b </body>", "Title"), ("<p>Title  x", ""), ("x" * 60 + "Title", "Title"), (None, "x"), ("<p>a</p>", None), ("", "")]
    df = spark.createDataFrame(pages, "h string, t string")
    for r in df.select("h", F.expr("html_clean(h, t)").alias("a"), clean.html_clean(F.col("h"), F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r["h"]


def test_word_tokens_are_the_engines(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_tokens('camelCase 日本語 🎉 Running', 'en') ORDER BY position").collect()] == [
        (0, "camel", "camel"), (1, "case", "case"), (2, "日本", "日本"), (3, "本語", "本語"), (4, "🎉", "🎉"), (5, "running", "run"),
    ]
    assert {"html_clean", "tokenize", "url_portable", "word_tokens"} <= set(describe()["functions"])
