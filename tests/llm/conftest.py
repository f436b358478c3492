import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two", "en", "a", 7),
    (4, "the same line\nthe same line\nother\n\n \n", "en", "b", 38),
    (5, "a b c d e f g a b c d e f g a b c d e", "en", "b", 37),
    (6, "héé ✓ 日本語 #tag $5 <b> a|b 50% x&y *", "fr", None, 30),
    (6, "héé ✓ 日本語 #tag $5 <b> a|b 50% x&y *", "fr", None, 30),
    (7, "w" * 5000, "en", "c", 5000),
    (8, " ".join(f"w{i}" for i in range(3000)), "en", "c", 0),
    (9, " ".join("x" for _ in range(400)), "en", "c", 0),
    (10, "tab\tand\x0bvt\x0cff\rcr nbsp em <|endoftext|>", "en", "c", 0),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with inner ones."""
    df = spark.createDataFrame(EDGE, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"key": F.lit("k"), "size": F.lit(1), "fp": F.lit(2), "start": F.lit(3), "piece": F.lit("p"), "host": F.lit("h"), "_text": F.lit("t"), "_doc": F.lit(7), "_crc": F.lit(8), "_n": F.lit(9), "_spans": F.lit("s"), "_q_host": F.lit("q")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
