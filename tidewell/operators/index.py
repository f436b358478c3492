"""Building the index: pages, tokens, postings, variants, lexicon, facets, sort orders, meta fields.

Everything is a table with a row for each smallest fact (term and page, value and page), so no list grows
with the corpus. Words are folded and stemmed once for each distinct form, then joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean, hashing, tokens, urls
from ..functions.stem import stem_column

#: Shortest indexed text, positions kept for each term and page, weight of body words.
MIN_CHARS = 10
MAX_POSITIONS = 200
BODY_WEIGHT = 25
ITEM = (
    "id string, title string, body_html string, url string, date string, site_name string, language string, "
    "filters map<string,array<string>>, metadata map<string,string>, sortable map<string,string>"
)


def dense_numbers(df: DataFrame, key: str, name: str = "page_no", first: int = 0) -> DataFrame:
    """(key, name): gapless numbers in the order of ``key``, without a single-task window over the rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the bucket must follow the order of the keys: range partitions by a sample of them
    ranged = df.select(key).repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_rank", inner).join(F.broadcast(offsets), "_part").select(key, (F.col("_before") + F.col("_rank") - 1 + first).cast("long").alias(name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by its key if it is in fewer partitions than there are cores, as a small table in one file is.

    A table that is already in many partitions isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def prepare_pages(items: DataFrame) -> DataFrame:
    """Cleaned items that are long enough, with content, field texts, merged filters, sort keys and meta."""
    title = clean.clean_title(F.coalesce("title", F.lit("")))
    df = items.withColumns({"title_text": title, "url": urls.portable(F.col("url"))})
    df = df.withColumn("clean", clean.html_clean(F.coalesce("body_html", F.lit("")), F.col("title_text"))).where(F.length("clean") >= MIN_CHARS)
    own = F.coalesce("filters", F.create_map().cast("map<string,array<string>>"))
    built_in = F.map_filter(F.create_map(F.lit("site"), F.array(F.coalesce("site_name", F.lit(""))), F.lit("language"), F.array(F.coalesce("language", F.lit("en")))), lambda k, v: (F.element_at(v, 1) != "") & ~F.map_contains_key(own, k))
    sortable = F.coalesce("sortable", F.create_map().cast("map<string,string>"))
    dated = F.when((F.coalesce("date", F.lit("")) != "") & ~F.map_contains_key(sortable, "date"), F.map_concat(sortable, F.create_map(F.lit("date"), F.col("date")))).otherwise(sortable)
    meta_own = F.map_filter(F.create_map(F.lit("title"), F.col("title_text"), F.lit("date"), F.col("date")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    meta = F.map_concat(meta_own, F.map_filter(sortable, lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~F.map_contains_key(meta_own, k)))
    return df.withColumns(
        {
            "content": F.when(F.col("title_text") != "", F.concat(F.col("title_text"), F.lit(". "), F.col("clean"))).otherwise(F.col("clean")),
            "all_filters": F.map_concat(built_in, own),
            "all_sortable": dated,
            "meta": meta,
            "content_key": hashing.content_hash(F.col("url"), F.col("body_html"), F.col("title_text")),
        }
    ).withColumn("page_hash", hashing.page_hash(F.col("content")))


def page_tokens(pages: DataFrame, page_col: str = "page_no", emoji: bool = True) -> DataFrame:
    """(page, field, position, original): one counter over title, body and path."""
    field = lambda text, name: F.transform(tokens.tokenize(text, emoji), lambda t: F.struct(F.lit(name).alias("field"), t.alias("original")))
    streams = F.concat(field(F.col("title_text"), "title"), field(F.col("clean"), "body"), field(urls.path_words(F.col("url")), "url"))
    return pages.select(page_col, F.col("language"), F.posexplode(streams).alias("position", "t")).select(page_col, "language", F.col("t.field").alias("field"), "position", F.col("t.original").alias("original"))


def word_forms(page_tokens: DataFrame, stem: bool = True) -> DataFrame:
    """(language, original, norm, term): every distinct form is folded and stemmed once."""
    forms = page_tokens.select("language", "original").distinct().withColumn("norm", tokens.fold(F.col("original"))).where("norm <> ''")
    return forms.withColumn("term", stem_column(F.col("norm"), F.col("language")) if stem else F.col("norm"))


def with_forms(toks: DataFrame, stem: bool = True) -> DataFrame:
    """``toks`` with norm and term, beside the rows: no table of forms, no join. Stems are kept by word in a worker."""
    named = toks.withColumn("norm", tokens.fold(F.col("original"))).where("norm <> ''")
    return named.withColumn("term", stem_column(F.col("norm"), F.col("language")) if stem else F.col("norm"))


def page_postings(pages: DataFrame, page_col: str = "page_no", stem: bool = True, emoji: bool = True) -> DataFrame:
    """``postings`` of prepared pages. The forms of a page are found once each: its tokens meet by form before they get terms."""
    toks = page_tokens(pages, page_col, emoji)
    place = F.collect_list(F.when(F.col("field") != "title", F.col("position")))
    title = F.collect_list(F.when(F.col("field") == "title", F.col("position")))
    by_form = toks.groupBy(page_col, "language", "original").agg(place.alias("places"), title.alias("titles"))
    whole = lambda c: F.sort_array(F.flatten(F.collect_list(c)))
    by_term = with_forms(by_form, stem).groupBy(page_col, "term").agg(whole("places").alias("places"), whole("titles").alias("titles"))
    return by_term.select("term", page_col, F.slice("places", 1, MAX_POSITIONS).alias("positions"), F.col("titles").alias("title_positions"), (F.size("places") + F.size("titles")).cast("long").alias("tf"))


def postings(toks: DataFrame, forms: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(term, page, positions, title_positions, tf): positions in body and path are cut to MAX_POSITIONS."""
    named = toks.join(forms, ["language", "original"])
    body = F.sort_array(F.collect_list(F.when(F.col("field") != "title", F.col("position"))))
    title = F.sort_array(F.collect_list(F.when(F.col("field") == "title", F.col("position"))))
    return named.groupBy("term", page_col).agg(F.slice(body, 1, MAX_POSITIONS).alias("positions"), title.alias("title_positions"), F.count(F.lit(1)).alias("tf"))


def variants(toks: DataFrame, forms: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(term, form, page): forms that the fold changes, and where they occur."""
    return toks.join(forms.where("norm <> original"), ["language", "original"]).select("term", F.col("original").alias("form"), page_col).distinct()


def lexicon(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def word_counts(toks: DataFrame, page_col: str = "page_no") -> DataFrame:
    """Words in title and body; path words don't count."""
    return toks.groupBy(page_col).agg(F.count(F.when(F.col("field") != "url", 1)).alias("word_count"))


def facet_rows(pages: DataFrame, page_col: str = "page_no", filters: str = "all_filters") -> DataFrame:
    """(dim, value, page): each value of each dimension once for a page."""
    return pages.select(page_col, F.explode(filters).alias("dim", "values")).select(page_col, "dim", F.explode("values").alias("value")).distinct()


def sort_ranks(pages: DataFrame, page_col: str = "page_no", sortable: str = "all_sortable") -> DataFrame:
    """(field, page, rank, is_numeric): numeric order if all values of a field are numbers, else by text; ties by page.

    Ranges of (field, value, page) are numbered on their own and offset by the counts of the ranges before, so a
    field's pages never meet in one task.
    """
    rows = pages.select(page_col, F.explode(sortable).alias("field", "value"))
    kinds = rows.groupBy("field").agg(F.bool_and(is_numeric(F.col("value"))).alias("is_numeric"))
    number = F.when(F.col("is_numeric"), F.trim("value").try_cast("double")).alias("number")
    # only the columns of the order, so that both uses below read one and the same exchange
    keyed = rows.join(kinds, "field").select("field", number, F.when(~F.col("is_numeric"), F.col("value")).alias("word"), page_col)
    order = ["field", "number", "word", page_col]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("field", "_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each field and range
    upto = Window.partitionBy("field").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("field", "_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part", "field").orderBy(*order[1:]))
    placed = ranged.withColumn("_rank", inner).join(offsets, ["field", "_part"]).join(kinds, "field")
    return placed.select("field", page_col, (F.col("_before") + F.col("_rank") - 1).cast("int").alias("rank"), "is_numeric")


def is_numeric(value: Column) -> Column:
    """A decimal number with optional sign, fraction and exponent; blanks around it are allowed."""
    return value.rlike(r"^[ \t\n\r\x0b\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0b\f]*$")


def meta_fields(pages: DataFrame, page_col: str = "page_no") -> DataFrame:
    """(name, place): title first, then in order of first page and place in its map; without url."""
    keys = pages.select(page_col, F.posexplode(F.map_keys("meta")).alias("at", "name")).where("name <> 'url'")
    first = keys.groupBy("name").agg(F.min(F.struct(page_col, "at")).alias("first"))
    order = Window.orderBy(F.col("name") != "title", "first")  # a row for each field name
    return first.select("name", (F.row_number().over(order) - 1).alias("place"))


def merge_postings(*parts: DataFrame, page_col: str = "page_no") -> DataFrame:
    """Union of partial postings; positions of the same term and page are united."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    both = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    return whole.groupBy("term", page_col).agg(both("positions").alias("positions"), both("title_positions").alias("title_positions"), F.sum("tf").alias("tf"))


def delta(values: Column) -> Column:
    """First value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def weighted_positions(by_weight: Column) -> Column:
    """Positions by weight (map) as one array: the body weight plainly, others behind -(weight + 1)."""
    full = F.map_filter(by_weight, lambda w, p: F.size(p) > 0)
    body = F.coalesce(delta(F.element_at(full, BODY_WEIGHT)), F.array().cast("array<int>"))
    others = F.filter(F.sort_array(F.map_keys(full)), lambda w: w != BODY_WEIGHT)
    marked = F.transform(others, lambda w: F.concat(F.array(-(w + 1)), delta(F.element_at(full, w))))
    return F.concat(body, F.flatten(marked))


def term_ranges(lexicon: DataFrame, chunk_terms: int) -> DataFrame:
    """(chunk, first_term, last_term, terms): a directory of fixed numbers of terms in order."""
    numbered = dense_numbers(lexicon, "term", "n")
    return numbered.groupBy(F.floor(F.col("n") / chunk_terms).alias("chunk")).agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.count(F.lit(1)).alias("terms"))


@dataclass
class TextIndex:
    """What the search operators read."""

    pages: DataFrame  # page, length
    postings: DataFrame  # term, page, tf, positions
    page_col: str = "page_no"

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str, stem_language: str | None = None, max_positions: int | None = MAX_POSITIONS) -> TextIndex:
        """Index of one text column: words, lower case, fold; stems if a language is given.

        max_positions: positions kept for a term and page; None keeps all, which phrases need to be exact.
        """
        toks = text_tokens(spread(docs, key), key, text)
        if stem_language:
            forms = toks.select("term").distinct().withColumn("stem", stem_column(F.col("term"), F.lit(stem_language)))
            toks = toks.join(forms, "term").select(key, "position", F.col("stem").alias("term"))
        return cls(toks.groupBy(key).agg(F.count(F.lit(1)).alias("length")), term_postings(toks, key, max_positions), key)

    def stats(self) -> DataFrame:
        """One row: pages, mean length."""
        return self.pages.agg(F.count(F.lit(1)).alias("total_pages"), F.avg("length").alias("average_length"))

    def lexicon(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def text_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, term) of one text column."""
    found = F.transform(tokens.words(F.coalesce(F.col(text), F.lit("")), emoji=False), F.lower)
    return docs.select(key, F.posexplode(found).alias("position", "original")).select(key, "position", tokens.fold_latin(F.col("original")).alias("term"))


def term_postings(toks: DataFrame, key: str, max_positions: int | None = MAX_POSITIONS) -> DataFrame:
    places = F.sort_array(F.collect_list("position"))
    return toks.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), (places if max_positions is None else F.slice(places, 1, max_positions)).alias("positions")).select("term", key, "tf", "positions")
