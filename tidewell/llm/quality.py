"""Host-level quality rules with an empirical beta prior, in DataFrame functions only.

Each document gets its word, symbol, line and repetition counts and the rules that it fails. Failures are
summed by host (``host_col``); host rates are shrunk towards the corpus by a beta prior fitted to the
hosts by moments, so a host with few documents isn't judged by chance. A host is bad if its shrunk rate is
``SPREAD`` standard deviations of the prior above the prior's mean, or above ``max_rate`` where that is less. The verdict comes back to the documents: a document that fails the base rules
always goes; one that fails only soft rules goes if its host is bad; one that fails no rule stays
wherever it comes from.

Defined results: a null text is empty (no words, so the base rules reject it). A null host is a host of its
own. Rows are judged one by one, so repeated rows get equal verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Bytes that separate words, and the counted symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Soft rules: symbols for each word, equal lines for each line, mean letters of a word.
MAX_SYMBOLS_PER_WORD = 0.3
MAX_DUP_LINES = 0.3
MEAN_WORD = (2.0, 12.0)
MAX_RATE = 0.5
#: Standard deviations of the fitted prior.
SPREAD = 2.0


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row even where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``h``: the hashes in order."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, i, j: F.get(s, j)["h"] == x["h"]
        repeated = F.filter(s, lambda x, i: F.when((i > 0) & same(x, i, i - 1), True).otherwise(F.coalesce((i < last) & same(x, i, i + 1), F.lit(False))))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(_let(pairs, starts), total)


def _repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w) - WINDOW + 1
        hashes = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))

    return F.coalesce(_let(words, of), F.lit(0).cast("long"))


def measures(text: Column) -> dict[str, Column]:
    """The counts of a text. n_lines: lines with a word."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return {
        "_words": word_counts,
        "_lines": line_counts,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_measures(docs: DataFrame, text_col: str, host_col: str, prefix: str = "__tidewell_") -> DataFrame:
    """``docs`` with prefixed counts, host, base_failed and soft_failed."""
    p = prefix
    df = docs.withColumns({f"{p}{k}": v for k, v in measures(F.col(text_col)).items()})
    df = df.withColumns({f"{p}n_words": F.col(f"{p}_words.n_words"), f"{p}n_repeat_words": F.col(f"{p}_words.n_repeat_words"), f"{p}n_lines": F.col(f"{p}_lines.n_lines"), f"{p}n_dup_lines": F.col(f"{p}_lines.n_dup_lines")}).drop(f"{p}_words", f"{p}_lines")
    n = F.col(f"{p}n_words")
    soft = (F.col(f"{p}n_symbols") > MAX_SYMBOLS_PER_WORD * n) | (F.col(f"{p}n_dup_lines") > MAX_DUP_LINES * F.col(f"{p}n_lines")) | ~F.col(f"{p}word_chars").between(MEAN_WORD[0] * n, MEAN_WORD[1] * n)
    base = (n < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return df.withColumns({f"{p}host": F.coalesce(F.col(host_col).cast("string"), F.lit("")), f"{p}base_failed": base, f"{p}soft_failed": soft})


def host_rates(measured: DataFrame, prefix: str = "__tidewell_", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, bad): failures by host, shrunk by the fitted beta prior."""
    failed = F.col(f"{prefix}base_failed") | F.col(f"{prefix}soft_failed")
    counted = measured.groupBy(F.col(f"{prefix}host").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = store(counted, "hosts", 64)
    k, n = F.col("n_failed"), F.col("n_docs")
    sums = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(k), F.sum(k * k / n)).first()
    a, ab = beta_prior(*sums) if sums[0] else (0.0, 1.0)
    rate = (k + a) / (n + ab)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > rate_limit(a, ab, max_rate)).alias("bad"))


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """(a, a + b) of the beta by moments. squares: sum of failed * failed / docs over the hosts."""
    mean = failed / docs
    between = (squares - failed * mean) / docs - mean * (1 - mean) * hosts / docs
    strength = min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e6)
    return mean * strength, strength


def rate_limit(a: float, ab: float, max_rate: float) -> float:
    """The rate from which a host is bad: an outlier of the fitted prior, or over ``max_rate``."""
    mean = a / ab
    return min(max_rate, mean + SPREAD * (mean * (1 - mean) / (ab + 1)) ** 0.5)


def _verdict(measured: DataFrame, hosts: DataFrame, p: str) -> DataFrame:
    bad = hosts.select(F.col("host").alias(f"{p}host"), F.col("rate").alias(f"{p}rate"), F.col("bad").alias(f"{p}bad"))
    # the size of the host table decides how Spark joins it
    joined = measured.join(bad, f"{p}host", "left")
    return joined.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~(F.col(f"{p}soft_failed") & F.coalesce(f"{p}bad", F.lit(False))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each document: its counts, base_failed, soft_failed, its host's shrunk rate, and kept."""
    p = "__tidewell_"
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    measured = store(with_measures(thin, "_text", "_host", p).drop("_text", "_host"), "quality")
    out = _verdict(measured, host_rates(measured, p, max_rate), p)
    return out.select("doc_id", *[F.col(p + c).alias(c) for c in COUNTS], F.col(p + "base_failed").alias("base_failed"), F.col(p + "kept").alias("kept"), F.col(p + "soft_failed").alias("soft_failed"), F.col(p + "host").alias("host"), F.col(p + "rate").alias("host_rate"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were.

    The rows are written once with their flags and host, so the counts are made once and texts are never shuffled.
    """
    p = "__tidewell_"
    flags = [f"{p}host", f"{p}base_failed", f"{p}soft_failed"]
    measured = store(with_measures(docs, text_col, host_col, p).select(*docs.columns, *flags), "quality-rows")
    return _verdict(measured, host_rates(measured, p, max_rate), p).where(F.col(f"{p}kept")).select(*docs.columns)
