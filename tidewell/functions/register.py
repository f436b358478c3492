"""SQL names: html_clean, html_entities, tokenize, stem_word, fold_word, url_key, url_portable, and the table function word_tokens.

All but the walk over a page's tags, references, stems and the fold of other than Latin letters are SQL bodies over built-in functions, the
same patterns as the column functions'; tests hold both against each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .clean import TITLE_WINDOW, TRIM, WS, decode_entities, text_of
from .stem import _stem
from .tokens import CJK, DIGITS, EMOJI, LETTERS, _fold

_RUN = LETTERS + DIGITS + EMOJI
_WORDS = rf"""regexp_extract_all(CASE WHEN contains(t, "'") THEN regexp_replace(regexp_replace(t, r"'(?![{LETTERS}])", " "), r"([{_RUN}]'[{LETTERS}]++)(?=[{DIGITS}{EMOJI}])", "$1 ") ELSE t END, r"[{_RUN}][{_RUN}']*", 0)"""
_BIGRAMS = rf"""flatten(transform(regexp_extract_all(lower(w), r"[{CJK}]+|[^{CJK}]+", 0), r -> CASE WHEN r RLIKE r"^[{CJK}]" AND length(r) > 1 THEN transform(sequence(1, length(r) - 1), i -> substring(r, i, 2)) ELSE array(r) END))"""
_CAMEL = r"""filter(transform(split(w, r"(?<=[a-z])(?=[A-Z])"), p -> lower(p)), p -> length(p) >= 2)"""
_TOKENIZE = rf"""coalesce(flatten(transform({_WORDS}, w -> CASE WHEN w RLIKE r"[{CJK}]" THEN {_BIGRAMS} WHEN size({_CAMEL}) > 0 THEN {_CAMEL} ELSE array(lower(w)) END)), array())"""
#: Native SQL functions by name and parameters, and body.
SQL_FUNCTIONS = {
    "url_key(u STRING) RETURNS STRING": r"""regexp_replace(regexp_replace(lower(u), r"\.html$", ""), r"/+$", "")""",
    "url_portable(u STRING) RETURNS STRING": r"""CASE WHEN contains(u, "://") THEN regexp_replace(regexp_replace(u, r"^[a-zA-Z][^:]*://[^/?#]*", ""), r"^(?![/])", "/") ELSE u END""",
    "tokenize(t STRING) RETURNS ARRAY<STRING>": _TOKENIZE,
    # a generator takes no SQL function, so the body stands here too
    "word_tokens(t STRING, language STRING) RETURNS TABLE(position INT, original STRING, term STRING)": f"SELECT pos, col, stem_word(fold_word(col), coalesce(language, '')) FROM posexplode({_TOKENIZE})",
}


@pandas_udf(StringType())
def _html_clean(html: pd.Series, title: pd.Series) -> pd.Series:
    import re

    space = re.compile(WS)

    def one(h: str | None, name: str | None) -> str | None:
        if h is None:
            return None
        text = space.sub(" ", text_of(h)).strip(TRIM)
        at = text.find(name) if name else -1
        return text[at + len(name) :].lstrip(TRIM) if name and 0 <= at < TITLE_WINDOW else text

    return pd.Series([one(h, t) for h, t in zip(html, title)], dtype=object)


def register(spark: SparkSession) -> None:
    """html_clean(html, title): an empty or null title takes nothing away."""
    spark.udf.register("html_clean", _html_clean)
    spark.udf.register("html_entities", decode_entities)
    spark.udf.register("stem_word", _stem)
    spark.udf.register("fold_word", _fold)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def describe() -> dict:
    """Names and version, for clients that ask."""
    from tidewell import __version__

    return {"name": "tidewell", "version": __version__, "functions": ["html_clean", "html_entities", "stem_word", "fold_word", *[h.split("(")[0] for h in SQL_FUNCTIONS]]}
