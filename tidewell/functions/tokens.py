"""Words, normalised forms, bigrams and query terms. All native but the fold of non-Latin diacritics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Emoji shown as pictures (Unicode Emoji_Presentation), for Java's regular expressions.
EMOJI = (
    r"\x{231A}-\x{231B}\x{23E9}-\x{23EC}\x{23F0}\x{23F3}\x{25FD}-\x{25FE}\x{2614}-\x{2615}\x{2648}-\x{2653}\x{267F}\x{2693}\x{26A1}\x{26AA}-\x{26AB}\x{26BD}-\x{26BE}"
    r"\x{26C4}-\x{26C5}\x{26CE}\x{26D4}\x{26EA}\x{26F2}-\x{26F3}\x{26F5}\x{26FA}\x{26FD}\x{2705}\x{270A}-\x{270B}\x{2728}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}"
    r"\x{2795}-\x{2797}\x{27B0}\x{27BF}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{1F004}\x{1F0CF}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}\x{1F201}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F236}\x{1F238}-\x{1F23A}\x{1F250}-\x{1F251}\x{1F300}-\x{1F320}\x{1F32D}-\x{1F335}\x{1F337}-\x{1F37C}\x{1F37E}-\x{1F393}\x{1F3A0}-\x{1F3CA}"
    r"\x{1F3CF}-\x{1F3D3}\x{1F3E0}-\x{1F3F0}\x{1F3F4}\x{1F3F8}-\x{1F43E}\x{1F440}\x{1F442}-\x{1F4FC}\x{1F4FF}-\x{1F53D}\x{1F54B}-\x{1F54E}\x{1F550}-\x{1F567}"
    r"\x{1F57A}\x{1F595}-\x{1F596}\x{1F5A4}\x{1F5FB}-\x{1F64F}\x{1F680}-\x{1F6C5}\x{1F6CC}\x{1F6D0}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}\x{1F6DC}-\x{1F6DF}"
    r"\x{1F6EB}-\x{1F6EC}\x{1F6F4}-\x{1F6FC}\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FA7C}"
    r"\x{1FA80}-\x{1FA89}\x{1FA8F}-\x{1FAC6}\x{1FACE}-\x{1FADC}\x{1FADF}-\x{1FAE9}\x{1FAF0}-\x{1FAF8}"
)
LETTERS, DIGITS = r"\p{L}", r"\p{N}"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{2FA1F}"
PUNCTUATION = r"[\p{Pd}\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}]"
#: Latin letters with marks and their bare letters.
_MARKED = "àáâãäåāăąǎçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőǒŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_BARE = "aaaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"


def words(text: Column, emoji: bool = True) -> Column:
    """Runs of letters, digits and pictures, with quotes inside that letters follow: ``don't``, ``rock'n'roll``.

    Letters behind a quote end a word where a digit or picture follows them: ``a'b1`` is ``a'b`` and ``1``. No group is
    repeated in any pattern, since Java's engine recurses at each repeat and a long word of quotes would end the JVM:
    quotes that no letter follows become blanks, a blank ends the letters behind a quote, and what is left are runs of one class.
    """
    others = DIGITS + (EMOJI if emoji else "")
    joined = F.regexp_replace(text, rf"'(?![{LETTERS}])", " ")
    cut = F.regexp_replace(joined, rf"([{LETTERS}{others}]'[{LETTERS}]++)(?=[{others}])", "$1 ")
    return F.regexp_extract_all(F.when(text.contains("'"), cut).otherwise(text), F.lit(rf"[{LETTERS}{others}][{LETTERS}{others}']*"), F.lit(0))


def fold_latin(text: Column) -> Column:
    """Diacritics of lower-case Latin letters, natively."""
    return F.translate(text, _MARKED, _BARE)


def fold_text(text: str) -> str:
    """Decompose, drop non-spacing marks, compose."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else fold_text(t))


def fold(text: Column) -> Column:
    """The fold of the index and of queries. Only text with letters beyond the native table reaches Python."""
    latin = fold_latin(text)
    plain = latin.rlike(r"^[\x00-\x7F]*$")
    # a Python function gets all rows, whatever the condition around it; those that it isn't for are null there
    return F.when(plain, latin).otherwise(_fold(F.when(~plain, text)))


def camel_parts(word: Column) -> Column:
    """Lower-cased parts at a-z|A-Z; parts of one letter go, and the whole word stands if none is left."""
    parts = F.filter(F.transform(F.split(word, "(?<=[a-z])(?=[A-Z])"), F.lower), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lower(word)))


def cjk_parts(word: Column) -> Column:
    """Overlapping bigrams of CJK runs (one character stays alone); other runs are one token each."""
    runs = F.regexp_extract_all(F.lower(word), F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, grams))


def tokenize(text: Column, emoji: bool = True) -> Column:
    """Lower-cased tokens in order (array of strings); normalise them by ``fold`` after exploding."""

    def parts(w: Column) -> Column:
        return F.when(w.rlike(f"[{CJK}]"), cjk_parts(w)).otherwise(camel_parts(w))

    return F.flatten(F.transform(words(F.coalesce(text, F.lit("")), emoji), parts))


def normalise_query(query: Column, keep: str = "") -> Column:
    """Punctuation out (but ``keep``), lower case, single blanks; fold it like the index."""
    pattern = PUNCTUATION if not keep else rf"(?![{''.join('\\' + c for c in keep)}]){PUNCTUATION}"
    return fold(F.trim(F.regexp_replace(F.lower(F.regexp_replace(query, pattern, "")), r"\s+", " ")))


def is_exact(query: Column) -> Column:
    """Whether a query is one quoted phrase."""
    return query.rlike(r'^\s*".+"\s*$')


def search_terms(query: Column, stop_words: list[str]) -> Column:
    """Query terms without stop words; all of them if nothing else is left."""
    terms = F.filter(tokenize(query), lambda t: t != "")
    kept = F.filter(terms, lambda t: ~t.isin(stop_words)) if stop_words else terms
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def significant_words(text: Column) -> Column:
    """Distinct lower-cased words of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\W]+"), lambda w: F.length(w) >= 2))
