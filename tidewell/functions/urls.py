"""URL forms: portable, export path, dedupe key, path tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable(url: Column) -> Column:
    """Path, query and fragment of an absolute URL; other URLs as they are."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][^:]*://[^/?#]*", "")
    rest = F.when(rest == "", "/").when(rest.rlike("^[?#]"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(url.contains("://"), rest).otherwise(url)


def export_path(url: Column) -> Column:
    """File of a URL: no query or fragment, index.html for folders and for what has no such name yet."""
    path = F.regexp_replace(F.regexp_replace(portable(url), r"[?#].*$", ""), r"^/+|/+$", "")
    return F.when(path == "", "index.html").when(path.rlike(r"(^|/)index\.html$"), path).otherwise(F.concat(path, F.lit("/index.html")))


def dedupe_key(url: Column) -> Column:
    """Lower case without .html and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"\.html$", ""), r"/+$", "")


def path_words(url: Column) -> Column:
    """The path as text for the tokenizer: no extension, slashes as blanks."""
    path = F.regexp_replace(portable(url), r"[?#].*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(path, r"\.\w+$", ""), "/+", " "))
