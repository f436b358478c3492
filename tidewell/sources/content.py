"""Content sources: published items, change streams, HTML files, site pages."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, urls

TRACKER = "content_id string, content_type string, action string, changed_at timestamp"


class ContentSource(Protocol):
    def published(self) -> DataFrame: ...

    def changed(self) -> DataFrame: ...

    def deleted_ids(self) -> DataFrame: ...

    def acknowledge(self) -> None: ...


class TableSource:
    """Items and a change log as tables; ``since`` moves on when a build acknowledges what it read.

    The first reading after an acknowledgement fixes the newest change that this build sees; ``changed``, ``deleted_ids``
    and ``counts`` all read up to it, and ``acknowledge`` moves ``since`` there and no further, so changes that arrive
    meanwhile are left for the next build. Changes at the very time of the bound that are logged later need a log whose
    times only grow, as a commit log's do.
    """

    def __init__(self, items: DataFrame, tracker: DataFrame, since=None):
        self.items, self.tracker, self.since = items, tracker, since
        self._read_to = None

    def _pending(self) -> DataFrame:
        if self._read_to is None:
            self._read_to = self.tracker.agg(F.max("changed_at")).first()[0]
        upto = F.col("changed_at") <= F.lit(self._read_to)
        return self.tracker.where(upto if self.since is None else upto & (F.col("changed_at") > F.lit(self.since)))

    def latest(self) -> DataFrame:
        """The last action of each content id."""
        return self._pending().groupBy("content_id").agg(F.max_by("action", F.struct("changed_at", "action")).alias("action"))

    def published(self) -> DataFrame:
        return self.items

    def changed(self) -> DataFrame:
        ids = self.latest().where("action = 'index'")
        return self.items.join(ids, self.items["id"] == ids["content_id"], "left_semi")

    def deleted_ids(self) -> DataFrame:
        return self.latest().where("action = 'delete'").select(F.col("content_id").alias("id"))

    def counts(self) -> tuple[int, int]:
        """Published items, pending changes."""
        return self.items.count(), self.latest().count()

    def acknowledge(self) -> None:
        """All that was read since the last acknowledgement is done; without a reading nothing changes."""
        self.since = self._read_to or self.since
        self._read_to = None


def html_files(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Items from HTML files: title, body, meta and filter attributes; the URL is the file's name."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1))
    return items_from_html(raw, F.col("value"), F.concat(F.lit("/"), F.col("file")), F.col("file"), F.lit(language))


def site_pages(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Items from a table of raw pages; the language is that of the html element."""
    return items_from_html(pages, F.col(html), urls.portable(F.col(url)), F.col(key).cast("string"), F.coalesce(F.nullif(clean.page_language(F.col(html)), F.lit("")), F.lit("en")))


def attribute_map(html: Column, kind: str) -> Column:
    """Map of attribute keys to arrays of their values, in order of the page."""
    pairs = clean.data_attributes(html, kind)
    keyed = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: x["v"])))


def items_from_html(rows: DataFrame, html: Column, url: Column, key: Column, language: Column) -> DataFrame:
    meta = F.transform_values(attribute_map(html, "meta"), lambda k, v: F.element_at(v, 1))
    return rows.select(
        key.alias("id"), clean.page_title(html).alias("title"), html.alias("body_html"), F.coalesce(F.element_at(meta, "url"), url).alias("url"), F.coalesce(F.element_at(meta, "date"), F.lit("")).alias("date"),
        F.lit("").alias("site_name"), language.alias("language"), attribute_map(html, "filter").alias("filters"), meta.alias("metadata"), F.create_map().cast("map<string,string>").alias("sortable"),
    )
