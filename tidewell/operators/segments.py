"""A search index that grows by segments: batches are added, replaced and deleted without building it anew.

Each batch becomes a segment, which is never written to again: its postings in order of terms, its pages with their lengths, and
bitmaps of the page ids that it replaces or deletes in all segments before it. A page of a segment is live if no later bitmap has it; the
ids of a batch aren't looked up anywhere when it is added, so adding costs what the batch costs. A search reads the postings of its terms
in all segments, pruned by row groups, and takes out what later bitmaps have.

Segments merge geometrically: the newest are put together while the one before them isn't ``RATIO`` times as large. There are then
logarithmically many, and a page is written logarithmically often. A merge drops dead rows and unites bitmaps; those of the oldest
segment go, as there is nothing before it.

A manifest names the segments of a version. It is put in place by one rename after all else is written: a
reader sees the version before or after, and what a lost writer leaves behind is in no manifest. ``vacuum`` removes such folders and
those of old versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.incremental import _files as hadoop_path
from ..streaming.incremental import _manifest as read_manifest
from ..streaming.incremental import _publish as publish_manifest
from ..streaming.incremental import latest_actions
from ..sources.sealed import check, seal
from .index import TextIndex

RATIO = 2
#: Pages for each file of a segment's postings.
FILE_PAGES = 50_000


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` has the bit at a position of ``bitmap_bit_position``."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def bitmaps(ids: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) of the ids; null ids have none."""
    return ids.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


@dataclass
class SegmentFamily:
    """A family in a folder. key: column of page ids, whole numbers; text: column that is indexed; secret: what segments are sealed with, if anything."""

    spark: SparkSession
    path: str
    key: str
    text: str
    secret: bytes = b""

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_col: str, text: str, key: bytes = b"") -> SegmentFamily:
        publish_manifest(spark, path, {"version": 0, "key": id_col, "text": text, "segments": [], "applied": {}})
        return cls.open(spark, path, key)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: bytes = b"") -> SegmentFamily:
        now = read_manifest(spark, path)
        return cls(spark, path, now["key"], now["text"], key)

    def check(self) -> None:
        """Read all files of the newest version and hold them against their seals; ``Broken`` if one differs."""
        if not self.secret:
            raise ValueError("seals can't be checked without a key")
        for s in (s for s in self.segments if s["pages"] or s["bitmaps"]):
            check(self.spark, f"{self.path}/segments/{s['name']}", f"{self.path}/seals/{s['name']}", self.secret)

    def _seal(self, name: str) -> None:
        if self.secret:
            seal(self.spark, f"{self.path}/segments/{name}", f"{self.path}/seals/{name}", self.secret)

    @property
    def segments(self) -> list[dict]:
        """Segments of the newest version, oldest first: name, number of pages written, whether it has bitmaps."""
        return read_manifest(self.spark, self.path)["segments"]

    def add(self, docs: DataFrame, applied: dict | None = None) -> None:
        """Index a batch; pages with its ids in earlier segments are replaced. An id that comes twice in a batch is one page of both texts' words."""
        self._append(docs, docs.select(self.key), applied)

    def delete(self, ids: DataFrame, applied: dict | None = None) -> None:
        """Pages with these ids are no longer found; ids that there aren't do nothing."""
        self._append(None, ids.select(F.col(self.key).cast("long")), applied)

    def apply(self, changes: DataFrame, items: DataFrame, applied: dict | None = None) -> None:
        """A batch of a change log (content_id, action, changed_at): the last action of each id, 'index' or another, counts.

        items: the new rows of the changed ids.
        """
        last = latest_actions(changes).select(F.col("content_id").cast("long").alias(self.key), "action")
        self._append(items.join(last.where("action = 'index'").select(self.key), self.key, "left_semi"), last.select(self.key), applied)

    def stream(self, changes: DataFrame, checkpoint: str, items: Callable[[DataFrame], DataFrame]):
        """Writer of a change stream into the family: a micro-batch is a segment, and its epoch is published with it.

        A batch that runs again after its manifest was published is skipped; one that died before it is done again.
        """

        def one(batch: DataFrame, epoch: int) -> None:
            own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
            if read_manifest(self.spark, self.path)["applied"].get(own, -1) < epoch:
                self.apply(batch, items(batch), {own: epoch})

        return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)

    def index(self) -> TextIndex:
        """What the search operators read: live pages and postings of all segments."""
        segments = self.segments
        return TextIndex(self._live(segments, "pages"), self._live(segments, "postings"), self.key)

    def vacuum(self) -> int:
        """Remove the folders that the newest manifest doesn't name, and old manifests. No other writer or reader of an old version may be at work."""
        now = read_manifest(self.spark, self.path)
        kept = {s["name"] for s in now["segments"]} | {f"{now['version']:012d}.json"}
        gone = 0
        for folder in ("segments", "seals", "manifests"):
            fs, at = hadoop_path(self.spark, f"{self.path}/{folder}")
            for entry in fs.listStatus(at) if fs.exists(at) else []:
                if entry.getPath().getName() not in kept:
                    fs.delete(entry.getPath(), True)
                    gone += 1
        return gone

    def _append(self, docs: DataFrame | None, replaced: DataFrame, applied: dict | None) -> None:
        now = read_manifest(self.spark, self.path)
        name = f"{now['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        pages = 0
        if docs is not None:
            built = TextIndex.of(docs, self.key, self.text, max_positions=None)
            pages = self._write(name, built.pages, built.postings)
        has_bits = bool(now["segments"])
        if has_bits:
            bitmaps(replaced, self.key).write.parquet(f"{self.path}/segments/{name}/bitmaps")
        if pages or has_bits:
            self._seal(name)
        segments = [*now["segments"], {"name": name, "pages": pages, "bitmaps": has_bits}]
        segments = self._merged(segments, f"{now['version'] + 1:08d}-{uuid.uuid4().hex[:8]}")
        publish_manifest(self.spark, self.path, now | {"version": now["version"] + 1, "segments": segments, "applied": now["applied"] | (applied or {})})

    def _write(self, name: str, pages: DataFrame, postings: DataFrame) -> int:
        """Write a segment's tables; its number of pages. Few pages are few files."""
        folder = f"{self.path}/segments/{name}"
        pages.write.parquet(f"{folder}/pages")
        n = self.spark.read.schema(pages.schema).parquet(f"{folder}/pages").count()
        files = max(1, -(-n // FILE_PAGES))
        postings.repartitionByRange(files, "term", self.key).sortWithinPartitions("term", self.key).write.parquet(f"{folder}/postings")
        return n

    def _merged(self, segments: list[dict], name: str) -> list[dict]:
        """The newest segments as one, from the first that isn't ``RATIO`` times as large as all behind it."""
        start = len(segments) - 1
        behind = segments[start]["pages"]
        while start and segments[start - 1]["pages"] < RATIO * behind:
            start -= 1
            behind += segments[start]["pages"]
        # deletions alone are no pages: they wait for a merge, but not for ever
        if len(segments) - start < 2:
            if sum(not s["pages"] for s in segments) < 16:
                return segments
            start = max(next(i for i, s in enumerate(segments) if not s["pages"]) - 1, 0)
        part = segments[start:]
        pages = self._write(name, self._live(part, "pages"), self._live(part, "postings"))
        has_bits = start > 0 and any(s["bitmaps"] for s in part)
        if has_bits:
            united = self._bitmaps(part).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            united.write.parquet(f"{self.path}/segments/{name}/bitmaps")
        self._seal(name)
        return [*segments[:start], {"name": name, "pages": pages, "bitmaps": has_bits}]

    def _bitmaps(self, segments: list[dict]) -> DataFrame:
        """(bucket, bits, since) of some segments; since: the segment's number among them."""
        out = self.spark.createDataFrame([], "bucket long, bits binary, since int")
        for i, s in enumerate(segments):
            if s["bitmaps"]:
                out = out.unionByName(self.spark.read.schema("bucket long, bits binary").parquet(f"{self.path}/segments/{s['name']}/bitmaps").withColumn("since", F.lit(i)))
        return out

    def _live(self, segments: list[dict], table: str) -> DataFrame:
        """Rows of a table of some segments that no later one of them replaces."""
        key = f"`{self.key}` long"
        schema = f"{key}, length long" if table == "pages" else f"term string, {key}, tf long, positions array<int>"
        out = self.spark.createDataFrame([], f"{schema}, _at int")
        for i, s in enumerate(segments):
            if s["pages"]:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s['name']}/{table}").withColumn("_at", F.lit(i)))
        if any(s["bitmaps"] for s in segments[1:]):
            later = self._bitmaps(segments)
            replaced = (F.bitmap_bucket_number(self.key) == F.col("bucket")) & (F.col("_at") < F.col("since")) & has_bit(F.col("bits"), F.bitmap_bit_position(self.key))
            out = out.join(later, replaced, "left_anti")
        return out.drop("_at")
