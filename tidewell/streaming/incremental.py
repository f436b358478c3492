"""Incremental maintenance: reuse of tokenised pages, pruning, change streams with the latest action winning."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def split_by_cache(items: DataFrame, cache: DataFrame, key: str = "content_key", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): items whose key is cached, and those to tokenise. ``force`` makes all of them misses."""
    if force:
        return items.limit(0), items
    known = cache.select(key).distinct()
    return items.join(known, key, "left_semi"), items.join(known, key, "left_anti")


def reuse(items: DataFrame, cache: DataFrame, tokenise: Callable[[DataFrame], DataFrame], key: str = "content_key", force: bool = False) -> DataFrame:
    """Cached rows for known keys, fresh rows for the others; ``tokenise`` sees only the misses."""
    hits, misses = split_by_cache(items, cache, key, force)
    return cache.join(hits.select(key).distinct(), key, "left_semi").unionByName(tokenise(misses))


def resolve_references(references: DataFrame, cache: DataFrame, key: str = "content_key") -> tuple[DataFrame, int]:
    """Rows of unchanged items from the cache, and how many references the cache doesn't have."""
    lost = references.join(cache.select(key).distinct(), key, "left_anti").count()
    return references.join(cache, key), lost


def prune(kept: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was seen in this build."""
    return kept.join(seen.select(key).distinct(), key, "left_semi")


def latest_actions(changes: DataFrame, key: str = "content_id", at: str = "changed_at", action: str = "action") -> DataFrame:
    """The last change of each key; of changes at one time, the greatest action."""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(action))
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_changes(table: DataFrame, changes: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """The table after deletes and upserts; items hold the new rows."""
    last = latest_actions(changes).select(F.col("content_id").alias(key), "action")
    rest = table.join(last.select(key), key, "left_anti")
    return rest.unionByName(items.join(last.where("action = 'index'").select(key), key, "left_semi").select(*table.columns))


def stream_changes(stream: DataFrame, table_path: str, checkpoint: str, items: Callable[[DataFrame], DataFrame], watermark: str | None = None):
    """Apply a change stream to a bucketed, versioned table (``create_table``).

    A micro-batch rewrites only the buckets that its ids fall into, in a new folder, and then publishes a manifest that
    names each bucket's folder. Manifests are new files put in place by one rename, so a reader or a restart
    sees the version before or the version after, never none. A manifest has the last epoch applied of each
    stream, by the query's id that its checkpoint keeps: a batch that runs again after its manifest is skipped, one that
    died before it is done again, and a query with a new checkpoint is a stream of its own whose epochs all count.
    A watermark, if given, is an extension: changes later than it are dropped.
    """
    if watermark:
        stream = stream.withWatermark("changed_at", watermark)

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        now = _manifest(spark, table_path)
        if now["applied"].get(own, -1) >= epoch:
            return
        bucket = _bucket(F.col("content_id"), now["buckets"])
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # a row for each bucket
        folder = f"{own.rsplit('/', 1)[-1]}-{epoch}"
        if touched:
            rows = apply_changes(_read_buckets(spark, table_path, now, touched), batch, items(batch), now["key"])
            _write_buckets(rows, f"{table_path}/data/{folder}", now["key"], now["buckets"])
        parts = now["parts"] | {str(b): folder for b in touched}
        _publish(spark, table_path, now | {"version": now["version"] + 1, "parts": parts, "applied": now["applied"] | {own: epoch}})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def create_table(rows: DataFrame, table_path: str, key: str = "id", buckets: int = 64) -> None:
    """Version 0 of a table in ``buckets`` buckets by the hash of its key."""
    _write_buckets(rows, f"{table_path}/data/start", key, buckets)
    parts = {str(b): "start" for b in range(buckets)}
    _publish(rows.sparkSession, table_path, {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.json(), "parts": parts, "applied": {}})


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    return _read_buckets(spark, table_path, _manifest(spark, table_path))


def current_version(spark: SparkSession, table_path: str) -> int:
    return _manifest(spark, table_path)["version"]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    rows.withColumn("_bucket", _bucket(F.col(key), buckets)).repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)


def _read_buckets(spark: SparkSession, table_path: str, manifest: dict, wanted: list[int] | None = None) -> DataFrame:
    """Rows of the wanted buckets, or all: a scan for each folder that still holds some of them, pruned to those."""
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    folders: dict[str, list[int]] = {}
    for b, folder in manifest["parts"].items():
        if wanted is None or int(b) in wanted:
            folders.setdefault(folder, []).append(int(b))
    out = spark.createDataFrame([], schema)
    for folder, own in sorted(folders.items()):
        part = spark.read.schema(StructType([*schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{table_path}/data/{folder}")
        out = out.unionByName(part.where(F.col("_bucket").isin(own)).drop("_bucket"))
    return out


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _manifest(spark: SparkSession, table_path: str) -> dict:
    """The newest manifest; names that begin with a dot were never published."""
    fs, folder = _files(spark, f"{table_path}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    last = max(n for n in names if n.endswith(".json") and not n.startswith("."))
    return json.loads(spark.read.text(f"{table_path}/manifests/{last}", wholetext=True).first()[0])


def _publish(spark: SparkSession, table_path: str, manifest: dict) -> None:
    name = f"{manifest['version']:012d}.json"
    fs, own = _files(spark, f"{table_path}/manifests/.{name}.{uuid.uuid4().hex}")
    out = fs.create(own, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    final = _files(spark, f"{table_path}/manifests/{name}")[1]
    if fs.exists(final) or not fs.rename(own, final):
        fs.delete(own, False)
        raise RuntimeError(f"version {manifest['version']} of {table_path} is there already: another writer was first")


def progress(written: int, total: int, chunk: int) -> float:
    """Share of chunks written."""
    return 1.0 if total <= 0 else min(1.0, written / -(-total // chunk))
