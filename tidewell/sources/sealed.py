"""Sealed tables: what wrote the files of a folder, and that nothing has changed, taken away or added one.

A seal has a row for each file: its name, length, CRC-32 and keyed digest, and the digest of the whole list, so a line that is taken out shows too. It is
written beside the table and made and checked by tasks, a file each, in built-in functions; a file is in one task's memory, so tables are written in
files of a bounded size. ``SegmentFamily`` seals each segment if it has a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256, intact

SEAL = "file string, length long, crc long, mac string"
#: The row of the list itself.
WHOLE = ""


class Broken(ValueError):
    """A table that isn't what was sealed."""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, content) of all data files below a folder; names relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    base = folder.rstrip("/").split("://")[-1].lstrip("/")
    return found.select(F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})").alias("file"), "length", "content")


def _list_mac(rows: DataFrame, key: bytes) -> DataFrame:
    """The list's own row: keyed digests of all rows added up, so no task has the list."""
    line = hmac_sha256(F.concat_ws("|", "file", F.col("length").cast("string"), "mac"), key)
    sums = [F.coalesce(F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)]
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    text = F.concat_ws(":", F.col("n").cast("string"), *[f"s{i}" for i in range(8)])
    return whole.select(F.lit(WHOLE).alias("file"), F.col("n").alias("length"), F.lit(0).cast("long").alias("crc"), hmac_sha256(text, key).alias("mac"))


def seal(spark: SparkSession, folder: str, target: str, key: bytes) -> None:
    """Write the seal of a folder's files to another folder."""
    rows = _files(spark, folder).select("file", "length", F.crc32("content").alias("crc"), hmac_sha256(F.col("content"), key).alias("mac"))
    rows.write.parquet(target)
    stored = spark.read.schema(SEAL).parquet(target)
    _list_mac(stored, key).write.mode("append").parquet(target)


def check(spark: SparkSession, folder: str, target: str, key: bytes) -> None:
    """Raise ``Broken`` with the first files that differ, if any does."""
    sealed = spark.read.schema(SEAL).parquet(target)
    lines = sealed.where(F.col("file") != WHOLE)
    known = {r["mac"] for r in sealed.where(F.col("file") == WHOLE).collect()}
    if known != {_list_mac(lines, key).first()["mac"]}:
        raise Broken(f"the seal of {folder} isn't whole, or has another key")
    own = lines.select(F.col("file").alias("sealed"), F.col("length").alias("n"), "crc", "mac")
    both = _files(spark, folder).join(own, F.col("file") == F.col("sealed"), "full")
    same = F.col("file").isNotNull() & F.col("sealed").isNotNull() & (F.col("length") == F.col("n")) & intact(F.col("content"), F.col("crc"), F.col("mac"), key)
    bad = both.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("file", "sealed").alias("file")).limit(5).collect()
    if bad:
        raise Broken(f"files of {folder} that differ from their seal: {sorted(r['file'] for r in bad)}")


def read_sealed(spark: SparkSession, folder: str, target: str, key: bytes, schema=None) -> DataFrame:
    """The table, after its files have been checked."""
    check(spark, folder, target, key)
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)
