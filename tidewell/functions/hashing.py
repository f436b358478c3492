"""Content keys: reuse of work, change of a corpus, cache keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(url: Column, body: Column, title: Column | None = None) -> Column:
    """Key of tokenised content. With ``title`` a changed title is a change too."""
    parts = [url, F.lit("\x00"), body] + ([F.lit("\x00"), title] if title is not None else [])
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def page_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def row_digest(key: Column, body: Column) -> Column:
    """Hash of an id and a body; nulls are told from empty ones."""
    return F.sha2(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(F.sha2(body, 256), F.lit("-"))), 256)


def digest_parts(digest: Column) -> list[Column]:
    """A hash as eight numbers, which can be added up."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]


def corpus_fingerprint(items: DataFrame, id_col: str, body_col: str, prefix: str = "tidewell-v1:") -> DataFrame:
    """One row: a hash of all ids and bodies that no order changes.

    Hashes of rows are added up (as decimals, per byte range), so no task gathers the corpus.
    """
    row = F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(F.col(body_col), 256)), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"p{i}") for i in range(8)]
    sums = items.select(row.alias("r"), id_col, body_col).agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws(":", F.lit(prefix), F.col("n").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"), F.col("n").alias("items"))


def cache_key(action: Column, generation: Column, parts: list[Column], prefix: str = "tidewell") -> Column:
    return F.concat_ws("_", F.lit(prefix), action, generation.cast("string"), F.sha2(F.lower(F.concat_ws("|", *parts)), 256))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest (RFC 2104) of a text or of bytes, natively: what wrote a chunk, and that nothing has changed it."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in block)) for mask in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def intact(message: Column, crc: Column, mac: Column | None = None, key: bytes = b"") -> Column:
    """Whether a record has its crc32, and its keyed digest if one is given."""
    same = F.crc32(message.cast("binary")) == crc
    return same if mac is None else same & (hmac_sha256(message, key) == mac)
