"""Token ids in directly addressable code (DAC) files.

Ids are split into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every id; a bit for each
tells whether the id goes on in level 1, and so on. A rank directory over these bits (ones before every
512th bit) gives the place of an id's next chunk, so any single token is read from a few bytes:
place i in level k continues at place rank_k(i) of level k + 1.

File: magic, header length, JSON header (counts, sections), then sections, each aligned to 8 bytes:
``doc_id`` and ``end`` (int64 a document: its id, ids up to its end in this file) and, for each level,
``chunk`` (uint8 or uint16), ``bits`` (uint64 words, lowest bit first) and ``rank`` (uint64).

Files hold the documents in ascending doc_id order: file n holds only ids below those of file n + 1.
A task writes under a name of its own and renames, so a task that runs again leaves the same files.

Defined results: a null text is empty and has the end id only. Rows with equal doc_id are written each,
ordered by text. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, id_text, scratch, shuffle_partitions
from .tokens import encoder, rank_table, small_batches

MAGIC = b"DACTOK01"
#: Ids in a file.
FILE_TOKENS = 16_000_000
CHUNK = 8
BLOCK = 512


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def encode_levels(ids: np.ndarray, chunk: int = CHUNK) -> list[dict[str, np.ndarray]]:
    """The levels of ``ids`` (unsigned 32-bit)."""
    levels = []
    rest = np.ascontiguousarray(ids, np.uint32)
    kind = np.uint8 if chunk <= 8 else np.uint16
    while True:
        more = rest >> chunk
        flags = more > 0
        words = np.packbits(flags, bitorder="little")
        words = np.pad(words, (0, -len(words) % 8)).view("<u8")
        counts = np.add.reduceat(flags, np.arange(0, len(flags), BLOCK), dtype=np.uint64) if len(flags) else np.zeros(0, np.uint64)
        rank = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        levels.append({"chunk": (rest & ((1 << chunk) - 1)).astype(kind), "bits": words, "rank": rank})
        if not flags.any():
            return levels
        rest = more[flags]


def decode_all(levels: list[dict[str, np.ndarray]], n: int, chunk: int = CHUNK) -> np.ndarray:
    """All ids, level by level."""
    out = np.zeros(n, np.uint32)
    at = np.arange(n)
    for k, level in enumerate(levels):
        out[at] |= level["chunk"].astype(np.uint32) << np.uint32(chunk * k)
        flags = np.unpackbits(level["bits"].view(np.uint8), count=len(level["chunk"]), bitorder="little").astype(bool)
        at = at[flags]
    return out


def _layout(doc_ids: list[int], ends: list[int], levels: list[dict[str, np.ndarray]], chunk: int) -> bytes:
    sections, blobs, at = [], [], 0
    named = [("doc_id", np.array(doc_ids, "<i8")), ("end", np.array(ends, "<i8"))]
    named += [(f"{name}{k}", a) for k, level in enumerate(levels) for name, a in level.items()]
    for name, a in named:
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        sections.append([name, a.dtype.str, len(a), at])
        blobs.append(raw)
        at += len(raw)
    head = json.dumps({"n": ends[-1] if ends else 0, "docs": len(doc_ids), "levels": len(levels), "chunk": chunk, "sections": sections}).encode()
    head += b" " * (-len(head) % 8)
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(blobs)


class TokenFile:
    """Reads a file: whole sections, or single tokens by a few small reads."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.f = fs.open_input_file(path)
        start = self.f.read_at(16, 0)
        if start[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        (n,) = struct.unpack("<Q", start[8:])
        self.head = json.loads(self.f.read_at(n, 16))
        self.at = {name: (np.dtype(kind), count, 16 + n + place) for name, kind, count, place in self.head["sections"]}

    def section(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        kind, total, place = self.at[name]
        count = total - first if count is None else count
        return np.frombuffer(self.f.read_at(count * kind.itemsize, place + first * kind.itemsize), kind)

    def ids(self) -> np.ndarray:
        levels = [{x: self.section(f"{x}{k}") for x in ("chunk", "bits")} for k in range(self.head["levels"])]
        return decode_all(levels, self.head["n"], self.head["chunk"])

    def token(self, i: int) -> int:
        """Id number ``i``: a chunk, a rank entry and at most a block of bits for each level."""
        value = 0
        for k in range(self.head["levels"]):
            value |= int(self.section(f"chunk{k}", i, 1)[0]) << (self.head["chunk"] * k)
            block = i // BLOCK
            words = self.section(f"bits{k}", block * BLOCK // 64, i // 64 - block * BLOCK // 64 + 1)
            if not int(words[-1]) >> (i % 64) & 1:
                return value
            ones = sum(int(w).bit_count() for w in words[:-1]) + (int(words[-1]) & ((1 << (i % 64)) - 1)).bit_count()
            i = int(self.section(f"rank{k}", block, 1)[0]) + ones
        return value

    def close(self) -> None:
        self.f.close()


def _write(folder: str, tokenizer: str, by_ranks: bool, end_id: int, chunk: int, file_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, by_ranks), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ends, parts, n, made = [], [], [], 0, 0

        def close():
            """Write what is held as a file; its manifest row."""
            nonlocal doc_ids, ends, parts, n, made
            levels = encode_levels(np.frombuffer(b"".join(parts), "<u4"), chunk)
            name = f"part-{part:06d}-{made:04d}.dac"
            fs, path = _fs(folder)
            fs.create_dir(path, recursive=True)
            own = f"{path}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(_layout(doc_ids, ends, levels, chunk))
            fs.move(own, f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [made], "file": [name], "docs": [len(doc_ids)], "tokens": [n]}, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            doc_ids, ends, parts, n, made = [], [], [], 0, made + 1
            return row

        for big in batches:
            for batch in small_batches(big):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                    if n and n + len(ids) // 4 + 1 > file_tokens:
                        yield close()
                    n += len(ids) // 4 + 1
                    doc_ids.append(doc_id)
                    ends.append(n)
                    parts.append(ids + end)
        if doc_ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, partitions: int | None = None, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Write the files; returns the folder and the manifest (part, number, file, docs, tokens, first).

    ``first``: ids in all files before. One shuffle orders the texts by doc_id; ids are made after it. A task closes a file
    before a document that would take it beyond ``file_tokens`` ids, so that it holds no more, or one document.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    n = partitions or shuffle_partitions(spark)
    rows = id_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = Stored(rows.mapInArrow(_write(folder, tokenizer, rank_table(tokenizer) is not None, end_id, chunk, file_tokens), "part int, number int, file string, docs long, tokens long"), "token-manifest").df
    upto = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return folder, manifest.withColumn("first", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(f"{folder}/{name}")
                ends, raw = f.section("end"), f.ids().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                view = memoryview(raw).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.section("doc_id")), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    return run


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = manifest.select("file", "first").repartition(shuffle_partitions(spark))
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
