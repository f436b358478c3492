"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Pass 1 turns each text into ids, cuts what is longer than a sequence and ranks pieces of equal length
inside their partition. The histogram of lengths, at most ``capacity`` numbers, is all that the driver
sees. It is packed there by best-two-fit: a bin is filled greedily, largest first; then its smallest
piece gives way to the two unpacked pieces that fill the widened gap more tightly than that piece did. A filling is
repeated for as many bins as the histogram has pieces for, so the plan has a row for each kind of
filling and slot. Pass 2 finds each piece's bin and offset from its length and its rank among equals.

Defined results: a null text is empty; an empty text is one piece that holds the end id. Rows with the
same doc_id are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, id_text
from .tokens import encoder, rank_table, small_batches

CAPACITY = 2048
END_ID = 0


def _pieces(path: str, by_ranks: bool, capacity: int, end_id: int):
    """Rows of (doc_id, piece, start, length, ids_crc32, part, rank) from (doc_id, text)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = encoder(path, by_ranks), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for big in batches:
            for batch in small_batches(big):
                out: list[list[int]] = [[], [], [], [], [], []]
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    bounds = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a])):
                            column.append(value)
                        seen[b - a] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(arrays[0]), part, np.int32))], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    return run


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best-two-fit over a histogram of lengths: (number of bins, the lengths in each of them)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        spare = left.copy()
        bin_: list[int] = []
        gap = capacity
        k = len(have) - 1
        while k >= 0 and gap >= have[0]:
            k = min(k, int(np.searchsorted(have, gap, "right")) - 1)
            if k < 0:
                break
            n = int(min(spare[have[k]], gap // have[k]))
            bin_ += [int(have[k])] * n
            spare[have[k]] -= n
            gap -= n * int(have[k])
            k -= 1
        if gap and bin_:
            smallest = bin_[-1]
            pair = _tightest_pair(spare, gap + smallest, smallest)
            if pair:
                bin_[-1:] = pair
        sizes, uses = np.unique(bin_, return_counts=True)
        times = int((left[sizes] // uses).min())
        left[sizes] -= times * uses
        out.append((times, sorted(bin_, reverse=True)))


def _tightest_pair(spare: np.ndarray, room: int, above: int) -> list[int] | None:
    """Two unpacked lengths with the largest sum that fits ``room`` and is above ``above``."""
    have = np.flatnonzero(spare[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1  # the largest partner of each
    ok = at >= 0
    a, b = have[ok], have[at[ok]]
    same = (a == b) & (spare[a] < 2)
    lower = np.searchsorted(have, b, "left") - 1
    b = np.where(same & (lower >= 0), have[np.maximum(lower, 0)], b)
    ok = ~(same & (lower < 0))
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    best = int(np.argmax(a + b))
    return [int(a[best]), int(b[best])] if a[best] + b[best] > above else None


def _plan(packed: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Rows (length, first rank, first sequence, offset), sorted by length and first rank."""
    rows, used, sequence = [], {}, 0
    for times, lengths in packed:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def _place(plan: tuple[np.ndarray, ...], capacity: int):
    lengths, ranks, sequences, offsets = plan
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            col = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            rank, length = col["rank"] + col["before"], col["length"]
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                lo, hi = starts[n], starts[n + 1]
                row[at] = lo + np.searchsorted(ranks[lo:hi], rank[at], "right") - 1
            arrays = [*[b.column(i) for i in range(5)], pa.array(sequences[row] + rank - ranks[row]), pa.array(offsets[row])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    made = id_text(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, rank_table(tokenizer) is not None, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int")
    pieces = Stored(made, "pack-pieces").df
    counts = Stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts", 32).df
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = _plan(pack_lengths(histogram, capacity))
    # pieces of a length before those of each partition: a row for each partition of pass 1 and length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInArrow(_place(plan, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
