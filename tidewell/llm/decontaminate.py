"""Benchmark decontamination by spaced-seed hashing.

A seed looks at some of the positions of a window of words and ignores the others (``MASKS``), so a
window hashes alike after substitutions at ignored positions. Seed hashes of the documents are joined
with those of the benchmark; each hit fixes an item and a diagonal (document position minus item
position). Along it the words are compared. The item is in the document if the diagonal matches
``MIN_SHARE`` of the item's words, wherever the substitutions are. For partial copies the best segment is found
too (a match counts 1, a substitution costs ``COST``): it has to match ``MIN_MATCH`` words, or ``MIN_SHARE`` of a
shorter item, and ``MIN_SHARE`` of its own positions.

No such diagonal is without a hit. m matches with at most m / 3 substitutions between them are at most
m / 3 + 1 runs, so one of them has over 2 words if m > 6: the mask of three words finds it. Items of ``MIN_ITEM``
words can have 6 matches, in runs of two, and have a seed of two words for themselves.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words (one item at least), a pass over the
documents each: the driver and a task have one block in memory, and the next one while it is made, whatever the number
of items. Documents are never
shuffled, and a word, passage or item that is in a third of them costs nothing extra.

Words are split at white space, lower-cased and rid of punctuation at both ends; words of punctuation
only are skipped. Items of fewer than ``MIN_ITEM`` words are found where all their words stand in a row, by a seed of their own
length; a single word is an item like any other. Null and empty texts match nothing; repeated rows get repeated results. Texts are read whole, one in memory at a time beside
slices of about 4 MB; only the named columns are looked at, so no other column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .tokens import small_batches

#: Positions of a window that a seed looks at (1) and ignores (0).
MASKS = ("110100110101", "111001010011", "101011100101", "1110110111", "110010111", "11101101", "111")
MIN_ITEM = 8
MIN_MATCH = 13
MIN_SHARE = 0.75
COST = 2
BLOCK_WORDS = 500_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: Words compared at once.
_AT_ONCE = 2_000_000


@lru_cache(maxsize=400_000)
def _word(raw: str) -> int:
    """Hash of a word without its edges; 0 if nothing is left."""
    import xxhash

    w = _EDGE.sub("", raw)
    return xxhash.xxh3_64_intdigest(w) or 1 if w else 0


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text ends."""
    parts, ends, n = [], [], 0
    for t in texts:
        h = np.array([_word(w) for w in t.lower().split()], np.uint64)
        h = h[h != 0]
        n += len(h)
        parts.append(h)
        ends.append(n)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(ends, np.int64)


def _masks() -> list[list[int]]:
    return [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def _seed(words: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    """Hash of the looked-at words of the window at every position."""
    n = len(words) - places[-1]
    h = np.full(max(n, 0), salt + 1, np.uint64)
    for p in places:
        h = (h ^ words[p : p + n]) * _MIX if n > 0 else h
        h ^= h >> np.uint64(29)
    return h


class Block:
    """Seeds of some items: sorted hashes with item and position, and a filter over their low bits."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.words, ends = word_hashes(texts)
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.ends = ends
        item_of = np.repeat(np.arange(len(ids)), self.ends - self.starts)
        self.seeds = []
        for k, places in enumerate(_masks()):
            h = _seed(self.words, places, k)
            at = np.arange(len(h))
            inside = item_of[: len(h)] == item_of[places[-1] : places[-1] + len(h)] if len(h) else np.zeros(0, bool)
            self._add(places, k, h[inside], at[inside])
        # items that are too short for substitutions: all of their words, as they are
        for n in range(1, MIN_ITEM):
            at = self.starts[self.ends - self.starts == n]
            if len(at):
                self._add(list(range(n)), 200 + n, _seed(self.words, list(range(n)), 200 + n)[at], at)
        # the shortest of the others: two words
        at = (self.starts[self.ends - self.starts == MIN_ITEM][:, None] + np.arange(MIN_ITEM - 1)).ravel()
        self._add([0, 1], 100, _seed(self.words, [0, 1], 100)[at], at)
        self.item_of = item_of

    def _add(self, places: list[int], salt: int, h: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        low = np.zeros(1 << _FILTER_BITS, bool)
        low[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.seeds.append((places, salt, h[order], at[order], low))

    def find(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, first word, end, matches) of each item found in each text."""
        if not len(words) or not len(self.words):
            return []
        doc_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        found: list[np.ndarray] = []
        for places, salt, hashes, at, low in self.seeds:
            h = _seed(words, places, salt)
            if not len(h) or not len(hashes):
                continue
            p = np.flatnonzero(low[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            p = p[doc_of[p] == doc_of[p + places[-1]]]
            lo, hi = np.searchsorted(hashes, h[p], "left"), np.searchsorted(hashes, h[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total = np.cumsum(n)
            a = 0
            while a < len(p):  # a slice of all hits at a time
                b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + _AT_ONCE, "right")))
                m = n[a:b]
                q = at[np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                at_word = np.repeat(p[a:b], m)
                found.append(np.unique(np.stack([doc_of[at_word], self.item_of[q], at_word - q]), axis=1))
                a = b
        if not found:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        starts = np.concatenate([[0], ends[:-1]])
        diagonals = np.unique(np.concatenate(found, axis=1), axis=1)
        for d, i, shift in diagonals[:, self._enough(words, starts, ends, *diagonals)].T.tolist():
            a = max(self.starts[i], starts[d] - shift)
            b = min(self.ends[i], ends[d] - shift)
            hit = self._segment(words[a + shift : b + shift] == self.words[a:b], int(self.ends[i] - self.starts[i]))
            if hit and hit[2] > best.get((d, i), (0, 0, 0))[2]:
                first = int(a + shift - starts[d])
                best[d, i] = (first + hit[0], first + hit[1], hit[2])
        return [(d, i, *v) for (d, i), v in best.items()]

    def _enough(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, d: np.ndarray, i: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which diagonals match as many words in all as a hit has to have at least."""
        a = np.maximum(self.starts[i], starts[d] - shift)
        n = np.minimum(self.ends[i], ends[d] - shift) - a
        total = np.cumsum(n)
        same = np.zeros(len(n), np.int64)
        k = 0
        while k < len(n):
            j = max(k + 1, int(np.searchsorted(total, total[k] - n[k] + _AT_ONCE, "right")))
            m = n[k:j]
            q = np.repeat(a[k:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            equal = words[q + np.repeat(shift[k:j], m)] == self.words[q]
            same[k:j] = np.add.reduceat(equal, np.cumsum(m) - m, dtype=np.int64)
            k = j
        return same >= np.minimum(MIN_MATCH, MIN_SHARE * (self.ends - self.starts)[i])

    @staticmethod
    def _segment(same: np.ndarray, length: int) -> tuple[int, int, int] | None:
        """(start, end, matches) of the whole overlap or else of the best segment, if it says that the item is there."""
        n = int(same.sum())
        if length < MIN_ITEM:
            return (0, n, n) if n == length else None
        if n >= MIN_SHARE * length:
            return int(same.argmax()), len(same) - int(same[::-1].argmax()), n
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -COST))])
        lowest = np.minimum.accumulate(total)
        end = int(np.argmax(total - lowest))
        start = int(np.argmax(total[: end + 1] == lowest[end]))
        n = int(same[start:end].sum())
        enough = n >= min(MIN_MATCH, MIN_SHARE * length)
        return (start, end, n) if enough and n >= MIN_SHARE * (end - start) else None


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark block by block; the driver reads one item at a time and closes a block when it is full."""
    ids, texts, n = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        size = len(r["t"].split())
        if ids and n + size > BLOCK_WORDS:
            yield Block(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        n += size
    if ids:
        yield Block(ids, texts)


def _passes(docs: DataFrame, benchmark: DataFrame, schema: str, of: Callable) -> DataFrame | None:
    """The union of what a pass over ``docs`` gives for each block.

    A benchmark of one block is a plan like any other. Of more, one block at a time is in the driver and the tasks: what a pass
    finds is written down before the next block is made, and its broadcast is given back.
    """
    source = blocks(benchmark)
    block = next(source, None)
    out: DataFrame | None = None
    while block is not None:
        following = next(source, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = docs.mapInArrow(of(shared), schema)
        if following is not None or out is not None:
            found = store(found, "decontamination")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
        block = following
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word, n_matched) for every item in every contaminated document."""
    schema = "doc_id long, item_id long, first_word int, end_word int, n_matched int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _passes(rows, benchmark, schema, _finder)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(shared):
    def run(batches):
        import pyarrow as pa

        block = shared.value
        for big in batches:
            for batch in small_batches(big):
                ids = batch.column(0).to_pylist()
                hits = block.find(*word_hashes(batch.column(1).to_pylist()))
                cols = list(zip(*[(ids[d], block.ids[i], a, b, n) for d, i, a, b, n in hits])) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "first_word", "end_word", "n_matched"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns as they were.

    A benchmark of one block drops rows as it reads them. Of more, each pass reads the texts and writes only the keys of those with
    an item (128 bits of hash of the text, by which alone a row is judged); the rows go by these in one join, so the corpus is never written.
    """
    source = blocks(benchmark)
    block = next(source, None)
    if block is None:
        return docs
    if next(source, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        return docs.mapInArrow(_dropper(shared, docs.columns.index(text_col), text_col), docs.schema)
    p = "__tidewell_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {f"{p}key": F.xxhash64(text), f"{p}alt": F.xxhash64(F.lit("alt"), text)}
    found = _passes(docs.select(*(v.alias(k) for k, v in keys.items()), text.alias("text")), benchmark, f"{p}key long, {p}alt long", _marker)
    return docs.withColumns(keys).join(found.distinct(), list(keys), "left_anti").select(*docs.columns)


def _marker(shared):
    """Rows (key, alt, text) to the keys of texts with an item."""

    def run(batches):
        import pyarrow as pa

        block = shared.value
        for big in batches:
            for batch in small_batches(big, "text"):
                hits = sorted({hit[0] for hit in block.find(*word_hashes(batch.column(2).to_pylist()))})
                yield batch.select([0, 1]).take(pa.array(hits, pa.int64()))

    return run


def _dropper(shared, at: int, text_col: str):
    def run(batches):
        import pyarrow as pa

        block = shared.value
        for big in batches:
            for batch in small_batches(big, text_col):
                keep = np.ones(batch.num_rows, bool)
                for hit in block.find(*word_hashes([t or "" for t in batch.column(at).to_pylist()])):
                    keep[hit[0]] = False
                yield batch.filter(pa.array(keep))

    return run
