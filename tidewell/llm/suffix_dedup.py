"""Removal of long repeated passages by a logarithmic family of suffix arrays.

Everything covered by a string of ``length`` symbols that also starts anywhere else (in any text, the same one
included) is removed. Strings are judged on the input, and matches don't cross texts. ``unit`` says what a symbol
is: a byte of the UTF-8 text, or a word `[^\\x20\\x09-\\x0D]+` whatever the white space beside it is.

Suffixes. A suffix array of every position of 100 TB would be many times the input, so the arrays hold the
suffixes at anchors only: the anchor of a string is the start of its smallest k-symbol piece by hash, the
first one if there are several. Equal strings have their anchor at the same place, so each match of
``length`` symbols shows at two anchors whose suffixes agree in their first ``k`` symbols. There is about one
anchor for each (length - k) / 2 symbols. The strings of one anchor start at neighbouring symbols; together
they are the anchor's region, of less than 2 * length symbols. A suffix array has a row for each different
region: the first ``k`` symbols of its suffix as bytes, by which it is sorted, the region's hash, how many copies
there are, and where one is. Equal regions are added up before any shuffle.

Family. Texts come in batches. The array of a batch is scanned with all levels in one pass in the order of the
suffixes' bytes (``_scan``): neighbours with a common prefix of ``k`` symbols are matches to look at, and rows of
equal regions add up. The same pass writes the batch and the full levels below as one array on the
next free level, so equal-sized levels merge geometrically and n batches make at most log2(n) + 1 levels.
The ranges of a pass are cut by suffix and region, so a beginning that many regions share is split over tasks;
the first and the last row of a range count as matches, since their neighbours may be in the next range.

Matches. Each pair of regions with one beginning has met in the scan of the later one's batch, so what the
scans have found is all there is. A region with two copies repeats from end to end. Where a beginning
has several different regions, the region's symbols are fetched once for each of them, and the regions of a beginning
meet in one task: there, all strings of ``length`` symbols are put in order of their hash and equal ones
are found. Beginnings with more than ``WIDE`` different regions are resolved by a shuffle on the strings'
hashes instead, so no task holds an unbounded group. Hashes have 64 bits and are compared only under
equal beginnings.

Defined results: null is empty; texts shorter than ``length`` are left alone. A row is known by a 128-bit hash of its
id, whether that is null, and its text; rows with all of these equal are copies of each other. An empty table gives an
empty result. In ``remove_repeats`` the kept bytes are decoded as UTF-8; the rest of a character that was cut through
is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, row_keys, shuffle_partitions
from .tokens import small_batches

LENGTH = 400
#: Symbols of a suffix's beginning, by unit; 32 bytes of a key in either case.
K = {"bytes": 32, "words": 8}
#: Different regions of one suffix beginning that a task resolves in memory.
WIDE = 2_000
#: Symbols hashed at once; longer texts are taken in overlapping tiles.
TILE = 1 << 20
BATCHES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, and a random value for each byte."""

    def __init__(self, n: int):
        self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), out=self.up)
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), out=self.down)
            self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_POWERS: _Powers | None = None


def _powers(n: int) -> _Powers:
    global _POWERS
    if _POWERS is None or len(_POWERS.up) < n:
        _POWERS = _Powers(max(n, TILE + 4 * LENGTH))
    return _POWERS


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1).up[: len(values)], out=out[1:])
    return out


def _window_hashes(sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    return _mix((sums[starts + lengths] - sums[starts]) * _powers(len(sums)).down[starts])


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w``: of a block's rest and the next block's beginning."""
    n = len(key) - w + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[:n], head[w - 1 : w - 1 + n])


#: Bytes between words.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of texts in a row; a text's end ends a word too."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    stops = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    return starts, stops


def _word_values(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word; about ``TILE`` bytes are in hand at once, one word at least."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + TILE, "right")))
        sums = _sums(_powers(1).byte[data[starts[i] : stops[j - 1]]])
        out[i:j] = _window_hashes(sums, starts[i:j] - starts[i], stops[i:j] - starts[i:j])
        i = j
    return out


class _Symbols:
    """The symbols of texts in a row: ``values`` are what is hashed, ``keys`` what suffixes are sorted by."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str):
        self.unit, self.ends = unit, ends
        if unit == "words":
            starts, stops = word_places(data, ends)
            self.raw = _word_values(data, starts, stops)
            self.ends = np.searchsorted(starts, ends, "left")
        else:
            self.raw = data

    def values(self, a: int, b: int) -> np.ndarray:
        return self.raw[a:b] if self.unit == "words" else _powers(1).byte[self.raw[a:b]]

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` symbols at each place as bytes; a word is the upper half of its hash."""
        found = np.lib.stride_tricks.sliding_window_view(self.raw, k)[at] if len(at) else np.zeros((0, k), self.raw.dtype)
        return (found >> np.uint64(32)).astype(">u4").view(np.uint8) if self.unit == "words" else found


def anchors(symbols: _Symbols, length: int, k: int):
    """(text, first start, last start, anchor, suffix hash, region hash) of each anchor of texts in a row.

    Places count from the text's own beginning.
    """
    parts = []
    ends = symbols.ends
    begins = np.concatenate([[0], ends[:-1]])
    i = 0
    while i < len(ends):
        if ends[i] - begins[i] > TILE:  # a long text alone, in tiles whose starts don't overlap
            for a in range(int(begins[i]), int(ends[i]) - length + 1, TILE):
                b = min(int(ends[i]), a + TILE + length - 1)
                parts.append(_tile(symbols.values(a, b), np.array([b - a]), length, k, i, np.array([a - begins[i]])))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + TILE, "right")))
        parts.append(_tile(symbols.values(begins[i], ends[j - 1]), ends[i:j] - begins[i], length, k, i, np.zeros(j - i, np.int64)))
        i = j
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6


def _tile(values: np.ndarray, ends: np.ndarray, length: int, k: int, first_text: int, shift: np.ndarray):
    n = len(values) - length + 1
    none = [np.zeros(0, np.int64)] * 6
    if n <= 0:
        return none
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - begins)
    valid = np.arange(n) + length <= ends[text[:n]]
    if not valid.any():
        return none
    sums = _sums(values)
    pieces = len(values) - k + 1
    h = _mix((sums[k:] - sums[:-k]) * _powers(len(sums)).down[:pieces])
    low = np.uint64((1 << 23) - 1)
    at = (_sliding_min((h & ~low) | np.arange(pieces, dtype=np.uint64), length - k + 1) & low).astype(np.int64)
    change = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (text[1:n] != text[: n - 1])) + 1
    lo = np.concatenate([[0], change])
    hi = np.concatenate([change, [n]]) - 1
    use = valid[lo]
    lo, hi = lo[use], hi[use]
    a, t = at[lo], text[lo]
    region = _window_hashes(sums, lo, hi - lo + length) ^ _mix(((a - lo) * 4096 + hi - lo).astype(np.uint64))
    back = shift[t] - begins[t]
    return [t + first_text, lo + back, hi + back, a + back, h[a].view(np.int64), region.view(np.int64)]


ENTRY = "key binary, fp long, rh long, doc long, alt long, lo int, hi int"


def _texts(batch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column's texts in a row and where each ends."""
    import pyarrow as pa

    col = batch.column(at)
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(col) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _binary(rows: np.ndarray):
    """An Arrow column of equally long byte strings."""
    import pyarrow as pa

    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _entries(length: int, k: int, unit: str = "bytes"):
    """Rows (doc, alt, text) to ``ENTRY`` rows."""

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in small_batches(big):
                symbols = _Symbols(*_texts(batch, 2), unit)
                t, lo, hi, a, fp, rh = anchors(symbols, length, k)
                begins = np.concatenate([[0], symbols.ends])[t]
                doc, alt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for i in range(0, len(t), 50_000):
                    p = slice(i, i + 50_000)
                    cols = [_binary(symbols.keys((begins + a)[p], k)), *(pa.array(c[p]) for c in (fp, rh, doc[t], alt[t], lo.astype(np.int32), hi.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "fp", "rh", "doc", "alt", "lo", "hi"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keys = row_keys(id_col, text_col)
    return docs.select(keys["doc"].alias("doc"), keys["alt"].alias("alt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))


#: A pass's rows: suffix beginning, its hash, region, copies in the new level and in all, one place, and flags.
_PASS = "key binary, fp long, rh long, n long, total long, doc long, alt long, lo int, hi int, seen boolean, stays boolean, found boolean"
_ARRAY = ["key", "fp", "rh", "n", "doc", "alt", "lo", "hi", "seen"]


def _scan(batches):
    """Rows of several suffix arrays in the order of (key, rh) to ``_PASS`` rows.

    In: ``_ARRAY`` columns, then new (of the batch) and stays (goes into the new level). Rows of one region add up.
    found: the row has a neighbour with its beginning, or copies, and wasn't found before.
    """
    import pyarrow as pa

    names = [*_ARRAY[:-1], "seen", "new", "stays"]
    held = None  # rows of the last region: the next batch may go on with it
    before = None  # the beginning of the region that came before those
    first = True

    def flush(t, last: bool):
        """Rows for the regions of ``t``, all but the last one unless it is the end; and that one's rows."""
        nonlocal before, first
        n = t.num_rows
        column = t.column("key").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        key = np.frombuffer(column.buffers()[2], np.uint8)[np.frombuffer(column.buffers()[1], np.int32)[column.offset] :]
        width = len(column[0].as_py())
        key = key[: n * width].reshape(n, width)
        v = {c: t.column(c).to_numpy() for c in names[1:]}
        same_key = np.concatenate([[False], (key[1:] == key[:-1]).all(1)])
        start = np.flatnonzero(~(same_key & np.concatenate([[False], v["rh"][1:] == v["rh"][:-1]])))
        m = len(start) if last else len(start) - 1
        rest = None if last else t.slice(start[-1])
        if not m:
            return None, rest
        like = np.append(same_key[start], False)  # with the region before
        like[0] = before is not None and bytes(key[0]) == before
        near = like[:m] | like[1 : m + 1]
        near[0] |= first
        near[-1] |= last
        first = False
        before = bytes(key[start[m - 1]])
        total = np.add.reduceat(v["n"], start)[:m]
        stays = np.logical_or.reduceat(v["stays"], start)[:m]
        old = np.logical_or.reduceat(v["seen"], start)[:m]
        new = np.logical_or.reduceat(v["new"], start)[:m]
        seen = near | (total > 1)
        found = seen & (new | ~old)
        out = found | stays
        at = start[:m][out]
        copies = np.add.reduceat(np.where(v["stays"], v["n"], 0), start)[:m]
        cols = [_binary(key[at]), *(pa.array(x) for x in (v["fp"][at], v["rh"][at], copies[out], total[out], v["doc"][at], v["alt"][at], v["lo"][at], v["hi"][at], (seen | old)[out], stays[out], found[out]))]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PASS.split(", ")]), rest

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        out, held = flush(pa.concat_tables([held, t]) if held is not None else t, False)
        if out is not None:
            yield out
    if held is not None:
        yield flush(held, True)[0]


class SuffixFamily:
    """The levels, and the regions that the scans have found so far."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[Stored | None] = []
        self.found: list[Stored] = []

    def add_batch(self, entries: DataFrame, keep: bool = True) -> None:
        """Scan a batch's array with every level, and merge it with the levels it fills. keep: more batches may come."""
        due = next((i for i, level in enumerate(self.levels) if level is None), len(self.levels))
        one = F.min(F.struct("doc", "alt", "lo", "hi")).alias("at")
        array = entries.groupBy("key", "rh").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"), one)
        rows = array.select("key", "fp", "rh", "n", "at.*", F.lit(False).alias("seen"), F.lit(True).alias("new"), F.lit(keep).alias("stays"))
        for i, level in enumerate(self.levels):
            if level is not None:
                part = level.df.where("stays").select(*_ARRAY)
                rows = rows.unionByName(part.withColumns({"new": F.lit(False), "stays": F.lit(keep and i < due)}))
        ordered = rows.repartitionByRange(shuffle_partitions(self.spark), "key", "rh").sortWithinPartitions("key", "rh", "doc", "alt", "lo")
        level = Stored(ordered.mapInArrow(_scan, _PASS), "suffix-array")
        self.found.append(Stored(level.df.where("found").select("fp", "rh", F.col("total").alias("n"), F.struct("doc", "alt", "lo", "hi").alias("at")), "suffix-found", 8))
        if not keep:
            level.drop()
            return
        for i in range(due):
            self.levels[i].drop()
            self.levels[i] = None
        self.levels[due:due + 1] = [level]

    def regions(self) -> DataFrame:
        """(fp, rh, n, at) of all regions that have copies or whose beginning other regions have."""
        found = self.found[0].df
        for x in self.found[1:]:
            found = found.unionByName(x.df)
        return found.groupBy("fp", "rh").agg(F.max("n").alias("n"), F.min("at").alias("at"))

    def drop(self) -> None:
        for x in [*self.found, *self.levels]:
            if x is not None:
                x.drop()


def _values(raws: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbol values of regions in a row, and how many each has."""
    size = 8 if unit == "words" else 1
    data = b"".join(raws)
    return np.frombuffer(data, np.uint64) if unit == "words" else _powers(1).byte[np.frombuffer(data, np.uint8)], np.array([len(r) // size for r in raws], np.int64)


def _fetch(length: int, unit: str):
    """Rows (text, regions of it) to rows (fp, rh, n, symbols of the region)."""

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in small_batches(big):
                out: list[list] = [[], [], [], []]
                for i, wanted in enumerate(batch.column(1).to_pylist()):
                    raw = _Symbols(*_texts(batch.slice(i, 1), 0), unit).raw
                    for w in wanted:
                        for column, value in zip(out, (w["fp"], w["rh"], w["n"], raw[w["lo"] : w["hi"] + length].tobytes())):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["fp", "rh", "n", "raw"])

    return run


def repeated_starts(raws: list[bytes], length: int, unit: str = "bytes") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For strings in a row: (string, start) of every start, its hash, and whether it occurs elsewhere."""
    values, sizes = _values(raws, unit)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(raws)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = _window_hashes(_sums(values), begins[of] + start, length)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return of, start, h, twice


def _runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts: (string, first, last)."""
    if not len(of):
        return of, start, start
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(of)) - 1
    return of[new], start[new], start[last]


def _resolve(length: int, unit: str):
    """Rows (fp, rh, n, raw) in order of fp to rows (fp, rh, a, b): starts a to b of a region repeat."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(rows):
            of, start, _, twice = repeated_starts([r[3] for r in rows], length, unit)
            single = np.array([r[2] == 1 for r in rows])
            twice &= single[of]
            of, a, b = _runs(of[twice], start[twice])
            fp, rh = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(fp[of]), pa.array(rh[of]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["fp", "rh", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > TILE and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return run


def _strings(length: int, unit: str):
    """Rows (fp, rh, n, raw) to rows (fp, rh, n, start, h): every string of every region."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                of, start, h, _ = repeated_starts(b.column(3).to_pylist(), length, unit)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(3)], pa.array(start.astype(np.int32)), pa.array(h.view(np.int64))], ["fp", "rh", "n", "start", "h"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes") -> DataFrame:
    """(doc, alt, spans): for each row with repeats (known by its keys) its spans (start, end in symbols), which may overlap."""
    spark = docs.sparkSession
    k = k or K[unit]
    keyed = _keyed(docs, id_col, text_col)
    entries = Stored(keyed.mapInArrow(_entries(length, k, unit), ENTRY).withColumn("batch", F.pmod("doc", F.lit(batches)).cast("int")), "suffix-entries")
    family = SuffixFamily(spark)
    for b in range(batches):
        family.add_batch(entries.df.where(F.col("batch") == b).drop("batch"), keep=b < batches - 1)
    regions = Stored(family.regions(), "suffix-regions", 8)
    family.drop()
    # beginnings with several different regions: their symbols decide
    kinds = regions.df.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = regions.df.join(kinds, "fp")
    wanted = several.select("at.doc", "at.alt", F.struct("fp", "rh", "n", "at.lo", "at.hi").alias("w")).groupBy("doc", "alt").agg(F.collect_list("w").alias("wanted"))
    # rows with equal keys: one of them is enough
    fetched = keyed.join(wanted, ["doc", "alt"]).select("text", "wanted").mapInArrow(_fetch(length, unit), "fp long, rh long, n long, raw binary").dropDuplicates(["fp", "rh"])
    raws = Stored(fetched, "suffix-bytes", 8)
    wide = Stored(kinds.where(F.col("kinds") > WIDE).select("fp"), "suffix-wide", 1024)
    narrow = raws.df.join(wide.df, "fp", "left_anti").repartition(shuffle_partitions(spark), "fp").sortWithinPartitions("fp")
    parts = narrow.mapInArrow(_resolve(length, unit), "fp long, rh long, a int, b int")
    if wide.df.limit(1).count():
        strings = raws.df.join(wide.df, "fp", "left_semi").mapInArrow(_strings(length, unit), "fp long, rh long, n long, start int, h long")
        twice = strings.groupBy("fp", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("fp", "h")
        hit = strings.where("n = 1").join(twice, ["fp", "h"], "left_semi")
        parts = parts.unionByName(hit.select("fp", "rh", F.col("start").alias("a"), F.col("start").alias("b")))
    # a region with copies repeats from its first start to its last
    copies = regions.df.where("n > 1").select("fp", "rh", F.lit(0).alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))
    found = Stored(parts.unionByName(copies).groupBy("fp", "rh").agg(F.collect_list(F.struct("a", "b")).alias("parts")), "suffix-parts", 8)
    raws.drop()
    regions.drop()
    hits = entries.df.select("fp", "rh", "doc", "alt", "lo").join(found.df, ["fp", "rh"]).select("doc", "alt", "lo", F.explode("parts").alias("p"))
    spans = hits.groupBy("doc", "alt").agg(F.collect_set(F.struct((F.col("lo") + F.col("p.a")).alias("start"), (F.col("lo") + F.col("p.b") + length).alias("end"))).alias("spans"))
    out = Stored(spans, "suffix-spans", 8)
    entries.drop()
    found.drop()
    return out.df


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _cut(raw: bytes, spans: list[dict] | None, unit: str = "bytes") -> tuple[bytes, int]:
    """The bytes outside of the spans, and the number of maximal removed runs. Words go with what is between them."""
    runs = _merged(spans)
    if runs and unit == "words":
        data = np.frombuffer(raw, np.uint8)
        starts, stops = word_places(data, np.array([len(data)]))
        runs = [(int(starts[a]), int(stops[b - 1])) for a, b in runs]
    kept, at = [], 0
    for start, end in runs:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]), len(runs)


def _report(batches):
    import pyarrow as pa

    for big in batches:
        for batch in small_batches(big):
            rows = []
            for doc_id, text, spans, passages in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                kept, runs = _cut(raw, spans)
                rows.append((doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in _merged(passages))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def repeat_report(docs: DataFrame, length: int = LENGTH, k: int | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    passage_words: adds ``n_passage_words``, the words in passages of at least so many that start anywhere else too.
    """
    joined = _keyed(docs, id_col, text_col).join(repeated_spans(docs, length, k, batches, id_col, text_col), ["doc", "alt"], "left")
    if passage_words:
        words = repeated_spans(docs, passage_words, None, batches, id_col, text_col, "words")
        joined = joined.join(words.withColumnRenamed("spans", "passages"), ["doc", "alt"], "left")
    else:
        joined = joined.withColumn("passages", F.lit(None).cast("array<struct<start:int,end:int>>"))
    rows = joined.select(F.col("id").alias("doc_id"), "text", "spans", "passages")
    out = rows.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
    return out if passage_words else out.drop("n_passage_words")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", unit: str = "bytes") -> DataFrame:
    """The rows of ``docs`` with repeats cut out of their texts; ``chars_col`` follows the new text."""
    p = "__tidewell_"
    spans = repeated_spans(docs, length, k, batches, id_col, text_col, unit).select(*(F.col(c).alias(p + c) for c in ("doc", "alt", "spans")))
    keyed = docs.withColumns({f"{p}own_{c}": v for c, v in row_keys(id_col, text_col).items()})
    same = (F.col(f"{p}own_doc") == F.col(f"{p}doc")) & (F.col(f"{p}own_alt") == F.col(f"{p}alt"))
    joined = keyed.join(spans, same, "left").select(*docs.columns, f"{p}spans")
    out = joined.mapInArrow(_cutter(docs.columns.index(text_col), text_col, len(docs.columns), unit), docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out


def _cutter(at: int, text_col: str, spans_at: int, unit: str):
    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in small_batches(big, text_col):
                texts = batch.column(at).to_pylist()
                for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                    if spans:
                        texts[i] = _cut(texts[i].encode(), spans, unit)[0].decode("utf-8", "ignore")
                cols = [batch.column(i) for i in range(spans_at)]
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:spans_at])

    return run
