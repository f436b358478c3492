"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Where tokens of both end, a text falls into two that don't touch. ``shared_groups`` looks for such a cut as
near as it can to the middle of an interval: ends of the first tokenizer, from the middle outwards, are looked up among those
of the second by bisection. Both halves are taken up the same way; an interval without a cut, or with one token on a side, is a leaf,
a group. All intervals of all texts of a batch go down a level at once. Rings around the middle double, so an interval of m tokens without a
cut costs m lookups, and a gap is looked through three times at most.

Links are all pairs of tokens of both sides in a group. A text's distinct pairs with their numbers of links are written down once, beside its
digests; tokens are never made again. In how many texts a pair is linked is counted by task first, then by pair. Counts of
the most frequent pairs, ``HEAD`` at most, and each first token's highest count, one number for each entry of its vocabulary, are broadcast; the
pairs beyond are joined by pair with their counts. No such pair is frequent, since those that are have been looked up already.

Defined cases: null and empty texts, and those whose tokens' bytes aren't a blank and the text (a tokenizer that normalises), have no
tokens: zeros and an empty digest. Texts of over ``PIECE`` characters are encoded in pieces cut before a blank behind something else, where
neither tokenizer has a token that crosses; whether that holds for the second one's pieces is looked up in its vocabulary. Repeated rows and null ids
give their rows again, and each counts as a text; an empty table gives none. Only the two named columns are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .tokens import _byte_of_char, encoder, rank_table, small_batches

#: Most frequent pairs whose counts are broadcast: 12 bytes each.
HEAD = 1 << 20
#: Characters of a text that are encoded at once; pairs of a text in one row.
PIECE = 1 << 20
ROW_PAIRS = 1 << 19
#: Groups with more links than this meet as distinct tokens with their numbers.
_WIDE = 4096
_CUT = re.compile(r"(?<=[^ ]) ")


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a0, a1, b0, b1): token ranges of all groups in order.

    a_ends, b_ends: rising ends of all tokens of all texts; a_bounds, b_bounds: where each text's tokens begin, and the end.
    The last tokens of a text have one end.
    """
    some = np.flatnonzero(np.diff(a_bounds) > 0)
    work = (a_bounds[some], a_bounds[some + 1], b_bounds[some], b_bounds[some + 1])
    leaves = []
    while len(work[0]):
        a0, a1, b0, b1 = work
        cut = np.full(len(a0), -1, np.int64)
        inner = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        cut[inner] = _middle_cut(a_ends, b_ends, a0[inner], a1[inner])
        whole = cut < 0
        leaves.append(np.stack([x[whole] for x in work]))
        a0, a1, b0, b1, at = (x[~whole] for x in (*work, cut))
        bt = np.searchsorted(b_ends, a_ends[at])
        # both halves of each side by side, so that all stay in order and lookups go on from each other
        work = tuple(np.stack(x, axis=1).ravel() for x in ((a0, at + 1), (at + 1, a1), (b0, bt + 1), (bt + 1, b1)))
    found = np.concatenate(leaves, axis=1) if leaves else np.zeros((4, 0), np.int64)
    return tuple(found[:, np.argsort(found[0], kind="stable")])


def _middle_cut(a_ends: np.ndarray, b_ends: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """For each interval the token of ``a``, nearest to the middle, inside whose end a token of ``b`` ends too; -1: none."""
    out = np.full(len(a0), -1, np.int64)
    todo = np.arange(len(a0))
    first, last = a0, a1 - 2  # ends inside
    mid = (first + last) // 2
    near, far = 0, 0
    while len(todo):
        lo, hi, m = first[todo], last[todo], mid[todo]
        best = np.full(len(todo), np.iinfo(np.int64).max)
        for side in (0, 1) if near else (1,):
            start = m + near if side else np.maximum(lo, m - far)
            n = np.maximum((np.minimum(hi, m + far) if side else m - near) - start + 1, 0)
            owner = np.repeat(np.arange(len(todo)), n)
            at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(owner))
            ends = a_ends[at]
            shared = b_ends[np.searchsorted(b_ends, ends)] == ends
            owner, at = owner[shared], at[shared]
            if far == near:  # one candidate each
                best[owner] = np.minimum(best[owner], 2 * np.abs(at - m[owner]) + side)
            else:
                np.minimum.at(best, owner, 2 * np.abs(at - m[owner]) + side)
        hit = best < np.iinfo(np.int64).max
        out[todo[hit]] = m[hit] + np.where(best[hit] & 1, 1, -1) * (best[hit] >> 1)
        near, far = far + 1, 2 * far + 2
        todo = todo[~hit & ((m - near >= lo) | (m + near <= hi))]
    return out


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, groups: tuple[np.ndarray, ...], text_of: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links): distinct pairs a * b_size + b of each text, in order, with their numbers of links."""
    a0, a1, b0, b1 = groups
    na, nb = a1 - a0, b1 - b0
    # a text and its pair are one number
    span = b_size * (int(a_ids.max(initial=0)) + 1)
    thin = np.flatnonzero(na * nb <= _WIDE)
    n = (na * nb)[thin]
    owner = np.repeat(thin, n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    many = nb[owner]
    key, link = np.unique(text_of[owner] * span + a_ids[a0[owner] + k // many] * b_size + b_ids[b0[owner] + k % many], return_counts=True)
    keys, links = [key], [link]
    for g in np.flatnonzero(na * nb > _WIDE).tolist():
        ua, ca = np.unique(a_ids[a0[g] : a1[g]], return_counts=True)
        ub, cb = np.unique(b_ids[b0[g] : b1[g]], return_counts=True)
        keys.append(text_of[g] * span + (ua[:, None] * b_size + ub).ravel())
        links.append((ca[:, None] * cb).ravel())
    if len(keys) > 1:
        key, link = np.concatenate(keys), np.concatenate(links)
        order = np.argsort(key, kind="stable")
        key, link = key[order], link[order]
        new = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        key, link = key[new], np.add.reduceat(link, new)
    text = key // span
    return text, key - text * span, link


def pieces(text: str) -> Iterator[str]:
    """A blank and the text, in pieces that begin with a blank."""
    whole, at = " " + text, 0
    while at < len(whole):
        found = _CUT.search(whole, at + PIECE) if at + PIECE < len(whole) else None
        end = found.start() if found else len(whole)
        yield whole[at:end]
        at = end


class Sides:
    """Both tokenizers of a worker: ids and bytes of tokens."""

    def __init__(self, a_path: str, b_path: str, by_ranks: bool):
        import sentencepiece

        self.a = encoder(a_path, by_ranks)
        spec = json.load(open(a_path, encoding="utf-8"))
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table = _byte_of_char()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(table[c] for c in token if c in table)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.in_pieces = not any("▁" in p.lstrip("▁") for p in names)
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # texts of ids with what follows them, for digests: ',' in a run of a side, '|' and ';' behind the runs of the sides
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(max(self.a_size, self.b_size))]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where the bytes differ or there is no text."""
        cut = [list(pieces(t)) if len(t) > PIECE and self.in_pieces else [" " + t] for t in texts if t]
        flat = [p for ps in cut for p in ps]
        a = iter(self.a.encode(flat))
        b = iter(self.b.encode([p[1:] for p in flat], num_threads=1))
        out, none = [], (np.zeros(0, np.int64),) * 2
        parts = iter(cut)
        for t in texts:
            if not t:
                out.append(none)
                continue
            n = len(next(parts))
            ids_a = np.frombuffer(b"".join(next(a) for _ in range(n)), "<u4").astype(np.int64)
            list_b = [i for _ in range(n) for i in next(b)]
            raw = (" " + t).encode()
            # a rank table cuts bytes and changes none
            same = raw == b"".join(map(self.b_bytes.__getitem__, list_b)) and (self.a.kind == "text" or raw == b"".join(map(self.a_bytes.__getitem__, ids_a.tolist())))
            out.append((ids_a, np.array(list_b, np.int64)) if same else none)
        return out

    def digest(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> str:
        """Lowercase hex SHA-256 of ``a1,a2|b1;a3|b2,b3``; groups: token ranges from the text's first tokens on."""
        if not len(a):
            return ""
        a0, a1, b0, b1 = groups
        size = len(self.names) // 3
        code = np.empty(len(a) + len(b), np.int64)
        # a group's tokens of a begin behind all tokens of both sides before it
        at_a = np.arange(len(a)) + np.repeat(b0, a1 - a0)
        at_b = np.arange(len(b)) + np.repeat(a1, b1 - b0)
        code[at_a], code[at_b] = a, b
        code[a1 - 1 + b0] += size
        code[b1 - 1 + a1] += 2 * size
        return hashlib.sha256("".join(map(self.names.__getitem__, code.tolist()))[:-1].encode()).hexdigest()


_SIDES: dict[tuple, Sides] = {}


def sides(*key) -> Sides:
    if key not in _SIDES:
        _SIDES[key] = Sides(*key)
    return _SIDES[key]


def _narrow(values: np.ndarray, offsets: np.ndarray):
    """Runs of numbers as Arrow binary, in the narrowest unsigned type that holds them all: (column, bytes a number)."""
    import pyarrow as pa

    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if k == "<u8" or not len(values) or int(values.max()) < 1 << 8 * int(k[2]))
    raw = values.astype(kind)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()), raw.itemsize


def _runs(column, widths: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(column, widths)]


def _align_batch(texts: list[str], s: Sides):
    """Digests and pairs of a batch: (n_a, n_b, n_groups, n_links, digests), (text, pair, links)."""
    ids = s.encode(texts)
    a, b = (np.concatenate([x[k] for x in ids] or [np.zeros(0, np.int64)]) for k in (0, 1))
    a_bounds, b_bounds = (np.r_[0, np.cumsum([len(x[k]) for x in ids], dtype=np.int64)] for k in (0, 1))
    groups = shared_groups(np.cumsum(s.a_len[a]), np.cumsum(s.b_len[b]), a_bounds, b_bounds)
    text_of = np.searchsorted(a_bounds, groups[0], "right") - 1
    n_groups = np.bincount(text_of, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, text_of, (groups[1] - groups[0]) * (groups[3] - groups[2]))
    at = np.r_[0, np.cumsum(n_groups)]
    digests = [s.digest(x, y, np.stack([g[at[i] : at[i + 1]] for g in groups]) - np.array([[a_bounds[i]], [a_bounds[i]], [b_bounds[i]], [b_bounds[i]]])) for i, (x, y) in enumerate(ids)]
    return (np.diff(a_bounds), np.diff(b_bounds), n_groups, n_links, digests), linked_pairs(a, b, groups, text_of, s.b_size)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> tuple[Stored, int]:
    """The written table of texts with digests and pairs, and the number of the second tokenizer's ids.

    A text of more than ``ROW_PAIRS`` pairs has further rows with nothing but pairs. ``row`` knows a text, whatever its id.
    """
    import sentencepiece

    by_ranks = rank_table(a_path) is not None
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    schema = "row long, is_first boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, pair_bytes int, links binary, link_bytes int"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        s = sides(a_path, b_path, by_ranks)
        row = TaskContext.get().partitionId() << 40
        for big in batches:
            for batch in small_batches(big, most_bytes=1_000_000):  # its numbers stay in a core's cache
                (*counts, digests), (text, pair, link) = _align_batch(batch.column(1).to_pylist(), s)
                n = batch.num_rows
                start = np.searchsorted(text, np.arange(n + 1))
                extra = np.maximum(-(-np.diff(start) // ROW_PAIRS), 1)  # rows of each text
                of = np.repeat(np.arange(n), extra)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(extra) - extra, extra)
                offsets = np.r_[start[of] + nth * ROW_PAIRS, len(text)]
                is_first = nth == 0
                empty = pa.array(~is_first)
                pairs, pair_bytes = _narrow(pair, offsets)
                links, link_bytes = _narrow(link, offsets)
                info = [batch.column(0).take(pa.array(of)), *[pa.array(c[of]) for c in counts], pa.array([digests[i] for i in of.tolist()], pa.string())]
                same = [pa.array(np.full(len(of), w), pa.int32()) for w in (pair_bytes, link_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(row + of), pa.array(is_first), *info, pairs, same[0], links, same[1]], names)
                row += n

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return Stored(texts.mapInArrow(run, schema), "alignment", codec="zstd"), b_size


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many texts a pair is linked; each text has a pair once."""

    def run(batches):
        import pyarrow as pa

        def out(pair, n):
            for i in range(0, len(pair), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + (1 << 16)].astype(np.int64)), pa.array(n[i : i + (1 << 16)])], ["pair", "n"])

        pair, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merge():
            # equal widths, so that sorting works on the narrowest numbers
            p, c = np.unique(np.concatenate(held), return_counts=True)
            whole = np.r_[pair, p.astype(np.uint64)]
            order = np.argsort(whole, kind="stable")
            whole, c = whole[order], np.r_[n, c][order]
            new = np.flatnonzero(np.r_[True, np.diff(whole) != 0])
            return whole[new], np.add.reduceat(c, new)

        for batch in batches:
            for x in _runs(batch.column(0), batch.column(1).to_pylist()):
                held.append(x)
                size += len(x)
                if size > 1 << 22:
                    pair, n = merge()
                    held, size = [], 0
                    if len(pair) > 1 << 22:
                        yield from out(pair, n)
                        pair, n = pair[:0], n[:0]
        if size:
            pair, n = merge()
        yield from out(pair, n)

    return rows.select("pairs", "pair_bytes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs, counts, least): all pairs with at least so many texts, ``most`` of them at most."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # 512 rows at most
    least, total = (sizes[0]["least"] + 1 if sizes and sizes[0]["k"] > most else 1 << 62), 0
    for r in sizes:
        total += r["k"]
        if total > most:
            break
        least = r["least"]
    if least == 1 << 62:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least
    head = counts.where(F.col("n") >= least).toArrow()
    pair, n = (head.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order], least


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    a_path: a byte-level BPE file of the tokenizers library, given a blank and the text. b_path: a model of the sentencepiece
    library, which adds that blank itself.
    """
    stored, b_size = aligned(docs, a_path, b_path, id_col, text_col)
    rows = stored.df
    counted = Stored(pair_counts(rows), "pair-counts")
    counts = counted.df
    first = F.expr(f"pair div {b_size}")
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))  # a row for each entry of the first vocabulary
    pair, n, least = frequent_pairs(counts, HEAD if head is None else head)
    highest = np.zeros(1, np.int64)
    found = best.toArrow()
    if found.num_rows:
        highest = np.zeros(int(found.column("a").to_numpy().max()) + 1, np.int64)
        highest[found.column("a").to_numpy()] = found.column("best").to_numpy()
    is_best = highest[pair // b_size] == n
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, is_best))

    def run(batches):
        import pyarrow as pa

        pair, n, is_best = shared.value
        kinds = [pa.int64()] * 5
        for batch in batches:
            at, tops = batch.column(0).to_numpy(), [[], []]
            tail = ([], [], [])
            columns = (_runs(batch.column(k), batch.column(k + 1).to_pylist()) for k in (1, 3))
            for row, p, links in zip(at.tolist(), *columns):
                p, links = p.astype(np.int64), links.astype(np.int64)
                k = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
                hit = pair[k] == p if len(pair) else np.zeros(len(p), bool)
                k, w = k[hit], links[hit]
                tops[0].append(int(w[is_best[k]].sum()))
                tops[1].append(int((w * n[k]).sum()))
                if not hit.all():
                    for out, x in zip(tail, (np.full(int((~hit).sum()), row), p[~hit], links[~hit])):
                        out.append(x)
            # a text's own row matches no pair, and isn't one key with those of others
            nothing = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((at, -1 - at, nothing, tops[0], tops[1]), kinds)], ["row", "pair", "links", "n_best", "count_sum"])
            if tail[0]:
                r, p, w = map(np.concatenate, tail)
                nothing = np.zeros(len(r), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((r, p, w, nothing, nothing), kinds)], ["row", "pair", "links", "n_best", "count_sum"])

    looked_up = rows.select("row", "pairs", "pair_bytes", "links", "link_bytes").mapInArrow(run, "row long, pair long, links long, n_best long, count_sum long")
    rare = counts.where(F.col("n") < least).join(F.broadcast(best), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    joined = looked_up.join(rare, "pair", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.col("n_best") + F.when(F.coalesce("is_best", F.lit(False)), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.col("links") * F.coalesce("n", F.lit(0))).alias("count_sum"),
    )
    info = rows.where("is_first").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return info.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
