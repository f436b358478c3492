"""N-gram Jaccard self-join by chosen paths (similarity of word shingle sets of at least 0.8).

1. Sets. A text's set is its ``N``-word shingles, as 64-bit hashes; a text of fewer words is one shingle. Texts
   with equal sets are one set with copies from here on. A set is embedded as ``T`` minimum-hash tokens
   (coordinate, value): two sets share each token with a probability equal to their similarity.
2. Chosen paths. A run is a tree. At a node a coordinate is sampled, and with probability 1 / 0.8 - 1 another, by
   a hash of the node; the sets go to the children of their tokens there. A node with at most ``SMALL`` sets is a
   bucket, and so is a node with over half of its parent's sets (they are alike) or at depth ``DEPTH``. Runs repeat until the recall that the depths reached so far
   guarantee for a pair at the threshold is at least ``RECALL``.
3. Buckets. In a bucket all sets are compared by their tokens, with a wide margin (``NEAR``). What is near gives
   the edges of a spanning forest, never all pairs; their components are the candidate clusters.
4. Links. A cluster's exact shingle sets meet once and all its pairs are counted exactly by matrix products over
   shared shingles, so a link is found if its sets are in one cluster by any way. Buckets and clusters of
   more than ``BUCKET_BLOCK`` or ``BLOCK`` sets are cut into blocks, and each pair of blocks is a task's work.

Result: for each row its class (connected by links) and its number of links to other rows; copies count.

Defined results: null and empty texts have no shingles and no links; each is a class of its own. Equal rows
are copies. A row is known by a 128-bit hash of its id, whether that is null, and its text. Words are `[^\\x20\\x09-\\x0D]+`, as they are. A null id stays null; its class is that of the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, row_keys, shuffle_partitions
from .components import components
from .tokens import small_batches

N = 5
THRESHOLD = 0.8
T = 64
SMALL = 32
DEPTH = 4
RECALL = 0.9999
RUNS = 8
NEAR = 0.58
BLOCK = 2048
#: Buckets hold tokens only (128 bytes a set), so their blocks are larger.
BUCKET_BLOCK = 16_384
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_SEEDS = _mix(np.arange(1, T + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str, n: int = N) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    words = text.encode().split()
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _STEP + w[j : j + len(h)])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """The T minimum-hash tokens of a set, 32 bits each."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(out, (s[None, a : a + 2048] * _SEEDS[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sets(batches):
    """Rows (doc, alt, text, id) to (doc, alt, id, sid, check, tokens); sid is null if there is no shingle."""
    import pyarrow as pa

    for big in batches:
        for batch in small_batches(big):
            sids, checks, tokens = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                if len(s):
                    sids.append(int(_mix(_mix(s + _STEP).sum()[None])[0].astype(np.int64)))
                    checks.append(int(np.bitwise_xor.reduce(_mix(s * _M2)).astype(np.int64)))
                    tokens.append(signature(s).tobytes())
                else:
                    sids.append(None)
                    checks.append(None)
                    tokens.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sids, pa.int64()), pa.array(checks, pa.int64()), pa.array(tokens, pa.binary())], ["doc", "alt", "id", "sid", "check", "tokens"])


def _matrix(column, kind=np.uint32) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _children(node: np.ndarray, tokens: np.ndarray, roots: bool):
    """(row, child) of each set at its node: one sampled coordinate, and now and then a second."""
    h = _mix(node)
    first = (h % np.uint64(T)).astype(np.int64)
    # a root's own coordinate is its number, so runs begin with different coordinates
    first = (node % np.uint64(T)).astype(np.int64) if roots else first
    h2 = _mix(h + _STEP)
    second = (first + 1 + (h2 % np.uint64(T - 1)).astype(np.int64)) % T
    both = np.zeros(len(node), bool) if roots else (h2 >> np.uint64(32)) < np.uint64(int((1 / THRESHOLD - 1) * 2**32))
    rows = np.concatenate([np.arange(len(node)), np.flatnonzero(both)])
    at = np.concatenate([first, second[both]])
    value = tokens[rows, at].astype(np.uint64) << np.uint64(8) | at.astype(np.uint64)
    return rows, _mix(_mix(node[rows] * _STEP + np.uint64(7)) ^ _mix(value))


def _roots(first: int, last: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sid, tokens = b.column(0).to_numpy(), _matrix(b.column(1))
            nodes = [_children(np.full(len(sid), r, np.uint64), tokens, True)[1].view(np.int64) for r in range(first, last)]
            n = len(sid) * (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.tile(sid, last - first)), pa.array(np.full(n, 1 << 62))], ["node", "sid", "parent"])

    return run


def _split(batches):
    import pyarrow as pa

    for b in batches:
        rows, child = _children(b.column(0).to_numpy().view(np.uint64), _matrix(b.column(3)), False)
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(b.column(1).to_numpy()[rows]), pa.array(b.column(2).to_numpy()[rows])], ["node", "sid", "parent"])


def guaranteed(depths: list[int]) -> float:
    """Recall of a pair at the threshold after runs of these depths."""
    missed = 1.0
    for depth in depths:
        found = THRESHOLD
        for _ in range(depth - 1):
            found *= 1 - (1 - THRESHOLD) * (1 - (1 / THRESHOLD - 1) * THRESHOLD)
        missed *= 1 - found
    return 1 - missed


def chosen_paths(sets: DataFrame) -> tuple[DataFrame, list[Stored]]:
    """(node, sid, size) of the buckets of all runs, and the stored tables that they are read from."""
    buckets, depths, kept = [], [], []
    tokens = sets.select("sid", "tokens")
    while guaranteed(depths) < RECALL:
        at = Stored(tokens.mapInArrow(_roots(len(depths), len(depths) + RUNS), "node long, sid long, parent long"), "paths")
        for depth in range(1, DEPTH + 1):
            sizes = at.df.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("parent")).where("size > 1")
            sized = Stored(at.df.select("node", "sid").join(sizes, "node"), "paths", 8)
            at.drop()
            kept.append(sized)
            # small, as deep as runs go, or so alike that a split hardly parts them
            small = (F.col("size") <= (SMALL if depth < DEPTH else 1 << 62)) | (2 * F.col("size") > F.col("parent"))
            buckets.append(sized.df.where(small).select("node", "sid", "size"))
            large = sized.df.where(~small)
            if not large.limit(1).count():
                break
            at = Stored(large.join(tokens, "sid").select("node", "sid", "size", "tokens").mapInArrow(_split, "node long, sid long, parent long"), "paths", 8)
        depths += [depth] * RUNS
    out = buckets[0]
    for b in buckets[1:]:
        out = out.unionByName(b)
    return out, kept


def _tiles(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows once for each pair of blocks that their own is in; a group of up to ``block`` rows has one block."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    return (
        rows.withColumn("blk", own)
        .withColumn("other", F.explode(other))
        .withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})
        .drop("other", "size")
        .repartition(shuffle_partitions(rows.sparkSession), group, "i", "j")
        .sortWithinPartitions(group, "i", "j", "sid")
    )


def _groups(batches, keys: int):
    """Arrow tables of the rows with equal first ``keys`` columns, from sorted batches."""
    import pyarrow as pa

    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(m: int, near) -> np.ndarray:
    """Labels of the components of ``near(u, candidates)``; a visited row is never compared again."""
    label = np.full(m, -1)
    rest = np.arange(m)
    for u in range(m):
        if label[u] >= 0:
            continue
        label[u] = u
        stack = [u]
        rest = rest[rest != u]
        while stack and len(rest):
            hit = near(stack.pop(), rest)
            if hit.any():
                label[rest[hit]] = u
                stack += rest[hit].tolist()
                rest = rest[~hit]
    return label


def _bucket_edges(batches):
    """Rows (node, i, j, sid, tokens) to edges of a spanning forest of each bucket."""
    import pyarrow as pa

    least = math.ceil(NEAR * T)
    out: list[tuple] = []
    for t in _groups(batches, 3):
        sid, tokens = t.column(3).to_numpy(), _matrix(t.column(4), np.uint16)
        if len(sid) == 2:
            if (tokens[0] == tokens[1]).sum() >= least:
                out.append((sid[1], sid[0]))
        else:
            label = _forest(len(sid), lambda u, rest: (tokens[rest] == tokens[u]).sum(1) >= least)
            own = np.flatnonzero(label != np.arange(len(sid)))
            out += zip(sid[own], sid[label[own]])
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _low_halves(batches):
    """Tokens by their lower 16 bits, for comparing."""
    import pyarrow as pa

    for b in batches:
        low = np.ascontiguousarray(_matrix(b.column(1)).astype(np.uint16))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in low], pa.binary())], ["sid", "low"])


def _fetch(batches):
    import pyarrow as pa

    for big in batches:
        for b in small_batches(big):
            sets = [shingles(t).tobytes() for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(sets, pa.binary())], ["root", "sid", "copies", "size", "shingles"])


def _exact(batches):
    """Rows (root, i, j, sid, blk, copies, shingles) to (sid, links, label): links counted in this pair of blocks."""
    import pyarrow as pa

    for t in _groups(batches, 3):
        i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
        sid, first = np.unique(t.column(3).to_numpy(), return_index=True)  # equal rows were fetched each
        blk, copies = t.column(4).to_numpy()[first], t.column(5).to_numpy()[first]
        column = t.column(6).to_pylist()
        links_to = linked([np.frombuffer(column[k], np.uint64) for k in first])
        np.fill_diagonal(links_to, False)
        if i != j:
            links_to &= blk[:, None] != blk[None, :]
        links = links_to @ copies.astype(np.float64)
        label = _forest(len(sid), lambda u, rest: links_to[u, rest])
        keep = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(links[keep].astype(np.int64)), pa.array(sid[label[keep]])], ["sid", "links", "label"])


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Whether each pair of sets has a Jaccard similarity of at least THRESHOLD (4/5), exactly."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    both = np.zeros((m, m), np.float32)
    width = max(64, (1 << 22) // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((m, min(width, int(column[-1]) + 1 - a)), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        both += x @ x.T
    return 9 * both >= 4 * (sizes[:, None] + sizes[None, :])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, alt, doc_id, class_id, stays, n_links): stays: the row has the least id of its class; null is less than all."""
    keys = row_keys(id_col, text_col)
    keyed = docs.select(keys["doc"].alias("doc"), keys["alt"].alias("alt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    members = Stored(keyed.mapInArrow(_sets, "doc long, alt long, id long, sid long, check long, tokens binary"), "join-members").df
    at = F.struct(F.col("id").isNotNull().alias("known"), "id", "doc", "alt")
    sets = Stored(members.where("sid is not null").groupBy("sid", "check").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")), "join-sets", 8)
    used, sets = [sets], sets.df
    buckets, paths = chosen_paths(sets)
    low = sets.select("sid", "tokens").mapInArrow(_low_halves, "sid long, low binary")
    tiles = _tiles(buckets.join(low, "sid"), "node", BUCKET_BLOCK).select("node", "i", "j", "sid", "low")
    used.append(Stored(components(tiles.mapInArrow(_bucket_edges, "a long, b long")), "join-clusters", 16))
    clusters = used[-1].df
    for x in paths:
        x.drop()
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    wanted = clusters.join(sizes, "root").join(sets.select(F.col("sid").alias("node"), "at", "copies"), "node").select("root", F.col("node").alias("sid"), "copies", "size", "at.doc", "at.alt")
    fetched = keyed.join(wanted, ["doc", "alt"]).select("root", "sid", "copies", "size", "text").mapInArrow(_fetch, "root long, sid long, copies long, size long, shingles binary")
    exact = _tiles(fetched, "root", BLOCK).select("root", "i", "j", "sid", "blk", "copies", "shingles").mapInArrow(_exact, "sid long, links long, label long")
    used.append(Stored(exact, "join-links", 2))
    links = used[-1].df
    used.append(Stored(components(links.select(F.col("sid").alias("a"), F.col("label").alias("b"))), "join-classes", 16))
    classes = used[-1].df
    # least member of each class, then what each set's rows get
    of = sets.select("sid", "at", "copies").join(classes.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = of.groupBy("root").agg(F.min("at").alias("least"))
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    verdict = of.join(least, "root").join(counts, "sid", "left").select("sid", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    verdict = Stored(verdict, "join-verdict", 16)
    for x in used:
        x.drop()
    out = members.select("doc", "alt", "id", "sid").join(verdict.df, "sid", "left")
    alone = F.col("least").isNull()
    first = alone | ((F.col("least.doc") == F.col("doc")) & (F.col("least.alt") == F.col("alt")))
    return out.select("doc", "alt", F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"), first.alias("stays"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every row; class_id: the smallest doc_id of its class, null if one is null."""
    return near_duplicates(docs, id_col, text_col).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the least id, with its columns as they were; all rows without shingles.

    Rows whose id and text are equal have one key, and the first of them stays.
    """
    p = "__tidewell_"
    verdict = near_duplicates(docs, id_col, text_col)
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marks = verdict.where("not stays").distinct()
    marks = Stored(marks.select(F.col("doc").alias(f"{p}doc"), F.col("alt").alias(f"{p}alt"), F.col("stays").alias(f"{p}stays")), "join-marks", 16).df
    keyed = docs.withColumns({p + c: v for c, v in row_keys(id_col, text_col).items()})
    # texts are dealt out by the key, at any size of the marks; the numbers need no other order
    marked = keyed.join(marks.hint("merge"), [f"{p}doc", f"{p}alt"], "left").where(F.coalesce(f"{p}stays", F.lit(True)))
    first = F.row_number().over(Window.partitionBy(f"{p}doc", f"{p}alt").orderBy(F.lit(0)))
    return marked.withColumn(f"{p}n", first).where((F.col(f"{p}n") == 1) | ~has_words).select(*docs.columns)
