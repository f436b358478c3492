import random
from collections import defaultdict

import numpy as np

import tidewell.llm.jaccard_join as J
from tidewell.llm.components import components
from tidewell.llm.jaccard_join import guaranteed, join_report, keep_one, linked, shingles


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = defaultdict(int)
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for (a, b), n in common.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    ids = [(-(1 << 63) if i is None else i) for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        r = find(k)
        least[r] = min(ids[k], least.get(r, ids[k]))
    back = lambda x: None if x == -(1 << 63) else x
    return sorted(((rows[k][0], back(least[find(k)]), links[k]) for k in range(len(rows))), key=repr)


def got(docs):
    return sorted((tuple(r) for r in join_report(docs).collect()), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def planted(seed, groups=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(20, 120))
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_planted_groups_and_small_blocks(spark, monkeypatch):
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(docs) == want
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(J, "SMALL", 2)
    assert got(docs) == want


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(edge_docs) == brute(rows)
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {tuple(r[c] for c in ("_doc", "_crc", "_n", "_spans", "_q_host", "host")) for r in kept.collect()} == {(7, 8, 9, "s", "q", "h")}
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 11))
    assert got(no_docs) == [] and keep_one(no_docs).collect() == []


def test_one_of_each_class_stays(spark):
    rows = planted(8) + [(0, planted(8)[0][1]), (None, planted(8)[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {c for _, c, _ in brute(rows)}
    assert sorted((r["doc_id"] for r in keep_one(docs).collect()), key=repr) == sorted(classes, key=repr)


def test_linked_at_the_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert linked([a, a[:8]])[0, 1]  # 8 / 9
    assert linked([np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64)])[0, 1]  # 4 / 5
    assert not linked([np.arange(1000, dtype=np.uint64), np.arange(799, dtype=np.uint64)])[0, 1]


def test_recall_bound():
    assert guaranteed([1]) == J.THRESHOLD and guaranteed([4] * 16) > 0.9999 > guaranteed([4] * 8)
    assert len(shingles("a b")) == 1 and len(shingles("")) == 0 and len(shingles("a b c d e f")) == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in list(root))
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tuple(r) for r in components(df).collect()) == want
    assert components(df.limit(0)).collect() == []


def test_null_ids_with_equal_crc_are_told_apart(spark):
    import zlib

    rng = random.Random(4)
    seen: dict[int, str] = {}
    while True:
        t = " ".join(f"w{rng.randrange(100_000)}" for _ in range(12))
        other = seen.setdefault(zlib.crc32(t.encode()), t)
        if other != t:
            break
    rows = [(None, t), (None, other), (None, t)] + [(None, f"x{i} " * 3) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["text"] for r in keep_one(docs).collect())
    assert kept == sorted({t for _, t in rows})
