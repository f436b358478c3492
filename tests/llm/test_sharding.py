import zlib

import pytest

from tidewell.llm.sharding import shard_documents


def brute(rows, n):
    import hashlib

    groups = {}
    for _, t in rows:
        b = (t or "").encode()
        groups.setdefault(hashlib.sha256(b).hexdigest(), []).append(len(b) + 1)
    sizes = [sum(v) for _, v in sorted(groups.items())]

    def fits(c):
        shards, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                shards, room = shards + 1, c
            room -= s
        return shards <= n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_smallest_capacity_and_whole_groups(request, name, n):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = shard_documents(docs, n).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    loads, slots, of = {}, {}, {}
    for r in out:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert max(loads.values()) == brute(rows, n)
    assert all(0 <= s < n for s in loads) and all(len(s) == 1 for s in of.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_no_rows(no_docs):
    assert shard_documents(no_docs).collect() == []


@pytest.mark.parametrize("reach", [200_000, 3])
def test_passes_and_the_end_on_the_driver_agree(spark, monkeypatch, reach):
    import random

    import tidewell.llm.sharding as S

    monkeypatch.setattr(S, "IN_REACH", reach)
    monkeypatch.setattr(S, "CANDIDATES", 5)
    rng = random.Random(9)
    rows = [(i if rng.random() < 0.5 else None, "x" * rng.randrange(0, 400) + str(rng.randrange(150))) for i in range(600)] + [(None, "same")] * 300
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    loads, slots = {}, {}
    for r in out:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 900 and max(loads.values()) == brute(rows, 7)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
