import itertools
import random

import pytest

from tidewell.llm.decontaminate import Block, drop_contaminated, find_items, word_hashes

ITEMS = "item_id long, text string, doc_id int"


def brute(docs, items, cost=2):
    """Best segment on every diagonal of every pair, without seeds."""
    import re

    def words(t):
        return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in (t or "").lower().split()) if w]

    out = set()
    split = [(i, words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        for i, v in split:
            if len(v) < 8 or not set(v) & set(w):
                continue
            for shift in range(-len(v) + 1, len(w)):
                best = run = n = length = 0
                top = (0, 0)
                for k in range(max(0, -shift), min(len(v), len(w) - shift)):
                    same = v[k] == w[k + shift]
                    if run <= 0:
                        run = n = length = 0
                    run, n, length = run + (1 if same else -cost), n + same, length + 1
                    if run > best:
                        best, top = run, (n, length)
                if top[0] >= min(13, 0.75 * len(v)) and top[0] >= 0.75 * top[1]:
                    out.add((d, i))
    return out


def test_equals_brute_force_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_items(docs, items).collect()}
    some = sorted({d for d, _ in got})[:40] + list(range(0, 1000, 25))
    rows = [(r["doc_id"], r["text"]) for r in docs.where(docs.doc_id.isin(some)).collect()]
    assert {x for x in got if x[0] in some} == brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])


def test_substitutions_are_found_and_clean_documents_stay(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(16, 60))), 0) for i in range(60)]
    docs, leaked = [], set()
    for i, text, _ in items:
        w = text.split()
        for k in range(0, 3):
            v = list(w)
            for at in rng.sample(range(len(v)), k if len(v) < 30 else 2 * k):
                v[at] = "changed"
            docs.append((len(docs), " ".join(rng.choices(vocabulary, k=50) + [x.upper() + "," for x in v] + rng.choices(vocabulary, k=50)), i))
            leaked.add((len(docs) - 1, i))
    clean = len(docs)
    docs += [(clean + i, " ".join(rng.choices(vocabulary, k=300)), -1) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in find_items(df, bench).collect()}
    assert all(d < clean for d, _ in got)
    assert got == leaked & got and len(got) >= 0.98 * len(leaked)
    kept = {r["doc_id"] for r in drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _, _ in docs} - {d for d, _ in got}


@pytest.mark.parametrize("n, changed", [(n, k) for n in (8, 9, 12, 15, 16, 17, 18) for k in range(2, n // 4 + 1)])
def test_every_placement_of_substitutions_is_found(n, changed):
    """All placements in a short item; equal words are counted on their own, without segments or seeds."""
    item = [f"w{i}" for i in range(n)]
    block = Block([1], [" ".join(item)])
    texts = []
    for at in itertools.combinations(range(n), changed):
        texts.append(" ".join(["before", *(f"new{i}" if i in at else w for i, w in enumerate(item)), "after"]))
    want = {i for i, t in enumerate(texts) if sum(a == b for a, b in zip(t.split()[1:], item)) >= 0.75 * n}
    got = block.find(*word_hashes(texts))
    assert want == set(range(len(texts))) == {d for d, *_ in got}
    assert {m for *_, m in got} == {n - changed}


def test_more_substitutions_are_not_found():
    item = [f"w{i}" for i in range(16)]
    block = Block([1], [" ".join(item)])
    assert block.find(*word_hashes([" ".join("new" if i in (2, 5, 8, 11, 14) else w for i, w in enumerate(item))])) == []


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c", 0), (4, "w0 w1 w2 w3 w4 w5 w6 w7", 0), (4, "w0 w1 w2 w3 w4 w5 w6 w7", 0), (5, " ".join("x" for _ in range(40)), 0)], ITEMS)
    got = sorted((r["doc_id"], r["item_id"]) for r in find_items(edge_docs, bench).collect())
    assert got == [(5, 3), (8, 4), (9, 5)]  # the item of three words stands in document 5
    assert find_items(no_docs, bench).collect() == [] and find_items(edge_docs, bench.limit(0)).collect() == []
    assert drop_contaminated(edge_docs, bench).columns == edge_docs.columns
    assert drop_contaminated(edge_docs, bench.limit(0)).count() == edge_docs.count()


def test_blocks_one_after_the_other(spark, monkeypatch):
    import tidewell.llm.decontaminate as D

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20)), 0) for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=30) + (items[i][1].split() if i % 2 and i < 12 else []))) for i in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    whole = sorted(map(tuple, find_items(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    assert sum(1 for _ in D.blocks(bench)) == 6
    assert sorted(map(tuple, find_items(df, bench).collect())) == whole and [r[:2] for r in whole] == [(i, i) for i in range(1, 12, 2)]
    assert {r["doc_id"] for r in drop_contaminated(df, bench).collect()} == {i for i, _ in docs} - set(range(1, 12, 2))


def test_blocks_write_keys_and_no_texts(spark, monkeypatch):
    """Several blocks keep the rows, columns and repeats that one block keeps; what they write has no text."""
    import tidewell.llm.decontaminate as D

    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20)), 0) for i in range(6)]
    dirty = "start " + items[3][1] + " end"
    rows = [(1, "clean text", "a", 1), (1, "clean text", "a", 1), (None, None, None, None), (2, "", "b", 2), (3, dirty, "c", 3), (3, dirty, "c", 3), (None, dirty, "d", 4), (4, "long " * 300_000, "e", 5)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string, key string, alt long"), spark.createDataFrame(items, ITEMS)
    one = sorted(map(repr, drop_contaminated(df, bench).collect()))
    written = []
    plain = D.store
    monkeypatch.setattr(D, "store", lambda found, name: written.append(found.columns) or plain(found, name))
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    several = drop_contaminated(df, bench)
    assert several.schema == df.schema and sorted(map(repr, several.collect())) == one and len(one) == 5
    assert len(written) == 3 and all(c == ["__tidewell_key", "__tidewell_alt"] for c in written)
    assert drop_contaminated(df.limit(0), bench).collect() == []


@pytest.mark.parametrize("n", range(1, 9))
def test_short_items_are_found_exactly(spark, n):
    """Whole items in a row, in plain reading; nothing else."""
    rng = random.Random(n)
    items = [(i, " ".join(rng.choices([f"v{j}" for j in range(4)] if n > 3 else [f"v{j}" for j in range(40)], k=n)), 0) for i in range(6)]
    docs = [(i, " ".join(rng.choices([f"v{j}" for j in range(4)], k=rng.randrange(0, 400)))) for i in range(30)] + [(100 + i, f"before, {t.upper()}! after") for i, t, _ in items]
    got = {(r["doc_id"], r["item_id"]) for r in find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    plain = {d: " " + " ".join(t.lower().replace(",", "").replace("!", "").split()) + " " for d, t in docs}
    exact = {(d, i) for d, t in plain.items() for i, item, _ in items if f" {item} " in t}
    assert exact and (got == exact if n < 8 else exact <= got)
