import hashlib
import random
import re
from collections import Counter

import pytest

import tidewell.llm.suffix_dedup as S
from tidewell.llm.suffix_dedup import SuffixFamily, remove_repeats, repeat_report


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[a : a + length] for _, r in raws for a in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_given_documents(spark, small, batches):
    got = sorted((tuple(r) for r in repeat_report(small, batches=batches).collect()), key=repr)
    assert got == brute(rows_of(small), 400)


@pytest.mark.parametrize("wide", [20_000, 1])
def test_random_repeats(spark, monkeypatch, wide):
    monkeypatch.setattr(S, "WIDE", wide)
    rng = random.Random(wide)
    passages = ["".join(rng.choices("abcdé ", k=rng.randrange(30, 90))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = "".join(rng.choice(passages)[: rng.randrange(20, 95)] + "".join(rng.choices("abcé", k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 7)))
        rows.append((i, t if i % 17 else "a" * rng.randrange(100, 300)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (151, "ab" * 200), (152, "x" * 40), (153, "x" * 39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in repeat_report(docs, length=40, k=12, batches=3).collect()), key=repr)
    assert got == brute(rows, 40)


def test_tiles_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 500)
    rng = random.Random(1)
    shared = "".join(rng.choices("abcdef", k=900))
    rows = [(1, "".join(rng.choices("abcdef", k=3000)) + shared), (2, shared[100:] + "".join(rng.choices("abcdef", k=1700))), (3, "zz" + shared[300:420])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeat_report(docs, length=40, k=12, batches=2).collect()) == brute(rows, 40)


def test_levels_merge_geometrically(spark, small):
    family = SuffixFamily(spark)
    entries = S._keyed(small, "doc_id", "text").mapInArrow(S._entries(400, 64), S.ENTRY)
    sizes = []
    for b in range(7):
        family.add_batch(entries.where(f"pmod(doc, 7) = {b}"))
        sizes.append([level is not None for level in family.levels])
    assert sizes == [[True], [False, True], [True, True], [False, False, True], [True, False, True], [False, True, True], [True, True, True]]


def test_equal_beginnings_without_a_repeat(spark):
    rng = random.Random(4)
    middle = "".join(rng.choices("abcdef", k=24))
    rows = [(i, "".join(rng.choices("abcdef", k=30)) + middle + "".join(rng.choices("abcdef", k=30))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeat_report(docs, length=40, k=12).collect()) == brute(rows, 40)


def test_edges_and_columns(edge_docs, no_docs):
    out = remove_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert {tuple(r[c] for c in ("_doc", "_crc", "_n", "_spans", "_q_host", "host")) for r in out.collect()} == {(7, 8, 9, "s", "q", "h")}
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[1] is None and text[7] == "" and text[3] == "one two"
    assert remove_repeats(no_docs).collect() == [] and repeat_report(no_docs).collect() == []


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(rows, length):
    """By id: what is left of each text without passages of ``length`` words that start anywhere else, and their words."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    places = [[m.span() for m in WORD.finditer(r)] for _, r in raws]
    grams = [[tuple(r[a:b] for a, b in p[k : k + length]) for k in range(len(p) - length + 1)] for (_, r), p in zip(raws, places)]
    seen = Counter(g for own in grams for g in own)
    out = []
    for (i, r), p, own in zip(raws, places, grams):
        gone = bytearray(len(p))
        for k, g in enumerate(own):
            if seen[g] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytearray(r)
        for k in reversed(range(len(p))):
            if gone[k]:
                del kept[p[k][0] : p[k + 1][0] if k + 1 < len(p) and gone[k + 1] else p[k][1]]
        out.append((i, bytes(kept).decode(), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide, tile", [(2_000, 1 << 20), (1, 1 << 20), (2_000, 60)])
def test_passages_in_words_equal_brute_force(spark, monkeypatch, wide, tile):
    monkeypatch.setattr(S, "WIDE", wide)
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(8 + wide)
    passages = [rng.choices(["a", "bé", "c", "d", "日本"], k=rng.randrange(10, 40)) for _ in range(12)]
    rows = []
    for i in range(150):
        w = [w for _ in range(rng.randrange(0, 6)) for w in rng.choice(passages)[: rng.randrange(5, 41)] + rng.choices("abcd", k=rng.randrange(0, 4))]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t "]) for x in w)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (200, "x " * 200), (201, " "), (202, "y " * 15)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")
    want = brute_words(rows, 15)
    got = remove_repeats(docs, length=15, k=4, batches=3, unit="words").collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=repr) == sorted(((i, t) for i, t, _ in want), key=repr)
    report = repeat_report(docs, length=40, k=12, batches=2, passage_words=15).collect()
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in report), key=repr) == sorted(((i, n) for i, _, n in want), key=repr)


def test_passages_of_51_words_are_cut_and_50_stay(spark, small):
    """Short words, so the passages have under 400 bytes; the rest of the documents is new in each."""
    rng = random.Random(51)
    rows = []
    for p in range(20):
        passage = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(50 + p % 2))
        for c in range(2 + p % 3):
            own = [" ".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(80)) for _ in range(2)]
            rows.append((10 * p + c, f"{own[0]} {passage}\n{own[1]}", passage, p % 2 == 1, own))
    assert all(len(passage.encode()) < 400 for _, _, passage, _, _ in rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in remove_repeats(docs, length=51, unit="words").collect()}
    for i, text, _, gone, own in rows:
        assert kept[i] == (f"{own[0]} \n{own[1]}" if gone else text)


def test_null_ids_with_equal_crc_are_told_apart(spark):
    """Two texts with one crc32 and no id, only one of which has a repeat."""
    import zlib

    rng = random.Random(2)
    seen: dict[int, str] = {}
    tail = "".join(rng.choices("abcdef", k=60))
    while True:
        t = "".join(rng.choices("ghijkl", k=12)) + tail
        c = zlib.crc32(t.encode())
        other = seen.setdefault(c, t)
        if other != t:
            break
    rows = [(None, t), (None, other), (None, "zz" + other[12:]), (None, "".join(rng.choices("mnop", k=90)))]
    rows += [(None, "".join(rng.choices("qrstuv", k=45))) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeat_report(docs, length=40, k=12).collect()), key=repr) == brute(rows, 40)
