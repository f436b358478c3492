import hashlib
import itertools
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewell.llm import alignment
from tidewell.llm.alignment import align_documents, pieces, shared_groups
from tidewell.llm.tokens import _byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    table = _byte_of_char()
    names = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    return tok, sentencepiece.SentencePieceProcessor(model_file=B), lambda i: bytes(table[c] for c in names[i])


def brute(rows, libraries):
    """Plain merging of ends, and all links one by one."""
    tok, sp, a_bytes = libraries

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    parts = []
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        x, y = [a_bytes(t) for t in a], [b_bytes(t) for t in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            parts.append((i, [], [], []))
            continue
        ea, eb = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        cuts = sorted(set(ea) & set(eb))
        groups, ia, ib = [], 0, 0
        for c in cuts:
            ja, jb = ea.index(c, ia) + 1, eb.index(c, ib) + 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        parts.append((i, a, b, groups))
    count = Counter()
    for _, _, _, groups in parts:
        count.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = []
    for i, a, b, groups in parts:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("head", [None, 300, 0])
def test_equals_brute_force_on_given_documents(spark, small, libraries, head):
    """With all pairs looked up, with some joined, and with all joined."""
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()], libraries)
    assert rows(align_documents(small.repartition(3), A, B, head=head)) == want


def test_texts_that_tokenizers_cut_apart(spark, libraries, monkeypatch):
    texts = ["a" * 5000, "=" * 777 + "-" * 333, " " * 999 + "x", "x" + " " * 1001, "日本語テキスト" * 50, "𐍈𐍉🎉👩‍👩‍👧" * 40, "<s> </s> <|endoftext|> <unk> <0x41>", "▁ low line", "tab\tnew\n\nline\r\n", "é é   x", "\x00\x01\x7f", None, "", " ", "x", "don't 12345 3.14", "﻿bom"]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, " " * 999 + "x")]
    df = spark.createDataFrame([(*r, 1, "p") for r in data], "doc_id long, text string, row long, pairs string")
    want = brute(data, libraries)
    assert rows(align_documents(df, A, B)) == want
    monkeypatch.setattr(alignment, "_WIDE", 2)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 3)
    assert rows(align_documents(df, A, B, head=5)) == want


def test_long_texts_in_pieces(spark, libraries):
    long = " ".join(f"word{i} don't  two\n{i}" for i in range(90_000))
    assert len(list(pieces(long))) > 1 and "".join(pieces(long)) == " " + long
    tok, sp, _ = libraries
    r = align_documents(spark.createDataFrame([(1, long)], "doc_id long, text string"), A, B).first()
    assert (r["n_a"], r["n_b"]) == (len(tok.encode(" " + long, add_special_tokens=False).ids), len(sp.encode(long)))


def test_groups_of_random_cuts():
    rng = np.random.default_rng(2)
    for _ in range(300):
        texts, a, b, ab, bb, base = int(rng.integers(1, 5)), [], [], [0], [0], 0
        for _ in range(texts):
            n = int(rng.integers(0, 60))
            share = rng.random()
            pick = lambda: [base + i for i in range(1, n) if rng.random() < share] + ([base + n] if n else [])
            x, y = pick(), pick()
            a, b, base = a + x, b + y, base + n
            ab.append(len(a))
            bb.append(len(b))
        got = np.stack(shared_groups(np.array(a, np.int64), np.array(b, np.int64), np.array(ab), np.array(bb))).T.tolist()
        want, ia, ib = [], 0, 0
        for c in sorted(set(a) & set(b)):
            ja, jb = a.index(c) + 1, b.index(c) + 1
            want.append([ia, ja, ib, jb])
            ia, ib = ja, jb
        assert got == want


def test_an_interval_without_cuts_costs_no_square():
    n = 400_000
    a, b = np.r_[np.arange(1, 2 * n, 2), 2 * n], np.r_[np.arange(2, 2 * n, 2), 2 * n]
    got = shared_groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert [x.tolist() for x in got] == [[0], [len(a)], [0], [len(b)]]


def test_empty_table(spark, no_docs, edge_docs):
    assert align_documents(no_docs, A, B).collect() == []
    assert align_documents(edge_docs, A, B).count() == edge_docs.count()
