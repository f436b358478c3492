import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewell.llm.lm_score import GROUPS, Model, Vocabulary, _group, _split, score_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def brute(rows):
    c = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted((i, zlib.crc32(str(i).encode()) % 5 == 1, len(t := tokens(x)), sum(c[k] > 0 for k in t), n, round(sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in t), 6)) for i, x in rows)


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_base_equals_brute_force(request, name, monkeypatch):
    monkeypatch.setattr("tidewell.llm.lm_score.HEAD", 3000)  # so that the joined tail has words
    docs = request.getfixturevalue(name)
    got = sorted((*tuple(r)[:5], round(r["base_score"], 6)) for r in score_documents(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_probabilities_add_up_to_one():
    words = [f"w{i}" for i in range(40)]
    counts = list(range(80, 40, -1))
    masses = np.zeros(GROUPS)
    for w, c in zip(words, counts):
        masses[_group(w.encode())] += c + 0.5
    voc = Vocabulary(words, counts, sum(counts) + 5, 41, 5, masses, 10, 6)
    model = Model(voc)
    rng = np.random.default_rng(0)
    model.q += rng.normal(size=model.q.shape).astype(np.float32)
    for one, two in [(0, 1), (7, 7), (6, 3)]:
        p = np.exp(model.log_probs(np.arange(voc.outputs), np.full(voc.outputs, one), np.full(voc.outputs, two)))
        assert abs(p.sum() - 1) < 1e-5
    groups = [_group(w.encode()) for w in words[10:]]
    inside = np.bincount(groups, np.exp(voc.share[10:]), GROUPS) + 0.5 / voc.masses
    assert np.allclose(inside, 1)


def test_contexts_start_anew_with_each_text():
    voc = Vocabulary(["a", "b"], [5, 4], 12, 3, 3, np.zeros(GROUPS) + 20, 2, 2)
    tok, out, one, two, _ = voc.encode(*_split(["a b", "", "b A x"]))
    assert tok.tolist() == [0, 1, -2, -2, 1, 0, -1, -2]
    assert one.tolist() == [3, 0, 1, 3, 3, 1, 0, 2]
    assert two.tolist() == [3, 3, 0, 3, 3, 3, 1, 0]


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    r = score_documents(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    print(r)
    assert r["s"] > r["b"] + 0.05


def test_no_rows(no_docs):
    assert score_documents(no_docs).collect() == []


def trained(n_words, n_context, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    counts = list(range(900, 600, -1))
    masses = np.zeros(GROUPS)
    for w, c in zip(words, counts):
        masses[_group(w.encode())] += c + 0.5
    voc = Vocabulary(words, counts, sum(counts) + 50, 301, 50, masses, n_words, n_context)
    model = Model(voc)
    texts = [" ".join(f"w{(i * 7 + k * k) % 300}" for k in range(40)) for i in range(60)]
    _, out, one, two, _ = voc.encode(*_split(texts))
    model.train(voc, out, one, two, rng)
    return voc, model, (out, one, two)


def test_touched_rows_are_the_whole_model():
    voc, model, tokens_ = trained(200, 150)
    copy = Model(voc)
    for key, rows, n, changes in model.slices(Model(voc)):
        assert (n > 0).all()
        copy.add(key, rows, changes)
    assert all(np.allclose(copy.tables[k], v, atol=2e-3) for k, v in model.tables.items())
    assert np.allclose(copy.log_probs(*tokens_), model.log_probs(*tokens_), atol=0.05)


@pytest.mark.parametrize("n_words", [1, 20, 299])
def test_trained_classes_give_whole_probabilities_and_a_gain(n_words):
    voc, model, (out, one, two) = trained(n_words, 300)
    for c in [(5, 9), (301, 301), (0, 300)]:
        p = np.exp(model.log_probs(np.arange(voc.outputs), np.full(voc.outputs, c[0]), np.full(voc.outputs, c[1])))
        assert abs(p.sum() - 1) < 1e-4
    assert model.log_probs(out, one, two).mean() > voc.log_start[out].mean()
    assert np.allclose(Model(voc).log_probs(out, one, two), voc.log_start[out], atol=1e-4)


def test_vocabulary_follows_the_counts(spark, monkeypatch):
    import tidewell.llm.lm_score as L

    sizes = []
    real = L.Vocabulary.__init__
    monkeypatch.setattr(L.Vocabulary, "__init__", lambda self, *a: (real(self, *a), sizes.append(self))[0])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for part in (docs.where("doc_id < 250"), docs):
        L.score_documents(part).count()
    a, b = sizes
    assert b.n_context > 1.5 * a.n_context and b.n_words > 1.5 * a.n_words
    assert all(v.n_context == v.n_words == int(L.WORDS_PER_ROOT * v.distinct**0.5) for v in sizes)


def test_words_are_those_of_bytes_split():
    from tidewell.llm.lm_score import _groups

    texts = ["", " ", "a", " A\tb  ", "\n\x0b\x0c\r", "x".join(map(chr, range(128))), "\u00a0Ä\u2003é \x85ß", "\x00 \x1c\x1d\x1e\x1f", "日本 語", "tail "]
    words, lengths = _split(texts)
    want = [t.encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]
    assert lengths.tolist() == [len(ws) for ws in want]
    assert _groups(words).tolist() == [_group(w) for ws in want for w in ws]


def test_tokens_with_the_same_words_before_them_share_their_sums(monkeypatch):
    import tidewell.llm.lm_score as L

    voc, model, (out, one, two) = trained(200, 150)
    summed = []
    real = L._normaliser
    monkeypatch.setattr(L, "_normaliser", lambda h, *a: (summed.append(len(h)), real(h, *a))[1])
    once = model.log_probs(out, one, two)
    rows = sum(summed)
    again = model.log_probs(np.tile(out, 5), np.tile(one, 5), np.tile(two, 5))
    assert sum(summed) == 2 * rows  # five times the tokens, no more sums
    assert np.allclose(again, np.tile(once, 5), atol=1e-6)


@pytest.mark.parametrize("share", [1, 100, 1 << 19])
def test_scores_equal_plain_sums(monkeypatch, share):
    monkeypatch.setattr("tidewell.llm.lm_score.SHARE", share, raising=False)
    voc, model, (out, one, two) = trained(200, 150)
    r, q, b, u, v, c = (x.astype(float) for x in (model.r, model.q, model.b, model.u, model.v, model.c))
    want = []
    for o, x, y in zip(model.rank[out], one, two):
        h, k = c[0] * r[x] + c[1] * r[y], o // model.size
        inside = slice(k * model.size, (k + 1) * model.size)
        want.append((u @ h + v)[k] - np.log(np.exp(u @ h + v).sum()) + (q @ h + b)[o] - np.log(np.exp((q @ h + b)[inside]).sum()))
    assert np.allclose(model.log_probs(out, one, two), want, atol=1e-4)


def test_slices_share_one_table_of_the_head_and_agree_with_encode(monkeypatch):
    import pyarrow as pa

    import tidewell.llm.lm_score as L

    monkeypatch.setattr(L, "SOME", 40)
    monkeypatch.setattr(L, "MANY", 4000)
    voc, _, _ = trained(200, 150)
    texts = ["", " w1 W2  unknown ", *(" ".join(f"w{i * k % 320}" for k in range(i % 9)) for i in range(60))]
    calls = []
    real = L.Vocabulary.find
    monkeypatch.setattr(L.Vocabulary, "find", lambda self, words: (calls.append(len(words)), real(self, words))[1])
    got = list(L._encoded(voc, [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], "text"))
    assert len(calls) == 1 and len(got) > 10
    assert [t for b, *_ in got for t in b.column(0).to_pylist()] == texts
    for batch, words, lengths, encoded in got:
        alone = voc.encode(*_split(batch.column(0)))
        assert all(np.array_equal(x, y) for x, y in zip(encoded, alone))
        assert lengths.sum() == len(words)


def test_order_is_the_stable_argsort():
    from tidewell.llm.lm_score import _order

    rng = np.random.default_rng(3)
    for n, high in [(1, 5), (17, 3), (8192, 200), (5000, 1 << 36)]:
        at = rng.integers(0, high, n)
        assert np.array_equal(_order(at), np.argsort(at, kind="stable"))
