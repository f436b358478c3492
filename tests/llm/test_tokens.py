import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm.packing import pack_documents, pack_lengths
from tidewell.llm.token_files import TokenFile, decode_all, encode_levels, read_token_files, write_token_files
from tidewell.llm.tokens import _PLAIN, _STABLE, TextEncoder, encoder, rank_table

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "x\n\n", "don't 's 'S it'll", "tab\tx \ty", "  a  b", "é ́x", "İstanbul ΣΑΣ ΟΔΟΣ", "␞ a␞ ␞", "<|endoftext|> x<|startoftext|>y",
    "日本語 テキスト", "😀 😀😀 👩‍👩‍👧", "\x00 \x1c \x1d x", "a　b  c", "1234 5 678", "... !!! ?", "\r\n a\r\n", "x" * 300, "- - - ----", "한국어 각 가",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_rank_tables_are_proven(path):
    assert rank_table(path)


def test_every_stable_character(spark):
    chars = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and _STABLE.fullmatch(c)]
    texts = [f"a{c}b {c} {c}{c}1 x {c}" for c in chars]
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert encoder(BYTE, True).encode(texts) == want
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    texts = [f"A{c}b{c}1'S {c} {c}{c}É" for c in chars if _PLAIN.fullmatch(c)]
    assert encoder(WORD, True).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_unproven_files_go_through_the_library():
    enc = TextEncoder(BYTE, None)
    assert enc.encode(HARD) == encoder(BYTE, True).encode(HARD)


def reference(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path, spark):
    texts = HARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids = reference(path)
    enc = encoder(path, True)
    for text, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text), repr(text[:80])


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_packing_is_whole_gapless_and_tight(request, name):
    docs = request.getfixturevalue(name)
    ids = reference(BYTE)
    want = sorted((r["doc_id"], np.array([*ids(r["text"] or ""), 0], "<u4").tobytes()) for r in docs.collect())
    out = pack_documents(docs, BYTE).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    expected = []
    for doc_id, raw in want:
        n = len(raw) // 4
        cuts = [0, *range((n - 1) % 2048 + 1, n + 1, 2048)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 2048) + max(2, len(bins) // 50)


def test_two_smaller_pieces_replace_the_smallest():
    # greedy puts 10 = 6 + 3 and leaves 1; 6 + 2 + 2 fills the bin
    assert pack_lengths({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    for seed in range(30):
        rng = np.random.default_rng(seed)
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40))}
        packed = pack_lengths(counts, 100)
        used = {}
        for times, lengths in packed:
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts


def test_codes_round_trip():
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], np.random.default_rng(1).integers(0, 50000, 5000).tolist()):
        a = np.array(ids, np.uint32)
        assert (decode_all(encode_levels(a), len(a)) == a).all()


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_token_files_round_trip(request, spark, name):
    docs = request.getfixturevalue(name)
    ids = reference(WORD)
    want, start = [], 0
    flat = []
    for doc_id, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        a = np.array([*ids(text), 2], "<u4")
        want.append((doc_id, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
        flat += a.tolist()
    folder, manifest = write_token_files(docs, WORD, 2)
    assert sorted(tuple(r) for r in read_token_files(spark, folder, manifest).collect()) == sorted(want)
    for r in manifest.collect():
        f = TokenFile(f"{folder}/{r['file']}")
        for i in {0, r["tokens"] - 1, *np.random.default_rng(0).integers(0, r["tokens"], 40).tolist()}:
            assert f.token(int(i)) == flat[r["first"] + int(i)]


def test_no_rows(spark, no_docs):
    assert pack_documents(no_docs, BYTE).collect() == []
    folder, manifest = write_token_files(no_docs, WORD, 2)
    assert read_token_files(spark, folder, manifest).collect() == []


def test_files_are_cut_at_a_number_of_ids(spark, small):
    whole = write_token_files(small, public_tokenizers.path("word_bpe_49k.json"), 2, partitions=2)
    cut = write_token_files(small, public_tokenizers.path("word_bpe_49k.json"), 2, partitions=2, file_tokens=5000)
    rows = cut[1].collect()
    assert len(rows) > 10 > 2 == whole[1].count() and all(r["tokens"] <= 5000 or r["docs"] == 1 for r in rows)
    assert sorted(map(tuple, read_token_files(spark, *cut).collect())) == sorted(map(tuple, read_token_files(spark, *whole).collect()))
