import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as classes
from test_quality import brute as quality
from test_suffix_dedup import brute_words as repeats
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm.common import store, table

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Each stage is held against a plain version of it on the same input."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = table(spark, SF, "documents")
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, SF), name)
        assert sorted(docs.columns) == sorted(columns)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        seen.append(kept[-1])
    # quality: base failures go; whatever else goes must fail a soft rule
    base = {i for i, t in seen[0].items() if quality(t)[5]}
    assert not base & set(kept[0])
    for i in set(seen[0]) - set(kept[0]) - base:
        n, chars, symbols, dup, _, _ = quality(seen[0][i])
        assert symbols > 0.3 * n or dup or not 2 * n <= chars <= 12 * n
    assert set(kept[1]) == {c for _, c, _ in classes(list(seen[1].items()))}
    # passages of over 50 words
    assert kept[2] == {i: text for i, text, _ in repeats(list(seen[2].items()), 51)}
    assert kept[2] != seen[2]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert set(kept[3]) == set(seen[3]) - {d for d, _ in leaks(list(seen[3].items()), items)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == whole.get(r["doc_id"], 0)
        whole[r["doc_id"]] = r["start"] + r["length"]
    assert whole == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept[3].items()}
    one = next(r for r in packed if r["piece"] == 0 and r["length"] == whole[r["doc_id"]])
    ids = np.array([*tok.encode(kept[3][one["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
    assert one["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
