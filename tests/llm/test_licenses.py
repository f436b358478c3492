import math
import re

import pytest

from tidewell.llm.licenses import MIN_SHARE, PHRASES, SLOP, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def stands(file, phrase, lo=0, hi=None):
    hi = len(file) if hi is None else hi
    return [i for i in range(max(lo, 0), min(hi, len(file)) - len(phrase) + 1) if file[i : i + len(phrase)] == phrase]


def brute(texts):
    """Every template at every beginning, without an index."""
    files = [words(t) for t in texts]
    sets = [set(f) for f in files]
    count = {}
    for _, text, _ in TEMPLATES:
        for w in words(text):
            count.setdefault(w, sum(w in s for s in sets))
    idf = {w: math.log(1 + (len(files) + 0.5) / (c + 0.5)) for w, c in count.items()}
    out = []
    for f, known in zip(files, sets):
        places = [(i, label) for p, label in PHRASES.items() for i in stands(f, words(p))]
        base = {label for _, label in places}
        found, best = set(), 0.0
        for label, text, keys in TEMPLATES:
            t = words(text)
            whole = sum(idf[w] for w in t)
            if sum(idf[w] for w in t if w in known) < 0.79 * whole:
                continue
            for d in range(-len(t), len(f) + SLOP):
                got = sum(idf[w] for j, w in enumerate(t) if w in f[max(d + j - SLOP, 0) : max(d + j + SLOP + 1, 0)])
                if got >= MIN_SHARE * whole * (1 - 1e-9) and all(stands(f, words(k), d - SLOP, d + len(t) + SLOP) for k in keys):
                    found.add(label)
                    best = max(best, got / whole)
        at = [i for i, _ in places]
        out.append((len(f), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), round(1.0 if at else best, 9)))
    return out


def scanned(df):
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in df.orderBy("doc_id").collect()]


def test_equals_brute_force_on_given_documents(spark, small):
    rows = small.orderBy("doc_id").collect()
    got = scanned(scan_licenses(small))
    want = brute([r["text"] for r in rows])
    assert got == want
    assert {"mit", "apache-2", "cc-by-nc"} <= {x for g in got for x in g[5].split(",")}


def changed(text, at, word):
    w = text.split()
    w[at:at] = [word] if word else []
    return " ".join(w)


def test_templates_with_changes(spark):
    filler = "some words of a text that no licence has in this order at all".split()
    docs = []
    for _, text, _ in TEMPLATES:
        docs += [text.upper(), "/* " + text.replace(" ", "\n * ", 5) + " */", " ".join(filler + text.split() + filler), changed(text, len(text.split()) // 2, "inserted")]
    docs += [" ".join(text.split()[: len(text.split()) // 2]) for _, text, _ in TEMPLATES]  # halves
    docs += [" ".join(reversed(text.split())) for _, text, _ in TEMPLATES]  # out of place
    docs += ["licensed under the GNU General Public License, version 4", " ".join(TEMPLATES[0][1] for _ in range(20)), "gnu general public license " * 300]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = scanned(scan_licenses(df))
    assert got == brute(docs)
    for k, (label, _, _) in enumerate(TEMPLATES):
        assert all(label in got[4 * k + i][5].split(",") for i in range(3))
    assert got[-3][5] == "" and got[-2][5] == "mit" and got[-1][5] == ""


def test_spans(spark):
    text = "one two three " + TEMPLATES[0][1] + " four five"
    m = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["matches"]
    assert [(x["label"], x["first_word"], x["end_word"], round(x["share"], 9)) for x in m] == [("mit", 3, 3 + len(words(TEMPLATES[0][1])), 1.0)]


def test_phrases_and_words(spark):
    texts = ["Released UNDER the\nMIT License! under-the-mit-license", "CC BY-NC 4.0", "İ under the mit license", "under the mit licenses", "Ünder the Apache License, Version 2.0", "a_b`c~d\x7fe é9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scanned(scan_licenses(df)) == brute(texts)


def test_edges(spark, edge_docs, no_docs):
    got = [tuple(r) for r in scan_licenses(edge_docs.withColumn("words", edge_docs.text)).drop("matches").collect()]
    assert len(got) == edge_docs.count() and scan_licenses(no_docs).collect() == []
    by_id = {r[0]: r for r in got}
    assert by_id[1] == by_id[1][:1] + (0, 0, None, None, "", "", 0.0) and by_id[2][1:] == by_id[1][1:]
    assert by_id[7][1] == 1 and by_id[8][1] == 3000
    nothing = spark.createDataFrame([(None, None), (None, "cc by nc")], "doc_id long, text string")
    assert sorted(r["labels"] for r in scan_licenses(nothing).collect()) == ["", "cc-by-nc"]


@pytest.mark.parametrize("n", [1, 3_000_000])
def test_very_long_texts_are_read_whole(spark, n):
    text = "w " * n + "x" * n + " under the mit license"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["first_word"], r["labels"]) == (n + 5, n + 1, "mit")
