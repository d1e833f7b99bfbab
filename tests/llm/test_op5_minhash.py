import random
import re

import numpy as np
import pyarrow as pa

from postsignal.llm.graph import connected_components
from postsignal.llm.op5_minhash import MinHashParams, drop_near_duplicates, near_duplicates
from postsignal.llm.similarity import sketches
from postsignal.llm.textkit import Words, distinct, mix, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _brute(rows):
    ids = [r[0] for r in rows if r[0] is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [(r[0], _set(r[1])) for r in rows if r[0] is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    base = [word() for _ in range(120)]
    for k in range(150):                          # a hot group of copies with different edits: many pairs near the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - k, " ".join(w)))
    shared = " ".join(word() for _ in range(60))
    rows += [(2000 + k, shared + " " + " ".join(word() for _ in range(60))) for k in range(30)]
    rows += [(3000, "Same  text here"), (3001, "same text\nHERE"), (3002, "same text"), (3003, None), (3004, ""), (3005, " \t"), (3006, None),
             (None, "same text here"), (3007, "x"), (3008, "X"), (3009, "é ö"), (3007, "another text for a repeated id of five words"),
             (3010, "another text for a repeated id of five words"), (3000, "Same  text here")]
    rows += [(4000 + k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(60)]
    rows += [(5000, " ".join(base * 300)), (5001, " ".join(base * 300) + " tail")]
    return rows


def test_against_all_pairs(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, rep string").repartition(5)
    got = near_duplicates(docs, params=MinHashParams(block_rows=40, block_shingles=4000)).collect()
    want = _brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["id"]], r
            assert r["kept"] == (r["id"] == want[r["id"]])
    sizes = {(r["id"], r["n_shingles"]) for r in got}
    assert sizes == {(i, len(_set(t))) for i, t in rows}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert [(r["n_shingles"], r["component_id"] == r["id"], r["kept"]) for r in rows] == [(0, True, True)] * 2


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(50)] + [(200, 200), (301, 300), (300, 301), (300, 301)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)} | {300: 300, 301: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    for same in (20, 300):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:same], rng.integers(0, 2**63, 400 - same, dtype=np.uint64)])
        s = sketches(np.concatenate([a, b]), np.array([0, 400, 800]), 512)
        assert abs((s[0] == s[1]).mean() - same / (800 - same)) < 0.07 and (s < np.iinfo(np.uint64).max).all()
    tiny = sketches(np.array([7], dtype=np.uint64), np.array([0, 1, 1]), 64)
    assert (tiny[0] < np.iinfo(np.uint64).max).all() and (tiny[1] == np.iinfo(np.uint64).max).all()


def test_words_over_segments_and_document_edges(monkeypatch):
    import postsignal.llm.textkit as kit
    texts = ["ab cd", "", None, "Ef", "x" * 300 + " y", "  lead", "trail \x0b", "é ü", "a" * 500]
    buf, off = utf8(pa.array(texts))
    whole = Words(buf, off)
    monkeypatch.setattr(kit, "SEGMENT", 16)
    parts = Words(buf, off)
    assert (whole.hash == parts.hash).all() and (whole.start == parts.start).all() and (whole.first == parts.first).all()
    data = buf.tobytes()
    want = [[w.encode() for w in WORD.findall(t or "")] for t in texts]
    assert [[data[s:e] for s, e in zip(whole.start[a:b], whole.end[a:b])] for a, b in zip(whole.first, whole.first[1:])] == want
    h = mix(np.arange(50, dtype=np.uint64) % np.uint64(7))
    at, number = distinct(h, 3)
    assert len(at) == 7 and (h[at][number] == h).all()
