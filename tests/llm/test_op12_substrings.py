import random
import re
from collections import Counter

import numpy as np
import pytest

from postsignal.llm.op12_substrings import RepeatParams, cover_places, difference_cover, inside, remove_repeats, run_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, n):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + n]) for _, w in docs for k in range(len(w) - n + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k:k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6)))
    words = lambda n: " ".join(word() for _ in range(n))
    shared, exact, almost = words(60), words(35), words(34)
    rows = [(k, f"{words(rng.randint(0, 40))} {shared}  {words(rng.randint(0, 40))}") for k in range(25)]
    rows += [(100 + k, f"{words(rng.randint(0, 20))}\n{exact}\t{words(3 + k)}") for k in range(4)]
    rows += [(200 + k, f"{words(7 + k)} {almost} {words(9)}") for k in range(4)]          # 34 common words: stay
    rows += [(300, "same " * 40), (301, "one " * 35), (302, "two " * 36), (303, "x y " * 20)]
    rows += [(304, shared.upper()), (305, None), (306, ""), (307, " \t\n"), (308, "a"), (None, words(50)), (309, words(80)), (309, words(80))]
    copy = words(90)
    rows += [(400, copy), (401, copy), (401, copy), (402, copy + " tail"), (None, copy)]
    rows += [(500, " ".join(words(300) + " " + shared for _ in range(30)))]
    rows += [(600 + k, words(rng.randint(0, 120))) for k in range(30)]
    return rows


@pytest.mark.parametrize("period, block", [(13, 4 << 20), (13, 2000), (21, 700), (1, 5000), (31, 1)])
def test_against_all_windows(spark, period, block):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "h", 3) for r in rows], "doc_id long, text string, hash string, block int").repartition(5)
    got = remove_repeats(docs, params=RepeatParams(period=period, block_bytes=block)).collect()
    assert sorted([(r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=repr) == _brute(rows, 35)


def test_shorter_window(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, params=RepeatParams(window=8, period=7, block_bytes=3000)).collect()
    assert sorted([(r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=repr) == _brute(rows, 8)


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    got = remove_repeats(spark.createDataFrame([(1, None), (1, None), (None, "")], schema)).collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == [(0, 0, "")] * 3


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31])
def test_any_two_places_share_a_cover_place(period):
    d = set(difference_cover(period))
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in d and (j + s) % period in d for s in range(period))
    if period == 13:
        assert len(d) == 4


def test_run_hashes_and_places():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 400).astype(np.uint64)
    for n in (1, 2, 5, 23, 35):
        x = run_hashes(h, n)
        assert len(x) == len(h) - n + 1
        runs = [tuple(h[i:i + n].tolist()) for i in range(len(x))]
        assert len(set(runs)) == len(set(x.tolist())) == len(set(zip(runs, x.tolist())))
    assert len(run_hashes(h[:3], 4)) == 0
    first = np.array([0, 0, 3, 40, 40, 75, 75])
    assert inside(first, 35).tolist() == [3, 4, 5, 40]
    p = RepeatParams(period=13)
    at = cover_places(first, p).tolist()
    d = difference_cover(13)
    assert at == [3 + k for k in range(15) if k % 13 in d] + [40 + k for k in range(13) if k % 13 in d]


def test_a_passage_of_every_document_sends_one_row_a_block(spark):
    from postsignal.llm.op12_substrings import _anchors, _blocks, BLOCK, HASHES
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(k, text) for k in range(3000)], "id long, text string").repartition(3)
    p = RepeatParams(period=13)
    rows = docs.mapInArrow(_blocks(p), BLOCK).mapInArrow(_anchors(p), HASHES)
    places = len([k for k in range(50 - 23 + 1) if k % 13 in difference_cover(13)])
    assert rows.count() == 3 * places and rows.filter("place % 2 = 1").count() == 3 * places


def test_runs_over_batch_ends():
    import pyarrow as pa
    from postsignal.llm.op12_substrings import _HASHES, _repeated
    rng = random.Random(2)
    for _ in range(200):
        rows = sorted((rng.randint(0, 6), rng.randint(0, 1)) for _ in range(rng.randint(0, 12)))
        rows = [(h, c, 2 * k + (rng.random() < 0.2)) for k, (h, c) in enumerate(rows)]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_pylist([dict(zip(_HASHES.names, r)) for r in part], schema=_HASHES) for part in parts]
        got = [(r["hash"], r["block"]) for b in _repeated(iter(batches)) for r in b.to_pylist()]
        total = Counter((h, c) for h, c, _ in rows)
        many = {(h, c) for h, c, k in rows if k % 2}
        assert got == [(h, k // 2) for h, c, k in rows if total[h, c] > 1 or (h, c) in many]
