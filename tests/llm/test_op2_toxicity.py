from dataclasses import replace

import numpy as np
import pyarrow as pa

from postsignal.llm import gru
from postsignal.llm.op2_toxicity import Network, Packed, Text, ToxicParams, document_logits, drop_toxic, fit, score_documents, train, windows
from postsignal.llm.textkit import utf8

SMALL = ToxicParams(window=12, stride=8, steps_at_least=120, rounds=("random",) * 3 + ("largest",), hidden=6, char_hidden=6, batch=32)


def _corpus(n, seed):
    rng = np.random.default_rng(seed)
    syl = ["ba", "no", "ti", "re", "lu", "so"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syl, rng.integers(1, 4))) for _ in range(rng.integers(3, 60))]
        toxic = k % 3 == 0
        if toxic:
            words[rng.integers(len(words))] = "grax" + rng.choice(syl)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network(ToxicParams(hidden=3, char_hidden=3, char_dim=3, word_dim=2, word_buckets=16))
    text = Text(*utf8(pa.array(["ab abc d", "x ab"])), 24)
    _, start, size = windows(text.first, 64, 48)
    label = np.array([1.0, 0.0], dtype=np.float32)
    grads, _ = net.learn(text, start, size, label)

    def loss():
        return net.learn(text, start, size, label)[1]
    for params, grad in zip((net.embed, net.char, net.word, net.out), grads):
        for k, v in params.items():
            flat, g = v.reshape(-1), grad[k].reshape(-1)
            for i in rng.permutation(np.flatnonzero(np.abs(g) > 2e-3))[:4]:
                keep = flat[i]
                flat[i] = keep + 1e-2
                up = loss()
                flat[i] = keep - 1e-2
                down = loss()
                flat[i] = keep
                assert abs((up - down) / 2e-2 - g[i]) < 0.05 * abs(g[i]) + 2e-4, k


def test_windows_cover_every_word():
    for n in [0, 1, 63, 64, 65, 112, 113, 1000]:
        doc, start, size = windows(np.array([0, 0, n]), 64, 48)
        seen = np.zeros(n, dtype=bool)
        for s, m in zip(start, size):
            seen[s:s + m] = True
        assert seen.all() and (size > 0).all() and (size <= 64).all() and (doc == 1).all() and (len(doc) > 0) == (n > 0)


def test_held_out_accuracy_and_one_toxic_word_in_a_long_text():
    texts, labels = _corpus(600, 1)
    net = train(texts, labels, SMALL)
    new, truth = _corpus(200, 2)
    logit = document_logits(net, Text(*utf8(pa.array(new)), SMALL.word_bytes))
    assert ((logit >= net.offset) == truth).mean() > 0.95
    long = " ".join(_corpus(400, 4)[0][k] for k in range(400) if k % 3)
    logit = document_logits(net, Text(*utf8(pa.array([long + " graxba"])), SMALL.word_bytes))
    assert logit[0] >= net.offset


def test_job_cases(spark):
    texts, labels = _corpus(300, 5)
    rows = [(k, t, "x", 0.5) for k, t in enumerate(texts)] + [(1000, None, "x", 0.1), (1001, "", "x", 0.1), (1002, " \n", "x", 0.1), (None, "ba no", "x", 0.1),
                                                                (1003, "z" * 5000, "x", 0.1), (3, texts[3], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    marked = spark.createDataFrame([(k, int(v)) for k, v in enumerate(labels)] + [(5, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    net = fit(docs, marked, lambda i: i % 5 != 0, params=SMALL)
    got = score_documents(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["id"]: r["score"] for r in got}
    assert by[1000] == by[1001] == by[1002] == net.share < 0.5
    test = [k for k in range(300) if k % 5 == 0]
    assert np.mean([(by[k] >= 0.5) == labels[k] for k in test]) > 0.9
    kept = drop_toxic(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)
    none = fit(docs, marked.limit(0), lambda i: i % 5 != 0, params=SMALL)
    assert {r["score"] for r in score_documents(docs, none).collect()} == {0.0}
    assert score_documents(docs.limit(0), net).count() == 0
    assert np.isfinite(gru.sigmoid(np.array([-1e9, 1e9]))).all()


def test_packed_words_read_as_the_whole_text():
    texts = [*_corpus(400, 6)[0], "", " \t", "Grax gRAX " + "é" * 40, "z" * 100, "grax"] * 3
    whole, column = Text(*utf8(pa.array(texts)), 24), pa.array(texts)
    packed = Packed([column.slice(0, 700), column.slice(700, 0), column.slice(700)], 24)
    assert (packed.first == whole.first).all()
    every = np.arange(len(whole.key))
    assert (packed.key[every] == whole.key).all() and (packed.size[every] == whole.size).all()
    assert len(packed.buf) < len(whole.buf) / 3

    def read(text, k):
        return bytes(text.buf[text.start[k]:text.start[k] + text.size[k]]).decode(errors="replace").lower()
    assert all(read(packed, k) == read(whole, k) for k in every.tolist())
    a, b = _corpus(200, 7)
    split = train([pa.array(a[:90]), pa.array(a[90:])], b, SMALL)
    assert split.offset == train(a, b, SMALL).offset


def test_documents_of_up_to_12000_bytes_teach(spark):
    texts = ["ba no ti re " * 900, "ba no grax re " * 800] * 10
    assert all(8_000 < len(t) <= 12_000 for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    p = replace(ToxicParams(), rounds=("random", "largest"), steps_at_least=8, batch=8)
    net = fit(docs, marked, lambda i: i >= 0, params=p)
    assert net.share == 0.5 and net.p.sample == (6000, 3000)
    assert (net.out["w"] != Network(p).out["w"]).any()


def test_batches_score_like_single_documents():
    from postsignal.llm.op2_toxicity import Known, batch_scores
    texts, labels = _corpus(200, 6)
    net = train(texts, labels, SMALL)
    odd = [None, "", " \t", "y" * 3000, texts[0], texts[0], " ".join(texts[:40])]
    column = pa.array([*texts, *odd], pa.string())
    share = net.share

    def alone(t):
        text = Text(*utf8(pa.array([t], pa.string())), net.p.word_bytes)
        if len(text.first) < 2 or text.first[-1] == 0:
            return share
        return float(1 / (1 + np.exp(-(document_logits(net, text)[0] - net.offset))))
    want = np.array([alone(t) for t in column.to_pylist()])
    for words, chunk in ((150_000, 1 << 20), (10, 1 << 20), (60, 700), (0, 1)):
        few = Network.__new__(Network)
        few.__dict__ = {**net.__dict__, "p": replace(net.p, known_words=words, score_chunk=chunk)}
        assert np.allclose(batch_scores(few, Known(words), column), want, atol=1e-6), (words, chunk)
