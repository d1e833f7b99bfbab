"""Toxicity by a bidirectional gated recurrent network over characters and words.

Every distinct word is read character by character (UTF-8 bytes, A-Z lower-cased) by a
bidirectional GRU with attention pooling; its pooled state and a hashed word
embedding are the word's input.  A second bidirectional GRU with attention
pooling reads windows of ``window`` words that overlap by ``window - stride``;
a document's logit is its largest window's, so a single passage in a very long text
counts as much as in a short one.  All windows of all documents are scored.

Training runs in numpy on the driver, which holds the bytes of the sample's
distinct words and four bytes per occurrence, on a bounded sample of labelled
documents: at most ``sample`` of the two labels, in hash order, of at most
``train_bytes`` bytes (scoring has no such limit).  The first rounds learn from
random windows with their document's label, the last ones only from each
document's largest window, as scoring does.  A tenth of the sample, weighted to
the labels' share in the table, sets the offset of the logit.  Only texts and
the ``toxic`` label are read.

Scoring is one pass over the documents in Arrow batches; a worker keeps the
inputs of the words that it has seen in a table of bounded size.

Defined cases: null and word-less texts get the share of toxic documents in the
sample as score; words longer than ``word_bytes`` are read in parts; a
label that is null, or neither 0 nor 1, is not learned from; a document id with
several labels counts as toxic if one of them says so; repeated rows are
scored each; without both labels in the sample every document has the sample's
share (0 without any); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .textkit import _LOWER, Words, chunks, distinct, mix, utf8
from .tokens import ragged


@dataclass(frozen=True)
class ToxicParams:
    window: int = 64
    stride: int = 48
    word_bytes: int = 24
    char_dim: int = 8
    char_hidden: int = 8
    word_dim: int = 8
    word_buckets: int = 1 << 13
    hidden: int = 8
    sample: tuple[int, int] = (6000, 3000)     # bound of the training sample: documents of label 0, of label 1
    train_bytes: int = 12_000
    rounds: tuple[str, ...] = ("random",) * 6 + ("largest",) * 3
    steps_at_least: int = 500          # small samples are passed more often
    batch: int = 64
    rate: float = 0.01
    seed: int = 3
    known_words: int = 150_000         # words whose inputs a worker keeps
    score_chunk: int = 1 << 20         # bytes of documents scored at a time
    out_rows: int = 500                # rows of a filtered output batch


class Text:
    """Word parts of some documents: ``first`` per document, ``key`` per part, and its bytes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_bytes: int):
        w = Words(buf, offsets)
        size = w.end - w.start
        if len(w) and size.max() > word_bytes:
            count = -(-size // word_bytes)
            word = np.repeat(np.arange(len(w)), count)
            part = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
            self.start = w.start[word] + part * word_bytes
            self.size = np.minimum(w.end[word] - self.start, word_bytes)
            self.key = np.where(count[word] > 1, mix(w.hash[word] + part.astype(np.uint64), 61), w.hash[word])
            self.first = np.concatenate([[0], np.cumsum(count)])[w.first]
        else:
            self.start, self.size, self.key, self.first = w.start, size, w.hash, w.first
        self.buf = buf

    def part(self, i: int, j: int) -> "Text":
        """Documents ``i`` to ``j`` (views of the same arrays)."""
        out, a, b = object.__new__(Text), self.first[i], self.first[j]
        out.start, out.size, out.key, out.first, out.buf = self.start[a:b], self.size[a:b], self.key[a:b], self.first[i:j + 1] - a, self.buf
        return out


class Through:
    """``table[row]`` as an array that is looked up where it is read."""

    def __init__(self, table: np.ndarray, row: np.ndarray):
        self.table, self.row = table, row

    def __getitem__(self, at):
        return self.table[self.row[at]]


class Packed(Text):
    """As ``Text`` of all documents, with the bytes of distinct word parts only: four bytes per further occurrence.

    ``columns``: string columns whose documents follow one another; read in chunks.
    """

    def __init__(self, columns, word_bytes: int):
        keys, rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        new_keys, sizes, bufs, every, counts = [], [], [], [], []
        for column in columns:
            buf, off = utf8(column)
            for i, j in chunks(off, 1 << 20):
                text = Text(buf[off[i]:off[j]], off[i:j + 1] - off[i], word_bytes)
                at, tok = distinct(text.key, 18)
                key = text.key[at]
                found = np.searchsorted(keys, key)
                new = np.flatnonzero(keys[np.minimum(found, len(keys) - 1)] != key) if len(keys) else np.arange(len(key))
                if len(new):
                    put, fresh = at[new], key[new]
                    order = np.argsort(fresh)
                    here = np.searchsorted(keys, fresh[order])
                    rows = np.insert(rows, here, (len(rows) + order).astype(np.int32))
                    keys = np.insert(keys, here, fresh[order])
                    new_keys.append(fresh)
                    sizes.append(text.size[put])
                    bufs.append(text.buf[ragged(text.start[put], text.size[put])])
                    found = np.searchsorted(keys, key)
                every.append(rows[found][tok])
                counts.append(np.diff(text.first))
        row = np.concatenate([np.zeros(0, dtype=np.int32), *every])
        size = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
        self.buf = np.concatenate([np.zeros(0, dtype=np.uint8), *bufs])
        self.first = np.concatenate([[0], *counts]).astype(np.int64).cumsum()
        self.start, self.size = Through(np.cumsum(size) - size, row), Through(size, row)
        self.key = Through(np.concatenate([np.zeros(0, dtype=np.uint64), *new_keys]), row)


def windows(first: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, size) of the windows that cover every word; none for word-less documents."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(-(-(n - window) // stride), 0), 0)
    doc = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return doc, first[:-1][doc] + begin, np.minimum(n[doc] - begin, window)


class Network:
    def __init__(self, p: ToxicParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.embed = {"char": (rng.standard_normal((256, p.char_dim)) * 0.5).astype(np.float32),
                      "word": (rng.standard_normal((p.word_buckets, p.word_dim)) * 0.1).astype(np.float32)}
        self.char = gru.init(rng, p.char_dim, p.char_hidden)
        self.word = gru.init(rng, 2 * p.char_hidden + p.word_dim, p.hidden)
        self.out = {"w": (rng.standard_normal(2 * p.hidden) * 0.5).astype(np.float32), "b": np.zeros(1, dtype=np.float32)}
        self.offset = 0.0
        self.share = 0.0

    def words(self, text: Text, at: np.ndarray, learn: bool = False):
        """Inputs of the word parts ``at``: (vectors, what the backward pass needs)."""
        size = text.size[at]
        order = np.argsort(-size, kind="stable")
        size = size[order]
        ch = _LOWER[text.buf[ragged(text.start[at][order], size)]].astype(np.int64)
        start = np.cumsum(size) - size
        layer = gru.Layer(self.char, self.embed["char"], ch, start, size, learn)
        x = np.empty((len(at), layer.pooled.shape[1] + self.p.word_dim), dtype=np.float32)
        x[order, :layer.pooled.shape[1]] = layer.pooled
        bucket = (text.key[at] % np.uint64(self.p.word_buckets)).astype(np.int64)
        x[:, layer.pooled.shape[1]:] = self.embed["word"][bucket]
        return x, (layer, order, bucket)

    def logits(self, tables, tok: np.ndarray, start: np.ndarray, size: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logit of every window; ``tok``: row of ``tables`` of every word part."""
        out = np.empty(len(start), dtype=np.float32)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            n = size[some]
            layer = gru.Layer(self.word, None, tok[ragged(start[some], n)], np.cumsum(n) - n, n, tables=tables)
            out[some] = layer.pooled @ self.out["w"] + self.out["b"][0]
        return out

    def zero(self) -> list[dict]:
        return [{k: np.zeros_like(v) for k, v in d.items()} for d in (self.embed, self.char, self.word, self.out)]

    def learn(self, text: Text, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[list[dict], float]:
        """Gradients of the mean cross entropy of some windows, and its value."""
        order = np.argsort(-size, kind="stable")
        start, size, label = start[order], size[order], label[order]
        parts = ragged(start, size)
        at, tok = distinct(text.key[parts], 16)
        x, (chars, places, bucket) = self.words(text, parts[at], learn=True)
        layer = gru.Layer(self.word, x, tok, np.cumsum(size) - size, size, learn=True)
        logit = layer.pooled @ self.out["w"] + self.out["b"][0]
        prob = gru.sigmoid(logit)
        d = (prob - label) / len(label)
        embed, char, word, out = grads = self.zero()
        out["w"] += layer.pooled.T @ d
        out["b"] += d.sum()
        dx = layer.backward(d[:, None] * self.out["w"], word)
        np.add.at(embed["word"], bucket, dx[:, chars.pooled.shape[1]:])
        embed["char"] += chars.backward(dx[places, :chars.pooled.shape[1]], char)
        loss = float(-np.mean(np.where(label > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))))
        return grads, loss


def document_logits(net: Network, text: Text, docs: np.ndarray | None = None) -> np.ndarray:
    """Largest window logit of each document (of ``docs``), one document at a time in memory; 0 without words."""
    docs = np.arange(len(text.first) - 1) if docs is None else docs
    out = np.zeros(len(docs), dtype=np.float32)
    for k, d in enumerate(docs.tolist()):
        one = text.part(d, d + 1)
        if len(one.key):
            _, start, size = windows(one.first, net.p.window, net.p.stride)
            at, tok = distinct(one.key, 14)
            x, _ = net.words(one, at)
            out[k] = net.logits(gru.project(net.word, x), tok, start, size).max()
    return out


def train(texts: list[str] | list[pa.Array], labels: np.ndarray, p: ToxicParams = ToxicParams(), share: float | None = None) -> Network:
    """A network fitted on whole texts (or string columns of them) with labels 0 and 1, in the given order; ``share``: of label 1 where it will be used."""
    net = Network(p)
    own = float(labels.mean()) if len(labels) else 0.0
    net.share = own if share is None else share
    if own in (0.0, 1.0):
        net.share = own
        return net
    rng = np.random.default_rng(p.seed + 1)
    text = Packed(texts if isinstance(texts[0], pa.Array) else [pa.array(texts, pa.string())], p.word_bytes)
    doc, start, size = windows(text.first, p.window, p.stride)
    checked = np.arange(len(labels)) % 10 == 9
    of_doc = np.searchsorted(doc, np.arange(len(labels) + 1))
    usable = np.flatnonzero((np.diff(of_doc) > 0) & ~checked)
    adam = gru.Adam([net.embed, net.char, net.word, net.out], p.rate)
    per_round = max(-(-len(usable) // p.batch), -(-p.steps_at_least // len(p.rounds)))
    step, steps = 0, per_round * len(p.rounds)
    for kind in p.rounds:
        queue: list[int] = []
        for _ in range(per_round):
            while len(queue) < min(p.batch, len(usable)):
                queue.extend(rng.permutation(usable).tolist())
            some, queue = np.array(queue[:p.batch]), queue[p.batch:]
            if kind == "random":
                pick = of_doc[some] + (rng.random(len(some)) * (of_doc[some + 1] - of_doc[some])).astype(np.int64)
            else:
                n = of_doc[some + 1] - of_doc[some]
                all_ = ragged(of_doc[some], n)
                parts = ragged(start[all_], size[all_])
                at, tok = distinct(text.key[parts], 18)
                x, _ = net.words(text, parts[at])
                logit = net.logits(gru.project(net.word, x), tok, np.cumsum(size[all_]) - size[all_], size[all_])
                ends = np.cumsum(n)
                pick = np.array([all_[a + int(logit[a:b].argmax())] for a, b in zip(ends - n, ends)])
            grads, _ = net.learn(text, start[pick], size[pick], labels[some].astype(np.float32)[np.arange(len(some))])
            step += 1
            adam.step(grads, p.rate * (1 - 0.95 * step / steps))
    has = np.diff(text.first) > 0
    held = np.flatnonzero(checked & has) if (checked & has).sum() >= 50 else np.flatnonzero(has)
    x, y = document_logits(net, text, held), labels[held]
    cuts = np.unique(np.concatenate([x, [x.min() - 1, x.max() + 1]]))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    weight = np.where(y > 0, net.share / max(y.mean(), 1e-9), (1 - net.share) / max(1 - y.mean(), 1e-9))
    wrong = np.array([(weight * ((x >= c) != (y > 0))).sum() for c in cuts])
    best = cuts[wrong <= wrong.min() + 1e-9]
    net.offset = float(np.clip(best[np.argmin(np.abs(best - np.median(best)))], -4, 4))
    return net


class Known:
    """Input projections of the words a worker has seen, by key; forgotten all at once when there are too many."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys = np.zeros(0, dtype=np.uint64)
        self.tables = None

    def rows(self, net: Network, text: Text, at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(tables, row of each of the distinct parts ``at``)."""
        key = text.key[at]
        if len(self.keys) + len(key) > self.limit:
            found = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            kept = np.unique(found[self.keys[found] == key]) if len(self.keys) else found[:0]
            kept = kept[:max(self.limit - len(key), 0)]
            self.keys, self.tables = self.keys[kept], tuple(t[kept] for t in self.tables) if self.tables else None
        found = np.searchsorted(self.keys, key)
        if len(self.keys):
            new = np.flatnonzero(self.keys[np.minimum(found, len(self.keys) - 1)] != key)
        else:
            new = np.arange(len(key))
        if len(new):
            x, _ = net.words(text, at[new])
            fresh = gru.project(net.word, x)
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.tables = tuple((np.concatenate([a, b]) if a is not None else b)[order] for a, b in zip(self.tables or (None, None), fresh))
            found = np.searchsorted(self.keys, key)
        return self.tables, found


def batch_scores(net: Network, known: Known, column: pa.Array) -> np.ndarray:
    """Score of every text of a column."""
    p = net.p
    buf, off = utf8(column)
    out = np.full(len(column), net.share)
    for i, j in chunks(off, p.score_chunk):
        text = Text(buf[off[i]:off[j]], off[i:j + 1] - off[i], p.word_bytes)
        has = np.diff(text.first) > 0
        if has.any() and 0 < net.share < 1:
            at, tok = distinct(text.key)
            tables, row = known.rows(net, text, at)
            doc, start, size = windows(text.first, p.window, p.stride)
            logit = net.logits(tables, row[tok], start, size).astype(np.float64)
            most = np.maximum.reduceat(logit, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
            out[i:j][has] = 1 / (1 + np.exp(-np.clip(most - net.offset, -500, 500)))
    return out


def _score(net: Network):
    def run(batches):
        known = Known(net.p.known_words)
        for batch in batches:
            score = batch_scores(net, known, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])
    return run


def _clean(net: Network, text: int):
    def run(batches):
        known = Known(net.p.known_words)
        for batch in batches:
            keep = pa.array(batch_scores(net, known, batch.column(text)) < 0.5)
            for a in range(0, batch.num_rows, net.p.out_rows):       # never a second copy of the whole batch
                yield batch.slice(a, net.p.out_rows).filter(keep.slice(a, net.p.out_rows))
    return run


def fit(docs: DataFrame, labels: DataFrame, may_learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        params: ToxicParams = ToxicParams()) -> Network:
    """Train on the labelled documents for which ``may_learn(id)`` holds (a bounded sample, see the module)."""
    p = params
    label = F.col(label_col).cast("int")
    known = (labels.select(F.col(id_col).cast("long").alias("id"), label.alias("label")).filter("id is not null and label in (0, 1)")
             .filter(may_learn(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")))
    small = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .filter(F.octet_length("text").between(1, p.train_bytes)))
    ids = small.select("id").join(known, "id").select("id", "label", F.xxhash64("id").alias("h"))
    chosen = (ids.filter("label = 0").orderBy("h", "id").limit(p.sample[0])
              .unionByName(ids.filter("label = 1").orderBy("h", "id").limit(p.sample[1])))
    picked = {r["id"]: r["label"] for r in chosen.collect()}                     # as many ids as the sample's bound
    if not picked:
        return train([], np.zeros(0), p)
    share = float(known.agg(F.avg("label")).first()[0])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in picked], "id long"))
    sample = small.join(wanted, "id").groupBy("id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").toArrow()
    return train(sample.column("text").chunks, np.array([picked[i] for i in sample.column("id").to_pylist()]), p, share)


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _score(net), "id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; columns unchanged."""
    return docs.mapInArrow(_clean(net, docs.columns.index(text_col)), docs.schema)
