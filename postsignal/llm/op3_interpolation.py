"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of orders ``order`` .. 1 and a
uniform one.  Which mixture a token gets depends on how often its context was
seen (a bucket per octave of the longest seen context's count); each bucket's
weights come from expectation-maximisation on held-out counts: a tenth of the
training documents is deleted from the counts and its tokens are predicted
from the rest.  Scores then use the counts of all training documents.

N-gram counts cover the whole corpus and are never sent to the driver or
broadcast.  Documents are dealt by hash, compressed, into blocks of ``block_bytes``.

1. A block sends, per order and key range, its distinct n-gram keys with their
   training and deleted counts (sorted, delta-coded, compressed).
2. A key range adds up all blocks' counts and answers every block, in the order
   of its request, with the totals.
3. A block meets its answers, so that it knows every total its tokens need; it
   writes them (compressed) together with the held-out statistics: cells of
   (context bucket, octaves of the estimates), at most ``CELLS`` of them.
4. EM runs over the cells; a last narrow pass turns totals into scores.

So a frequent n-gram costs one entry per block, work and traffic grow in
proportion to the text, and no key, document or source is a hot spot.

Tokens are words (runs outside 0x20 and 0x09-0x0D, A-Z lower-cased) and one end per
document.  Keys are 64-bit hashes for words (collisions are negligible below
10**9 types) and, for longer n-grams, as many bits as keep the expected number
of colliding pairs of each order at 256 at most (about 140 for 0.5 GB of text and
250 for 30 GB if nearly all n-grams differ, fewer if they repeat).

Defined cases: a null text is empty (one end token); a null id is held like an
empty id text; repeated rows are counted and scored each; without training
documents every token has the uniform probability; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textkit import Words, mix, utf8

_OCTAVES = 32
_LEVELS = 64                                       # context buckets
CELLS = _LEVELS * _OCTAVES ** 3                    # bound of the statistics that reach the driver


@dataclass(frozen=True)
class LmParams:
    order: int = 3                 # 2 or 3
    block_bytes: int = 16 << 20    # text of a block, about
    range_tokens: int = 1 << 20    # tokens per key range, about
    deleted_in: int = 10           # one in so many training documents is held out for the weights
    iterations: int = 60


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    import zstandard
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), dtype=np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :b[0]] = planes.T
    return out.view("<u8").ravel()


PACKED = "block long, doc_id array<long>, train array<boolean>, deleted array<boolean>, size array<int>, text binary"
_PACKED = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("deleted", pa.list_(pa.bool_())),
                     ("size", pa.list_(pa.int32())), ("text", pa.binary())])


def _deal(batches):
    """Documents (block, doc_id, train, deleted, text) as one compressed row per block and batch."""
    import zstandard
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True]) if len(order) else np.zeros(0, dtype=np.int64)
        rows = []
        for a, b in zip(edges, edges[1:]):
            part = batch.take(pa.array(order[a:b]))
            buf, off = utf8(part.column("text"))
            rows.append({"block": int(block[order[a]]), "doc_id": part.column("doc_id").to_pylist(), "train": part.column("train").to_pylist(),
                         "deleted": part.column("deleted").to_pylist(), "size": np.diff(off).tolist(),
                         "text": zstandard.ZstdCompressor(level=3).compress(buf.tobytes())})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)


class Tokens:
    """The tokens of a block: keys of every order, document starts."""

    def __init__(self, table: pa.Table, order: int, bits: int):
        import zstandard
        flat = {c: table[c].combine_chunks().flatten() for c in ("doc_id", "train", "deleted", "size")}
        buf = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b.as_py()) for b in table["text"]), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum(flat["size"].to_numpy(), dtype=np.int64)])
        self.doc_id = flat["doc_id"]
        w = Words(buf, off)
        del buf
        end = mix(np.zeros(1, dtype=np.uint64), 71)[0]
        h, first = np.insert(w.hash, w.first[1:], end), w.first
        del w                                          # a block's arrays are large: drop each one as soon as it is used
        self.first = first + np.arange(len(first))
        start = self.first[:-1]
        marks = mix(np.arange(2, dtype=np.uint64), 72)
        one = np.roll(h, 1)
        one[start] = marks[0]
        self.keys = [h, mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(one, 73), 74)]
        del h
        if order > 2:
            two = np.roll(one, 1)
            two[start] = marks[1]
            self.keys.append(mix(self.keys[1] * np.uint64(0xD1342543DE82EF95) + mix(two, 75), 76))
        for k in range(1, order):
            self.keys[k] = self.keys[k] >> np.uint64(64 - bits)
        self.width = [64] + [bits] * (order - 1)
        self.train = flat["train"].to_numpy(zero_copy_only=False)
        self.deleted = flat["deleted"].to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(self.first))

    def take(self, k: int) -> np.ndarray:
        """The keys of one order, given up."""
        key, self.keys[k] = self.keys[k], None
        return key


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return x.astype(np.int32 if not len(x) or x.max() < 1 << 31 else np.int64)


def _requests(p: LmParams, bits: int, ranges: int):
    """Rows (ord, range, block, keys, train, deleted) of one block."""
    def run(table: pa.Table) -> pa.Table:
        t = Tokens(table, p.order, bits)
        block = table["block"][0].as_py()
        rows = []
        train, deleted = t.train[t.doc], t.deleted[t.doc]
        for k in range(p.order):
            distinct, number = np.unique(t.take(k), return_inverse=True)
            number = number.astype(np.int32)
            a = np.bincount(number[train], minlength=len(distinct)).astype(np.uint64)
            d = np.bincount(number[deleted], minlength=len(distinct)).astype(np.uint64)
            del number
            shift = np.uint64(t.width[k] - ranges)
            edges = np.searchsorted(distinct >> shift, np.arange((1 << ranges) + 1, dtype=np.uint64))
            for r in range(1 << ranges):
                i, j = edges[r], edges[r + 1]
                if i < j:
                    gaps = np.diff(distinct[i:j], prepend=np.uint64(r) << shift)
                    rows.append((k + 1, r, block, pack(gaps), pack(a[i:j]), pack(d[i:j])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _REQUEST)], schema=_REQUEST) if rows else _REQUEST.empty_table()
    return run


_REQUEST = pa.schema([("ord", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("deleted", pa.binary())])
REQUEST = "ord int, range int, block long, keys binary, train binary, deleted binary"
_ANSWER = pa.schema([("ord", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("train", pa.binary()), ("deleted", pa.binary()),
                     ("types", pa.int64()), ("tokens", pa.int64()), ("deleted_tokens", pa.int64())])
ANSWER = "ord int, range int, block long, train binary, deleted binary, types long, tokens long, deleted_tokens long"


def _answers(table: pa.Table) -> pa.Table:
    """Totals of one key range, for every block in the order of its keys."""
    keys = [np.cumsum(unpack(b.as_py()), dtype=np.uint64) for b in table["keys"]]
    size = np.array([len(k) for k in keys])
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = {c: np.bincount(number, weights=np.concatenate([unpack(b.as_py()) for b in table[c]]), minlength=len(distinct)).astype(np.uint64)
             for c in ("train", "deleted")}
    ends = np.cumsum(size)
    ordered, span, block = table["ord"][0].as_py(), table["range"][0].as_py(), table["block"].to_pylist()
    seen, tokens, gone = int((total["train"] > 0).sum()), int(total["train"].sum()), int(total["deleted"].sum())
    rows = [(ordered, span, block[i], pack(total["train"][number[ends[i] - size[i]:ends[i]]]),
             pack(total["deleted"][number[ends[i] - size[i]:ends[i]]]), seen, tokens, gone) for i in range(len(block))]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)


def context_bucket(context: list[np.ndarray]) -> np.ndarray:
    """Bucket of the longest context that was seen (``context``: counts, shortest first): an octave of its count."""
    out = np.zeros(len(context[0]), dtype=np.int64)
    room = (_LEVELS - 1) // len(context)
    for k, c in enumerate(context):
        octave = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), room - 1)
        out = np.where(c > 0, 1 + k * room + octave, out)
    return out


def contexts(counts: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """Counts of each token's contexts of one, two words, from the counts of the n-grams that end in a token."""
    start, last = first[:-1], first[1:] - 1
    one = np.roll(counts[0], 1)
    one[start] = counts[0][last]                       # a document begins as often as one ends
    out = [one]
    if len(counts) > 2:
        two = np.roll(counts[1], 1)
        two[start] = 0
        out.append(two)
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _octave(f: np.ndarray) -> np.ndarray:
    """0: impossible; else 1 + octaves below 1."""
    safe = np.where(f > 0, f, 1.0)
    return np.where(f > 0, 1 + np.clip(-np.log2(safe), 0, _OCTAVES - 2).astype(np.int64), 0)


_BLOCK = pa.schema([("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.binary())),
                    ("range", pa.list_(pa.int32())), ("types", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("deleted_tokens", pa.list_(pa.int64())),
                    ("cell", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(pa.float64())))])
BLOCK = ("doc_id array<long>, held_out array<boolean>, n_tokens array<long>, counts array<binary>, range array<int>, types array<long>, "
         "tokens array<long>, deleted_tokens array<long>, cell array<long>, n array<long>, sums array<array<double>>")


def _meet(p: LmParams, bits: int):
    """A block's documents and answers: totals per token, and the held-out cells."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(table, p.order, bits)
        answers = answers.sort_by([("ord", "ascending"), ("range", "ascending")])
        ordered = answers["ord"].to_numpy()
        counts, kept = [], []
        some = t.deleted.any()
        for k in range(p.order):
            mine = np.flatnonzero(ordered == k + 1)
            number = np.unique(t.take(k), return_inverse=True)[1].astype(np.int32)
            total = _narrow(np.concatenate([unpack(answers["train"][int(i)].as_py()) for i in mine]))
            counts.append(total[number])
            if some:
                gone = _narrow(np.concatenate([unpack(answers["deleted"][int(i)].as_py()) for i in mine]))
                kept.append((total - gone)[number])
            del number, total
        cell, n, sums = [], [], []
        if some:
            context = contexts(kept, t.first)
            out = t.deleted[t.doc]
            kept, context = [c[out] for c in kept], [c[out] for c in context]
            f = [kept[0].astype(float), *(_ratio(c, x) for c, x in zip(kept[1:], context))]
            code = context_bucket(context) * _OCTAVES + np.minimum(np.log2(kept[0] + 1).astype(np.int64), _OCTAVES - 1)
            for x in f[1:]:
                code = code * _OCTAVES + _octave(x)
            cell, number, n = np.unique(code, return_inverse=True, return_counts=True)
            sums = np.stack([np.bincount(number, weights=x, minlength=len(cell)) for x in f], axis=1).tolist()
            cell, n = cell.tolist(), n.tolist()
        words = np.flatnonzero(ordered == 1)
        row = {"doc_id": t.doc_id.to_pylist(), "held_out": (~t.train).tolist(), "n_tokens": np.diff(t.first).tolist(),
               "counts": [pack(c) for c in counts], "cell": cell, "n": n, "sums": sums}
        row |= {c: answers[c].take(pa.array(words)).to_pylist() for c in ("range", "types", "tokens", "deleted_tokens")}
        return pa.Table.from_pylist([row], schema=_BLOCK)
    return run


def learn_weights(cell: np.ndarray, n: np.ndarray, sums: np.ndarray, tokens: float, types: int, orders: int, iterations: int) -> np.ndarray:
    """(context buckets, orders + 1) mixture weights: uniform, order 1, 2, ...; EM over the held-out cells.

    ``sums``: per cell the sum of its tokens' word counts and of their
    estimates of order 2, ...; a bucket without held-out tokens takes the weights of all tokens together.
    """
    bucket = (cell // _OCTAVES ** orders).astype(np.int64)
    f = np.empty((len(cell), orders + 1))
    f[:, 0] = 1.0 / (types + 1)
    mean = sums / np.maximum(n, 1)[:, None]
    f[:, 1] = mean[:, 0] / max(tokens, 1.0)
    f[:, 2:] = mean[:, 1:]

    def fit(of: np.ndarray, groups: int) -> np.ndarray:
        w = np.full((groups, orders + 1), 1.0 / (orders + 1))
        mass = np.bincount(of, weights=n, minlength=groups)
        for _ in range(iterations):
            share = w[of] * f
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(of, weights=share[:, k], minlength=groups) for k in range(orders + 1)], axis=1)
            w = np.where(mass[:, None] > 0, new / np.maximum(mass, 1e-300)[:, None], w)
        return w
    overall = fit(np.zeros(len(cell), dtype=np.int64), 1)
    weights = fit(bucket, _LEVELS)
    weights[np.bincount(bucket, weights=n, minlength=_LEVELS) == 0] = overall[0]
    if not types:
        weights[:] = np.eye(orders + 1)[0]
    floor = 1e-6                                        # a word never seen keeps some probability in every bucket
    weights[:, 0] = np.maximum(weights[:, 0], floor)
    return weights / weights.sum(axis=1, keepdims=True)


def mixture(counts: list[np.ndarray], first: np.ndarray, weights: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Probability of every token."""
    context = contexts(counts, first)
    w = weights[context_bucket(context)]
    out = w[:, 0] / (types + 1) + w[:, 1] * (counts[0] / max(tokens, 1))
    for k, x in enumerate(context):
        out += w[:, k + 2] * _ratio(counts[k + 1], x)
    return out


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scores(weights: np.ndarray, tokens: int, types: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc, held, size, counts = (batch.column(n)[row] for n in ("doc_id", "held_out", "n_tokens", "counts"))
                size = np.asarray(size.values)
                first = np.concatenate([[0], np.cumsum(size)])
                counts = [unpack(c.as_py()).astype(np.int64) for c in counts.values]
                score = np.add.reduceat(np.log10(mixture(counts, first, weights, tokens, types)), first[:-1])
                base = np.add.reduceat(np.log10(counts[0] + 0.5), first[:-1]) - size * math.log10(tokens + 0.5 * (types + 1))
                known = np.add.reduceat((counts[0] > 0).astype(np.int64), first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [doc.values, held.values, pa.array(size), pa.array(known), pa.array(np.full(len(size), tokens)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score_documents(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text", params: LmParams = LmParams()) -> DataFrame:
    """Per document: ``SCORES``.  ``is_train(crc)``: from the CRC-32 of the id as text, whether a document is learned from."""
    p = params
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    crc = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // p.block_bytes))
    tokens = max(2, size // 5)
    bits = min(64, max(44, math.ceil(2 * math.log2(tokens)) - 9))
    ranges = max(0, math.ceil(math.log2(tokens / p.range_tokens)))
    dealt = rows.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text", is_train(crc).alias("train"),
        (is_train(crc) & (F.floor(crc / 5) % p.deleted_in == 0)).alias("deleted")).mapInArrow(_deal, PACKED)
    requests = dealt.groupBy("block").applyInArrow(_requests(p, bits, ranges), REQUEST)
    answers = requests.groupBy("ord", "range").applyInArrow(_answers, ANSWER)
    met = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_meet(p, bits), BLOCK).checkpoint()
    told = (met.select(F.explode(F.arrays_zip("range", "types", "tokens", "deleted_tokens")).alias("x")).select("x.*").distinct()
            .agg(F.sum("types"), F.sum("tokens"), F.sum("deleted_tokens")).first())
    types, total, gone = (int(x or 0) for x in told)
    cells = (met.select(F.explode(F.arrays_zip("cell", "n", "sums")).alias("x")).select("x.*").groupBy("cell")
             .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(p.order)]).toPandas())   # CELLS rows at most
    weights = learn_weights(cells["cell"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=float),
                            cells[[f"s{k}" for k in range(p.order)]].to_numpy(dtype=float), total - gone, types, p.order, p.iterations)
    return met.mapInArrow(_scores(weights, total, types), SCORES)
