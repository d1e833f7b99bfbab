"""Array-column vector helpers (TXT-12, STR-6, PRJ-4, JN-3).

Embeddings stay one ``array<double>`` column; dot products, norms and
variances are higher-order ``aggregate``/``zip_with`` expressions evaluated on
the executors, row by row, with no Python in the loop.  Only the variance over
tokens runs in Arrow batches (numpy over a batch's distinct words).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def vec_sum(c) -> Column:
    return F.aggregate(as_double_array(c), F.lit(0.0), lambda acc, x: acc + x)


def vec_dot(a, b) -> Column:
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def vec_norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, x: acc + x * x))


def vec_variance(c) -> Column:
    """Sample variance over the components of one vector (two-pass, stable)."""
    arr = as_double_array(c)
    n = F.size(arr)
    mean = vec_sum(arr) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, ss / (n - 1))


def token_variances(words: list[str], dim: int) -> np.ndarray:
    """Sample variance of the components of every word's vector: its runs of three characters (a shorter word is one),
    each added with a sign to one of ``dim`` places by its code, the value of its code points to base 31."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    start = np.cumsum(size) - size
    grams = np.maximum(size - 2, np.minimum(size, 1))
    word = np.repeat(np.arange(len(words)), grams)
    at = np.repeat(start - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    code = points[at]
    for step in (1, 2):
        more = size[word] > step                      # a word's only run may be shorter than three
        nxt = points[np.minimum(at + step, max(len(points) - 1, 0))]
        code = np.where(more, code * 31 + nxt, code)
    x = np.zeros((len(words), dim))
    np.add.at(x, (word, code % dim), np.where(code // dim % 2 == 0, 1.0, -1.0))
    return x.var(axis=1, ddof=1)


def token_variance(text, dim: int = 32, known: int = 200_000) -> Column:
    """TXT-12: mean over a text's tokens (runs without white space) of the variance of the token's vector; 0 without tokens.

    One projection; a batch works out every distinct word once, ``known`` words at a time."""
    @F.arrow_udf("double")
    def mean(texts: pa.Array) -> pa.Array:
        seen: dict[str, float] = {}
        out = []
        for t in texts.to_pylist():
            words = (t or "").split()
            fresh = list(dict.fromkeys(w for w in words if w not in seen))
            if fresh:
                if len(seen) > known:
                    seen.clear()
                    fresh = list(dict.fromkeys(words))
                seen.update(zip(fresh, token_variances(fresh, dim).tolist()))
            out.append(sum(seen[w] for w in words) / len(words) if words else 0.0)
        return pa.array(out, pa.float64())

    return mean(_c(text))


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def vector_default(c, k: int) -> Column:
    """PRJ-4: exactly ``k`` components; missing ones (or a null vector) -> 0."""
    arr = F.coalesce(as_double_array(c), F.array().cast("array<double>"))
    head = F.slice(arr, 1, k)
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(k) - F.size(head)))
    return F.concat(head, pad)


def contrast_columns(main, quoted, has_quote) -> list[Column]:
    """STR-6: 1 - cosine(main, quoted); 0 without a quote or for a zero-sum vector."""
    a, b = as_double_array(main), as_double_array(quoted)
    usable = _c(has_quote) & (vec_sum(a) != 0) & (vec_sum(b) != 0)
    contrast = F.when(usable, F.lit(1.0) - vec_dot(a, b) / (vec_norm(a) * vec_norm(b))).otherwise(F.lit(0.0))
    internal = F.least(contrast * F.lit(0.8), F.lit(1.0))
    return [contrast.alias("main_quoted_contrast"), internal.alias("internal_diversity"),
            ((contrast + internal) / F.lit(2.0)).alias("combined_diversity")]


def align_vectors(df: DataFrame, vectors: DataFrame, key: str, vkey: str, vcol: str,
                  dim: int, out: str = "embedding") -> DataFrame:
    """JN-3: left join vectors computed for a subset; others get a zero vector."""
    v = vectors.select(F.col(vkey).alias(key), as_double_array(vcol).alias(out))
    return (df.join(v, on=key, how="left")
            .withColumn(out, F.coalesce(F.col(out), zeros(dim))))
