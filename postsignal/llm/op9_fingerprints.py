"""Threshold-scaled fingerprints (native: DataFrame functions only).

A text's fingerprint keeps every shingle hash that lies below a fixed fraction
of the hash space, so it grows with the text, two fingerprints merge by union,
and containment as well as similarity can be estimated between texts of very
different length.  A shingle is five words (runs outside 0x20 and 0x09-0x0D,
A-Z lower-cased); fewer words are one shingle.  Where no hash is below the
threshold the smallest one stands alone, so that a text with words is never
without one; ``merge`` drops it again next to a kept one.  As a string: the
sorted hashes, 16 hexadecimal digits each.

``next_rows`` pairs every row with its successor in id order without a
single-task window: ids are cut into buckets (equal-depth segments from
approximate percentiles, each cut evenly), at most ``SEGMENTS * SLICES`` of
them and one before them for null ids; the first row of every bucket is also sent to the bucket before it, so a
window inside the buckets finds every successor with one shuffle of the texts.

Defined cases: a null text is empty and an empty text has the empty
fingerprint; two empty fingerprints have likeness 1, an empty and another one
0; a null id counts as smaller than any other; rows with equal ids follow each other in
text order; a single row is its own successor; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SCALE = 4                      # one hash in SCALE is kept
SEGMENTS, SLICES = 256, 256    # most buckets of next_rows: their product
BUCKET_ROWS = 512              # rows of a bucket, until there are too many buckets

_LEAST = -(1 << 63)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Array of the 64-bit hashes of all ``k``-word shingles of a text, in text order."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(
            *[F.element_at(h, (i + j).cast("int")) for j in range(k)]))
        one = F.array(F.xxhash64(h))
        return F.when(n >= k, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    # a one-element transform names the word hashes, so that they are computed once
    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of_hashes), 1)


def keep_scaled(hashes: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below the threshold; the smallest one where none is."""
    last = F.lit(_LEAST + (1 << 64) // scale - 1)

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x <= last)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(
            F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(hashes), kept), 1)


def fingerprint(text: Column, scale: int = SCALE) -> Column:
    """Fingerprint of a text as an array of hashes."""
    return keep_scaled(shingle_hashes(text), scale)


def fingerprint_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Fingerprint of the union of two shingle sets from their fingerprints."""
    return keep_scaled(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two shingle sets (0..1) from their fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that are in ``b``; null for an empty ``a``."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double"))


def _search(value: Column, edges: list[int], low: int = 0) -> Column:
    """Number of ``edges`` (ascending) at or below ``value``, by halving."""
    if not edges:
        return F.lit(low)
    mid = len(edges) // 2
    return F.when(value < edges[mid], _search(value, edges[:mid], low)).otherwise(
        _search(value, edges[mid + 1:], low + mid + 1))


def next_rows(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, Window]:
    """``rows`` with ``_bucket`` and ``_extra`` and the window in which ``lead`` finds each row's successor.

    ``key``: a long column; ``order``: columns that order equal keys.
    Rows with ``_extra`` are copies of the next bucket's first rows (of the very
    first ones, for the last bucket): drop them after taking ``lead``.
    """
    n, least, most, cuts = rows.agg(
        F.count(F.lit(1)), F.min(key), F.max(key),
        F.percentile_approx(key, [k / SEGMENTS for k in range(1, SEGMENTS)], 10_000)).first()
    if not n:
        return (rows.withColumns({"_bucket": F.lit(0), "_extra": F.lit(0)}),
                Window.partitionBy("_bucket").orderBy("_extra", key, *order))
    if least is None:                                     # null keys only
        bucket = F.lit(-1)
    else:
        edges = sorted(set(cuts) - {least})
        slices = max(1, min(SLICES, -(-n // (BUCKET_ROWS * (len(edges) + 1)))))
        starts, ends = [least, *edges], [*edges, most + 1]
        shift = 2 if any(b - a >= 1 << 63 for a, b in zip(starts, ends)) else 0    # else their differences leave a long
        firsts = [a >> shift for a in starts]
        widths = [max(1, -(-(((b - 1) >> shift) - a + 1) // slices)) for a, b in zip(firsts, ends)]
        segment = _search(F.col(key), edges)
        first = F.element_at(F.array(*[F.lit(x) for x in firsts]), segment + 1)
        width = F.element_at(F.array(*[F.lit(x) for x in widths]), segment + 1)
        value = F.shiftright(key, shift) if shift else F.col(key)
        bucket = F.when(F.col(key).isNull(), -1).otherwise(segment * slices + F.floor((value - first) / width))
    bucketed = rows.withColumn("_bucket", bucket.cast("int"))
    # at most SEGMENTS * SLICES rows of three numbers: this bound makes the window and the broadcast safe
    heads = bucketed.groupBy("_bucket").agg(F.min(key).alias("_head"))
    by_bucket = Window.orderBy("_bucket")
    before = heads.select("_head", F.coalesce(F.lag("_bucket").over(by_bucket), F.max("_bucket").over(Window.partitionBy())).alias("_before"))
    extra = (rows.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_head"))).drop("_head")
             .withColumnRenamed("_before", "_bucket").withColumn("_extra", F.lit(1)))
    both = bucketed.withColumn("_extra", F.lit(0)).unionByName(extra)
    return both, Window.partitionBy("_bucket").orderBy("_extra", key, *order)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both, window = next_rows(rows, "id", ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("_next", F.lit(1), half))
    return (both.withColumn("fp", fingerprint(F.col("text"), scale))
            .withColumns({"_next": F.lead("text").over(window), "_next_fp": F.lead("fp").over(window)})
            .filter("_extra = 0")
            .withColumn("edited", edited)
            .withColumn("edited_fp", fingerprint(F.col("edited"), scale))
            .select(
                "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                likeness(F.col("fp"), F.col("_next_fp")).alias("near_next")))
