"""JSON arrays read by many tasks (SRC-1).

A file is cut at its closing braces by the text reader, whose splits are byte
ranges, so one large array is read by as many tasks as it has splits.  Where a
split starts (inside a string or not, how many braces deep) depends on everything
before it in the file, so

1. each split is summed up for both cases (outside and inside a string): the
   state it ends in, the change of depth, the lowest depth it reaches;
2. these rows, one per split, are chained in file order to every split's true start;
3. with it, each split gives out the records that lie in it; a record that runs
   over split edges comes as pieces, which meet by the split it began in.

The rows of step 2 are one per split, as many as the scan has tasks on the driver;
those of splits inside a file are broadcast.  Nothing else leaves its task but
records that cross an edge.  Files are scanned three times where a record crosses an edge, else twice.

Defined cases: a record is an outermost object, so arrays of objects (packed or
indented), single objects and JSON lines are read alike; array elements that are not
objects, blank files and empty arrays give no rows; a last record without its end
gives a row of nulls; compressed files are one split each.  All scans have to see
the same splits: if the cluster's size changed them in between, the read stops
with an error (fix ``spark.sql.files.minPartitionNum`` to rule that out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)', re.S)              # a string, or one that does not end here
REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)                    # what is left of a string
LEAD = re.compile(r'(?:[^"{]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"?)*+', re.S)    # all before the first brace
BATCH = 4 << 20                                                           # characters given out at a time

_SUM = pa.schema([("file", pa.string()), ("start", pa.int64()), *[(f"{c}{s}", pa.int64()) for s in (0, 1) for c in ("inside", "delta", "low")]])
_OUT = pa.schema([("file", pa.string()), ("open", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
SUM = ", ".join(f"{f.name} {'string' if f.name == 'file' else 'long'}" for f in _SUM)
OUT = "file string, open long, start long, text string"


def step(text: str, inside: bool) -> tuple[bool, int]:
    """(ends inside a string, braces opened outside strings) of a text between two closing braces."""
    if inside:
        rest = REST.match(text)
        if not rest:
            return True, 0
        text = text[rest.end():]
    bare, strings = STRING.subn(r"\1", text)
    return strings > bare.count('"'), bare.count("{")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, start, ...) of every split of a task and its texts; a split's rows are consecutive."""
    def rows():
        for b in batches:
            names = [c for c in b.schema.names if c != "value"]
            keys = zip(*[b.column(c).to_pylist() for c in names])
            yield from zip(keys, b.column("value").to_pylist())
    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (v for _, v in group)


def _sums(batches):
    for (file, start), texts in _runs(batches):
        inside, delta, low = [False, True], [0, 0], [0, 0]
        for text in texts:
            found = [step(text, x) for x in sorted(set(inside))]              # the two cases soon meet
            for s in (0, 1):
                now, opened = found[inside[s] if len(found) > 1 else 0]
                inside[s] = now
                delta[s] += opened
                if not now:
                    delta[s] -= 1
                    low[s] = min(low[s], delta[s])
        values = [file, start, *[int(x) for s in (0, 1) for x in (inside[s], delta[s], low[s])]]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SUM)], schema=_SUM)


def chain(sums: pd.DataFrame) -> pd.DataFrame:
    """Each split of one file: whether it starts inside a string, its depth, the split in which the open record began, the depth it leaves."""
    inside, depth, began, rows = 0, 0, -1, []
    for r in sums.sort_values("start").to_dict("records"):
        head = (r["file"], r["start"], inside, depth, began)
        closes = depth + r[f"low{inside}"] <= 0
        depth, inside, fresh = max(depth + r[f"delta{inside}"], 0), r[f"inside{inside}"], depth == 0 or closes
        began = (r["start"] if fresh else began) if depth else -1
        rows.append((*head, depth))
    return pd.DataFrame(rows, columns=["file", "start", "inside", "depth", "began", "left"])


def _records(pieces: bool):
    """The records inside each split, or (``pieces``) its parts of records that cross an edge."""
    def run(batches):
        out, size = [], 0

        def flush():
            return pa.RecordBatch.from_pylist(out, schema=_OUT)
        for (file, start, inside, depth, began), texts in _runs(batches):
            inside, crossing, held = bool(inside), depth > 0, []
            for text in texts:
                now, opened = step(text, inside)
                if not depth and opened:                     # a record begins: leave out what stands before it
                    if inside:
                        text = text[REST.match(text).end():]
                    text = text[LEAD.match(text).end():]
                depth += opened
                inside = now
                if not depth:
                    continue
                held.append(text + "}")
                if not now:
                    depth -= 1
                    if not depth:
                        if crossing == pieces:
                            out.append({"file": file, "open": began if crossing else None, "start": start, "text": "".join(held)})
                            size += sum(map(len, held))
                        held, crossing = [], False
                        if size > BATCH:
                            yield flush()
                            out, size = [], 0
            if held and pieces:
                out.append({"file": file, "open": began if crossing else start, "start": start, "text": "".join(held)})
        if out:
            yield flush()
    return run


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every outermost object in the files at ``path``."""
    ensure_checkpoint_dir(spark)
    lines = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    starts = (lines.mapInArrow(_sums, SUM).groupBy("file").applyInPandas(chain, "file string, start long, inside long, depth long, began long, left long")
              .checkpoint())
    known = F.broadcast(starts.filter("start > 0").drop("left"))          # one row per split inside a file
    seen = F.when((F.col("start") > 0) & F.col("depth").isNull(), F.raise_error(F.lit("the splits of the files changed while they were read")).cast("long"))
    placed = lines.join(known, ["file", "start"], "left").select(
        "file", "start", F.coalesce("inside", seen, F.lit(0)).alias("inside"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("began", F.lit(-1)).cast("long").alias("began"), "value")
    whole = placed.mapInArrow(_records(False), OUT).select(F.col("text").alias("value"))
    if not starts.filter("left > 0").head(1):             # no record leaves a split unfinished
        return whole
    part = placed.mapInArrow(_records(True), OUT)
    joined = (part.groupBy("file", "open").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
              .select(F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("value")))
    return whole.unionByName(joined)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``schema`` from JSON files of arrays, single objects or lines, each read by as many tasks as it has splits."""
    return record_texts(spark, path).select(F.from_json("value", schema, options or {}).alias("r")).select("r.*")
