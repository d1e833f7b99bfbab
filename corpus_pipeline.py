"""Corpus pipeline: documents -> without toxic texts -> without near duplicates -> mixed -> packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and its result is written as Parquet and reread as the next one's ``docs``.
All but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty result (the toxicity
stage without any labelled text gives every text the score 0 and keeps it); null and
empty texts are no copies of each other, have size 0 in the mix, which takes them or
leaves them by source like others, and are one end id in a sequence; texts of
any length are read whole; rows that repeat an id stay or go by their text (near
duplicates: the id's group decides); rows with a null id stay; extra columns, also
those named like a stage's own, pass through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postsignal.llm.op10_packing import PackParams, pack_documents
from postsignal.llm.op2_toxicity import drop_toxic, fit
from postsignal.llm.op5_minhash import drop_near_duplicates
from postsignal.llm.op8_mixing import mixed_documents
from postsignal.llm.queries import crc_of_id, table, tokenizer_path
from postsignal.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores 0.5 or more go; it learns from the same labels as its query."""
    net = fit(docs, table(spark, sf_dir, "labels"), lambda i: crc_of_id(i) % 5 != 0)
    return drop_toxic(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (its smallest id)."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, a row for each time the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack_documents(docs, PackParams(tokenizer_path()))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None      # a trained network, hash order and best fit have no SQL form; tests/llm checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage outputs go under ``spark.checkpoint.dir``."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
