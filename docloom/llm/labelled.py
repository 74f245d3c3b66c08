"""A bounded, deterministic sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fold


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text as binary, label) of at most ``most`` labelled documents, held-out ones left out.

    The labels with the least hash of doc_id are taken, so the sample is the same in every run. They
    are at most ``most`` rows of two numbers, which bounds the broadcast. A doc_id with several
    labels counts with the least; one with several rows gives the text of the least hash, so that an
    id that very many rows share doesn't fill the sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    known = known.where(fold(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    one = texts.groupBy("doc_id", label).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return one.select("doc_id", "text", F.col(label).cast("int").alias(label))
