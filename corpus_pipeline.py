"""A corpus pipeline of five stages: quality, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, near_dup, quality_model, suffix_dedup
from docloom.llm.common import cut, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names of up to so many dropped rows (24 bytes each) are sent to all executors.
MOST_BROADCAST = 1 << 20
#: Near copies share 80 % or more of their shingles of five words.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts to be good."""
    docs = docs.select(*COLUMNS)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, tuple(COLUMNS)).where("score >= 0.5").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of the least doc_id; null ids come last. Rows without words stay."""
    docs = docs.select(*COLUMNS)
    own = [f"_{c}" for c in near_dup.ROW]
    rows, repeats = near_dup.judged(docs, SHINGLE, PERCENT)
    dropped = cut(rows.where(F.struct(*near_dup.ROW) != F.col("top")).select(*(F.col(c).alias(f"_{c}") for c in near_dup.ROW)).distinct())
    dropped = F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped
    left = docs.select("*", *near_dup.named_rows(docs, "_")).join(dropped, own, "left_anti")
    if repeats.isEmpty():
        return left.select(*COLUMNS)
    # Of rows with the same id and text one stays, the least by the other columns.
    repeats = repeats.select(*(F.col(c).alias(f"_{c}") for c in near_dup.ROW))
    once = left.join(repeats, own, "left_semi").groupBy(*own).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(repeats, own, "left_anti").select(*COLUMNS).unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 100-byte strings of earlier texts cover."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), ("lang", "source"), keep_text=True)
    length = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources have their target weights."""
    return mixing.repeated_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, *bpe.vocabulary(), emit_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", tokens),
]

#: The stages learn, hash shingles and encode, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder and read again.

    What the last stage reads stays there, for the result is not computed yet.
    """
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove the rows of a stage that the next one has read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
