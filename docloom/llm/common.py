"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.workers import ready

#: A word, by the contracts of the corpus queries: a run of bytes other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside an operator, so that such rows keep a place in every order.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch; the default counts rows only, and texts may be long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Ready a session for Python workers: small batches, and a path to this package.

    The bound on batches stays set in the session, for plans run after an operator has returned.
    """
    spark.conf.set(*BATCH_BYTES)
    ready(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; rows of fold 1 are held out of all learning (null: as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` columns (numbers), one table for each.

    Rows of a run may stand in many batches; each batch is looked at once.
    """
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        new[0] = last != tuple(c[0] for c in columns)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        starts = np.flatnonzero(new).tolist()
        ends = [*starts, n]
        if ends[0]:
            held.append(batch.slice(0, ends[0]))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)
