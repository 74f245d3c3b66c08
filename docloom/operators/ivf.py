"""Approximate vector search: an inverted file over centroids, as a partitioned table.

Centroids are learned on a bounded sample; every vector is written to the folder of its nearest
one. A search reads the folders of the ``probes`` centroids nearest to the query and ranks their
rows exactly, so partition pruning leaves out the rest of the table. How many lists a search should
read follows from the data: ``build`` measures it against brute force on the sample. An extension:
``vector.knn`` stays the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import vector
from docloom.workers import ready

#: Lists; vectors to learn on at most, and rounds of learning.
LISTS, SAMPLE, ROUNDS, SEED = 64, 20_000, 15, 7
#: Sampled vectors that stand as queries, neighbours that count, and the share of them that should be found.
TRIALS, NEIGHBOURS, RECALL = 256, 10, 0.95
#: The list of vectors of another length, which a query of their length reads whole.
OTHERS = -1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def learn_centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means; fewer centroids than asked for if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    x = _unit(x)
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        for k in range(len(centroids)):
            own = x[nearest == k]
            if len(own):
                mean = own.sum(axis=0)
                centroids[k] = mean / max(1e-12, np.linalg.norm(mean))
    return centroids


def enough_probes(x: np.ndarray, centroids: np.ndarray, recall: float = RECALL, seed: int = SEED) -> int:
    """Lists to read so that ``recall`` of the nearest neighbours by cosine among the sample are in them."""
    x = _unit(x)
    q = x[np.random.default_rng(seed + 1).permutation(len(x))[:TRIALS]]
    k = min(NEIGHBOURS, len(x))
    near = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    place = (x @ centroids.T).argmax(axis=1)
    order = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(order, place[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@dataclass
class Index:
    path: str
    centroids: np.ndarray
    probes: int

    def to_json(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "probes": self.probes})

    @staticmethod
    def from_json(path: str, text: str) -> Index:
        d = json.loads(text)
        return Index(path, np.array(d["centroids"]), d["probes"])

    def near(self, query: list[float], probes: int | None = None) -> list[int]:
        """The lists to read for a query."""
        if len(query) != self.centroids.shape[1]:
            return [OTHERS]
        return np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[: probes or self.probes].tolist()

    def rows(self, spark: SparkSession, query: list[float], probes: int | None = None) -> DataFrame:
        """Rows of the lists nearest to a query."""
        return spark.read.parquet(self.path).where(F.col("_list").isin(self.near(query, probes))).drop("_list")

    def search(self, spark: SparkSession, query: list[float], k: int = 10, probes: int | None = None, metric: str = "cosine", vector_col: str = "vector", id_col: str = "_id") -> DataFrame:
        """Like ``vector.knn``, over the rows of the nearest lists."""
        return vector.knn(self.rows(spark, query, probes), query, k, metric, vector_col, id_col)

    def search_batch(self, spark: SparkSession, queries: DataFrame, k: int = 10, probes: int | None = None, metric: str = "cosine", vector_col: str = "vector", id_col: str = "_id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, similarity, rank): like ``vector.knn_batch``, each query in its nearest lists.

        Queries go to all executors in blocks; in a task those that read a list meet its rows in one
        matrix product. Queries of another length than the centroids' have no rows.
        """
        dims, most = self.centroids.shape[1], probes or self.probes
        rows = spark.read.parquet(self.path).where(F.col("_list") != OTHERS)

        def readers(q: np.ndarray) -> dict[int, np.ndarray]:
            near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :most]
            return {int(n): np.flatnonzero((near == n).any(axis=1)) for n in np.unique(near)}

        return vector.knn_batch(rows, queries.where(F.size(query_vector) == dims), k, metric, vector_col, id_col, query_id, query_vector, by="_list", readers=readers)


def build(df: DataFrame, path: str, lists: int = LISTS, vector_col: str = "vector", id_col: str = "_id", sample: int = SAMPLE, mode: str = "error") -> Index:
    """Write ``df`` as an inverted file. Rows without a vector are left out; those of another length than the usual one have a list of their own."""
    rows = df.where(F.size(vector_col) > 0)
    usual = rows.groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        raise ValueError("there are no vectors")
    dims = usual["dims"]
    learn = rows.where(F.size(vector_col) == dims).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector_col).cast("array<double>").alias("v")).toPandas()["v"]
    x = np.stack(learn.to_numpy())
    centroids = learn_centroids(x, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(vector_col))
            right = np.flatnonzero(np.array(v.value_lengths()) == dims)
            out = np.full(batch.num_rows, OTHERS, np.int32)
            if len(right):
                own = v.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(right), dims)
                out[right] = (own @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_list"])

    ready(df.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    rows.mapInArrow(assign, f"{kinds}, _list int").write.mode(mode).partitionBy("_list").parquet(path)
    return Index(path, centroids, enough_probes(x, centroids))
