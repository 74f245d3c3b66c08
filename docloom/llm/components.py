"""Connected components of links between ids, by union-find inside tasks and star contraction between them.

Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is one
aggregation with partial results and one join, so an id with very many links is no hot task; every
round is cut by a checkpoint. The driver only sees whether another round is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, ship

#: Links that a task contracts at once.
BLOCK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) for the components of links a-b, without the roots."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            break
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush():
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        u, v = forest(a, b)
        for at in range(0, len(u), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 17)]), pa.array(v[at : at + (1 << 17)])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids of ``links`` (a, b: bigint, no nulls), component the least id reachable.

    Links may repeat and stand in either direction; a link of an id with itself only names the id.
    No links give no rows.
    """
    ship(links.sparkSession)
    links = cut(links.select("a", "b"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # From here a link (u, v) has u > v.
    edges = cut(links.where("a <> b").mapInArrow(_contract, "u bigint, v bigint").distinct())
    while True:
        parents = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # Both sides of this join are tables, so a v with very many links is a partition that can be split.
        above = edges.join(parents.select(F.col("u").alias("p"), "m"), F.col("v") == F.col("p"), "left")
        if parents.where("n > 1").isEmpty() and above.where("p is not null").isEmpty():
            break
        # Large star: the greater neighbours of v point to the least id around v.
        large = cut(above.select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: u and its lesser neighbours point to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u <> v").mapInArrow(_contract, "u bigint, v bigint").distinct())
    return ids.join(edges, ids["id"] == edges["u"], "left").select("id", F.coalesce("v", "id").alias("component"))
