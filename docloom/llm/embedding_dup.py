"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label become one node with a number of its own and a weight, so large groups of
   copies cost one row. Ids play no part until the end, for they may be null or repeated.
2. Rotations are learned on a bounded sample (Gong and Lazebnik, 2011): alternate between the signs
   of the rotated vectors and the orthogonal matrix that brings the vectors closest to them. The
   sign bits of a rotated vector are its code; rotations from several starts make longer codes.
3. Codes are cut into substrings, one table for each; vectors with equal substrings meet. Substrings
   grow with the logarithm of the vectors of a label, so the vectors that meet by chance do not grow
   in number. There are as many tables as it takes for ``RECALL`` of pairs at the threshold to meet,
   as measured on pairs made from the sample.
4. In a bucket of a table the first 64 bits of the codes are compared first. Only nodes with a partner
   whose code is close enough, and that they did not meet in an earlier table (by 16 bits of each
   substring), fetch their vectors, and are compared by these in double precision, block by block; a
   pair that meets in several tables is counted in the first one only.
5. Links that are found give numbers of links and, through a spanning forest of each bucket, the
   components. Pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import cut, runs, ship, table
from docloom.llm.components import components, forest

COSINE = 0.98
#: Vectors that the rotations of one length are learned on at most, and their bytes; rounds of learning.
SAMPLE, SAMPLE_BYTES, ROUNDS, SEED = 20000, 64 << 20, 20, 11
#: Pairs at the threshold that are made of the sample at least.
PAIRS = 8192
#: Bits of a rotation at most; share of pairs at the threshold that should meet; tables at most.
BITS, RECALL, MOST_TABLES = 64, 0.995, 48
#: Vectors of a label that should share a substring by chance, on average.
COMPANY = 16
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 4096
#: Bits of a table's number within the key of a bucket.
PLACE = 56


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are balanced codes of ``bits`` bits."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(x.shape[1]))
    main = vectors[:, ::-1][:, :bits]
    v = centred @ main
    rotation, _ = np.linalg.qr(rng.standard_normal((main.shape[1], main.shape[1])))
    for _ in range(rounds):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(signs.T @ v)
        rotation = (u @ w).T
    return mean, main @ rotation


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values (64 at most) as numbers."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return packed((x - mean) @ projection >= 0)


@dataclass
class Index:
    """Tables over the vectors of one length."""

    mean: np.ndarray
    projection: np.ndarray
    #: bits of a substring, tables, and how many of the first 64 bits a pair may differ in
    width: int
    tables: int
    apart: int

    def values(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(rows, tables) substrings as numbers."""
        n = self.tables if tables is None else tables
        if not self.width:
            return np.zeros((len(x), n), np.int64)
        bits = (x - self.mean) @ self.projection[:, : n * self.width] >= 0
        return np.stack([packed(bits[:, t * self.width : (t + 1) * self.width]).astype(np.int64) for t in range(n)], axis=1) if n else np.zeros((len(x), 0), np.int64)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return packed((x - self.mean) @ self.projection[:, :64] >= 0)


def build(x: np.ndarray, largest: int, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> Index:
    """The index for unit vectors ``x`` (a sample), where the largest label holds ``largest`` of them.

    Each sampled vector gets a partner at exactly the threshold in a random direction. Tables are
    added until ``recall`` of these pairs share a substring; if ``MOST_TABLES`` don't do, substrings
    get shorter. Substrings of no bits make one bucket of all, which is exact.
    """
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    mean = x.mean(axis=0)
    own, x = x, np.tile(x, (-(-PAIRS // len(x)), 1))
    across = rng.standard_normal(x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.maximum(1e-300, np.sqrt((across**2).sum(axis=1, keepdims=True)))
    partner = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * (across if dims > 1 else 0 * across)
    bits = min(dims, BITS)
    projections: list[np.ndarray] = []
    agree = np.zeros((len(x), 0), bool)

    def grown(most: int) -> None:
        nonlocal agree
        while agree.shape[1] < most:
            _, p = learn_rotation(own, bits, seed=seed + len(projections))
            projections.append(p)
            agree = np.concatenate([agree, ((x - mean) @ p >= 0) == ((partner - mean) @ p >= 0)], axis=1)

    grown(min(64, -(-64 // bits) * bits))
    width = max(0, min(PLACE - 8, math.ceil(math.log2(max(1, largest / COMPANY)))))
    while width:
        met = np.zeros(len(x), bool)
        tables = 0
        while tables < MOST_TABLES and met.mean() < recall:
            grown((tables + 1) * width)
            met |= agree[:, tables * width : (tables + 1) * width].all(axis=1)
            tables += 1
        if met.mean() >= recall:
            break
        width -= 1
    if not width:
        tables = 1
    # Few vectors tell little of the bits, and need no comparison by them.
    apart = int((~agree[:, :64]).sum(axis=1).max()) + 4 if largest > 2 * COMPANY else 64
    return Index(mean, np.concatenate(projections, axis=1)[:, : max(64, tables * width)], width, tables, apart)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _by_dims(batch: pa.RecordBatch, at: int):
    """(rows, unit vectors) of a batch for each length among them."""
    dims = np.array(batch.column(at).value_lengths())
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, unit(_matrix(batch.column(at).take(pa.array(rows)), d))


def _encode(indexes: dict[int, Index]):
    """(node, one, two, v) to a row for each table: (one, two, key, node, sketch, met: 16 bits of each earlier substring)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for d, rows, x in _by_dims(part, 3):
                    index, take = indexes[d], pa.array(rows)
                    values, sketch = index.values(x), pa.array(index.sketch(x).view(np.int64))
                    short = (values ^ values >> 16 ^ values >> 32).astype(np.uint16)
                    node, one, two = (part.column(i).take(take) for i in range(3))
                    for t in range(index.tables):
                        met = pa.array([r.tobytes() for r in short[:, :t]], pa.binary())
                        yield pa.RecordBatch.from_arrays([one, two, pa.array(values[:, t] | t << PLACE), node, sketch, met], names=["one", "two", "key", "node", "sketch", "met"])

    return run


def _close(apart: int):
    """Rows of one bucket and pair of blocks to those that have a partner whose sketch is close, and whom they first meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 5):
            if t.num_rows < 2:
                continue
            second, sketch = t.column("second").to_numpy(), t.column("sketch").to_numpy().view(np.uint64)
            met = np.frombuffer(b"".join(t.column("met").to_pylist()), np.uint16).reshape(len(sketch), -1).T
            alive = np.zeros(len(sketch), bool)
            cross = int(t.column("i")[0].as_py()) != int(t.column("j")[0].as_py())
            for low in range(0, len(sketch), 512):
                near = np.bitwise_count(sketch[low : low + 512, None] ^ sketch[None, :]) <= apart
                if cross:
                    near &= second[low : low + 512, None] != second[None, :]
                else:
                    near[np.arange(len(near)), np.arange(low, low + len(near))] = False
                for earlier in met:
                    near &= earlier[low : low + 512, None] != earlier[None, :]
                alive[low : low + 512] = near.any(axis=1)
            if alive.any():
                kept = t.filter(pa.array(alive)).drop_columns(["sketch", "met"]).combine_chunks()
                yield from kept.to_batches()

    return run


def _compare(indexes: dict[int, Index], cosine: float):
    """Sorted bucket rows with vectors to (kind 0: node, links found) and (kind 1: tree link of two nodes)."""

    def bucket(t: int, cross: bool, node, second, weight, x, index: Index):
        values = index.values(x, t)
        if cross:
            order = np.argsort(second, kind="stable")
            split = int((~second).sum())
        else:  # vectors that met in the first table stand together and are passed over
            order = np.argsort(values[:, 0], kind="stable") if t else np.arange(len(node))
            split = 0
        node, weight, x, values = node[order], weight[order], x[order], values[order]
        ends = np.searchsorted(values[:, 0], values[:, 0], "right") if t and not cross else None
        count = np.zeros(len(node), np.int64)
        a_out, b_out = [], []
        for at in range(0, split if cross else len(node), 512):
            q = np.arange(at, min(at + 512, split if cross else len(node)))
            low = split if cross else int(ends[at]) if t else at + 1
            if low >= len(node):
                break
            hit = x[q] @ x[low:].T >= cosine
            if not cross:
                hit &= np.arange(low, len(node))[None, :] > q[:, None]
            i, j = np.nonzero(hit)
            i, j = q[i], j + low
            if t:
                fresh = (values[i] != values[j]).all(axis=1)
                i, j = i[fresh], j[fresh]
            if len(i):
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                u, v = forest(node[i], node[j])
                a_out.append(u)
                b_out.append(v)
        if not a_out:
            return None
        found = np.flatnonzero(count)
        return node[found], count[found], *forest(np.concatenate(a_out), np.concatenate(b_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 5):
            if rows.num_rows < 2:
                continue
            t, cross = int(rows.column("key")[0].as_py()) >> PLACE, rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            v = rows.column("v").combine_chunks()
            dims = len(v[0])
            node, second, weight = (rows.column(c).to_numpy() for c in ("node", "second", "weight"))
            found = bucket(t, cross, node, second, weight, unit(_matrix(v, dims)), indexes[dims])
            if found:
                ids, n, a, b = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[np.zeros(len(ids), np.int32), np.ones(len(a), np.int32)]), pa.array(np.r_[ids, a]), pa.array(np.r_[n, b])],
                    names=["kind", "a", "b"],
                )

    return run


def _names(vectors: DataFrame) -> tuple[Column, Column, Column]:
    """(usable vector or null, two hashes of label and length) of the rows of ``vectors``."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0) & F.col("label").isNotNull()
    label = F.col("label")
    if isinstance(vectors.schema["label"].dataType, (T.FloatType, T.DoubleType)):
        label = F.when(label == 0, 0.0).otherwise(label)  # 0.0 and -0.0 are equal
    return F.when(sound, v), F.xxhash64(label, F.size(v)), F.xxhash64(F.lit(1), label, F.size(v))


def find_links(nodes: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(kind, a, b) for nodes (node, one, two, v, weight): kind 0 tells of b links of a, kind 1 of a tree link.

    One row for each length of vectors goes to the driver, and the samples, one after the other.
    """
    sizes = nodes.groupBy("one", "two", F.size("v").alias("dims")).count().groupBy("dims").agg(F.max("count").alias("n")).where("n > 1").collect()
    indexes = {}
    for dims, n in sorted((r["dims"], r["n"]) for r in sizes):
        rows = max(256, min(sample, SAMPLE_BYTES // (8 * dims)))
        if n <= 2 * COMPANY:
            x, n = np.eye(1, dims), 1
        else:
            got = nodes.where(F.size("v") == dims).orderBy("h1", "h2").limit(rows).select("v").toPandas()["v"]
            x = unit(np.stack(got.to_numpy()).astype(np.float64))
        indexes[dims] = build(x, n, cosine)
    spark = nodes.sparkSession
    if not indexes:
        return spark.createDataFrame([], "kind int, a bigint, b bigint")
    met = nodes.where(F.size("v").isin(list(indexes)))
    key = ["one", "two", "key"]
    rows = cut(met.select("node", "one", "two", "v").mapInArrow(_encode(indexes), "one bigint, two bigint, key bigint, node bigint, sketch bigint, met binary"))
    full = rows.groupBy(*key).count().where("count > 1").select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(full, key).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", (F.col("mine") > F.col("other")).alias("second"), "sketch", "met")
    apart = max(i.apart for i in indexes.values())
    pair = [*key, "i", "j"]
    close = placed.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_close(apart), "one bigint, two bigint, key bigint, i int, j int, node bigint, second boolean")
    close = cut(close).join(nodes.select("node", "weight", "v"), "node").select(*pair, "node", "second", "weight", "v")
    return cut(close.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_compare(indexes, cosine), "kind int, a bigint, b bigint"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal, non-null labels and of equal length are compared; labels and ids may be of
    any type that can be ordered. A vector that is null, empty, zero, or holds null or non-finite
    components has no links. Rows are told apart by label and vector (by a hash of 128 bits), not by
    id: rows that repeat a vec_id are judged each by its own vector. A null vec_id counts as the
    greatest; component_id is null if no row of the component has an id, and such a row is kept.
    Equal rows get equal results; no rows give none; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v, one, two = _names(vectors)
    src = vectors.select(F.struct(F.col("vec_id").isNull().alias("last"), F.col("vec_id").alias("id")).alias("row"), v.alias("v"), one.alias("one"), two.alias("two"))
    named = [F.when(F.col("v").isNotNull(), F.xxhash64(*seed, "one", "two", "v")).alias(name) for seed, name in (((), "h1"), ((F.lit(1),), "h2"))]
    src = src.select("*", *named)
    nodes = src.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("one").alias("one"), F.first("two").alias("two"), F.min("row").alias("row"), F.count("*").alias("weight"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = find_links(nodes, cosine, sample)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    thin = nodes.select("node", "h1", "h2", "row", "weight")
    member = cut(components(found.where("kind = 1").select("a", "b")).join(thin.select("node", "row"), F.col("id") == F.col("node")).select("node", "component", "row"))
    tops = member.groupBy("component").agg(F.min("row").alias("top"))
    member = member.join(tops, "component").select("node", "top")
    known = thin.join(counts, "node", "left").join(member, "node", "left")
    known = known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("links"), F.coalesce("top", "row").alias("top"))
    out = src.select("row", "h1", "h2").join(known, ["h1", "h2"], "left")
    top = F.coalesce("top", "row")
    return out.select(F.col("row.id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), top["id"].alias("component_id"), F.col("row.id").eqNullSafe(top["id"]).alias("kept"))


def op9_itq_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def perturbed_copies(vectors: DataFrame) -> DataFrame:
    """Every vector, and a copy of it at a cosine of about 0.9988 under another id."""
    other = F.transform("embedding", lambda e, i: e.cast("double") * F.when(i % 2 == 0, 1.05).otherwise(0.95))
    pair = F.array(
        F.struct((F.col("vec_id") * 2).alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("embedding"), "label"),
        F.struct((F.col("vec_id") * 2 + 1).alias("vec_id"), other.alias("embedding"), "label"),
    )
    return vectors.select(F.explode(pair).alias("r")).select("r.*")


def embedding_dup_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a table in which every vector has a near copy."""
    return near_duplicates(perturbed_copies(table(spark, sf_dir, "embeddings")))


#: All pairs of a label by brute force, for vectors without nulls. Embeddings that are compared here
#: have finite components.
_SQL = r"""
WITH RECURSIVE v AS ({source}),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
c AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, coalesce(least(v.vec_id, m.b), v.vec_id) AS component_id, v.vec_id = coalesce(least(v.vec_id, m.b), v.vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""
OP9_SQL = _SQL.format(source="SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
COPIES_SQL = _SQL.format(
    source="""SELECT vec_id * 2 AS vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id * 2 + 1, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * CASE WHEN i % 2 = 1 THEN 1.05::DOUBLE ELSE 0.95::DOUBLE END) FROM embeddings"""
)
