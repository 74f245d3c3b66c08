"""The inverted file against the exact search."""

import numpy as np
import pytest

from docloom.operators import ivf, vector


def test_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.3 * rng.standard_normal((1500, 16))
    rows = [(f"{i:05d}", [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "_id string, vector array<float>, k int")
    index = ivf.build(df, str(tmp_path / "ivf"), lists=16)
    hits = 0
    for q in x[:20]:
        q = [float(v) for v in q]
        want = {r._id for r in vector.knn(df, q, 10).collect()}
        found = index.search(spark, q, 10)
        hits += len(want & {r._id for r in found.collect()})
    assert hits >= 0.9 * 200 and index.probes < 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan or "PartitionFilters: [isnotnull(_list" in plan or "_list#" in plan.split("PartitionFilters")[1]
    full = index.search(spark, [float(v) for v in x[0]], 5, probes=16).collect()
    assert [r._id for r in full] == [r._id for r in vector.knn(df, [float(v) for v in x[0]], 5).collect()]
    with pytest.raises(ValueError):
        ivf.build(df.where("_id = 'none'"), str(tmp_path / "x"))


def test_batch_with_default_probes(spark, tmp_path):
    """Vectors without clusters, and some of another length."""
    x = np.random.default_rng(1).standard_normal((3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [1.0, float(i)]) for i in range(9)], "_id bigint, vector array<double>").repartition(4)
    index = ivf.Index.from_json(str(tmp_path / "ivf"), ivf.build(df, str(tmp_path / "ivf"), lists=24).to_json())
    queries = df.where("_id % 50 = 0").selectExpr("_id AS query_id", "vector AS query_vector")
    got = {(r.query_id, r._id) for r in index.search_batch(spark, queries, 10).collect()}
    want = {(r.query_id, r._id) for r in vector.knn_batch(df, queries.where("query_id < 5000"), 10).collect()}
    assert len(want) == 600 and len(got) == 600 and len(got & want) >= 0.9 * 600
    assert [r._id for r in index.search(spark, [1.0, 8.0], 2).collect()] == [5008, 5007]
