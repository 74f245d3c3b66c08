"""Vector search, full-text search and column functions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars
from docloom.operators import fulltext, vector

RAYS = [(f"r{k}", [round(math.cos(k / 2), 3), round(math.sin(k / 2), 3), round(k / 9, 3)]) for k in range(6)] + [("short", [3.0]), ("none", None), ("hole", [1.0, None, 2.0])]
ASKED = [0.7, 0.6, 0.1]


def right():
    return {i: np.array(v, np.float32).astype(float) for i, v in RAYS if v and len(v) == 3 and None not in v}


def by_cosine():
    q = np.array(ASKED)
    return sorted(right(), key=lambda i: (-(right()[i] @ q) / np.linalg.norm(right()[i]), i))


@pytest.fixture(scope="module")
def rays(spark):
    return spark.createDataFrame([(i, v, "even" if i[-1] in "024" else "odd") for i, v in RAYS], "_id string, vector array<float>, parity string").repartition(3).cache()


def test_order_and_k(rays):
    best = vector.knn(rays, ASKED, 3).collect()
    assert [r._id for r in best] == by_cosine()[:3]
    assert all(a.similarity >= b.similarity for a, b in zip(best, best[1:], strict=False))
    assert vector.knn(rays, ASKED, 100).count() == 6 and vector.knn(rays, ASKED, 0).count() == 0
    assert vector.knn(rays, ASKED, 1).columns == ["_id", "parity", "similarity"]


def test_ties_and_many_rows(spark):
    """Equal vectors tie, in order of id, wherever they stand; scores are those of the expressions."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((50, 12))
    rows = [(int(i), base[i % 50].tolist()) for i in rng.permutation(9000)]
    df = spark.createDataFrame(rows, "_id bigint, vector array<double>").repartition(5)
    q = rng.standard_normal(12)
    for metric in vector.METRICS:
        got = vector.knn(df, q.tolist(), 400, metric).collect()
        s = vector.exact(base, np.broadcast_to(q, base.shape), metric)
        want = sorted(range(9000), key=lambda i: (-s[i % 50], i))[:400]
        assert [r._id for r in got] == want
        c = vector.similarity(F.col("vector"), F.array(*[F.lit(float(x)) for x in q]), metric)
        assert {r._id: r.s for r in df.where("_id < 20").select("_id", c.alias("s")).collect()} == pytest.approx({i: float(s[i % 50]) for i in range(20)})


def test_metrics(rays):
    q = np.array(ASKED)
    x = right()
    want = {
        "cosine": {i: v @ q / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-10) for i, v in x.items()},
        "l2": {i: 1 / (1 + ((v - q) ** 2).sum()) for i, v in x.items()},
        "ip": {i: v @ q for i, v in x.items()},
    }
    for metric, by in want.items():
        got = {r._id: r.similarity for r in vector.knn(rays, q.tolist(), 10, metric).collect()}
        assert got == pytest.approx(by)


def test_filters(rays):
    q, order = ASKED, by_cosine()
    assert [r._id for r in vector.knn(rays, q, 3, filter={"parity": "even"}).collect()] == [i for i in order[:3] if i in ("r0", "r2", "r4")]
    assert [r._id for r in vector.knn(rays, q, 2, filter={"parity": "even"}, filter_mode="pre").collect()] == [i for i in order if i in ("r0", "r2", "r4")][:2]
    for bad in ({"dims": 5}, {"metric": "x"}, {"filter": {"a": 1}, "filter_mode": "x"}):
        with pytest.raises(ValueError):
            vector.knn(rays, q, 2, **bad)


def test_batch_and_checks(spark, rays):
    queries = spark.createDataFrame([(1, ASKED), (2, [9.0]), (3, [1.0, 1.0])], "query_id int, query_vector array<float>")
    got = vector.knn_batch(rays, queries, 2).collect()
    assert {(r.query_id, r.rank, r._id) for r in got} == {(1, 1, by_cosine()[0]), (1, 2, by_cosine()[1]), (2, 1, "short")}
    assert vector.knn_batch(rays, queries.where("query_id > 2"), 2).count() == 0 and vector.knn_batch(rays, queries.where("false"), 2).count() == 0
    good, bad = vector.split_by_dims(rays, 3)
    assert good.count() == 7 and sorted(r.error for r in bad.collect()) == ["expected 3 dimensions, got 0", "expected 3 dimensions, got 1"]
    assert vector.stats(rays).first().asDict() == {"n": 8, "dims": 3, "least_dims": 1}


def test_batch_in_blocks(spark, monkeypatch):
    """More queries than one broadcast takes give the same rows as one by one."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "_id bigint, vector array<double>")
    queries = df.where("_id % 50 = 0").selectExpr("_id AS query_id", "vector AS query_vector")
    want = {(r.query_id, r.rank, r._id) for r in vector.knn_batch(df, queries, 4).collect()}
    monkeypatch.setattr(vector, "MOST_QUERY_BYTES", 2 * 6 * 8)
    got = [(r.query_id, r.rank, r._id) for r in vector.knn_batch(df, queries, 4).collect()]
    assert len(got) == 24 and set(got) == want
    assert {(q, 1, q) for q in range(0, 300, 50)} <= set(got)


def test_tfidf(spark, tmp_path):
    docs = {"1": "Copper kettle in the harbour", "2": "brass lamp and copper kettle, kettle", "3": "the anchor of a harbour-master", "4": "", "5": None, "6": "kettledrum"}
    df = spark.createDataFrame(list(docs.items()), "_id string, text string")
    words = {"1": ["copper", "kettle", "harbour"], "2": ["brass", "lamp", "copper", "kettle", "kettle"], "3": ["anchor", "harbour", "master"], "6": ["kettledrum"]}
    asked = ["kettle", "harbour", "kettle", "copper"]
    known = {t: sum(t in w for w in words.values()) for t in asked}
    want = {i: sum(w.count(t) / len(w) * math.log(len(docs) / known[t]) for t in asked) for i, w in words.items() if set(w) & set(asked)}
    index = fulltext.build(df, str(tmp_path / "index"))
    for found, none, other in ((fulltext.search(df, "Kettle harbour kettle, copper"), fulltext.search(df, "the of"), fulltext.search(df, "nothing")), (index.search("Kettle harbour kettle, copper").withColumnRenamed("id", "_id"), index.search("the of"), index.search("nothing"))):
        assert {r._id: r.score for r in found.collect()} == pytest.approx(want)
        assert [r._id for r in found.collect()] == sorted(want, key=lambda i: (-want[i], i))
        assert none.count() == 0 and other.count() == 0
    plan = index.search("anchor")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(token,anchor)" in plan
    assert fulltext.top_tokens(df, 1).first().token == "kettle"
    assert {(r._id, r.token, r.n) for r in fulltext.frequencies(df).collect()} >= {("2", "kettle", 2)}


def test_texts_are_taken_apart_once(spark, tmp_path):
    spark.createDataFrame([("1", "alpha beta"), ("2", "beta")], "_id string, text string").write.parquet(str(tmp_path / "t"))
    found = fulltext.search(spark.read.parquet(str(tmp_path / "t")), "alpha beta gamma", None)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Counted in their rows and sent once, one folder a task; repeated and null ids are added up."""
    text = "copper lamp copper anchor the copper lamp"
    df = spark.createDataFrame([(1, text), (2, "lamp"), (3, None), (4, ""), (5, "the of")], "_id int, text string")
    plan = fulltext._counted(df, "text", "_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    got = {(r.token, r.id): (r.n, r.length) for r in fulltext.build(df, str(tmp_path / "a")).postings().collect()}
    want = {("copper", 1): (3, 6), ("lamp", 1): (2, 6), ("anchor", 1): (1, 6), ("lamp", 2): (1, 1)}
    assert got == want and all(len(list(b.glob("*.parquet"))) == 1 for b in (tmp_path / "a" / "postings").glob("bucket=*"))
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "lamp brass"), (None, "brass lamp"), (2, "lamp lamp")], "_id int, text string"))
    monkeypatch.setattr(fulltext, "TASK_TEXT", 30)
    index = fulltext.build(twice, str(tmp_path / "b"))
    rows = [(r.token, r.id, r.n, r.length) for r in index.postings().collect()]
    assert len(rows) == len(set(rows)) and index.documents() == 13
    assert set(rows) == {(t, i, 2 * n, k) for (t, i), (n, k) in want.items()} | {("lamp", 2, 2, 2), ("lamp", None, 2, 2), ("brass", None, 2, 2)}


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.tokens(F.lit("The Zürich-Bern db, is_ok 42")).alias("t"),
        scalars.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
        scalars.normalise(F.array(F.lit(0.0))).alias("z"),
        scalars.half_even(F.lit(2.5), 0).alias("h"),
        F.size(scalars.letter_embedding(F.lit("abc"))).alias("e"),
        scalars.decrypt(scalars.encrypt(F.lit("x"), bytes(32)), bytes(32)).alias("c"),
    ).first()
    assert scalars.derive_key("word", b"salt", 1000) == hashlib.pbkdf2_hmac("sha256", b"word", b"salt", 1000, 32)
    both = spark.sql("SELECT array(1, 2, 2) AS a, array(2, 3) AS b, CAST(NULL AS array<int>) AS n").select(scalars.array_union(F.col("a"), F.col("b")).alias("x"), scalars.array_union(F.col("a"), F.col("n")).alias("y")).first()
    assert both.x == [1, 2, 3] and both.y == [1, 2]
    assert r.t == ["zürich", "bern", "is_ok"] and r.n == [0.6, 0.8] and r.z == [0.0] and r.h == 2 and r.e == 128 and r.c == "x"
