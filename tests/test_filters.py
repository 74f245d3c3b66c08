"""Filters on typed tables and on schema-free documents must agree with a plain evaluator."""

import datetime as dt
import json
import operator
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.plans.filters import Fields, compile_filter, count, find, page

WELLS = [
    {"_id": f"w{i}", "title": t, "depth": d, "county": c, "use": u, "rock": r}
    for i, (t, d, c, u, r) in enumerate(
        [("Old Mill 3", 118, "Kerry", "closed", "chalk"), ("Brae", None, "Clare", "pumped", None), ("Dún Árann", 64, None, "pumped", "chalk"), ("Mill Race", 118, "Clare", "dry", "slate"), ("Nine Oaks", 7, "Kerry", None, "slate"), ("brae north", 250, "Clare", "pumped", "chalk"), ("Zinc 40", 41, None, None, None)]
    )
]


def typed(spark, rows, schema):
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema)


def free(spark, rows):
    return spark.createDataFrame([(r["_id"], json.dumps(r)) for r in rows], "_id string, j string").select("_id", F.parse_json("j").alias("doc"))


@pytest.fixture(scope="module")
def wells(spark):
    schema = "_id string, title string, depth int, county string, use string, rock string"
    return typed(spark, WELLS, schema).cache(), free(spark, WELLS).cache()


def plain(query, row):
    """A fresh evaluator of the semantics: missing is null, types never mix."""

    def get(path):
        v = row
        for p in path.split("."):
            v = v.get(p) if isinstance(v, dict) else None
        return v

    def kind(x):
        return "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else type(x).__name__

    def eq(a, b):
        return (a is None and b is None) or (a is not None and b is not None and kind(a) == kind(b) and a == b)

    def op(a, o, b):
        if o == "$eq":
            return eq(a, b)
        if o == "$ne":
            return not eq(a, b)
        if o in ("$gt", "$gte", "$lt", "$lte"):
            if a is None or b is None or kind(a) != kind(b) or isinstance(a, (list, dict)):
                return False
            return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[o]
        if o == "$in":
            return any(eq(a, x) for x in b)
        if o == "$nin":
            return not any(eq(a, x) for x in b)
        if o == "$regex":
            return a is not None and re.search(b, str(a)) is not None
        if o == "$exists":
            return (a is not None) == bool(b)
        if o == "$not":
            return not all(op(a, k, v) for k, v in b.items())
        raise ValueError(o)

    out = True
    for k, v in query.items():
        if k == "$and":
            out &= all(plain(q, row) for q in v)
        elif k == "$or":
            out &= any(plain(q, row) for q in v)
        elif k == "$nor":
            out &= not any(plain(q, row) for q in v)
        elif isinstance(v, dict):
            out &= all(op(get(k), o, b) for o, b in v.items())
        else:
            out &= eq(get(k), v)
    return out


CASES = [
    {},
    {"county": "Clare"},
    {"county": "Clare", "use": "pumped", "rock": "chalk"},
    {"depth": {"$gt": 64}},
    {"depth": {"$gte": 41, "$lte": 118}},
    {"depth": {"$lt": 64}},
    {"county": None},
    {"county": {"$ne": "Kerry"}},
    {"county": {"$ne": None}},
    {"county": {"$in": ["Kerry", None]}},
    {"county": {"$nin": ["Kerry"]}},
    {"county": {"$nin": ["Kerry", None]}},
    {"county": {"$in": []}},
    {"title": {"$regex": "^[A-N]"}},
    {"title": {"$regex": r"(?P<w>\w)\w* \w+$"}},
    {"title": {"$regex": r"^\w+ Árann$"}},
    {"depth": {"$regex": "^1"}},
    {"county": {"$exists": True}},
    {"county": {"$exists": 0}},
    {"nothing": {"$exists": False}},
    {"nothing": 1},
    {"nothing": None},
    {"title.first": None},
    {"depth": "118"},
    {"depth": {"$gt": "5"}},
    {"depth": True},
    {"depth": 118.0},
    {"$or": [{"depth": 7}, {"county": "Clare"}]},
    {"$and": [{"depth": {"$gt": 20}}, {"$nor": [{"rock": "slate"}, {"use": "dry"}]}]},
    {"depth": {"$not": {"$gte": 118}}},
    {"depth": {}},
    {"depth": {"$in": [7, 64.0, "41", None, True]}},
]


@pytest.mark.parametrize("query", CASES, ids=[json.dumps(c)[:60] for c in CASES])
def test_cases(wells, query):
    want = [r["_id"] for r in WELLS if plain(query, r)]
    for df in wells:
        assert sorted(r._id for r in find(df, query).select("_id").collect()) == want


def test_random_filters_agree(spark):
    rng = random.Random(4)
    values = [None, 0, 1, 2.5, -3, "", "a", "b1", True, False]
    rows = [{"_id": str(i), "n": rng.choice([None, 0, 1, 2, 5]), "s": rng.choice([None, "a", "b1", "ü"]), "b": rng.choice([None, True, False]), "o": {"x": rng.choice([None, 1, 2]), "y": rng.choice(["a", None])}} for i in range(40)]
    wide = spark.createDataFrame([(r["_id"], r["n"], r["s"], r["b"], (r["o"]["x"], r["o"]["y"])) for r in rows], "_id string, n int, s string, b boolean, o struct<x:int,y:string>")
    loose = free(spark, rows)
    queries = []
    for _ in range(40):
        path = rng.choice(["n", "s", "b", "o.x", "o.y", "q", "s.t"])
        op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not"])
        arg = [rng.choice(values) for _ in range(3)] if op in ("$in", "$nin") else rng.random() < 0.5 if op == "$exists" else {"$in": [rng.choice(values)]} if op == "$not" else rng.choice(values)
        queries.append({path: {op: arg}})
    for df in (wide, loose):
        fields = Fields(df)
        got = df.select("_id", *[compile_filter(q, fields).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
        by = {r["_id"]: r for r in rows}
        for r in got:
            for i, q in enumerate(queries):
                assert r[f"q{i}"] == plain(q, by[r._id]), (q, by[r._id])


def test_errors(wells):
    fields = Fields(wells[0])
    for bad in ({"a": {"$what": 1}}, {"$what": []}, {"a": {"$gt": 1, "b": 2}}, {"$or": []}, {"a": {"$in": 3}}):
        with pytest.raises(ValueError):
            compile_filter(bad, fields)
    assert find(wells[0], {"depth": {"$what": 1}}, lenient=True).count() == len(WELLS)
    with pytest.raises(TypeError):
        compile_filter({"depth": {"$gt": "5"}}, fields, strict=True)


def test_arrays_and_structs(spark):
    rows = [{"_id": "1", "tags": ["a", "b"], "v": {"name": "x", "ok": True}}, {"_id": "2", "tags": ["b"], "v": {"name": "y", "ok": False}}, {"_id": "3"}]
    t = spark.createDataFrame([("1", ["a", "b"], ("x", True)), ("2", ["b"], ("y", False)), ("3", None, None)], "_id string, tags array<string>, v struct<name:string,ok:boolean>")
    for df in (t, free(spark, rows)):
        for q, want in [
            ({"tags": {"$in": ["a"]}}, []),
            ({"tags": {"$in": [["b"], "a"]}}, ["2"]),
            ({"tags": ["a", "b"]}, ["1"]),
            ({"tags": {"$contains": "b"}}, ["1", "2"]),
            ({"tags": {"$all": ["a", "b"]}}, ["1"]),
            ({"tags": {"$overlaps": ["a", "z"]}}, ["1"]),
            ({"tags": {"$size": 1}}, ["2"]),
            ({"tags": {"$elemMatch": {"$regex": "^a"}}}, ["1"]),
            ({"v.ok": True}, ["1"]),
            ({"v": {"name": "y", "ok": False}}, ["2"]),
            ({"v": {"name": "y"}}, []),
            ({"v.name": {"$type": "string"}}, ["1", "2"]),
            ({"tags": {"$type": "array"}}, ["1", "2"]),
        ]:
            assert sorted(r._id for r in find(df, q).collect()) == want, q


def test_limits_and_pages(wells):
    for df in wells:
        assert [r._id for r in find(df, None, 2).collect()] == ["w0", "w1"]
        assert find(df, None, 0).count() == 0
        with pytest.raises(ValueError):
            find(df, None, -1)
        assert [r._id for r in find(df, {"depth": {"$exists": True}}, 3, 1, [("depth", -1)]).collect()] == ["w0", "w3", "w2"]
        assert [r._id for r in find(df, None, 3, 0, [("depth", 1)]).collect()] == ["w1", "w4", "w6"]
        p = page(df, {"county": "Clare"}, 0, 2)
        assert p["total"] == 3 and p["has_more"] and p["rows"].count() == 2
        assert count(df, {"county": "Clare"}) == 3


TIMES = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.5", "2024-01-01 12:00:00", "2024-01-02 00:00:00", None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times(spark, tmp_path, kind):
    """Operands are times, dates or ISO text; the column stays bare, so scans can skip by it."""
    rows = [(i, t[:10] if t and kind == "date" else t) for i, t in enumerate(TIMES)]
    spark.createDataFrame(rows, "_id int, s string").selectExpr("_id", f"cast(s AS {kind}) AS t").write.parquet(str(tmp_path / kind))
    df = spark.read.parquet(str(tmp_path / kind))
    have = {i: dt.datetime.fromisoformat(t) for i, t in rows if t}
    compare = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le, "$eq": operator.eq}
    for text in ("2024-01-01", "2024-01-01T00:00:00", "2024-01-01T00:00:00.500", "2024-01-01 12:00:00", "2024-01-02"):
        at = dt.datetime.fromisoformat(text)
        for op, holds in compare.items():
            want = sorted(i for i, t in have.items() if holds(t, at))
            for operand in (text, at, at.date()) if at.time() == dt.time() else (text, at):
                assert sorted(r._id for r in find(df, {"t": {op: operand}}).collect()) == want, (op, operand)
    assert sorted(r._id for r in find(df, {"t": {"$in": ["2024-01-01", None]}}).collect()) == sorted({i for i, t in have.items() if t == dt.datetime(2024, 1, 1)} | {4})
    assert find(df, {"t": {"$gt": "no time"}}).count() == 0
    plan = find(df, {"t": {"$gte": "2024-01-01T12:00:00"}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan.split("PushedFilters")[1]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id AS _id", "cast(id AS string) AS s", "id * 2 AS n").write.parquet(str(tmp_path / "t"))
    df = find(spark.read.parquet(str(tmp_path / "t")), {"n": {"$gte": 50}, "s": {"$in": ["30", "40"]}}).select("n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,50)" in plan and "In(s" in plan and "_id" not in plan.split("ReadSchema")[1]
    assert df.count() == 2
