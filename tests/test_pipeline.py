"""Aggregation pipelines on typed and schema-free rows."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.plans.pipeline import aggregate, distinct, intersect, subtract

BOATS = [
    ("b1", "Wren", "sail", 9, 2, "Cork"),
    ("b2", "Kite", "sail", 14, 5, "Bray"),
    ("b3", "Ox", "tug", 31, 8, "Cork"),
    ("b4", "Mole", "tug", 22, 4, None),
    ("b5", "Teal", "ferry", 60, 21, "Cork"),
    ("b6", "Coot", "ferry", 45, 12, "Bray"),
    ("b7", "Rook", "sail", 9, 3, "Cork"),
]
FIELDS = ["_id", "name", "kind", "length", "crew", "port"]


@pytest.fixture(scope="module")
def boats(spark):
    typed = spark.createDataFrame(BOATS, "_id string, name string, kind string, length int, crew int, port string")
    loose = spark.createDataFrame([(r[0], json.dumps(dict(zip(FIELDS, r, strict=True)))) for r in BOATS], "_id string, j string").select("_id", F.parse_json("j").alias("doc"))
    return typed.cache(), loose.cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group(boats):
    for df in boats:
        out = aggregate(df, [{"$group": {"_id": "$port", "n": {"$sum": 1}, "p": {"$avg": "$length"}, "f": {"$first": "$name"}, "l": {"$last": "$name"}, "all": {"$push": "$name"}, "k": {"$addToSet": "$kind"}, "d": {"$countDistinct": "$kind"}, "big": {"$countIf": {"length": {"$gt": 20}}}}}, {"$sort": {"n": -1, "_id": 1}}])
        got = {r._id: r for r in out.collect()}
        for port in ("Cork", "Bray", None):
            own = [r for r in BOATS if r[5] == port]
            r = got[port]
            assert (r.n, r.p, r.f, r.l, r["all"]) == (len(own), sum(x[3] for x in own) / len(own), own[0][1], own[-1][1], [x[1] for x in own])
            assert r.k == sorted({x[2] for x in own}) and r.d == len(r.k) and r.big == sum(x[3] > 20 for x in own)
        assert [r._id for r in out.collect()] == ["Cork", "Bray", None]


def test_first_and_last_after_a_sort(boats):
    for df in boats:
        out = aggregate(df, [{"$sort": {"length": 1}}, {"$group": {"_id": "$port", "f": {"$first": "$name"}, "l": {"$last": "$name"}, "all": {"$push": "$name"}}}])
        got = {r._id: r for r in out.collect()}
        assert (got["Cork"].f, got["Cork"].l, got["Cork"]["all"]) == ("Wren", "Teal", ["Wren", "Rook", "Ox", "Teal"])
        out = aggregate(df, [{"$sort": {"name": 1}}, {"$match": {"kind": "sail"}}, {"$group": {"_id": "$port", "f": {"$first": "$_id"}}}])
        assert {r._id: r.f for r in out.collect()} == {"Cork": "b7", "Bray": "b2"}
    out = aggregate(boats[0], [{"$sort": {"length": -1, "name": 1}}, {"$group": {"_id": None, "all": {"$push": "$name"}}}])
    assert out.first()["all"] == ["Teal", "Coot", "Ox", "Mole", "Kite", "Rook", "Wren"]
    with pytest.raises(ValueError):
        aggregate(boats[0], [{"$sort": {"name": -1}}, {"$group": {"_id": None, "f": {"$first": "$name"}}}])


def test_group_globally_and_min_max(boats):
    for df in boats:
        r = aggregate(df, [{"$group": {"_id": None, "n": {"$count": {}}, "s": {"$sum": "$length"}, "twice": {"$sum": 2}, "lo": {"$min": "$length"}, "hi": {"$max": "$length"}}}]).first()
        lengths = [x[3] for x in BOATS]
        assert (r.n, int(r.s), r.twice, float(r.lo), float(r.hi)) == (7, sum(lengths), 14, min(lengths), max(lengths))


def test_missing_group_key(spark):
    df = spark.createDataFrame([("1", None), ("2", "a"), ("3", None)], "_id string, k string")
    assert dict(rows(aggregate(df, [{"$group": {"_id": "$k", "n": {"$sum": 1}}}]))) == {None: 2, "a": 1}


def test_sort_orders(boats):
    for df in boats:
        stages = [{"$sort": {"kind": 1, "length": -1}}]
        assert [r._id for r in aggregate(df, stages).collect()] == ["b5", "b6", "b2", "b1", "b7", "b3", "b4"]
        assert [r._id for r in aggregate(df, stages, legacy_sort=True).collect()] == ["b5", "b6", "b3", "b4", "b2", "b1", "b7"]


def test_project_limit_skip_count(boats):
    for df in boats:
        out = aggregate(df, [{"$sort": {"_id": 1}}, {"$skip": 1}, {"$limit": 2}, {"$project": {"name": 1, "length": 0, "a.b": 1}}])
        assert out.columns == ["name", "a.b"]
        assert [str(r[0]).strip('"') for r in out.select(F.col("name").cast("string")).collect()] == ["Kite", "Ox"]
        assert aggregate(df, [{"$match": {"port": "Cork"}}, {"$count": "n"}]).first().n == 4
    for bad in ({"$limit": -1}, {"$group": {"_id": "$port", "x": {"$median": "$length"}}}, {"$what": 1}, {"$project": {"a.b": 0}}):
        with pytest.raises(ValueError):
            aggregate(boats[0], [bad])


def test_project_leaves_out(boats):
    typed, loose = (aggregate(df, [{"$project": {"name": 0, "crew": False, "nothing": 0}}]) for df in boats)
    assert typed.columns == ["_id", "kind", "length", "port"]
    left = {r._id: json.loads(r.j) for r in loose.select("_id", F.to_json("doc").alias("j")).collect()}
    assert set(left["b1"]) == {"_id", "kind", "length", "port"} and left["b3"]["length"] == 31


def test_set_stages(spark, boats):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("x", 1), ("q", 9)], "v string, k int")
    run = lambda stage: sorted(map(str, rows(aggregate(a, [{stage: "b"}], tables={"b": b}))))
    assert run("$intersectWith") == sorted(map(str, [(1, "x"), (2, None)])) and run("$exceptWith") == [str((3, "z"))]
    assert intersect(a, b, all=True).count() == 3 and subtract(a, b, all=True).count() == 2
    arrays = spark.createDataFrame([("1", ["a", "b"], ["b", "c"])], "_id string, x array<string>, y array<string>")
    assert aggregate(arrays, [{"$addFields": {"z": {"$setUnion": ["$x", "$y"]}, "k": 5, "w": "$x"}}]).first()[3:] == (["a", "b", "c"], 5, ["a", "b"])
    loose = spark.createDataFrame([('{"x": ["a", 1], "y": [1, {"q": 2}]}',)], "j string").select(F.lit("1").alias("_id"), F.parse_json("j").alias("doc"))
    assert aggregate(loose, [{"$addFields": {"z": {"$setUnion": ["$x", "$y"]}}}]).first().z == ['"a"', "1", '{"q":2}']


def test_extensions(spark, boats):
    df = spark.createDataFrame([("1", ["a", "b"]), ("2", [])], "_id string, t array<string>")
    assert aggregate(df, [{"$unwind": "$t"}]).count() == 2
    assert aggregate(df, [{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}]).count() == 3
    names = spark.createDataFrame([("Cork", "C"), ("Bray", "B")], "r string, short string")
    out = aggregate(boats[0], [{"$lookup": {"from": "names", "localField": "port", "foreignField": "r", "as": "x"}}], tables={"names": names})
    assert {r._id: len(r.x) for r in out.collect()} == {r[0]: int(r[5] is not None) for r in BOATS}
    assert sorted(r.value for r in distinct(boats[1], "port").collect()) == ["Bray", "Cork"]
