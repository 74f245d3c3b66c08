"""Collections over a commit log, change streams, the text form, access helpers."""

import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import access
from docloom.operators.latest import latest_per_key
from docloom.sources import toon
from docloom.sources.collections import Store, documents, ingest_json
from docloom.sources.toon_files import read_toon, register, write_toon
from docloom.streaming import changes


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_documents(store):
    c = store.create_database("shop").create_collection("users")
    c.insert_many([{"_id": "a", "name": "Ann", "n": 1}, {"_id": "b", "name": "Bob", "n": {"x": [1, 2]}}])
    new = c.insert({"name": "Cy"})
    assert len(new) == 16 and c.count() == 3
    assert c.find_by_id("b")["n"] == {"x": [1, 2]} and c.find_by_id("zz") is None
    before = c.find_by_id("a")
    assert c.update("a", {"n": 5, "status": "active"}) and not c.update("zz", {"n": 1})
    after = c.find_by_id("a")
    assert (after["name"], after["n"], after["status"]) == ("Ann", 5, "active")
    assert after["_created_at"] == before["_created_at"] and after["_updated_at"] >= before["_updated_at"]
    with pytest.raises(ValueError):
        c.update("a", {"x.y": 1})
    assert c.update_many({"name": {"$in": ["Bob", "Cy"]}}, {"old": True}) == 2
    assert c.delete("b") and c.count() == 2 and c.find_one({"name": "Bob"}) is None
    assert [d["_id"] for d in documents(c.find({"old": True}))] == [new]
    c.insert({"_id": "b", "name": "Back"})
    assert c.find_by_id("b")["name"] == "Back"
    c.compact()
    assert c.count() == 3 and c.find_by_id("a")["n"] == 5
    assert c.update("a", {"n": 6}) and c.find_by_id("a")["n"] == 6
    assert [r._id for r in c.scan("a", 2).collect()] == sorted(x for x in ("a", "b", new) if x >= "a")[:2]
    assert c.delete_many({}) == 3 and c.count() == 0


def test_catalog(store):
    a, b = store.create_database("one"), store.create_database("two")
    for db in (a, b):
        db.create_collection("t")
    a.collection("t").insert({"x": 1})
    assert store.databases() == ["default", "one", "two"] and a.collections() == ["t"]
    assert a.collection("t").count() == 1 and b.collection("t").count() == 0
    assert a.stats() == {"database": "one", "collections": 1, "documents": 1}
    assert store.stats()["documents"] == 1 and store.stats()["bytes"] > 0
    c = a.collection("t")
    c.create_index("x")
    assert c.indexes() == ["x"] and c.explain({"x": 1})["strategy"] == "scan"
    c.compact()
    plan = c.explain({"x": {"$gte": 1}})
    assert (plan["strategy"], plan["index_field"], plan["exchanges"]) == ("pruned scan", "x", []) and plan["estimated_bytes"] > 0
    assert c.explain({"_id": "q"})["index_field"] == "_id" and c.explain({"y": 1})["index_field"] is None
    c.drop_index("x")
    assert c.indexes() == []
    assert a.drop_collection("t") and a.collections() == []
    assert store.drop_database("two") and "two" not in store.databases()
    for bad in ("default", "../x"):
        with pytest.raises(ValueError):
            store.drop_database(bad)


def test_vectors(store, spark):
    c = store.create_database("v").create_collection("items", dims=2)
    rows = spark.createDataFrame([("1", [1.0, 0.0], "A"), ("2", [0.0, 1.0], "B"), ("3", [1.0], "A")], "_id string, vector array<double>, category string")
    out = c.insert_vectors(rows)
    assert out["successful"] == 2 and out["failed"].count() == 1
    assert [r._id for r in c.search([1.0, 0.1], 1).collect()] == ["1"]
    assert [r._id for r in c.search([1.0, 0.1], 2, filter={"category": "B"}).collect()] == ["2"]
    with pytest.raises(ValueError):
        c.search([1.0], 1)
    with pytest.raises(ValueError):
        c.insert_many([{"vector": [1.0]}])
    c.delete("1")
    assert [r._id for r in c.search([1.0, 0.1], 2).collect()] == ["2"]
    assert store.database("v").vector_stats().first().asDict() == {"collection": "items", "n": 1, "dims": 2}


def test_text_and_pipeline(store):
    c = store.create_database("d").create_collection("t")
    c.insert_many([{"_id": "1", "body": "red fox runs", "k": "a"}, {"_id": "2", "body": "blue fox", "k": "b"}, {"_id": "3", "body": "tree", "k": "a"}])
    assert [r._id for r in c.search_text("body", "red fox").collect()] == ["1", "2"]
    assert {r._id: r.n for r in c.aggregate([{"$group": {"_id": "$k", "n": {"$sum": 1}}}]).collect()} == {"a": 2, "b": 1}


def test_text_form_of_a_collection(store):
    c = store.create_database("x").create_collection("t")
    c.insert_many([{"_id": "1", "a": "p,q", "n": None}, {"_id": "2", "a": [1, {"b": 2}]}])
    text, sizes = c.export_text()
    assert sizes["toon_size"] == len(text) and "collection: t" in text
    d = store.create_database("y").create_collection("t")
    d.insert({"_id": "old"})
    assert d.import_text(text, replace=True) == 2 and d.count() == 2
    assert d.find_by_id("2")["a"] == [1, {"b": 2}] and d.find_by_id("1")["a"] == "p,q"
    assert d.query_text({"a": "p,q"})[0].count("p,q") == 1


def test_command_line(spark, store, tmp_path):
    from docloom.__main__ import main

    c = store.create_database("x").create_collection("t")
    c.insert_many([{"_id": "1", "a": "p,q"}, {"_id": "2", "b": {"c": [1]}}])
    root = str(tmp_path / "store")
    main(["export", root, "x", "t", str(tmp_path / "out")])
    main(["import", root, "y", "u", str(tmp_path / "out")])
    d = store.database("y").collection("u")
    assert d.count() == 2 and d.find_by_id("1")["a"] == "p,q" and d.find_by_id("2")["b"] == {"c": [1]}
    main(["import", root, "y", "u", str(tmp_path / "out"), "--replace"])
    assert d.count() == 2


def test_change_stream(store, spark, tmp_path):
    c = store.create_database("s").create_collection("t")
    c.insert_many([{"_id": "1", "n": 1}, {"_id": "2", "n": 2}])
    c.update("1", {"n": 9})
    seen = []
    go = lambda: changes.subscribe(changes.watch(c, ["insert", "update"], {"n": {"$gte": 2}}), lambda b, _: seen.extend((r.operationType, r.documentKey._id) for r in b.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    assert sorted(seen) == [("insert", "2"), ("update", "1")]
    c.insert({"_id": "3", "n": 3})
    c.delete("2")
    seen.clear()
    go()  # goes on where it stopped
    assert seen == [("insert", "3")]
    for every, folder in ((50, "a"), (2, "b")):
        path = str(tmp_path / folder)
        keep = lambda: changes.keep_state(spark, changes.watch(c, per_trigger=1), path, f"{path}-cp", once=True, merge_every=every).awaitTermination()  # noqa: B023, E731
        keep()
        c.insert({"_id": "4" + folder, "n": 4})
        c.update("1", {"n": 10})
        keep()
        want = {r._id: r.j for r in c.frame().select("_id", F.to_json("doc").alias("j")).collect()}
        assert {r._id: r.json for r in changes.state(spark, path).where("op <> 'delete'").collect()} == want and set(want) >= {"1", "3"}
    assert len(list((tmp_path / "b" / "base").iterdir())) >= 1
    with pytest.raises(ValueError):
        changes.watch(c, ["replace"])


def test_commits_of_small_files_are_packed(store, spark):
    """A stream of one file a batch has a batch a commit, however many partitions the rows had."""
    c = store.create_database("s").create_collection("packed")
    c.insert_many(spark.range(100).selectExpr("cast(id AS string) AS _id", "id AS n").repartition(9))
    c.update_many({"n": {"$gte": 50}}, {"n": -1})
    c.delete_many({"n": {"$lt": 10, "$gte": 0}})
    assert [len(c.files.sizes(f"{c.log_path}/_seq={s:012d}")) for s in c._commits()] == [1, 1, 1]
    assert c.count() == 90 and c.count({"n": -1}) == 50


def test_kept_state_is_rewritten_in_runs(store, spark, tmp_path):
    """Of 13 batches, bases hold the first 2, 4 and 8 only; later ones stand in runs; deletions hold across them."""
    c = store.create_database("s").create_collection("runs")
    path = str(tmp_path / "changes" / "state")
    keep = lambda: changes.keep_state(spark, changes.watch(c, per_trigger=1), path, f"{path}-cp", once=True, merge_every=2).awaitTermination()
    for i in range(11):
        c.insert({"_id": str(i), "n": i})
        if i == 7:
            keep()
    c.delete("2")
    c.update("9", {"n": 0})
    keep()
    c.insert({"_id": "2", "n": 22})
    assert {(r._id, r.json) for r in changes.state(spark, path).where("op <> 'delete'").collect()} == {(str(i), f'{{"n":{i % 9}}}') for i in range(11) if i not in (2, 10)} | {("10", '{"n":10}')}
    assert [(p.first, p.last, p.kind) for p in changes._parts(c.files, path)] == [(0, 7, "base"), (8, 11, "run"), (12, 12, "batch")]
    assert {int(n.split("=")[1]) for n in c.files.names(f"{path}/base")} <= {1, 3, 7}
    keep()
    assert {r._id for r in changes.state(spark, path).where("op <> 'delete'").collect()} == {str(i) for i in range(11)}
    assert [(p.first, p.last) for p in changes._parts(c.files, path)] == [(0, 7), (8, 11), (12, 13)]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, s int, v string")
    assert {r.k: (r.s, r.v) for r in latest_per_key(df, ["k"], ["s"]).collect()} == {"a": (3, "z"), "b": (1, None)}


def test_ingest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_id": {"$oid": "5f"}, "x": 1}\n{"_id": "k", "x": [2]}\n\nnot json\n')
    rows = ingest_json(spark, str(tmp_path / "a.json"), "_id")
    assert {r._id: r.j for r in rows.select("_id", F.to_json("doc").alias("j")).collect()} == {"5f": '{"x":1}', "k": '{"x":[2]}'}
    (tmp_path / "b.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert ingest_json(spark, str(tmp_path / "b.json"), multiline=True).count() == 2


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=12) | st.sampled_from(["12", "1.5", "true", "null", "a,b", ' "q" ', "@x", "- x", "x: y", "[1]", "{}", ""]),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=6), v, max_size=4),
    max_leaves=12,
)


def same(a, b):
    """Equal, where a table's missing cells may come back as nulls."""
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) <= set(b) and all(b[k] is None for k in set(b) - set(a)) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return type(a) is type(b) and a == b


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=6), VALUES, max_size=5))
def test_toon_round_trip(data):
    assert same(data, toon.loads(toon.dumps(data)))


def test_toon_form():
    users = {"users": [{"id": 1, "name": "Alice", "role": "admin", "active": True}, {"id": 2, "name": "Bob, Jr", "role": "user", "active": False}], "tags": ["a", "b"], "none": [], "db": {"name": "x", "perf": {"n": 1}}}
    want = 'users[2]{id,name,role,active}:\n  1,Alice,admin,true\n  2,"Bob, Jr",user,false\ntags[2]: a,b\nnone[0]:\ndb:\n  name: x\n  perf:\n    n: 1'
    assert toon.dumps(users) == want and toon.loads(want) == users
    s = toon.stats([{"a": 1}], "a: 1")
    assert s == {"json_size": 10, "toon_size": 4, "reduction_percent": 60.0}
    for bad in ("a[2]: 1", "a", "a[1]{x,y}:\n  1", '"a: 1'):
        with pytest.raises(toon.ToonError):
            toon.loads(bad)


def test_toon_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y", None), (2, None, 2.5)], "id int, s string, d double")
    write_toon(df, str(tmp_path / "t"), "things")
    assert sorted(map(tuple, read_toon(spark, str(tmp_path / "t"), "id int, s string, d double").collect())) == [(1, "x,y", None), (2, None, 2.5)]
    assert read_toon(spark, str(tmp_path / "t")).count() == 2
    register(spark)
    df.coalesce(1).write.format("toon").mode("append").save(str(tmp_path / "u"))
    load = lambda: sorted(r.id for r in spark.read.format("toon").schema("id int, s string").load(str(tmp_path / "u")).collect())
    assert load() == [1, 2]
    df.write.format("toon").mode("append").option("rowsPerFile", 1).save("file:" + str(tmp_path / "u"))
    assert load() == [1, 1, 2, 2]
    df.write.format("toon").mode("overwrite").save(str(tmp_path / "u"))
    assert load() == [1, 2] and not [p for p in (tmp_path / "u").iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="."):
        spark.range(3).selectExpr("raise_error('x') AS s").write.format("toon").mode("append").save(str(tmp_path / "u"))
    assert load() == [1, 2] and not [p for p in (tmp_path / "u").iterdir() if p.name.startswith("_")]
    df.where("false").write.format("toon").mode("overwrite").save(str(tmp_path / "u"))
    assert load() == []
    df.coalesce(1).write.format("toon").mode("append").save(str(tmp_path / "u"))
    assert json.loads(spark.read.format("toon").load(str(tmp_path / "u")).orderBy("doc").first().doc)["id"] == 1


def test_access(spark, tmp_path):
    assert access.allowed("admin", "write") and not access.allowed("read", "write")
    assert access.allowed("guest", "read", {"d": "write"}, "d") and not access.allowed("write", "read", {}, "d")
    access.audit(spark, str(tmp_path / "audit"), [{"event_type": "login", "username": "ann", "status": "ok"}, {"event_type": "read", "username": "bob", "status": "ok"}])
    assert access.search_audit(spark, str(tmp_path / "audit"), user="ann").first().event_type == "login"
    times = spark.sql("SELECT 'u' AS user, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts FROM (SELECT explode(array_repeat(0, 250)) AS s UNION ALL SELECT explode(array_repeat(1, 120)) AS s)")
    got = {r.second.second: (r.requests, r.allowed) for r in access.over_rate(times).collect()}
    assert got == {0: (250, 200), 1: (120, 100)}


def test_compaction_keeps_the_log_and_the_state(store, spark, tmp_path):
    c = store.create_database("s").create_collection("t")
    c.create_index("n")
    c.create_index("who.name")
    c.insert_many([{"_id": f"{i:03d}", "n": i, "who": {"name": f"p{i % 5}"}, "s": str(i)} for i in range(60)])
    c.update("003", {"n": 300})
    c.delete("004")
    seen = []
    go = lambda: changes.subscribe(changes.watch(c), lambda b, _: seen.extend(r.operationType for r in b.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    assert len(seen) == 62
    show = lambda: {r._id: r.j for r in c.frame().select("_id", F.to_json("doc").alias("j")).collect()}
    before = show()
    assert c.compact() == 3 == c.compact() and show() == before and len(before) == 59
    go()
    assert len(seen) == 62  # nothing is sent again
    # After compaction a find is one pruned scan, without an exchange.
    plan = c.explain({"_id": "003"})
    assert "EqualTo(_id,003)" in plan["scans"][0]["pushed"] and plan["exchanges"] == []
    for query, want in (({"n": {"$gte": 58}}, ["003", "058", "059"]), ({"n": 300}, ["003"]), ({"who.name": "p4", "n": {"$lt": 20}}, ["009", "014", "019"]), ({"n": None}, []), ({"n": {"$in": [1, "2", 300.0]}}, ["001", "003"])):
        assert [r._id for r in c.find(query).collect()] == want
        assert [r._id for r in c.find(query).collect()] == [r._id for r in find_plain(c, query)]
    assert "_number" in c.explain({"n": {"$gte": 58}})["scans"][0]["pushed"]
    # Changes after it: the base without what they name, and the newest of those.
    c.update_many({"n": {"$gte": 58}}, {"n": 1})
    c.insert({"_id": "new", "n": 58})
    c.delete("000")
    c.insert({"_id": "000", "n": "text"})
    assert [r._id for r in c.find({"n": {"$gte": 57}}).collect()] == ["057", "new"] and c.count({"n": 1}) == 4
    assert c.find_by_id("000")["n"] == "text" and c.find_by_id("004") is None and c.count() == 60
    after = show()
    go()
    assert len(seen) == 62 + 3 + 3
    assert c.compact() == 7 and show() == after and c.forget() == 7 and show() == after
    c.insert({"_id": "last"})
    assert c.count() == 61 and c.log().count() == 1
    # A base that was not finished does not count.
    store.files.delete(f"{c.path}/base/upto=000000000007/_COMPLETE")
    assert c._base()[0] == 3


def find_plain(c, query):
    from docloom.plans.filters import find

    return find(c.frame(), query, 100).collect()


def test_large_logs(store, monkeypatch):
    """A large log is rid of its older versions, which are few, instead of joined with the newest."""
    from docloom.sources import collections

    c = store.create_database("s").create_collection("t")
    c.insert_many([{"_id": str(i), "n": i} for i in range(30)])
    c.update("3", {"n": 33})
    c.update("3", {"n": 34})
    c.delete("4")
    want = {r._id: r.j for r in c.frame().select("_id", F.to_json("doc").alias("j")).collect()}
    monkeypatch.setattr(collections, "LARGE_LOG", 0)
    frame = c.frame()
    assert {r._id: r.j for r in frame.select("_id", F.to_json("doc").alias("j")).collect()} == want
    exchanged = [x for x in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert not any("doc" in x for x in exchanged)
    monkeypatch.setattr(collections, "MOST_OLDER", 0)
    assert {r._id: r.j for r in c.frame().select("_id", F.to_json("doc").alias("j")).collect()} == want


def test_writers_meet(store, monkeypatch):
    c = store.create_database("s").create_collection("t")
    c.insert({"_id": "1"})
    other = store.database("s").collection("t")
    monkeypatch.setattr(other, "_commits", lambda: [])
    with pytest.raises(RuntimeError):
        other.insert({"_id": "2"})
    assert c.count() == 1


def test_encrypted_collection(store, spark):
    db = store.create_database("s")
    c = db.create_collection("t", password="open sesame")
    c.insert_many([{"_id": "1", "word": "plainly"}, {"_id": "2", "word": "hidden"}])
    c.update("1", {"n": 2})
    c.delete("2")
    for _ in range(2):
        assert c.find_by_id("1")["word"] == "plainly" and c.count({"n": 2}) == 1 and c.count() == 1
        raw = spark.read.option("recursiveFileLookup", "true").parquet(c.log_path).select(F.to_json("doc").alias("j")).collect()
        assert not any("plainly" in (r.j or "") for r in raw)
        c.compact()
    assert "plainly" not in str(spark.read.parquet(f"{c.path}/base").select(F.to_json("doc")).collect())
    with pytest.raises(PermissionError):
        db.collection("t").count()
    with pytest.raises(Exception, match="."):
        db.collection("t", password="wrong").count({"n": 2})


def test_vector_index_of_a_collection(store, spark):
    c = store.create_database("v").create_collection("items", dims=8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    c.insert_many([{"_id": f"{i:03d}", "k": i % 2, "vector": v.tolist()} for i, v in enumerate(x)])
    info = c.build_vector_index(lists=8)
    assert info["status"] == "built" and info["num_vectors"] == 600 and 1 <= info["probes"] <= 8
    found = want = 0
    for q in x[:12]:
        exact = [r._id for r in c.search(q.tolist(), 5).collect()]
        near = c.search(q.tolist(), 5, approximate=True).collect()
        found, want = found + len({r._id for r in near} & set(exact)), want + 5
        assert near[0]._id == exact[0] and near[0].doc is not None
    assert found >= 0.9 * want
    c.insert({"_id": "zz", "vector": x[0].tolist()})
    c.delete("000")
    assert c.search(x[0].tolist(), 1, approximate=True).first()._id == "zz" == c.search(x[0].tolist(), 1).first()._id
    assert c.rebuild_vector_index(lists=8)["num_vectors"] == 600 and c.vector_index()[0] == 3
    assert {r._id for r in c.search(x[1].tolist(), 9, filter={"k": 1}, approximate=True, probes=8).collect()} == {r._id for r in c.search(x[1].tolist(), 9, filter={"k": 1}).collect()}


def test_text_index_of_a_collection(store):
    c = store.create_database("d").create_collection("t")
    c.insert_many([{"_id": "1", "body": "red fox runs"}, {"_id": "2", "body": "blue fox"}, {"_id": "3", "body": "tree"}])
    plain = c.search_text("body", "red fox").collect()
    c.create_text_index("body")
    assert [(r._id, round(r.score, 9)) for r in c.search_text("body", "red fox").collect()] == [(r._id, round(r.score, 9)) for r in plain]
    c.insert({"_id": "4", "body": "red red"})  # the index is older than this
    assert c.search_text("body", "red").first()._id == "4"


def test_handlers_and_the_whole_store(store, spark, tmp_path):
    a, b = store.create_database("one").create_collection("t"), store.create_database("two").create_collection("u")
    a.insert_many([{"_id": "1"}, {"_id": "2"}])
    b.insert({"_id": "3"})
    a.delete("1")
    calls = []
    note = lambda name: lambda rows: calls.extend((name, r.ns.db, r.ns.coll, r.documentKey._id, r.seq) for r in rows.collect())
    h = changes.Handlers()
    gone = note("gone")
    h.on("insert", note("any"))
    h.on("insert", note("u"), "u")
    h.on("drop", note("drop"))
    h.on("delete", gone)
    h.on("delete", note("del"))
    h.off("delete", gone)
    go = lambda: h.start(changes.watch_store(store), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    assert sorted(calls) == [("any", "one", "t", "1", 1), ("any", "one", "t", "2", 1), ("any", "two", "u", "3", 1), ("del", "one", "t", "1", 2), ("u", "two", "u", "3", 1)]
    calls.clear()
    store.database("one").create_collection("later").insert({"_id": "9"})
    assert store.database("two").drop_collection("u")
    go()
    assert sorted(calls, key=str) == [("any", "one", "later", "9", 1), ("drop", "two", "u", None, None)]
    h.off("insert")
    assert not h.by["insert", None] and store.events().count() == 1
    with pytest.raises(ValueError):
        h.on("replace", gone)


def test_rate_by_window(store, spark, tmp_path):
    c = store.create_database("s").create_collection("t")
    c.insert_many([{"_id": str(i)} for i in range(5)])
    c.delete("1")
    out = str(tmp_path / "out")
    q = changes.rate(changes.watch(c), "1 hour", "0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert changes.rate(c.frame().sparkSession.createDataFrame([("insert", dt.datetime(2024, 1, 1, 0, 30)), ("insert", dt.datetime(2024, 1, 1, 0, 59)), ("delete", dt.datetime(2024, 1, 1, 1, 0))], "operationType string, timestamp timestamp"), "1 hour").count() == 2


def test_rate_limit_of_a_stream(spark, tmp_path):
    schema = "user string, ts timestamp"
    batches = [[("a", 0.0)] * 5 + [("b", 0.0)], [("a", 0.5), ("a", 0.5), ("a", 1.0), ("a", 10.0), ("a", 10.0), ("a", 10.0), ("a", 10.0), ("a", 9.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for u, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = changes.limit_rate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), per_second=2, burst=3)
        stream.writeStream.foreachBatch(lambda b, n, i=i: b.write.mode("append").parquet(str(tmp_path / f"out{i}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    first, second = (spark.read.schema("user string, ts timestamp, allowed boolean").parquet(str(tmp_path / f"out{i}")).collect() for i in (0, 1))
    assert sorted((r.user, r.allowed) for r in first) == [("a", False)] * 2 + [("a", True)] * 3 + [("b", True)]
    by = {}
    for r in second:
        by.setdefault((r.ts - dt.datetime(2024, 1, 1)).total_seconds(), []).append(r.allowed)
    assert {k: sorted(v) for k, v in by.items()} == {0.5: [False, True], 1.0: [True], 9.0: [True], 10.0: [False, True, True, True]}


def test_permissions(spark):
    roles = spark.createDataFrame([("ann", "admin"), ("bob", "write"), ("cy", "read"), ("cy", "guest")], "user string, role string")
    grants = spark.createDataFrame([("cy", "delete", "logs"), ("eve", "read", "logs"), ("eve", "fly", "logs")], "user string, permission string, collection string")
    every = access.PERMISSIONS["admin"]
    asked = spark.createDataFrame([(u, p, c, "x") for u in ("ann", "bob", "cy", "eve") for p in [*every, "fly"] for c in ("logs", "notes", None)], "user string, permission string, collection string, role string")
    got = {(r.user, r.permission, r.collection) for r in access.may(roles, grants, asked).where("allowed").collect()}
    by_role = {"ann": every, "bob": access.PERMISSIONS["write"], "cy": ["read"]}
    assert len(every) == 9 and got == {(u, p, c) for u, ps in by_role.items() for p in ps for c in ("logs", "notes", None)} | {("cy", "delete", "logs"), ("eve", "read", "logs")}
