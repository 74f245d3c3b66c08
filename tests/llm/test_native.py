"""Sharding, mixing, revisits and the pipeline: laws, brute force and SQL."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from docloom.llm import mixing, registry, revisits, sharding

DOCS = "doc_id bigint, text string, source string, lang string, size string, shard string, target string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", "y", "z", None) for i, t, s in rows], DOCS)


def test_slots_of_rows_without_an_id(spark):
    """Rows that share an id are dealt to many bins by their text."""
    df = frame(spark, [(None, f"text {i}", "s") for i in range(3000)] + [(4, f"t{i}", "s") for i in range(500)])
    got = sharding.shard_documents(df, bins=64).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) <= 2 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    plan = sharding.shard_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "hint" not in sharding.shard_documents(df)._jdf.queryExecution().logical().toString().lower() and "Window" in plan


def test_header_names_in_either_case(spark):
    rows = [
        (1, "response", "http://x.org/a", 1, 200, '"e"', None, "p", {"ETag": '"e"', "Content-Type": "text/html", "content-type": "text/plain", "Server": "s"}),
        (2, "revisit", "http://x.org/a", 2, 304, '"e"', None, None, {"ETAG": 'W/"e"', "Date": "d", "SERVER": "t"}),
    ]
    r = revisits.resolve(spark.createDataFrame([(*r, "own") for r in rows], RECORDS)).first()
    assert r.outcome == "resolved" and r.headers == {"etag": 'W/"e"', "date": "d", "content-type": "text/plain", "server": "s"}


def jump(key, n):
    """The published algorithm on 64-bit integers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "é", "text " * rng.randrange(9)]), "s") for i in range(2000)] + [(None, "a", "s"), (None, None, "s"), (7, "b", "s"), (7, "b", "s")]
    got = sharding.shard_documents(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 16), jump(key, 17), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert 0.03 < sum(r.grown_shard == 16 for r in got) / len(got) < 0.09
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_sharding_of_any_count(spark):
    rows = frame(spark, [(i, "", "s") for i in range(300)])
    got = {n: {r.doc_id: r.shard for r in sharding.assign(rows, "doc_id", n).select("doc_id", "shard").collect()} for n in (1, 2, 3, 40)}
    assert set(got[1].values()) == {0} and max(got[40].values()) < 40
    assert all(got[3][k] in (v, 2) for k, v in got[2].items())
    with pytest.raises(ValueError):
        sharding.jump_hash(sharding.key_of(rows["doc_id"]), 0)


def fill(sizes, weights, share, most):
    """Clamp and reshare until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark):
    rng = random.Random(2)
    rows = []
    for s, n in [("a", 400), ("b", 30), ("B", 60), ("é", 5), (None, 80), ("zero", 0)]:
        rows += [(len(rows) + k, " ".join("w" for _ in range(rng.randrange(60))), s) for k in range(n)]
    rows += [(None, "one two", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (9000, None, "zero"), (9001, "  \n", "zero")]
    got = mixing.mix_documents(frame(spark, rows).repartition(6)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes, (3, 1, 2), 1.5, 2)
    assert len(got) == len(rows)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    again = mixing.mix_documents(frame(spark, rows).repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_documents(frame(spark, [(1, "", "a"), (2, None, None)])).collect()} == {0}


def test_the_mix_itself(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(50))), rng.choice("abc")) for i in range(200)]
    df = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(df).collect()}
    out = mixing.repeated_documents(df)
    assert out.columns == df.columns
    words = Counter()
    whole = dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_the_mix_of_rows_without_ids_and_texts(spark):
    """Null and repeated ids, null sources and texts: the rows of the mix have the words of the plan."""
    rng = random.Random(4)
    text = lambda: " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(12)))
    rows = [(rng.choice([None, None, 3, i]), rng.choice([text(), text(), None, "same words here"]), rng.choice(["a", "b", None])) for i in range(400)]
    rows += [(None, "x y", "one")] * 7 + [(None, None, "none"), (None, " ", "none")]
    df = frame(spark, rows).repartition(5)
    taken, mixed, sizes = Counter(), Counter(), Counter()
    key = {(i, t): s for i, t, s in rows}
    for r in mixing.mix_documents(df).collect():
        taken[r.source_size, r.target] += r.taken
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goals = fill(sizes, (3, 1, 2), 1.5, 2)
    for r in mixing.repeated_documents(df).collect():
        mixed[r.source] += len(r.text.split())
    assert key and all(abs(mixed[s] - goals[s]) <= 0.51 for s in sizes)
    assert sum(taken.values()) == sum(mixed.values())
    assert mixing.repeated_documents(frame(spark, [])).count() == 0


def test_bins_decide_nothing(spark, monkeypatch):
    """With few bins many rows stand in the edge of a source; the mix is the same."""
    rng = random.Random(6)
    rows = [(rng.choice([None, i]), " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(30))), rng.choice("aaab")) for i in range(300)]
    df = frame(spark, rows)
    want = Counter(map(tuple, mixing.mix_documents(df).collect())), Counter(map(tuple, mixing.repeated_documents(df).collect()))
    monkeypatch.setattr(mixing.bin_of, "__defaults__", (1,))
    monkeypatch.setattr(mixing, "EDGE_BITS", 3)
    assert (Counter(map(tuple, mixing.mix_documents(df).collect())), Counter(map(tuple, mixing.repeated_documents(df).collect()))) == want


def test_only_the_edge_of_a_source_is_shuffled(spark):
    df = frame(spark, [(i, "some words", "ab"[i % 2]) for i in range(50)])
    plan = mixing.repeated_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_revisits_by_brute_force(spark):
    """Many captures of few URLs, by blocks of any widths."""
    rng = random.Random(17)
    rows = []
    for k in range(500):
        url, ts, tag = f"http://u{rng.randrange(3)}.org/", rng.choice([None, *range(120)]), f'"{rng.randrange(3)}"'
        rows.append((k, rng.choice(["response", "revisit"]), url, ts, rng.choice([200, 200, 404]), tag, None, None, {"k": str(k)}))
    want = {}
    for k, kind, url, ts, _, tag, *_ in rows:
        if kind == "revisit":
            held = [r for r in rows if r[1] == "response" and r[2] == url and r[4] == 200 and r[3] is not None and ts is not None and r[3] < ts]
            ref = max(held, key=lambda r: (r[3], r[0]), default=None)
            want[k] = ("missing", None) if ref is None else ("resolved" if ref[5] == tag else "mismatch", ref[0])
    df = spark.createDataFrame([(*r, "own") for r in rows], RECORDS).repartition(3)
    for blocks in ((86400, 30), (40, 10, 2), (6, 2), (7,), (1,)):
        got = revisits.resolve(df, blocks).collect()
        assert len(got) == len(want) and {r.record_id: (r.outcome, r.ref_id) for r in got} == want, blocks


RECORDS = "record_id bigint, kind string, url string, ts bigint, status int, etag string, last_modified string, digest string, headers map<string,string>, outcome string"


def test_revisits(spark):
    h = {"date": "d0", "content-type": "text/html", "etag": "e"}
    rows = [
        (1, "response", "http://www.X.org:80/a/?b=2&utm_source=q&a=1#f", 10, 200, '"e1"', "m1", "p1", h),
        (2, "response", "https://x.org/a?a=1&b=2", 20, 200, '"e2"', None, "p2", h),
        (3, "response", "https://x.org/a?a=1&b=2", 25, 500, '"e9"', None, "p9", h),
        (4, "revisit", "http://x.org/a?b=2&a=1", 15, 304, 'W/"e1"', None, None, {"date": "d1", "content-type": "text/plain", "vary": None}),
        (5, "revisit", "http://x.org/a?b=2&a=1", 20, 304, '"e1"', None, None, None),
        (6, "revisit", "http://x.org/a?b=2&a=1", 30, 304, '"e1"', None, None, {"date": "d1"}),
        (7, "revisit", "http://x.org/a?b=2&a=1", 10, 304, '"e1"', None, None, {"date": "d1"}),
        (8, "revisit", "http://x.org/a?b=2&a=1", 10**7, 304, None, None, "p2", {"date": "d1"}),
        (9, "revisit", "http://x.org/a?b=2&a=1", 10**7, 304, None, "m2", None, {"date": "d1"}),
        (10, "revisit", None, 40, 304, '"e1"', None, None, None),
        (11, "revisit", "http://x.org/a?b=2&a=1", None, 304, '"e1"', None, None, None),
        (12, "response", None, 1, 200, '"e1"', None, None, None),
        (13, "revisit", "http://y.org/a", 40, 304, None, None, None, None),
        (13, "revisit", "http://y.org/a", 40, 304, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], RECORDS)
    got = {r.record_id: r for r in revisits.resolve(df, blocks=(21, 7)).collect()}
    assert revisits.resolve(df).count() == 10 and {r.url for r in got.values()} >= {"x.org/a?a=1&b=2", "y.org/a", None}
    short = {k: (r.outcome, r.ref_id, r.status) for k, r in got.items()}
    assert short == {
        4: ("resolved", 1, 200), 5: ("resolved", 1, 200), 6: ("mismatch", 2, 304), 7: ("missing", None, 304), 8: ("resolved", 2, 200),
        9: ("unverifiable", 2, 304), 10: ("missing", None, 304), 11: ("missing", None, 304), 13: ("missing", None, 304),
    }
    assert got[4].headers == {"date": "d1", "content-type": "text/html", "etag": "e"} and got[4].digest == "p1"
    assert got[5].headers == h and got[6].headers == {"date": "d1"}
    pages = spark.createDataFrame([(1, "one"), (2, "two")], "record_id bigint, payload string")
    assert {r.record_id: r.payload for r in revisits.attach(revisits.resolve(df), pages).collect() if r.payload} == {4: "one", 5: "one", 8: "two"}
    assert revisits.resolve(df.where("false")).count() == 0
    assert {k: (r.outcome, r.ref_id) for k, r in ((r.record_id, r) for r in revisits.resolve(df).collect())} == {k: v[:2] for k, v in short.items()}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA), duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda rows, names: Counter(tuple(f"{r[names.index(c)]:.6f}" if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in columns) for r in rows)
    assert show(got.collect(), got.columns) == show(want.fetchall(), want.columns)
