"""Suffix dedup, near copies and embeddings against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import common, components, embedding_dup, near_dup, suffix_dedup, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size int"


def frame(spark, rows):
    """(doc_id, text) rows with extra columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def cut_texts(rows):
    """Brute force: id to (bytes, removed, spans, sha of what is left)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(1)
    shared = [prose(rng, 30) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(40)
            parts += [s[a : a + 60 + rng.randrange(120)], prose(rng, rng.randrange(30))]
        rows.append((i * 3 - 50, rng.choice(["", " "]).join(parts)))
    rows += [(1000, "a" * 250), (1001, "a" * 120), (1002, "ab" * 200), (1003, ""), (1004, None), (1005, "x" * 99), (1006, rows[5][1]), (1007, rows[5][1] + "!"), (1008, "é" * 130)]
    long = prose(rng, 60000, 10**6)
    rows += [(2000, long), (2001, prose(rng, 10) + long[100_000:300_000] + prose(rng, 10))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows).repartition(5)).collect()}
    assert got == cut_texts(rows)


def test_suffix_dedup_keeps_ties_and_null_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, a), (None, b), (2, b), (3, a), (3, b)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), carry=("lang", "size"), keep_text=True).collect()
    assert len(got) == 6 and all(r.lang == "en" and r["size"] == 1 for r in got)
    removed = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got)
    assert removed == sorted([(1, 0), (1, 0), (-1, 0), (2, len(b.encode())), (3, len(a.encode())), (3, len(b.encode()))])
    assert {bytes(r.kept) for r in got if r.doc_id == 1} == {a.encode()} and {r.kept_text for r in got if r.doc_id == 2} == {""}
    assert [len(r.spans) for r in got if r.doc_id == 2] == [1]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_of_many_texts_under_one_id(spark):
    """Pairs that share a passage: one text of each loses it and nothing else, however many share the id."""
    rng = random.Random(13)
    rows, passages = [], {}
    for k in range(3000):
        passage = f"<{k}>" + "".join(rng.choices("abcdefgh", k=140)) + f"<{k}>"
        passages[k] = passage
        rows += [(None, "0" * rng.randrange(60) + "xy"[side] + passage + f"{'pq'[side]}#{k}") for side in (0, 1)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), keep_text=True).collect()
    assert len(got) == 6000
    lost = {}
    for r in got:
        k = int(re.search(r"#(\d+)$", r.kept_text)[1])
        lost.setdefault(k, []).append(r.n_removed)
    assert {k: sorted(x) for k, x in lost.items()} == {k: [0, len(p)] for k, p in passages.items()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def joined(n, linked):
    """Least index reachable by links."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_copies(rows):
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = joined(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[root[i]][0], root[i] == i) for i in range(len(rows))}


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(4, 80), 3000)) for i in range(0, 200, 2)]
    for g in range(6):
        base = prose(rng, 120, 3000).split()
        for k in range(15):  # similar by 0.5 to 1 to each other
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((1000 + g * 100 + k * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    same = prose(rng, 50, 3000)
    rows += [(5000 + i, same.replace("w", "W") if i % 2 else same) for i in range(40)]
    rows += [(6000, ""), (6001, None), (6002, " \n"), (6003, "one two"), (6004, "ONE  two"), (6005, "one"), (6006, "ein zwei drei"), (6007, "ÄÖ x y"), (6008, "äö x y")]
    rows.append((7000, prose(rng, 30000, 10**6)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == near_copies(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.near_duplicates(frame(spark, [(1, None)])).first().asDict() == {"doc_id": 1, "n_shingles": 0, "component_id": 1, "kept": True}
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "e f g h"), (7, "e f g h"), (9, "e f g h"), (9, "e f g h"), (None, "q r s t")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([(-1, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (-1, -1, True)])


def test_near_duplicates_do_not_meet_in_null_or_repeated_ids(spark):
    rng = random.Random(11)
    five, nine, seven, eight = (prose(rng, 100, 10**6) for _ in range(4))
    rows = [(5, five), (9, nine), (None, five + " x"), (None, nine + " y"), (None, nine + " y")]
    rows += [(7, seven), (8, eight), (20, seven + " x"), (20, eight + " y")]
    rows += [(None, prose(rng, 40, 10**6)) for _ in range(50)]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id} == {(i, i, True) for i in (5, 7, 8, 9)} | {(20, 7, False), (20, 8, False)}
    assert sorted(r.component_id or -1 for r in got if r.doc_id is None) == [-1] * 50 + [5, 9, 9]


def test_blocks_of_buckets_and_families(spark, monkeypatch):
    """Small limits, so that buckets and families are dealt out in many blocks."""
    rng = random.Random(5)
    base = prose(rng, 100, 3000).split()
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(100)) for i in range(60))]
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", 1500)
    monkeypatch.setattr(near_dup, "MOST_BROADCAST", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_copies(rows)


def test_large_families(spark, monkeypatch):
    """Chains of copies of copies, dense groups, and texts joined by boilerplate only, all in few families."""
    rng = random.Random(15)
    rows = []

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        return w

    for g in range(4):  # each a small step from the one before
        w = prose(rng, 100, 10**6).split()
        for k in range(25):
            rows.append((1000 * g + k, " ".join(w)))
            w = changed(w, rng.randrange(1, 4))
    common = prose(rng, 70, 10**6)
    for k in range(40):  # half of each is the same
        rows.append((5000 + k, common + " " + prose(rng, 40, 10**6)))
    base = prose(rng, 100, 10**6).split()
    rows += [(6000 + k, " ".join(changed(base, rng.randrange(5)))) for k in range(60)]
    rows += [(7000 + k, r[1] + " end") for k, r in enumerate(rng.sample(rows, 20))]
    want = near_copies(rows)
    for family, bucket in ((400, 5), (2000, 20000), (100, 20000)):
        monkeypatch.setattr(near_dup, "FAMILY_BLOCK", family)
        monkeypatch.setattr(near_dup, "BUCKET_BLOCK", bucket)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
        assert got == want, (family, bucket)


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for overlap in (0, 100, 300, 380):
        for n in (3, 40, 400):
            k = overlap * n // 400
            ids = rng.integers(0, 2**52, 2 * n - k, dtype=np.uint64)
            a, b = ids[:n], ids[n - k :]
            s = near_dup.superminhash(np.r_[a, b], np.r_[np.zeros(n, int), np.ones(n, int)], 2, 250)
            errors.append((s[0] == s[1]).mean() - k / (2 * n - k))
    assert np.abs(errors).max() < 0.12
    one = near_dup.superminhash(np.array([7], np.uint64), np.zeros(1, int), 2, 16)
    assert sorted(one[0] >> np.uint64(32)) == list(range(16)) and (one[1] >> np.uint64(32) == 16).all()


def test_leaders_of_blocks_are_all_compared(spark, monkeypatch):
    """Leaders that are each close to another one, but to each other only by the wider threshold."""
    rng = np.random.default_rng(14)
    one, two = rng.integers(0, 2**8, (2, 130)).astype(np.uint8)
    two[:49] = one[:49]  # similar by 0.38
    heads = [x.copy() for x in (one, two)]
    for head, part in zip(heads, (slice(0, 24), slice(25, 49)), strict=True):
        head[part] = ~head[part]  # 0.82 to their own, 0.19 or less to the other
    assert near_dup.estimate(one, two) > near_dup.Rule().far > max(near_dup.estimate(heads[0], two), near_dup.estimate(heads[1], one), near_dup.estimate(*heads))
    found = []
    mapped = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, kind, *a: found.append(f) or mapped(self, f, kind, *a))
    near_dup.rough_links(spark.createDataFrame([], near_dup.SIGNED))
    rows = [heads[0], heads[1], one, two]
    columns = [pa.array([5] * 4), pa.array([0] * 4), pa.array([0] * 4), pa.array(range(4)), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([1] * 4)]
    batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "x", "y", "node", "signature", "blocks"])
    pairs = [(a, b) for out in found[-1](iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert joined(4, pairs) == [0] * 4


def test_exact_forest_finds_all_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**50, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rng.integers(0, 60, rng.integers(0, 9))
        s[at] = rng.integers(0, 2**50, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    links = [(i, j) for i in range(80) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)]
    a, b = near_dup.exact_forest(np.arange(80), sets)
    assert joined(80, zip(a.tolist(), b.tolist(), strict=True)) == joined(80, links)
    assert len(a) < 80


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300) * 7, rng.randrange(300) * 7) for _ in range(260)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, 9000)]
    ids = sorted({x for e in links for x in e})
    at = {x: i for i, x in enumerate(ids)}
    root = joined(len(ids), [(at[a], at[b]) for a, b in links])
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    got = {r.id: r.component for r in components.components(df).collect()}
    assert got == {x: ids[root[at[x]]] for x in ids}
    assert components.components(df.where("a < 0")).count() == 0


EMBEDDED = "vec_id bigint, embedding array<float>, label int, node string, weight string"


def linked_vectors(rows, cosine=0.98):
    """Brute force by row: (links, place of the least id of the component) for (id, vector, label) rows; null ids last."""
    sound = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and y is not None for _, v, y in rows]
    links = np.zeros((len(rows), len(rows)), bool)
    for d in {len(v) for (_, v, _), ok in zip(rows, sound, strict=True) if ok}:
        for label in {y for _, _, y in rows if y is not None}:
            at = np.array([i for i, (_, v, y) in enumerate(rows) if sound[i] and len(v) == d and y == label], int)
            if len(at):
                x = np.array([rows[i][1] for i in at], float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    back = {i: k for k, i in enumerate(order)}
    root = joined(len(rows), [(back[i], back[j]) for i, j in zip(*np.nonzero(links), strict=True)])
    return links.sum(axis=1), [rows[order[root[back[i]]]][0] for i in range(len(rows))]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16), i % 3) for i in range(400)]
    for g in range(20):
        base = rng.standard_normal(16)
        rows += [(1000 + g * 20 + k, base + 0.04 * rng.standard_normal(16), 1) for k in range(12)]
    rows += [(2000 + i, np.ones(16), 2) for i in range(30)] + [(2100, 5 * np.ones(16), 2), (2101, np.ones(16), 0)]
    data = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    odd = [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [1.0] * 16, None), (3004, [None] + [1.0] * 15, 1), (3005, [], 1), (3006, [float("inf")] * 16, 1), (3007, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in data + odd], EMBEDDED)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.near_duplicates(df, sample=200).collect()}
    links, tops = linked_vectors(data)
    want = {data[i][0]: (int(links[i]), tops[i], tops[i] == data[i][0]) for i in range(len(data))}
    assert sum(got[i][0] for i in want) >= 0.9 * links.sum() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.9 * len(want)
    assert all(got[i] == (0, i, True) for i, _, _ in odd)
    assert {got[2000 + i] for i in range(1, 30)} == {(30, 2000, False)} and got[2101][0] == 0


@pytest.mark.parametrize("cosine", [0.9805, 0.985])
def test_recall_in_64_dimensions(spark, cosine):
    """Pairs planted just above the threshold among many others, in labels of different sizes."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6000, 64)) * np.linspace(0.5, 2, 64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = rng.standard_normal((600, 64))
    across -= (across * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    planted = cosine * base[:600] + np.sqrt(1 - cosine**2) * across
    label = np.where(np.arange(6000) < 4500, 1, 2)
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(base, label, strict=True))] + [(10_000 + i, v.tolist(), 1) for i, v in enumerate(planted)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDED.replace("float", "double"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.near_duplicates(df).collect()}
    links, tops = linked_vectors(rows)
    found = sum(n for n, _ in got.values())
    assert links.sum() >= 1200 and links.sum() >= found >= 0.98 * links.sum()
    assert sum(got[i][1] == t for (i, _, _), t in zip(rows, tops, strict=True)) >= 0.98 * len(rows)


def test_embeddings_do_not_meet_in_null_or_repeated_ids(spark):
    """By row: null and repeated ids in several labels, two lengths, labels that are no whole numbers."""
    rng = np.random.default_rng(10)
    a, b, c, d = rng.standard_normal((4, 24))
    near = lambda x: x + 0.01 * rng.standard_normal(len(x))
    rows = [(None, a, 1.2), (1, near(a), 1.2), (None, b, 1.7), (2, near(b), 1.7), (7, c, 1.2), (7, d, 1.7), (8, near(c), 1.2), (9, near(d), 1.7), (10, a, 1.7)]
    rows += [(20 + i, near(a[:5]), 1.2) for i in range(3)] + [(None, a[:5], 1.2), (None, a[:5], 1.2), (30, [1.0], 1.2), (31, [2.0], 1.2), (32, [-1.0], 1.2)]
    rows += [(None, x, 1.2) for x in rng.standard_normal((40, 24))] + [(40, c, 0.0), (41, c, -0.0), (42, c, float("nan")), (43, c, float("nan"))]
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDED.replace("float", "double").replace("label int", "label double")).repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dup.near_duplicates(df).collect())
    links, tops = linked_vectors([r for r in rows if r[2] == r[2]])
    want = Counter((r[0], int(n), t, r[0] == t) for r, n, t in zip([r for r in rows if r[2] == r[2]], links, tops, strict=True))
    assert got == want + Counter({(42, 1, 42, True): 1, (43, 1, 42, False): 1})  # Spark takes NaN labels as equal
    words_ = df.selectExpr("CAST(vec_id AS string) AS vec_id", "embedding", "CAST(label AS string) AS label")
    assert {(r.vec_id, r.component_id) for r in embedding_dup.near_duplicates(words_).collect()} >= {("1", "1"), ("8", "7"), ("9", "7"), ("31", "30"), ("32", "32")}


def test_embeddings_of_odd_tables(spark, monkeypatch):
    assert embedding_dup.near_duplicates(spark.createDataFrame([], EMBEDDED)).count() == 0
    only = spark.createDataFrame([(1, None, 1, "", "")], EMBEDDED)
    assert embedding_dup.near_duplicates(only).first().asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}
    monkeypatch.setattr(embedding_dup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, [float(v) for v in base + 0.01 * rng.standard_normal(8)], 1, "", "") for i in range(80)] + [(None, [float(v) for v in base], 1, "", "")]
    got = embedding_dup.near_duplicates(spark.createDataFrame(rows, EMBEDDED)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert all(r.n_links <= 80 for r in got) and sum(r.n_links for r in got) >= 0.9 * 81 * 80


def test_runs():
    batches = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "c"]) for a, b, c in (([1, 1], [1, 2], [0, 1]), ([], [], []), ([1], [2], [2]), ([1, 2, 2], [2, 2, 2], [3, 4, 5]), ([3], [1], [6]))]
    batches[1] = batches[0].slice(0, 0)
    assert [t.column("c").to_pylist() for t in common.runs(iter(batches), 2)] == [[0], [1, 2, 3], [4, 5], [6]]


def test_itq_codes_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 32)) * np.linspace(1, 3, 32)
    mean, projection = embedding_dup.learn_rotation(x, 32)
    codes = embedding_dup.codes_of(x, mean, projection)
    share = np.array([(codes >> np.uint64(b) & np.uint64(1)).mean() for b in range(32)])
    assert np.abs(share - 0.5).max() < 0.08
    assert np.allclose(projection.T @ projection, np.eye(32))


def test_words():
    texts = ["a B  c\n d", "", None, "é x y", "\t\r\n", "z"]
    chunk = next(words.chunks(pa.array([None if t is None else t.encode() for t in texts])))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert chunk.count.tolist() == [len(w) for w in want]
    got = [chunk.data[a:b].tobytes().decode() for a, b in zip(chunk.start, chunk.end, strict=True)]
    assert got == [x for w in want for x in w]
    assert len(set(chunk.hashes().tolist())) == len(set(got))
