"""The corpus pipeline against the same stages by brute force on a small table."""

import hashlib
import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from docloom.llm import bpe  # noqa: E402
from tests.llm.test_dedup import cut_texts, frame, near_copies, prose  # noqa: E402
from tests.llm.test_native import fill  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], DATA).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert frames[-1].columns == corpus_pipeline.COLUMNS, name
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:4]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    known = [i for i in rows[0] if i in labels]
    assert sum((i in gone) == (labels[i] == 0) for i in known) >= 0.95 * len(known)
    copies = near_copies([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, c in copies.items() if c[2]}
    want = cut_texts([(i, r.text) for i, r in rows[2].items()])
    for i, r in rows[3].items():
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][3] or want[i][1]
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= want[i][0] - want[i][1]
    sizes, taken = {}, {}
    for r in rows[3].values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in frames[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for s, target in fill(sizes, (3, 1, 2), 1.5, 2).items():
        assert abs(taken.get(s, 0) - target) <= 0.02 * target + 1
    tokens = frames[5].collect()
    assert len(tokens) == frames[4].count()
    enc = bpe.encoding(bpe.read_ranks(bpe.vocabulary()[0]), bpe.vocabulary()[1])
    texts = {hashlib.sha256(r.text.encode()).hexdigest() for r in frames[4].collect()}
    assert all(r.n_tokens == len(r.token_ids) and r.decoded_sha256 in texts and hashlib.sha256(enc.decode(r.token_ids)).hexdigest() == r.decoded_sha256 for r in tokens)


def test_run(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, DATA).where("n_tokens > 0").count() > 0


def test_near_copies_by_five_words_at_80(spark):
    """Copies with one block added or cut off have a similarity of 0.80 to 0.85, and go."""
    rng = random.Random(6)
    rows = []
    for k in range(12):
        base = prose(rng, 200, 10**6).split()
        added, cut_off = base[:90] + prose(rng, 34 + k % 5, 10**6).split() + base[90:], base[: 164 + k % 6]
        rows += [(10 * k + j, " ".join(w)) for j, w in enumerate((base, added, cut_off))]
    got = corpus_pipeline.near_copies(spark, frame(spark, rows).drop("score", "size"), "")
    assert {r.doc_id for r in got.collect()} == {10 * k for k in range(12)}


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids: rows are judged, not ids."""
    rng = random.Random(12)
    x, y, z, u, v = (prose(rng, 60, 10**6) for _ in range(5))
    rows = [(3, x), (5, x), (5, y), (None, z), (None, z), (None, z + " more"), (8, u), (8, u), (8, u), (None, v), (10, v), (11, ""), (11, "")]
    rows += [(None, x)] * 3
    out = corpus_pipeline.near_copies(spark, frame(spark, rows).drop("score", "size"), "").collect()
    got = sorted((r.doc_id or -1, r.text) for r in out if r.text not in (z, z + " more"))
    assert got == sorted([(3, x), (5, y), (8, u), (10, v), (11, ""), (11, "")])
    assert [r.doc_id for r in out if r.text in (z, z + " more")] == [None]


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (None, "", "en", "s", 0), (3, "", None, None, 0), (4, " \n\t ", "en", "s", None),
    (5, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "two words", None, "t", 9), (None, "two words", None, "t", 9), (6, "a " * 30_000, "en", "u", None),
    (-7, "x" * 200_000, None, "u", 1), (8, "é漢😀 " * 5000, "zh", "é", 5),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing extra columns: defined results, nothing lost but by rule."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(16)
    prose_ = [prose(rng, 80, 10**6) for _ in range(6)]
    rows = ODD + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(prose_)] + [(None, prose_[0], "en", "s", 1), (200, prose_[1] + " more", "en", "v", 1), (100, prose_[2], "en", "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = plain.selectExpr("*", "'x' AS score", "1 AS size", "2 AS node", "'k' AS kept", "array(1) AS bands", "3 AS taken", "4 AS row", "5 AS id", "6 AS doc", "7 AS body", "'t' AS _text")
    for name, stage in corpus_pipeline.STAGES:
        out = [stage(spark, df, DATA) for df in (plain, clashing)]
        got = [sorted(map(str, f.collect())) for f in out]
        assert got[0] == got[1], name
        assert stage(spark, plain.where("false"), DATA).count() == 0, name
        if name != "byte-level BPE":
            assert out[0].columns == corpus_pipeline.COLUMNS, name

    near = corpus_pipeline.near_copies(spark, clashing, DATA).collect()
    texts = sorted((r.text or "") for r in near)
    with_words = sorted({t for _, t, *_ in rows if t and t.split()} - {prose_[1] + " more"})
    assert [t for t in texts if t.split()] == with_words  # one row of each group, whatever its ids
    assert sum(not t.split() for t in texts) == 5  # rows without words are not copies of each other
    cut = corpus_pipeline.repeated_passages(spark, plain, DATA).collect()
    assert len(cut) == len(rows) and sum(r.text == "x" and r.n_chars == 1 for r in cut) == 1
    mixed = corpus_pipeline.mixed(spark, plain, DATA).collect()
    sizes, words = {}, {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words.get(s, 0) - t) <= 0.51 for s, t in fill(sizes, (3, 1, 2), 1.5, 2).items())
    tokens = corpus_pipeline.tokens(spark, plain, DATA).collect()
    assert sorted(r.decoded_sha256 for r in tokens) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows)
    kept = corpus_pipeline.quality(spark, plain, DATA).collect()
    assert {(r.doc_id, r.text) for r in kept} <= {(i, t) for i, t, *_ in rows}
