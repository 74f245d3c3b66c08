"""Quality model, decision lists, language identification, tokens: brute force and held-out accuracy."""

import base64
import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import bpe, language, quality_model, quality_rules, words
from docloom.llm.labelled import training_texts

DOCS = "doc_id bigint, text string, lang string, source string, score double, kept boolean, n_words int"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "der"], "cc": ["да", "не", "ти", "ко"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        text, good = sentence(rng, lang, rng.randrange(60, 200)), 1
        if i % 4 == 0:
            good = 0
            bad = i // 4 % 3
            if bad == 0:
                text = " ".join(w + rng.choice("#$%&*") * 2 for w in text.split())
            elif bad == 1:
                text = text[:200] + " " + " ".join(w for w in text.split() for _ in range(4))
            else:
                text = text.upper().replace(" ", "!! ")
        rows.append((i, text, lang, f"s{i % 3}", None, None, None))
        if i % 2 == 0 or rng.random() < 0.8:
            labels.append((i, good, 0))
    rows += [(1000, "", None, None, 0.0, True, 1), (1001, None, "aa", "s", 0.0, True, 1), (1002, "42 17!", "aa", "s", None, None, None), (None, "ka lo", "aa", "s", None, None, None), (5, "ka lo mi", "aa", "s", None, None, None)]
    labels += [(5, 0, 1), (7, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).cache()
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache(), {r[0]: r for r in labels[:-3]}


def test_quality_model(corpus):
    docs, labels, by = corpus
    got = quality_model.judge(docs, labels).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == held_out(r.doc_id) for r in got if r.doc_id is not None)
    test = [(r.predicted, by[r.doc_id][1]) for r in got if r.held_out and r.doc_id in by]
    assert len(test) > 80 and sum(a == b for a, b in test) / len(test) >= 0.95
    again = {r.doc_id: r.score for r in quality_model.judge(docs.repartition(3), labels).collect() if r.doc_id not in (5, None)}
    assert again == pytest.approx({r.doc_id: r.score for r in got if r.doc_id not in (5, None)}, abs=1e-6)


def test_quality_model_of_odd_tables(spark, corpus):
    docs, labels, _ = corpus
    none = labels.where("doc_id < 0")
    assert quality_model.judge(docs, none).where("score between 0 and 1").count() == 405
    assert quality_model.judge(docs.where("doc_id < 0"), labels).count() == 0


def test_scores_by_hand(spark, corpus):
    """The forward pass of the learned model in plain Python, from the text on."""
    docs, labels, _ = corpus
    model = quality_model.fit(docs, labels)
    w = {k: v.tolist() for k, v in model.weights.items()}
    classes = [*range(quality_model.CLASSES)]

    def features(body):
        words_ = list(re.finditer(rb"[^\x20\x09-\x0D]+", body))
        groups = [words_[i : i + 64] for i in range(0, len(words_), 64)] or [[]]
        starts = [0, *(g[0].start() for g in groups[1:])]
        out = []
        for g, a, b in zip(groups, starts, [*starts[1:], len(body) + 1], strict=True):
            part = (body + b"\n")[a:b]  # a text is ended by a line end
            by = Counter(int(quality_model._CLASS[c]) for c in part)
            x = [math.sqrt(by[c] / max(1, len(part))) for c in classes]
            ws, n = [m[0] for m in g], max(1, len(g))
            before = [words_[i - 1][0] if i else None for i in range(words_.index(g[0]), words_.index(g[0]) + len(g))] if g else []
            lengths = [len(t) for t in ws]
            mean = sum(lengths) / n
            x += [math.log1p(len(g)) / 4, sum(p == q for p, q in zip(ws, before, strict=True)) / n, len(set(ws)) / n, mean / 8]
            x += [math.sqrt(max(0, sum(v * v for v in lengths) / n - mean**2)) / 4, sum(65 <= t[0] <= 90 for t in ws) / n, sum(v <= 2 for v in lengths) / n, sum(v >= 12 for v in lengths) / n]
            out.append(x)
        return out

    def layer(x, m, b=None):
        return [sum(xi * row[j] for xi, row in zip(x, m, strict=True)) + (b[j] if b else 0) for j in range(len(m[0]))]

    def score(text):
        hidden, energy = [], []
        for x in features((text or "").encode()):
            x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale, strict=True)]
            h = [math.tanh(v) for v in layer(x, w["w"], w["b"])]
            gate = [math.tanh(t) / (1 + math.exp(-s)) for t, s in zip(layer(h, w["v"]), layer(h, w["u"]), strict=True)]
            hidden.append(h)
            energy.append(sum(a * g for a, g in zip(w["a"], gate, strict=True)))
        share = [math.exp(e - max(energy)) for e in energy]
        z = [sum(s * h[j] for s, h in zip(share, hidden, strict=True)) / sum(share) for j in range(len(hidden[0]))]
        return 1 / (1 + math.exp(-sum(c * v for c, v in zip(w["c"], z, strict=True)) - w["d"]))

    rng = random.Random(5)
    texts = [None, "", " \n", "one", "a a B " * 200, sentence(rng, "cc", 333), "long" * 50_000, "w x " * 20_000]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(2)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    assert got == pytest.approx({i: score(t) for i, t in enumerate(texts)}, abs=1e-9)


def test_language_by_hand(spark, corpus):
    """Counts, scores and paths in plain Python: the prediction of every row of the table."""
    docs, _, _ = corpus
    rows = [r for r in docs.collect()]
    rows += [type(rows[0])(**{**rows[0].asDict(), "doc_id": 5000, "text": "sch ung  ka-lo!\tда"}), type(rows[0])(**{**rows[0].asDict(), "doc_id": 5001, "text": "ka lo mi " * 40_000})]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    langs = sorted({r.lang for r in rows if r.lang and not (held_out(r.doc_id) if r.doc_id is not None else held_out(""))})

    def pieces(text):
        """(word, trigrams that begin in it, letters, script)."""
        body = text.encode()
        low = re.sub(rb"[\x09-\x0D]", b" ", body).lower() if body.isascii() else bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in body)
        framed = b" " + low + b"    "
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", body):
            word = m[0].decode()
            scripts = [int(language._SCRIPT[np.searchsorted(language._FIRST, ord(c), "right") - 1]) for c in word if c.isalpha()]
            yield [framed[i : i + 3] for i in range(m.start(), m.end())], len(scripts), max(scripts, default=0)

    @functools.cache
    def bucket(gram):
        chunk = next(words.chunks(pa.array([gram[1:] + b"x"])))
        return int(language.buckets_of_bytes(chunk)[0]) if gram[0] == 32 else int(language.buckets_of_bytes(next(words.chunks(pa.array([gram]))))[1])

    counts, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for r in rows:
        if r.lang in counts and not held_out("" if r.doc_id is None else r.doc_id):
            for grams_, n, kind in pieces(r.text or ""):
                if n:
                    scripts[r.lang][kind] += 1
                    for g in grams_:
                        counts[r.lang][bucket(g)] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    cost = lambda x, b: math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * language.BUCKETS))
    usual = {x: {k for k, n in c.items() if n >= language.SCRIPT_SHARE * max(1, sum(c.values()))} for x, c in scripts.items()}

    def predict(text):
        best, letters = None, []
        back = []
        for grams_, n, kind in pieces(text or ""):
            some = any(kind in usual[x] for x in langs)
            own = [(sum(cost(x, bucket(g)) for g in grams_) - (1e4 if some and kind not in usual[x] else 0)) if n else 0.0 for x in langs]
            letters.append(n)
            if best is None:
                best = own
            else:
                top = max(best) - language.PENALTY
                back.append([i if best[i] >= top else best.index(max(best)) for i in range(len(langs))])
                best = [max(b, top) + o for b, o in zip(best, own, strict=True)]
        if not sum(letters):
            return "und", 0.0
        at = best.index(max(best))
        by = [0] * len(langs)
        for i in range(len(letters) - 1, -1, -1):
            by[at] += letters[i]
            if i:
                at = back[i - 1][at]
        return langs[by.index(max(by))], max(by) / sum(by)

    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify(df).collect())
    assert got == Counter((r.doc_id, *(lambda p: (p[0], round(p[1], 6)))(predict(r.text))) for r in rows)


def test_attention_finds_the_bad_passage():
    rng = random.Random(2)
    good = [sentence(rng, "aa", 300) for _ in range(60)]
    bad = [sentence(rng, "aa", 128) + " " + "$$ ## " * 32 + sentence(rng, "aa", 108) for _ in range(60)]
    chunk = next(words.chunks(pa.array([t.encode() for t in good + bad])))
    x, row = quality_model.passages(chunk)
    y = np.r_[np.ones(60), np.zeros(60)]
    model = quality_model.learn(x, row, y)
    f = model.forward(x, row, 120)
    assert ((f["y"] >= 0.5) == (y == 1)).all()
    assert np.allclose(np.bincount(row, f["share"]), 1)
    assert np.mean([np.argmax(f["share"][row == i]) in (2,) for i in range(60, 120)]) > 0.8


def test_passages_do_not_depend_on_neighbours():
    rng = random.Random(3)
    texts = [sentence(rng, "bb", n).encode() for n in (0, 1, 63, 64, 65, 300)] + [b"  \n x", b""]
    together, row = quality_model.passages(next(words.chunks(pa.array(texts))))
    for i, t in enumerate(texts):
        alone, _ = quality_model.passages(next(words.chunks(pa.array([t]))))
        assert np.array_equal(together[row == i], alone)


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\n", "a", "a b", "a b c a b c", "x\ny\nx\n x\nx ", "é ü|<>　ж", "a a a a", "\x0b\x1cz\n"]
    texts += ["".join(rng.choice("ab c\n#é") for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_decision_list(corpus):
    docs, labels, by = corpus
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == 405
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    test = [(r.kept, by[r.doc_id][1] == 1) for r in got if r.doc_id in by and held_out(r.doc_id)]
    assert sum(a == b for a, b in test) / len(test) >= 0.95


def test_rules_match_their_columns(spark, corpus):
    docs, labels, _ = corpus
    rules = quality_rules.fit(docs, labels)
    assert rules and all(rules)
    rows = quality_rules.statistics(docs).withColumn("v", quality_rules.verdict(rules)).toPandas()
    x = quality_rules.ratio_matrix({c: rows[c].to_numpy() for c in quality_rules.COUNTS})
    want = np.zeros(len(x), int)
    for i, rule in reversed(list(enumerate(rules, 1))):
        want[quality_rules.covers(rule, x)] = i
    assert (rows["v"].to_numpy() == want).all()
    assert quality_rules.learn({c: np.zeros(0, int) for c in quality_rules.COUNTS}, np.zeros(0, int)) == []
    assert quality_rules.judge(docs, labels.where("false")).where("rule <> 0").count() == 0


def test_language(corpus):
    docs, _, _ = corpus
    got = {(r.doc_id, r.lang_pred): r for r in language.identify(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 1000}
    good = [k for k in got if k[0] is not None and k[0] < 1000 and k[0] != 5 and want[k[0]] == k[1]]
    assert len(good) >= 0.98 * 399
    assert {k[1] for k in got if k[0] in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 and (r.doc_id is None or r.held_out == held_out(r.doc_id)) for r in got.values())


def test_language_spans(spark, corpus):
    docs, _, _ = corpus
    model = language.fit(docs)
    rng = random.Random(6)
    parts = [sentence(rng, "aa", 40), sentence(rng, "bb", 60), sentence(rng, "cc", 30)]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text, None, None, None, None, None), (2, "", None, None, None, None, None)], DOCS)
    r = {x.doc_id: x for x in language.label(df, model, spans=True).collect()}
    assert [s.lang for s in r[1].spans] == ["aa", "bb", "cc"] and r[2].spans == []
    raw = text.encode()
    assert [raw[s.start : s.end].decode() for s in r[1].spans] == parts
    assert model.allowed[3].tolist() == [False, False, True]
    assert language.identify(docs.where("false")).count() == 0
    assert {x.lang_pred for x in language.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.mark.parametrize("block", [1, 3, 7, 256])
def test_viterbi(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(60):
        count = rng.integers(0, 16, 7)
        scores, penalty, at = rng.normal(0, 3, (count.sum(), 3)), 2.0, 0
        path = language.viterbi(scores, count, penalty)
        for c in count:
            s, p = scores[at : at + c], path[at : at + c]
            at += c
            if c:
                best = s[0].copy()
                for i in range(1, c):
                    best = np.maximum(best, best.max() - penalty) + s[i]
                got = s[np.arange(c), p].sum() - penalty * (p[1:] != p[:-1]).sum()
                assert got == pytest.approx(best.max())


def test_scripts():
    text = "aé жЩ ελ 漢字 かな 한글 ש ع ह 42 ×÷ 😀 𝐀"
    data = np.frombuffer(text.encode(), np.uint8)
    letter, script = language.scripts_of_bytes(data)
    at = np.cumsum([0, *(len(c.encode()) for c in text)])[:-1]
    by = {c: int(script[i]) for c, i in zip(text, at, strict=True)}
    assert by["a"] == by["é"] == 1 and by["ж"] == by["Щ"] == 3 and by["ε"] == 2 and by["漢"] == 17 and by["か"] == 15 and by["한"] == 13
    assert [by[c] for c in " 42×÷😀"] == [0] * 6
    assert [bool(letter[i]) for i in at] == [c.isalpha() for c in text]


WITHOUT_LETTERS = ["١٢٣", "०१२३", "\u0301\u0300 \u0323", "⸺ ⸺", "\u037e", "\U00010100\U00010102", "42 17!", "×÷ 😀", "ּ ֱ", "㈠ 〇", "\u2160 \u00b2"]


def test_texts_without_letters_are_undetermined(spark, corpus):
    """Digits, marks and signs of any script are no letters; letters of rare scripts are."""
    docs, _, _ = corpus
    model = language.fit(docs)
    texts = [*WITHOUT_LETTERS, "\u2102", "ª", "ꓐꓑ", "𝐀", "ᏣᎳᎩ", "42 x"]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.label(df, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i][0] == "und") == (not any(c.isalpha() for c in t)) == (got[i][1] == 0.0), t


def test_most_frequent_languages(spark, corpus):
    docs, _, _ = corpus
    known = Counter(r.lang for r in docs.collect() if r.lang and not (r.doc_id is not None and held_out(r.doc_id)))
    want = sorted(known, key=lambda x: (-known[x], x))[:2]
    assert language.fit(docs, most=2).languages == sorted(want)


def test_samples_of_rows_that_share_an_id(spark):
    """An id that very many rows share, or none, neither fills a sample nor is left out of it."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    ids = [i for i in range(99) if not held_out(i)][:3] + [i for i in range(99) if held_out(i)][:2]
    rows = [(i, text(), "aa", "s", None, None, None) for i in ids] + [(ids[0], text(), "aa", "s", None, None, None) for _ in range(500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id bigint, quality int, toxic int")
    got = training_texts(spark.createDataFrame(rows, DOCS).repartition(3), labels, "quality", 100).collect()
    assert sorted(r.doc_id for r in got) == ids[:3] and all(bytes(r.text).decode() in {t for i, t, *_ in rows if i == r.doc_id} for r in got)
    again = training_texts(spark.createDataFrame(rows[::-1], DOCS), labels, "quality", 100).collect()
    assert {(r.doc_id, bytes(r.text)) for r in again} == {(r.doc_id, bytes(r.text)) for r in got}
    nameless = spark.createDataFrame([(None, text(), "aa", "s", None, None, None) for _ in range(2000)], DOCS)
    column = language.fit(nameless, sample=100).table[:, 0]
    assert 300 < int((column > column.min()).sum()) < 2500


def reference_encoding():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path, pattern = bpe.vocabulary()
    return path, pattern, public_tokenizers


def test_very_long_runs_are_encoded():
    """A million characters of one class, for which the library's own split may run out of stack."""
    path, pattern, _ = reference_encoding()
    enc = bpe.encoding(bpe.read_ranks(path), pattern)
    n = 10**6
    for c in (" ", "\n", "\t", "\u3000", "\r\n", " \n"):
        for text in (c * n, "a" + c * n, c * n + "b", "a" + c * n + " b" + c * n + "\nc"):
            ids = enc.encode(text)
            assert enc.decode(ids) == text.encode()
        # The run is one match but for its last character, which goes to what follows.
        want = enc.single.encode_ordinary((c * n)[:-1]) + enc.own.encode_ordinary(c[-1] + "b")
        assert enc.encode(c * n + "b") == want and enc.encode(c * n) == enc.single.encode_ordinary(c * n)
    for c in ("x", "漢", "1", "!", "'s", "é1", "\x1c", "a ", "😀"):
        assert enc.encode(c * n) == enc.own.encode_ordinary(c * n)


def test_long_runs_as_the_library_does(monkeypatch):
    """With small limits, on texts that the library splits by itself."""
    path, pattern, _ = reference_encoding()
    enc = bpe.encoding(bpe.read_ranks(path), pattern)
    monkeypatch.setattr(bpe, "PIECE", 30)
    monkeypatch.setattr(bpe, "_LONG_WHITE", re.compile(f"[{bpe.WHITE}]{{3,}}"))
    rng = random.Random(10)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b'", "s", " ", "\n", "\u3000", "1", "\x1c", "\x85", "é", "'ll"]) * rng.choice([1, 1, 2, 5]) for _ in range(80))
        assert enc.encode(text) == enc.own.encode_ordinary(text)


def test_other_patterns_are_not_cut(monkeypatch):
    path, _, _ = reference_encoding()
    enc = bpe.encoding(bpe.read_ranks(path), r"\S+ |\S+|\s")
    monkeypatch.setattr(bpe, "PIECE", 20)
    text = "some words and more of them " * 9
    assert enc.encode(text) == enc.own.encode_ordinary(text)


def merge(piece, ranks):
    """Plain byte-level BPE of one match."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 10**9:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_bpe(spark):
    import hashlib

    import regex

    path, pattern, _ = reference_encoding()
    ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in open(path, "rb"))}
    rng = random.Random(8)
    texts = [None, "", " ", "it's  we'll\n\n x", "Größe 漢字 😀 <|endoftext|>", "a　b  c", "\t \t", "x" * 50] + ["".join(rng.choice("abc 'st\n1é!  ") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r for r in bpe.round_trip(df, path, pattern, emit_ids=True).collect()}
    plain = {r.doc_id: r for r in bpe.encode(df, path, pattern).collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect()}
    for i, t in enumerate(texts):
        want = [x for m in regex.finditer(pattern, t or "") for x in merge(m[0].encode(), ranks)]
        assert got[i].token_ids == want == plain[i].token_ids and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and back[i] == (t or "").encode()
    assert bpe.round_trip(df.where("false"), path, pattern).count() == 0


def test_long_texts_are_cut_safely(monkeypatch):
    path, pattern, _ = reference_encoding()
    enc = bpe.encoding(bpe.read_ranks(path), pattern)
    rng = random.Random(9)
    for size in (7, 23):
        for _ in range(150):
            text = "".join(rng.choice(["a", "b'", "s", " ", "  ", "\n", "1", "!", "é", "　", "'ll"]) for _ in range(120))
            pieces = list(bpe.safe_pieces(text, size))
            assert "".join(pieces) == text
            assert [x for p in pieces for x in enc.own.encode_ordinary(p)] == enc.own.encode_ordinary(text)
    monkeypatch.setattr(bpe, "PIECE", 50)
    long = "word and more  " * 5000 + "y" * 30000
    assert enc.encode(long) == enc.own.encode_ordinary(long)
