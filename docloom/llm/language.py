"""Language identification: script ranges, scores of single words, and Viterbi over them.

Byte trigrams of words are counted for each language on a bounded sample of labelled texts. A
word's letters give its script, which leaves those languages that use the script. The best path of
languages over a text's words, with a penalty for each switch, labels its spans; the language of
most letters is the text's.

Texts are cut into blocks of 256 words. A block gives its best path from every language before it
to every language at its end, for all blocks of a chunk at once; blocks are then joined in order.
So the work is the same for one long text as for many short ones.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import grams, words
from docloom.llm.common import fold, ship, table

#: Labelled texts of each language to learn from, about; languages to learn at most (the most
#: frequent ones); buckets of trigrams; cost of a switch.
SAMPLE, MOST_LANGUAGES, BUCKETS, PENALTY = 2000, 128, 1 << 16, 12.0
#: Words of a block, and numbers that a step over blocks holds at most.
BLOCK, ROOM = 256, 1 << 22
#: A language is a candidate for a script that at least this share of its words is written in.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
#: First code points of script ranges (Unicode blocks) and the script of each;
#: 0 stands for no script of these, 1 for Latin. They only choose candidates: what is a letter
#: follows from the Unicode category.
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00BA, 1), (0x00BB, 0),
    (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5),
    (0x0600, 6), (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0E00, 10), (0x0E80, 11), (0x10A0, 12), (0x1100, 13), (0x1200, 14),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 3), (0x3000, 0), (0x3040, 15), (0x3100, 16), (0x3130, 13), (0x3190, 16),
    (0x3400, 17), (0xA000, 16), (0xAC00, 13), (0xD7B0, 0), (0xF900, 17), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0x10000, 18), (0x1F000, 0), (0x20000, 17), (0xE0000, 0),
]
_FIRST, _SCRIPT = (np.array(x) for x in zip(*SCRIPTS, strict=True))
N_SCRIPTS = int(_SCRIPT.max()) + 1


@functools.cache
def letter_table() -> np.ndarray:
    """Which code points are letters (categories L*)."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def scripts_of_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter begins at each byte, and its script; 0 at other bytes."""
    script = np.zeros(len(data), np.int8)
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A) & (data < 0x80)
    script[letter] = 1
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b = data[at].astype(np.int64)
        size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        point = b & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point = np.where(more, point << 6 | data[np.minimum(at + k, len(data) - 1)] & 0x3F, point)
        point = np.minimum(point, 0x10FFFF)
        letter[at] = letter_table()[point]
        script[at] = np.where(letter[at], _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1], 0)
    return letter, script


def buckets_of_bytes(chunk: words.Chunk) -> np.ndarray:
    """Bucket of the lower-cased trigram that begins at each byte, white space being one sign."""
    data = np.where(words.BLANK[chunk.data], np.uint8(32), words.LOWER[chunk.data])
    data = np.concatenate([np.array([32], np.uint8), data, np.array([32, 32], np.uint8)])
    two = grams.doubled(data, 2)
    return (grams.mix64(grams.pair(two[:-1], grams.BYTE_NAMES[0][data[2:]], 0, 2)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    #: log probability of a bucket (BUCKETS, languages), and candidates (scripts, languages)
    table: np.ndarray
    allowed: np.ndarray


def learn(rows: list[tuple[str, int, int, int]], languages: list[str]) -> Model:
    """From (language, kind, key, count): kind 0 counts trigram buckets, kind 1 words of a script."""
    k = len(languages)
    index = {x: i for i, x in enumerate(languages)}
    counts, scripts = np.zeros((BUCKETS, k)), np.zeros((N_SCRIPTS, k))
    for language, kind, key, n in rows:
        (counts if kind == 0 else scripts)[key, index[language]] += n
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS) if k else counts
    usual = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(languages, np.log(share).astype(np.float32) if k else share.astype(np.float32), usual)


def word_scores(chunk: words.Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) log scores, 0 for words without letters, and letters of each word."""
    letter, script = scripts_of_bytes(chunk.data)
    n = len(chunk.start)
    k = len(model.languages)
    if not n:
        return np.zeros((0, k)), np.zeros(0, np.int64)
    sums = np.r_[0, np.cumsum(letter)]
    letters = sums[chunk.end] - sums[chunk.start]
    kind = np.maximum.reduceat(script, chunk.start)  # up to the next word; blanks between are 0
    bucket = buckets_of_bytes(chunk)
    out = np.empty((n, k))
    for i in range(k):
        total = np.r_[0.0, np.cumsum(model.table[:, i][bucket], dtype=np.float64)]
        out[:, i] = total[chunk.end] - total[chunk.start]
    candidates = model.allowed[kind]
    out -= np.where(candidates | ~candidates.any(axis=1, keepdims=True), 0.0, 1e4)
    out[letters == 0] = 0
    return out, letters


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word; ``count`` words a text, in order. Ties go to the first language.

    First every block gives the value of its best path from each language to each, then the blocks of
    a text are joined in order, then the path inside each block follows from its known ends. What is
    kept for a word is one truth value a language.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-count // BLOCK)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), blocks)
    base = np.cumsum(blocks) - blocks
    nth = np.arange(len(text)) - np.repeat(base, blocks)
    begin = first[text] + nth * BLOCK
    size = np.minimum(BLOCK, (first + count)[text] - begin)
    order = np.argsort(-size, kind="stable")  # blocks with more than t words come first
    active = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), "right")
    enter = np.where(np.eye(k, dtype=bool), 0.0, -penalty)
    value = np.empty((len(text), k, k))
    step = max(1, ROOM // (k * k))
    for low in range(0, len(order), step):
        own = order[low : low + step]
        v = enter[None] + scores[begin[own]][:, None, :]
        for t in range(1, int(size[own[0]])):
            m = min(len(own), int(active[t]) - low)
            part = v[:m]
            v[:m] = np.maximum(part, part.max(axis=2, keepdims=True) - penalty) + scores[begin[own[:m]] + t][:, None, :]
        value[own] = v
    # Join the blocks of a text: the best score at the end of each, and the language before it. The
    # first block may begin in any language: the penalty of its first word is not due.
    before, after = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    reach = np.full((len(count), k), -np.inf)
    came = []
    most = int(blocks.max())
    for b in range(most):
        who = np.flatnonzero(blocks > b)
        paths = value[base[who] + b] if b == 0 else reach[who][:, :, None] + value[base[who] + b]
        came.append(paths.argmax(axis=1))
        reach[who] = paths.max(axis=1)
    last = reach.argmax(axis=1)
    for b in range(most - 1, -1, -1):
        who = np.flatnonzero(blocks > b)
        after[base[who] + b] = last[who]
        last[who] = before[base[who] + b] = came[b][np.arange(len(who)), last[who]]
    # The path inside a block, from the language before it to that at its end.
    own = order
    v = enter[before[own]] + scores[begin[own]]
    kept, source = [None], [None]
    for t in range(1, len(active)):
        m = int(active[t])
        part = v[:m]
        top = part.max(axis=1, keepdims=True) - penalty
        kept.append(part >= top)
        source.append(part.argmax(axis=1))
        v[:m] = np.maximum(part, top) + scores[begin[own[:m]] + t]
    out = np.zeros(n, np.int64)
    now = after[own]
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        out[begin[own[:m]] + t] = now[:m]
        if t:
            now[:m] = np.where(kept[t][np.arange(m), now[:m]], now[:m], source[t])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, kind, key, n), summed over the task."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for chunk in words.chunks(batch.column(1)):
            bucket, (letter, script) = buckets_of_bytes(chunk), scripts_of_bytes(chunk.data)
            if not len(chunk.start):
                continue
            kind = np.maximum.reduceat(script, chunk.start)
            sums = np.r_[0, np.cumsum(letter)]
            lettered = sums[chunk.end] > sums[chunk.start]
            own = langs[chunk.first : chunk.first + chunk.rows]
            # Trigrams that begin at the blank before a word's letters and up to its last letter.
            inside = np.zeros(len(chunk.data) + 1, np.int64)
            np.add.at(inside, chunk.start[lettered], 1)
            np.add.at(inside, chunk.end[lettered], -1)
            inside = np.cumsum(inside)[:-1] > 0
            for lang in set(own):
                rows = np.flatnonzero(own == lang)
                t = totals.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                byte_rows = np.isin(np.searchsorted(chunk.bounds, np.arange(len(chunk.data)), "right") - 1, rows)
                t[0][:] += np.bincount(bucket[: len(chunk.data)][inside & byte_rows], minlength=BUCKETS)
                t[1][:] += np.bincount(kind[lettered & np.isin(chunk.row, rows)], minlength=N_SCRIPTS)
    for lang, parts in totals.items():
        for kind, counts in enumerate(parts):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(counts[at])], names=["lang", "kind", "key", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_LANGUAGES) -> Model:
    """Learn from about ``sample`` texts of each language outside fold 1, drawn by a hash of doc_id and text.

    The text takes part so that rows which share an id, or have none, are not drawn all or none.

    Of more than ``most`` languages the most frequent ones are learned (ties: those whose names are
    first). The driver gets at most ``most`` x (buckets + scripts) counts.
    """
    ship(docs.sparkSession)
    known = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not sizes:
        return learn([], [])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20).cast("bigint"))
    share = None
    for lang, n in sorted(sizes.items()):
        limit = F.lit(min(1 << 20, -(-sample * (1 << 20) // n)))
        share = F.when(F.col("lang") == lang, limit) if share is None else share.when(F.col("lang") == lang, limit)
    texts = known.where(draw < share).select("lang", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_counts, "lang string, kind int, key bigint, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    return learn(list(zip(got["lang"], got["kind"], got["key"], got["n"], strict=True)), sorted(sizes))


def label(docs: DataFrame, model: Model, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of ``carry``, lang_pred, score and, if asked for, spans (start and end byte, lang).

    ``und`` with score 0 where a text is null or has no letter (of a Unicode category L*), or nothing
    was learned. The score is the share of the letters that the path gives to the language. Ties go to
    the language whose name is first; equal texts give equal rows; no rows give none. Texts of any
    length are taken whole, in memory of about 60 bytes a byte and language. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    languages = np.array([*model.languages, UNKNOWN], object)
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, found = np.full(batch.num_rows, k), np.zeros(batch.num_rows), []
            for chunk in words.chunks(batch.column(0)):
                if not k:
                    found += [[] for _ in range(chunk.rows)]
                    continue
                scores, letters = word_scores(chunk, model)
                path = viterbi(scores, chunk.count)
                by = np.bincount(chunk.row * k + path, np.maximum(letters, 0), minlength=chunk.rows * k).reshape(chunk.rows, k)
                total = by.sum(axis=1)
                some = total > 0
                at = slice(chunk.first, chunk.first + chunk.rows)
                pred[at] = np.where(some, by.argmax(axis=1), k)
                score[at] = np.where(some, by.max(axis=1) / np.maximum(1, total), 0.0)
                if spans:
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (chunk.row[1:] != chunk.row[:-1])
                    first = np.flatnonzero(new)
                    last = np.r_[first[1:] - 1, len(path) - 1] if len(first) else first
                    rows = [[] for _ in range(chunk.rows)]
                    for a, b in zip(first.tolist(), last.tolist(), strict=True):
                        r = int(chunk.row[a])
                        if some[r]:
                            rows[r].append({"start": int(chunk.start[a] - chunk.bounds[r]), "end": int(chunk.end[b] - chunk.bounds[r]), "lang": languages[path[a]]})
                    found += rows
            cols = [*batch.columns[1:], pa.array(languages[pred], pa.string()), pa.array(score)]
            names = [*batch.schema.names[1:], "lang_pred", "score"]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col("text").cast("binary").alias("_text"), "doc_id", *[c for c in carry if c != "doc_id"])
    more = ", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else ""
    return src.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in src.dtypes[1:]) + ", lang_pred string, score double" + more)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang)."""
    out = label(docs, fit(docs, sample))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
