"""Quality rules: a learned decision list over statistics of the text.

Rules that reject are learned by sequential covering in the manner of RIPPER (Cohen, 1995): a rule
grows condition by condition (statistic at least or at most a threshold) by information gain on one
part of the labelled rows, is pruned from its end on the other part, and the rows that it covers are
taken away. The list is applied as ordered conditional expressions of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import grams, words
from docloom.llm.common import ship, table
from docloom.llm.labelled import training_texts

#: Labelled documents to learn from at most; rules and conditions at most; rows that a rule covers at least.
SAMPLE, MOST_RULES, MOST_CONDITIONS, SUPPORT, SEED = 20000, 12, 4, 5, 3
#: A rule joins the list if at least this share of the rows under it are bad, in both parts.
PRECISION = 0.9
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_upper", "n_digits", "n_marks", "n_adjacent"]
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT[ord("0") : ord("9") + 1] = 1
_MARK[list(b"!?")] = 1
_WORD_CHAR = (~words.BLANK).astype(np.int64)
_WORD_CHAR[0x80:0xC0] = 0


def _by_row(chunk: words.Chunk, table_: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table_[chunk.data], chunk.bounds[:-1])


def _twice(row: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which (row, name) occur more than once."""
    order = np.lexsort((names, row))
    r, n = row[order], names[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (n[1:] == n[:-1])
    many = same.copy()
    many[:-1] |= same[1:]
    out = np.empty(len(r), bool)
    out[order] = many
    return out


def statistics_of(chunk: words.Chunk) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk."""
    names = chunk.hashes()
    out = {"n_words": chunk.count, "n_bytes": np.diff(chunk.bounds) - 1}
    for name, t in (("word_chars", _WORD_CHAR), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = _by_row(chunk, t)
    ends = np.flatnonzero(chunk.data == 0x0A)
    begins = np.r_[0, ends[:-1] + 1]
    row = np.searchsorted(chunk.bounds, begins, "right") - 1
    filled = np.searchsorted(chunk.start, ends) > np.searchsorted(chunk.start, begins)
    begins, ends, row = begins[filled], ends[filled], row[filled]
    room = 1 << max(20, int(len(chunk.data) + 1).bit_length())
    line = grams.span_hash(grams.prefix_sums(grams.BYTE_NAMES[1][chunk.data], room), begins, ends, room)
    out["n_lines"] = np.bincount(row, minlength=chunk.rows)
    order = np.lexsort((line, row))
    again = np.zeros(len(order), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (line[order][1:] == line[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=chunk.rows)
    n = len(names)
    covered = np.zeros(n, bool)
    adjacent = np.zeros(n, bool)
    if n:
        adjacent[1:] = (names[1:] == names[:-1]) & (chunk.row[1:] == chunk.row[:-1])
        at = np.flatnonzero(chunk.row[: n - 2] == chunk.row[2:]) if n > 2 else np.empty(0, np.int64)
        window = grams.mix64(grams.pair(grams.pair(names[at], names[at + 1], 0, 1), names[at + 2], 0, 2)) if len(at) else np.empty(0, np.uint64)
        found = at[_twice(chunk.row[at], window)]
        for k in range(3):
            covered[found + k] = True
    out["n_repeat_words"] = np.bincount(chunk.row, covered, minlength=chunk.rows).astype(np.int64)
    out["n_adjacent"] = np.bincount(chunk.row, adjacent, minlength=chunk.rows).astype(np.int64)
    return out


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of ``carry`` and the counts of each row; a null text has none of anything. One pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics_of(chunk) for chunk in words.chunks(batch.column(0))]
            cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *COUNTS])

    src = docs.select(F.col("text").cast("binary").alias("_text"), "doc_id", *[c for c in carry if c != "doc_id"])
    return src.mapInArrow(run, ", ".join([f"`{c}` {kind}" for c, kind in src.dtypes[1:]] + [f"{c} bigint" for c in COUNTS]))


#: Statistics that conditions may use: name, numerator, denominator; 0 where the denominator is 0.
RATIOS = [
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "word_chars"),
    ("mark_share", "n_marks", "word_chars"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("adjacent_share", "n_adjacent", "n_words"),
    ("line_words", "n_words", "n_lines"),
]


def ratio_column(name: str) -> Column:
    _, top, below = next(r for r in RATIOS if r[0] == name)
    if below is None:
        return F.col(top).cast("double")
    return F.when(F.col(below) == 0, F.lit(0.0)).otherwise(F.col(top) / F.greatest(F.col(below), F.lit(1)))


def ratio_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    cols = []
    for _, top, below in RATIOS:
        x = counts[top].astype(np.float64)
        cols.append(x if below is None else np.where(counts[below] == 0, 0.0, x / np.maximum(1, counts[below])))
    return np.stack(cols, axis=1)


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, [r[0] for r in RATIOS].index(self.statistic)]
        return values >= self.threshold if self.at_least else values <= self.threshold

    def column(self) -> Column:
        c = ratio_column(self.statistic)
        return c >= self.threshold if self.at_least else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of the greatest gain until no good row is covered or nothing is gained."""
    rule: Rule = ()
    live = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best, best_gain = None, 1e-9
        for k, (name, _, _) in enumerate(RATIOS):
            v, b = x[live, k], bad[live]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cut):
                continue
            p_below, below = np.cumsum(b)[cut - 1], cut
            for at_least, p, n in ((True, p0 - p_below, n0 - (below - p_below)), (False, p_below, below - p_below)):
                enough = p >= SUPPORT
                gain = np.where(enough, p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))), -1)
                i = int(np.argmax(gain))
                if gain[i] > best_gain:
                    low, high = v[cut[i] - 1], v[cut[i]]
                    best, best_gain = Condition(name, at_least, float((low + high) / 2)), gain[i]
        if best is None:
            break
        rule += (best,)
        live &= best.holds(x)
    return rule


def _pure(x: np.ndarray, bad: np.ndarray) -> Rule:
    """The one condition that covers most bad rows and no good one, half-way to the nearest good row."""
    best, most = (), SUPPORT - 1
    for k, (name, _, _) in enumerate(RATIOS):
        for at_least, v in ((True, x[:, k]), (False, -x[:, k])):
            edge = v[~bad].max() if (~bad).any() else v.min() - 1
            above = v[bad & (v > edge)]
            if len(above) > most:
                middle = float(edge + above.min()) / 2
                best, most = (Condition(name, at_least, middle if at_least else -middle),), len(above)
    return best


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = covers(rule, x)
    p, n = (c & bad).sum(), (c & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _sure(rule: Rule, x: np.ndarray, bad: np.ndarray) -> bool:
    c = covers(rule, x)
    return (c & bad).sum() >= PRECISION * c.sum()


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, part: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on; none if none is sure enough."""
    options = [rule[:k] for k in range(1, len(rule) + 1)]
    options = [r for r in options if _sure(r, x[part], bad[part]) and _sure(r, x[~part], bad[~part])]
    return max(options, key=lambda r: _worth(r, x[~part], bad[~part]), default=())


def learn(counts: dict[str, np.ndarray], quality: np.ndarray, seed: int = SEED) -> list[Rule]:
    """Rules that reject, in order. Without bad rows, or where no rule is sure enough, fewer or none."""
    x, bad = ratio_matrix(counts), quality == 0
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and (bad & part).sum() >= SUPPORT:
        options = [_prune(r, x, bad, part) for r in (_grow(x[part], bad[part]), _pure(x[part], bad[part]))]
        rule = max(options, key=lambda r: ((c := covers(r, x)) & bad).sum() - (c & ~bad).sum() if r else -1)
        if not rule:
            break
        rules.append(rule)
        keep = ~covers(rule, x)
        x, bad, part = x[keep], bad[keep], part[keep]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule (from 1) that rejects the row, else 0, as one conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = F.when(condition, i) if out is None else out.when(condition, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents outside fold 1; their counts go to the driver."""
    texts = training_texts(docs, labels, "quality", sample)
    got = statistics(texts, ("quality",)).toPandas().sort_values(["doc_id", *COUNTS])
    return learn({c: got[c].to_numpy() for c in COUNTS}, got["quality"].to_numpy())


def base_rules(counts: DataFrame) -> DataFrame:
    """``counts`` with base_failed: fewer than 50 words, or more than half of them in repeated windows."""
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts, base_failed, rule (0: none) and kept for each row of ``docs``.

    A null or empty text has no words and so fails the base rules. A row's result follows from its
    text alone, so equal texts get equal results; null and repeated ids stay rows of their own, other
    columns are ignored, no rows give none. Texts of any length are counted whole, in memory of about
    60 bytes a byte.
    """
    rules = fit(docs, labels, sample)
    out = base_rules(statistics(docs))
    out = out.withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts under op6 and its base rules, without the learned list."""
    out = base_rules(statistics(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


STATISTICS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
s AS (SELECT l.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM l LEFT JOIN c ON c.doc_id = l.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
