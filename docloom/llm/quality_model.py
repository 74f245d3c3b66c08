"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by shares of byte classes and
by statistics of its words, then by a learned layer. Gated attention (Ilse, Tomczak and Welling,
2018) learns from document labels alone how much each passage counts; the weighted passage
representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import words
from docloom.llm.common import fold, ship, table
from docloom.llm.labelled import training_texts

PASSAGE = 64
#: Labelled documents to learn from at most, and how.
SAMPLE, EPOCHS, RATE, DECAY, SEED = 4000, 200, 0.02, 1e-4, 5
#: Passages of a document to learn from at most, spread evenly over it; scores take all passages.
MOST_PASSAGES = 128
HIDDEN, ATTENTION = 16, 8
#: Signs that get a class of their own; other bytes: letters of either case, digits, blanks, line
#: ends, the rest of ASCII, and bytes of longer characters.
SIGNS = b"!#$%&*|<>@.,;:?-_/\\\"'()[]{}=+~^"
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[128:] = 6
for _i, _b in enumerate(SIGNS):
    _CLASS[_b] = 7 + _i
CLASSES = 7 + len(SIGNS)
FEATURES = CLASSES + 8


def passages(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, row of each passage); a text without words has one empty passage."""
    size = np.maximum(1, -(-chunk.count // PASSAGE))
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(chunk.rows), size)
    n = len(row)
    place = np.arange(len(chunk.row)) - (np.cumsum(chunk.count) - chunk.count)[chunk.row]
    of_word = first[chunk.row] + place // PASSAGE
    # A passage's bytes go from its first word to the next passage's; the first has what stands before.
    begin = np.full(n, -1, np.int64)
    begin[first] = chunk.bounds[:-1]
    inner = place % PASSAGE == 0
    later = inner & (place > 0)
    begin[of_word[later]] = chunk.start[later]
    length = np.diff(np.r_[begin, chunk.bounds[-1]])
    byte_passage = np.repeat(np.arange(n), length)
    counts = np.bincount(byte_passage * CLASSES + _CLASS[chunk.data], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    out = np.zeros((n, FEATURES))
    total = np.maximum(1, length)[:, None]
    out[:, :CLASSES] = np.sqrt(counts / total)
    names = chunk.hashes()
    w = np.bincount(of_word, minlength=n).astype(np.float64)
    safe = np.maximum(1, w)
    long = (chunk.end - chunk.start).astype(np.float64)
    again = np.zeros(len(names), bool)
    again[1:] = (names[1:] == names[:-1]) & (chunk.row[1:] == chunk.row[:-1])
    key = np.sort(of_word.astype(np.uint64) << np.uint64(40) | names >> np.uint64(24))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    mean = np.bincount(of_word, long, minlength=n) / safe
    upper = _CLASS[chunk.data[chunk.start]] == 1 if len(names) else again
    out[:, CLASSES:] = np.stack(
        [
            np.log1p(w) / 4,
            np.bincount(of_word, again, minlength=n) / safe,
            distinct / safe,
            mean / 8,
            np.sqrt(np.maximum(0, np.bincount(of_word, long**2, minlength=n) / safe - mean**2)) / 4,
            np.bincount(of_word, upper, minlength=n) / safe,
            np.bincount(of_word, long <= 2, minlength=n) / safe,
            np.bincount(of_word, long >= 12, minlength=n) / safe,
        ],
        axis=1,
    )
    return out, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class GatedAttention:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, row: np.ndarray, docs: int) -> dict[str, np.ndarray]:
        """All that is between features (passages sorted by document) and scores."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["w"] + w["b"])
        t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * s) @ w["a"]
        starts = np.searchsorted(row, np.arange(docs))
        e = np.exp(e - np.maximum.reduceat(e, starts)[row])
        share = e / np.add.reduceat(e, starts)[row]
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "share": share, "z": z, "y": _sigmoid(z @ w["c"] + w["d"]), "starts": starts}

    def score(self, x: np.ndarray, row: np.ndarray, docs: int) -> np.ndarray:
        return self.forward(x, row, docs)["y"]


def learn(x: np.ndarray, row: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> GatedAttention:
    """Full-batch Adam on the log loss; with no labels, or one class only, scores stay near its share."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    w = {"w": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(())}
    if not len(labels):
        return GatedAttention(np.zeros(FEATURES), np.ones(FEATURES), w)
    model = GatedAttention(x.mean(axis=0), x.std(axis=0) + 1e-2, w)
    docs = len(labels)
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in w.items()}
    for epoch in range(1, epochs + 1):
        f = model.forward(x, row, docs)
        dy = (f["y"] - labels) / docs
        grads = {"c": f["z"].T @ dy, "d": dy.sum()}
        dz = (dy[:, None] * w["c"])[row]
        dshare = (dz * f["h"]).sum(axis=1)
        de = f["share"] * (dshare - np.add.reduceat(f["share"] * dshare, f["starts"])[row])
        gate = f["t"] * f["s"]
        grads["a"] = gate.T @ de
        dgate = de[:, None] * w["a"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        grads["v"], grads["u"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["share"][:, None] * dz + dt @ w["v"].T + ds @ w["u"].T
        dx = dh * (1 - f["h"] ** 2)
        grads["w"], grads["b"] = f["x"].T @ dx, dx.sum(axis=0)
        for k, g in grads.items():
            g = g + DECAY * w[k]
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            moments[k] = (m, v)
            w[k] = w[k] - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, quality) to (label, features of passages as float32 bytes), a row for each document."""
    for batch in batches:
        labels = batch.column(2)
        for chunk in words.chunks(batch.column(1)):
            x, row = passages(chunk)
            begin = np.searchsorted(row, np.arange(chunk.rows + 1))
            x = x.astype(np.float32)
            spread = [a + np.arange(min(b - a, MOST_PASSAGES)) * (b - a) // min(b - a, MOST_PASSAGES) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.rows), labels.slice(chunk.first, chunk.rows), pa.array([x[s].tobytes() for s in spread], pa.binary())],
                names=["doc_id", "label", "x"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention:
    """Learn from at most ``sample`` labelled documents outside fold 1, on the driver.

    Of a long document ``MOST_PASSAGES`` passages take part, so the sample is at most ``sample`` x
    ``MOST_PASSAGES`` x 200 bytes (100 MB), some 20 MB for usual texts.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    got = training_texts(docs, labels, "quality", sample).mapInArrow(_features, f"doc_id {kind}, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"]]
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    x = np.concatenate(bags).astype(np.float64) if bags else np.empty((0, FEATURES))
    return learn(x, row, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: GatedAttention, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of ``carry``, and score (0 to 1) for each row; null and empty texts get one too.

    One pass without a shuffle; a row's score follows from its text alone, so equal texts tie. Texts
    of any length are taken whole, in memory of about 60 bytes a byte; no rows give none.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for chunk in words.chunks(batch.column("text").cast(pa.binary())):
                x, row = passages(chunk)
                out[chunk.first : chunk.first + chunk.rows] = model.score(x, row, chunk.rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out)], names=[*kept, "score"])

    kept = ["doc_id", *[c for c in carry if c != "doc_id"]]
    src = docs.select(*dict.fromkeys([*kept, "text"]))
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) for each row of ``docs``."""
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
