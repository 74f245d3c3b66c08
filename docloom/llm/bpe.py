"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ship, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Longer texts are cut at safe boundaries about every so many characters.
PIECE = 65536
#: A rank file is sent to the executors whole; a larger one is refused.
MOST_RANK_BYTES = 64 << 20
#: The split pattern that the cuts below hold for, and the characters that its \s takes
#: (the Unicode property White_Space; Python's own \s takes more).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer runs of white space are encoded by themselves.
MOST_WHITE = 10_000
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_LONG_WHITE = re.compile(f"[{WHITE}]{{{MOST_WHITE},}}")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return data


class Encoder:
    """The tiktoken encoding of a rank file's bytes and a split pattern.

    Long texts are cut where ``PATTERN`` always has a boundary, so the tokens stay those of the whole
    text. Another pattern may have none there: its texts go to the library whole.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table_ = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.cuts = pattern == PATTERN
        self.own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        # Takes any text as one match.
        self.single = tiktoken.Encoding("single", pat_str=r"(?s).+", mergeable_ranks=table_, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if not self.cuts or len(text) <= PIECE:
            return self.own.encode_ordinary(text)
        ids: list[int] = []
        for piece in safe_pieces(text):
            ids += self._piece(piece)
        return ids

    def _piece(self, piece: str) -> list[int]:
        """A piece with very long runs of white space, on which the library's pattern runs out of stack.

        Such a run is one match, but for its last character if anything follows: that one begins the
        next match.
        """
        ids: list[int] = []
        at = 0
        for m in _LONG_WHITE.finditer(piece):
            stop = m.end() if m.end() == len(piece) else m.end() - 1
            ids += self.own.encode_ordinary(piece[at : m.start()])
            ids += self.single.encode_ordinary(piece[m.start() : stop])
            at = stop
        return ids + self.own.encode_ordinary(piece[at:])

    def decode(self, ids: list[int]) -> bytes:
        return self.own.decode_bytes(ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoding(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file's bytes; built once in a process."""
    key = (hashlib.md5(ranks).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text where ``PATTERN`` always has a boundary, so the tokens stay the same.

    White space whose predecessor is none always starts a match: what stands before is a run of
    letters, digits or signs, which never reaches over white space, and no run of white space is
    open. So a run of white space is never parted, and only the last piece may end in one. Where
    there is no such place, the piece goes on until there is one.
    """
    start, n = 0, len(text)
    while n - start > size:
        found = _BOUNDARY.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _map(df: DataFrame, ranks: str | bytes, pattern: str, columns: list[str], schema: str, make) -> DataFrame:
    """Arrow batches of (columns) through ``make(encoding, batch)``; one pass, no shuffle."""
    spark = df.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(ranks if isinstance(ranks, bytes) else read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data.value, pattern)
        for batch in batches:
            yield make(enc, batch)

    return df.select(*columns).mapInArrow(run, schema)


def _text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def encode(df: DataFrame, ranks: str | bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>, n_tokens long), a row for each row of ``df``; a null text has no tokens."""
    kind = dict(df.dtypes)[id_col]

    def make(enc, batch):
        ids = [enc.encode(_text(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=[id_col, "token_ids", "n_tokens"])

    src = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return _map(src, ranks, pattern, [id_col, "_text"], f"`{id_col}` {kind}, token_ids array<int>, n_tokens bigint", make)


def decode(df: DataFrame, ranks: str | bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded binary): the raw bytes of the tokens, which need not be whole characters."""
    kind = dict(df.dtypes)[id_col]

    def make(enc, batch):
        out = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return _map(df, ranks, pattern, [id_col, ids_col], f"`{id_col}` {kind}, decoded binary", make)


def round_trip(df: DataFrame, ranks: str | bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", emit_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass.

    Texts are whole, however long; null counts as empty and has no tokens; equal rows give equal
    rows; no rows give none; other columns are ignored. A text is one row's work in one task. Without
    ``emit_ids`` the ids stay in the worker; with it they follow as token_ids array<int>.
    """
    kind = dict(df.dtypes)[id_col]

    def make(enc, batch):
        n, ids_sha, out_sha, kept = [], [], [], []
        for value in batch.column(1).to_pylist():
            ids = enc.encode(_text(value))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            if emit_ids:
                kept.append(pa.array(ids, pa.int32()))
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if emit_ids:
            flat = pa.concat_arrays(kept) if kept else pa.array([], pa.int32())
            cols.append(pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(n)], pa.int32()), flat))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    src = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    more = ", token_ids array<int>" if emit_ids else ""
    return _map(src, ranks, pattern, [id_col, "_text"], f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}", make)


def vocabulary() -> tuple[str, str]:
    """Path of the installed public rank file, and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's ids decode to, which must be the texts."""
    return op10_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


DECODED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
