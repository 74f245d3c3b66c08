"""Removal of repeated passages: suffix positions ranked by distributed prefix doubling.

A byte goes if a string of 100 bytes over it also starts earlier. Suffix positions are ranked by
their first 32, 64 and 100 bytes, in a loop. The rank of a length is the name of a pair of ranks of
the length before: 64 bytes by the ranks at offsets 0 and 32, 100 bytes by those at 0 and 36. In each
round Spark sorts the positions by (rank, document, place); then a position

* leaves for good if its rank is unique: no longer string that begins there, and no window of 100
  bytes that holds it, stands anywhere else;
* is ranked again at the next offset if its rank is not unique;
* is past the threshold at 100 bytes: all positions of a rank but the first are repeats.

Names are hashes of rank pairs, made from the text in place, so no round has to fetch the ranks of
other positions; a wrong match costs work at 64 bits and decides only at 112.

Before the loop positions are sampled, which loses nothing. Of the 69 grams of 32 bytes within a
window of 100 bytes the one with the least hash stands for it (the leftmost of equals). The choice
follows from the window's bytes alone, so two equal windows are represented by equal grams at equal
offsets: if a window repeats, its gram is a repeated sampled gram. About every 34th position is
sampled, and stands for the run of windows that chose it. Two refinements keep later rounds small:

* ``context`` is the name of all bytes that a position's windows cover. Of positions with equal
  contexts all but the first have only repeated windows, and are past the threshold at once.
* Only where equal grams stand in different contexts, at the edges of repeated passages, the loop
  goes on. At 64 bytes it ranks two pieces for a position: the one at the gram, which every window
  holds that begins at most 36 bytes before, and the one 36 bytes earlier, which every other window
  holds. A window is ranked at 100 bytes unless a piece of it was unique.

Skew: a task combines its own positions before a shuffle, one row for each rank and task at most,
so a passage that stands in a third of all documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import grams
from docloom.llm.common import NO_ID, cut, ship, table

THRESHOLD = 100
GRAM = 32
#: Lengths that the loop ranks, each at most twice the one before; the last is the threshold.
LENGTHS = (64, THRESHOLD)
#: Chunks of text that are handled at once, in bytes (below 2^20), and positions combined at once.
CHUNK, COMBINE = 1 << 17, 1 << 21
#: Kinds of rows between the rounds.
SPAN, PLACE, SIGNAL, KNOWN, EDGE = 0, 1, 2, 3, 4
ROW = "key bigint, sub bigint, doc bigint, pos bigint"
NAMES = ["key", "sub", "doc", "pos"]
#: pos: kind (from bit 60), check (20 bits from 40; 0, as doc names the text), place (40 bits). sub: distances from
#: the first and the last window to the gram (7 bits from 57 and from 50), sides that are still
#: alive (2 bits from 48), and 48 bits of a name; for spans the end. Few bytes a row keep the
#: shuffles small.
#: Sides: pieces of 64 bytes that are not unique, at the gram and before it.
AT, BEFORE = 1, 2
LOW48 = (1 << 48) - 1


def at(kind: int, check, place):
    return kind << 60 | check << 40 | place


def where(pos: np.ndarray):
    """Kind, check and place."""
    return pos >> 60, pos >> 40 & ((1 << 20) - 1), pos & ((1 << 40) - 1)


def edge_info(far, near, sides=0, name=None) -> np.ndarray:
    out = far.astype(np.uint64) << np.uint64(57) | near.astype(np.uint64) << np.uint64(50) | np.asarray(sides).astype(np.uint64) << np.uint64(48)
    return signed(out if name is None else out | name & np.uint64(LOW48))


def edge_of(sub: np.ndarray):
    """Distances of the first and the last window, and the sides alive."""
    u = sub.view(np.uint64)
    return ((u >> np.uint64(shift) & np.uint64(mask)).astype(np.int64) for shift, mask in ((57, 127), (50, 127), (48, 3)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spread(doc: np.ndarray, check: np.ndarray) -> np.ndarray:
    return signed(grams.mix64(doc.view(np.uint64) + check.astype(np.uint64)))


def rows_out(*parts: tuple) -> Iterator[pa.RecordBatch]:
    """Record batches of (key, sub, doc, pos) parts."""
    for part in parts:
        for i in range(0, len(part[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + (1 << 17)])) for x in part], names=NAMES)


def span_rows(doc, check, start, end):
    """Spans merged by document, as rows that pass through the next round."""
    order = np.lexsort((check, doc))
    d, c = doc[order], check[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    owner, s, e = grams.merge_spans(np.cumsum(new) - 1, start[order], end[order])
    first = np.flatnonzero(new)[owner] if len(d) else owner.astype(np.int64)
    d, c = d[first], c[first]
    return spread(d, c), e, d, at(SPAN, c, s)


def later(key, sub, doc, pos):
    """For rows sorted by (key, sub, doc, pos): where (key, sub) begins, and who starts after the first."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return new, (doc != doc[first]) | (pos != pos[first])


def twins(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted names: which occur more than once, and the first of each of these."""
    same = np.zeros(len(name), bool)
    same[1:] = name[1:] == name[:-1]
    many = same.copy()
    many[:-1] |= same[1:]
    return many, many & ~same


def signals(name: np.ndarray) -> tuple:
    """Rows that tell other tasks that a name is not unique."""
    zero = np.zeros(len(name), np.int64)
    return signed(name), zero, zero, zero + at(SIGNAL, 0, 0)


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by key, cut so that no key is split."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
        if rows >= 1 << 18:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield [x[:cut] for x in cols]
                held, rows = [[x[cut:] for x in cols]], rows - cut
            else:
                held = [cols]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Rows of a batch as chunks of (row, first byte, last byte + 1) within it; long texts in overlapping parts."""
    chunk: list[tuple[int, int, int]] = []
    size = 0
    for row, n in enumerate(np.diff(offsets).tolist()):
        if n < THRESHOLD:
            continue
        if size + n > CHUNK and chunk:
            yield chunk
            chunk, size = [], 0
        if n > CHUNK:
            for low in range(0, n - THRESHOLD + 1, CHUNK):
                yield [(row, low, min(n, low + CHUNK + THRESHOLD - 1))]
        else:
            chunk.append((row, 0, n))
            size += n
    if chunk:
        yield chunk


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def sample(data: np.ndarray, bounds: np.ndarray):
    """Sampled positions of a chunk of texts: place, first and last window, name, context, text.

    bounds: where the texts begin in ``data``, and its length.
    """
    width = THRESHOLD - GRAM + 1
    names = grams.mix64(grams.doubled(data, GRAM))
    order = (names & ~np.uint64((1 << grams.PLACE) - 1)) | np.arange(len(names), dtype=np.uint64)
    least = signed(grams.sliding_min(order, width)) & ((1 << grams.PLACE) - 1)
    valid = np.ones(len(least), bool)
    for end in bounds[1:-1].tolist():
        valid[end - THRESHOLD + 1 : end] = False
    window = np.flatnonzero(valid)
    place = least[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(window) - 1]
    place, lo, hi = place[first], window[first], window[last]
    room = 1 << grams.PLACE
    sums = grams.prefix_sums(grams.BYTE_NAMES[1][data], room)
    context = grams.span_hash(sums, lo, hi + THRESHOLD, room) + grams.mix64(((place - lo) << 8 | (place - hi)).astype(np.uint64))
    return place, lo, hi, names[place], context, np.searchsorted(bounds, lo, "right") - 1


def combine(name, context, doc, pos, far, near, check):
    """Rows of the first round from the positions of one task, in their order."""
    order = np.argsort(name)
    twin, _ = twins(name[order])
    one = np.sort(order[~twin])
    yield signed(name[one]), edge_info(far[one], near[one], 0, context[one]), doc[one], at(PLACE, check[one], pos[one])
    more = order[twin]
    if not len(more):
        return
    k, s, d, p = name[more], edge_info(far[more], near[more], 0, context[more]), doc[more], at(PLACE, check[more], pos[more])
    order = np.lexsort((p, d, s, k))
    more, k, s, d, p = more[order], k[order], s[order], d[order], p[order]
    new, after = later(k, s, d, p)
    f, r, c = far[more], near[more], check[more]
    begins = np.ones(len(k), bool)
    begins[1:] = k[1:] != k[:-1]
    group = np.cumsum(begins) - 1
    many = (np.bincount(group[new]) > 1)[group]
    yield span_rows(d[after], c[after], (pos[more] - f)[after], (pos[more] - r)[after] + THRESHOLD)
    lone, known = ~after & ~many, ~after & many
    yield signed(k[lone]), s[lone], d[lone], p[lone]
    yield signed(context[more][known]), edge_info(f[known], r[known], 0, k[known]), d[known], at(KNOWN, c[known], pos[more][known])
    yield signals(k[begins & many])


def first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, check, body) to rows of sampled positions at 32 bytes."""
    held: list[tuple] = []
    count = 0

    def flush():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield from rows_out(*combine(*cols))

    for batch in batches:
        docs, checks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        data, offsets = binary_column(batch.column(2))
        for chunk in pieces(offsets):
            rows, begin, stop = (np.array(x) for x in zip(*chunk, strict=True))
            lengths = stop - begin
            bounds = np.r_[0, np.cumsum(lengths)]
            low = offsets[rows[0]] + begin[0]
            if int(low + bounds[-1]) == int(offsets[rows[-1]] + stop[-1]):
                body = data[low : low + bounds[-1]]
            else:
                body = np.concatenate([data[offsets[r] + b : offsets[r] + e] for r, b, e in chunk])
            place, lo, hi, name, context, text = sample(body, bounds)
            held.append((name, context, docs[rows[text]], place - bounds[text] + begin[text], place - lo, place - hi, checks[rows[text]]))
            count += len(place)
            if count >= COMBINE:
                yield from flush()
                held.clear()
                count = 0
    if held:
        yield from flush()


def rerank_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of the first round to spans, and edges: places whose gram stands in several contexts."""
    for key, sub, doc, pos in sorted_groups(batches):
        kind, check, place = where(pos)
        span = kind == SPAN
        yield from rows_out((key[span], sub[span], doc[span], pos[span]))
        told = key[kind == SIGNAL]
        keep = (kind == PLACE) | (kind == KNOWN)
        k, s, d, p, c, at_, known = (x[keep] for x in (key, sub, doc, pos, check, place, kind == KNOWN))
        if not len(k):
            continue
        far, near, _ = edge_of(s)
        new, after = later(k, s, d, p)
        begins = np.ones(len(k), bool)
        begins[1:] = k[1:] != k[:-1]
        group = np.cumsum(begins) - 1
        many = (np.bincount(group[new]) > 1)[group] | known | np.isin(k, told)
        yield from rows_out(span_rows(d[after], c[after], (at_ - far)[after], (at_ - near)[after] + THRESHOLD))
        edge = many & ~after
        yield from rows_out((spread(d[edge], c[edge]), edge_info(far[edge], near[edge], AT | BEFORE), d[edge], at(EDGE, c[edge], at_[edge])))


def documents_with_items(batches: Iterator[pa.RecordBatch]):
    """(doc, check, body, items) rows: document, check, a call for the bytes, and arrays of sub and pos of its rows."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        items = batch.column(3)
        flat = items.flatten()
        cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]
        ends = np.cumsum([len(x) if x.is_valid else 0 for x in items]).tolist()
        begin = 0
        docs, checks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, body in enumerate(batch.column(2)):
            sub, pos = (x[begin : ends[i]] for x in cols)
            begin = ends[i]
            yield docs[i], checks[i], (lambda b=body: unzip.decompress(b.as_py())), sub, pos


def passing(doc: int, check: int, sub: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans among a document's items, as rows."""
    span = where(pos)[0] == SPAN
    if span.any():
        d = np.full(int(span.sum()), doc)
        yield from rows_out((spread(d, np.full(len(d), check)), sub[span], d, pos[span]))


def names_at(body: bytes, places: np.ndarray, length: int, families: int) -> list[np.ndarray]:
    """Names of ``length`` (64 to 128) bytes at sorted places of a text, in bounded memory."""
    data = np.frombuffer(body, np.uint8)
    out = [np.empty(len(places), np.uint64) for _ in range(families)]
    for at in range(0, len(data), CHUNK):
        a, b = np.searchsorted(places, (at, at + CHUNK))
        if a < b:
            low = int(places[a])
            part = data[low : int(places[b - 1]) + length]
            for family in range(families):
                out[family][a:b] = grams.at_length(grams.doubled(part, 64, family), 64, length, places[a:b] - low, family)
    return out


def edges_of(sub: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, distances and sides of the edges among a document's items, each once."""
    kind, _, place = where(pos)
    edge = kind == EDGE
    far, near, side = (x[edge] for x in edge_of(sub))
    gram, same = np.unique(place[edge] << 16 | far << 8 | near, return_inverse=True)
    sides = np.zeros(len(gram), np.int64)
    np.bitwise_or.at(sides, same, side)
    return gram >> 16, gram >> 8 & 255, gram & 255, sides


def pieces_of(place, far, near, sides, length: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, start, side) of the strings of ``length`` bytes to rank for edges that were alive at length ``before``.

    Below the threshold there are two pieces at most; at the threshold one for each window whose
    pieces of the length before are alive.
    """
    if length < THRESHOLD:
        step = THRESHOLD - length
        here, earlier = np.flatnonzero((near <= step) & (sides & AT > 0)), np.flatnonzero((far >= step) & (sides & BEFORE > 0))
        return np.r_[here, earlier], np.r_[place[here], place[earlier] - step], np.r_[np.full(len(here), AT), np.full(len(earlier), BEFORE)]
    n = far - near + 1
    edge = np.repeat(np.arange(len(place)), n)
    back = far[edge] - (np.arange(len(edge)) - (np.cumsum(n) - n)[edge])
    step = THRESHOLD - before
    live = ((back > step) | (sides[edge] & AT > 0)) & ((back < step) | (sides[edge] & BEFORE > 0))
    return edge[live], (place[edge] - back)[live], sides[edge][live]


def rank_pieces(length: int, before: int):
    """A round of the loop: edges to rows of their pieces by the rank of ``length`` bytes, combined within the task."""
    last = length >= THRESHOLD

    def combined(key, sub, doc, check, place):
        if last:
            order = np.lexsort((place, doc, sub, key))
            _, after = later(key[order], sub[order], doc[order], place[order])
            gone, kept = order[after], np.sort(order[~after])
            yield span_rows(doc[gone], check[gone], place[gone], place[gone] + THRESHOLD)
            yield signed(key[kept]), signed(sub[kept]), doc[kept], at(PLACE, check[kept], place[kept])
            return
        order = np.argsort(key)
        many, told = twins(key[order])
        one, more = np.sort(order[~many]), np.sort(order[many])
        yield signed(key[one]), sub[one], doc[one], at(PLACE, check[one], place[one])
        yield spread(doc[more], check[more]), sub[more], doc[more], at(EDGE, check[more], place[more])
        yield signals(key[order][told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for doc, check, body, sub, pos in documents_with_items(batches):
            yield from passing(doc, check, sub, pos)
            place, far, near, sides = edges_of(sub, pos)
            edge, start, side = pieces_of(place, far, near, sides, length, before)
            if not len(start):
                continue
            if last:  # windows; the same one may stand under two edges
                start = np.unique(start)
                key, more = names_at(body(), start, length, 2)
                more, own = more & np.uint64(LOW48), start
            else:
                order = np.argsort(start)
                edge, start, side = edge[order], start[order], side[order]
                (key,) = names_at(body(), start, length, 1)
                more, own = edge_info(far[edge], near[edge], side), place[edge]
            held.append((key, more, np.full(len(start), doc), np.full(len(start), check), own))
            count += len(start)
            if count >= COMBINE:
                yield from rows_out(*combined(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held.clear()
                count = 0
        if held:
            yield from rows_out(*combined(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def rerank(length: int):
    """Sorted rows of a round to spans and the pieces whose rank is not unique; at the threshold to spans only.

    Spans at the threshold are single windows: neighbouring ones stand in any partitions, and are merged
    by document, not here, so that the rows follow the input and not the number of partitions.
    """
    last = length >= THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sub, doc, pos in sorted_groups(batches):
            kind, check, place = where(pos)
            through = (kind == SPAN) | (kind == EDGE)
            yield from rows_out((key[through], sub[through], doc[through], pos[through]))
            keep = np.flatnonzero(kind == PLACE)
            if last:
                after = keep[later(key[keep], sub[keep], doc[keep], pos[keep])[1]] if len(keep) else keep
                yield from rows_out((key[after], place[after] + THRESHOLD, doc[after], at(SPAN, check[after], place[after])))
            else:
                many = keep[twins(key[keep])[0] | np.isin(key[keep], key[kind == SIGNAL])]
                yield from rows_out((spread(doc[many], check[many]), sub[many], doc[many], at(EDGE, check[many], place[many])))

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zipper = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("body")
        body = pa.array([zipper.compress(b or b"") for b in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, "body", body)


def _cut_texts(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, text, found = [], [], [], [], [], []
            for _, _, body, sub, pos in documents_with_items([batch]):
                raw = body()
                _, start, end = grams.merge_spans(np.zeros(len(pos), np.int64), where(pos)[2], sub)
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                n_spans.append(len(start))
                sha.append(hashlib.sha256(left).hexdigest())
                found.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)] if keep_text else None)
                text.append(left if keep_text else None)
            cols = [batch.column(0), *batch.columns[4:], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", *batch.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols += [pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(text, pa.binary()), pa.array([t.decode("utf-8", "ignore") for t in text], pa.string())]
                names += ["spans", "kept", "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number for each different (id, h1, h2), in the order of these."""
    names = ["id", "h1", "h2"]
    # Numbers of a sorted table grow with its rows; the checkpoint holds them fast.
    numbers = cut(rows.select(*names).distinct().orderBy(*names).withColumn("number", F.monotonically_increasing_id()))
    return rows.join(numbers, names)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Remove bytes of ``text`` that a string of 100 bytes covers which also starts earlier.

    Earlier is by smaller doc_id, or in the same document by place. Matches never cross documents
    and are judged on the input. Returns doc_id, the columns of ``carry``, n_bytes, n_removed,
    n_spans, kept_sha256 and, with ``keep_text``, the removed spans, the bytes that are kept, and these
    as text without characters of which a part is gone.

    A null text is empty; a null doc_id comes before all others. Rows that repeat a doc_id with
    other texts are documents of their own, in the order of a 128-bit hash of the text; equal rows
    are one document, and none loses a byte to the other. Where ids repeat, every (doc_id, text) gets
    a number in that order, and the rounds go by it. Other columns are ignored; no rows give none. A
    text of any length is handled whole in one task, in memory of about 40 bytes a byte.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("bigint")
    unique = docs.groupBy(ids.alias("doc")).count().where("count > 1").isEmpty()
    # Ids or numbers tell all documents apart, so the check, which only spreads rows, is 0.
    check = F.lit(0).cast("bigint")
    own = "doc_id"
    if unique:
        src = docs.select(ids.alias("doc"), check.alias("check"), body.alias("body"), *carry)
    else:
        own = "_own"
        while own in carry:
            own += "_"
        src = numbered(docs.select(ids.alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("body"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))))
        src = src.select(F.col("number").alias("doc"), check.alias("check"), "body", F.col("id").alias(own), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
        carry = (own, *carry)
    kinds = dict(src.dtypes)
    extra = "".join(f", `{c}` {kinds[c]}" for c in carry)
    texts = src.mapInArrow(_squeeze, f"doc bigint, check bigint, body binary{extra}").repartition("doc", "check")

    def items(rows: DataFrame) -> DataFrame:
        owner = F.shiftright("pos", 40).bitwiseAND(F.lit((1 << 20) - 1).cast("bigint"))
        return rows.groupBy("doc", owner.alias("check")).agg(F.collect_list(F.struct("sub", "pos")).alias("items"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions(*NAMES)

    def fetched(rows: DataFrame) -> DataFrame:
        # A left join, so that its side of texts is the same exchange in every round.
        return texts.join(items(rows), ["doc", "check"], "left").select("doc", "check", "body", "items", *carry)

    rows = src.select("doc", "check", "body").mapInArrow(first_ranks, ROW)
    rows = ranked(rows).mapInArrow(rerank_contexts, ROW)
    for before, length in zip((GRAM, *LENGTHS[:-1]), LENGTHS, strict=True):
        rows = fetched(rows).mapInArrow(rank_pieces(length, before), ROW)
        rows = ranked(rows).mapInArrow(rerank(length), ROW)
    out = fetched(rows)
    more = ", spans array<struct<start: bigint, end: bigint>>, kept binary, kept_text string" if keep_text else ""
    out = out.mapInArrow(_cut_texts(keep_text), f"doc_id bigint{extra}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")
    if own != "doc_id":
        out = out.drop("doc_id").withColumnRenamed(own, "doc_id")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: All windows of 100 bytes, as hex, by brute force; those that are not the first of their kind cover
#: what goes.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 500)) AS j FROM d WHERE n >= 100),
q AS (SELECT doc_id, j, least(500, n - 99 - j) AS m, substr(h, 2 * j + 1, 1198) AS part FROM b),
p AS (SELECT doc_id, j, part, unnest(range(0, m)) AS k FROM q),
w AS (SELECT doc_id, j + k AS i, row_number() OVER (PARTITION BY md5_number(substr(part, 2 * k + 1, 200)) ORDER BY doc_id, j + k) > 1 AS again FROM p),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 100 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM w WHERE again WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, g.a AS b FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY g.a)
      UNION ALL SELECT d.doc_id, coalesce(max(g.b), 0), d.n FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.n),
t AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
