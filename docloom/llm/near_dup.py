"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

1. Every document becomes the set of its distinct shingles (of 3 words in op3, of 5 in the
   pipeline's stage; see ``Rule``), a 128-bit name of that set and a
   SuperMinHash signature (Ertl, 2017): each shingle deals out correlated ranks by a random
   permutation of the components, level by level, and stops as soon as no component can fall.
2. Rows with equal sets are one node with a number of its own; ids play no part until the end, for
   they may be null or repeated.
3. Signatures are cut into bands. Nodes that share a band are compared by signature in their bucket:
   a node that is close to a leader joins its ball, others become leaders, so a bucket of n close
   copies costs n comparisons and gives n - 1 links. Jaccard distance is a metric, so the wider
   threshold for links to leaders can't part two nodes whose true similarity is high enough.
4. The components of these rough links are families. Only here full sets are compared: a breadth
   first search inside the family links sets with an exact similarity at the threshold, and emits a
   spanning forest, never all pairs.
5. A family of more shingles than a task takes is not compared as a whole, for boilerplate may chain
   very many documents into one. Its nodes are verified in their largest bucket first, in chunks that
   share one node, which joins dense groups in linear work. Then only nodes of buckets that still
   hold several components count, and of these only nodes with a partner in another component whose
   signature comes near the threshold; they are verified bucket by bucket, equal buckets once.

A pair at the threshold shares no band with probability (1 - 0.85^5)^26 = 2.4e-7 at 0.85, and
(1 - 0.80^4)^32 = 4.8e-8 at 0.80. In a bucket it is parted only if an estimate errs by ``ROOM`` (3 to
4 standard deviations of 130 components) against a leader that stands at the edge of its ball, and
that in every bucket that the pair shares, which are 11 of 26 on average at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import grams, words
from docloom.llm.common import cut, partitions, runs, ship, table
from docloom.llm.components import components

SHINGLE = 3
#: Components of a signature, rows of a band at most, and how often a pair at the threshold may be missed.
SIZE, ROWS, MISSED = 130, 5, 1e-6
#: 100 * intersection >= PERCENT * union
PERCENT = 85
#: Estimated similarity to a leader that joins its ball, and room for the estimate's error.
BALL, ROOM = 0.80, 0.13
#: Room for the error of the estimate between the two nodes of a pair (5 standard deviations).
PAIR_ROOM = 0.16
#: A ball that nothing joins: leaders of blocks are all compared, or they would stand four balls apart.
ALL = 2.0
#: Nodes of a bucket, and shingles of a family, that one task handles.
BUCKET_BLOCK, FAMILY_BLOCK = 20000, 1 << 21
#: Nodes to verify are sent to all executors if they and their groups are no more than this (24 bytes each, and two
#: more for each node).
MOST_BROADCAST = 1 << 18
ELEMENT = 52
NO_DOC = 2**63 - 1


class Rule(NamedTuple):
    """What makes two documents near copies: 100 * intersection >= percent * union of their shingles."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    @property
    def rows(self) -> int:
        """Components of a band, as many as miss few enough pairs at the threshold."""
        return next(r for r in range(ROWS, 0, -1) if r == 1 or (1 - (self.percent / 100) ** r) ** (SIZE // r) <= MISSED)

    @property
    def near(self) -> float:
        """Estimated similarity that links to a leader: a true pair has BALL - (1 - percent / 100) at least."""
        return BALL - (1 - self.percent / 100) - ROOM

    @property
    def pair(self) -> float:
        """Estimated similarity that two nodes need to be verified."""
        return self.percent / 100 - PAIR_ROOM

    @property
    def far(self) -> float:
        """The same for leaders of two blocks of one bucket, which stand two balls and a pair apart at most."""
        return 1 - (2 * (1 - BALL) + 1 - self.percent / 100) - ROOM


def superminhash(elements: np.ndarray, owner: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """Signatures (docs, size) of sets given as distinct 64-bit elements with their owner.

    A component holds level << 32 | random of the least (level + random) among its elements.
    Level by level all elements of the unfinished sets take a step; a set is finished as soon as
    its greatest component is below the next level.
    """
    out = np.full(docs * size, np.uint64(size) << np.uint64(32), np.uint64)
    state = grams.mix64(elements)
    shuffled: np.ndarray | None = None
    for level in range(size):
        state = grams.mix64(state + np.uint64(0x9E3779B97F4A7C15))
        to = level + ((state >> np.uint64(32)) * np.uint64(size - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            place = to
        else:
            rows = np.arange(len(owner))
            if shuffled is None:
                raise AssertionError
            place = shuffled[rows, to].astype(np.int64)
            shuffled[rows, to] = shuffled[:, level]
        value = np.uint64(level) << np.uint64(32) | state & np.uint64(0xFFFFFFFF)
        np.minimum.at(out, owner * size + place, value)
        open_ = out.reshape(docs, size).max(axis=1) >= np.uint64(level + 1) << np.uint64(32)
        keep = open_[owner]
        if not keep.any():
            break
        if level == 0:
            shuffled = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (int(keep.sum()), 1))
            rows = np.arange(len(shuffled))
            shuffled[rows, place[keep]] = 0
        elif not keep.all():
            shuffled = shuffled[keep]
        if not keep.all():
            owner, state = owner[keep], state[keep]
    return out.reshape(docs, size)


def sets_of(chunk: words.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk's rows as 52-bit elements sorted by row, and where each row begins."""
    names, row = chunk.shingles(chunk.hashes(lower=True), n)
    shift = np.uint64(ELEMENT)
    if chunk.rows < 1 << (64 - ELEMENT):
        key = np.sort(row.astype(np.uint64) << shift | names >> np.uint64(64 - ELEMENT))
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        row = (key >> shift).astype(np.int64)
        elements = key & np.uint64((1 << ELEMENT) - 1)
    else:
        names = names >> np.uint64(64 - ELEMENT)
        order = np.lexsort((names, row))
        row, elements = row[order], names[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (elements[1:] != elements[:-1])]
        row, elements = row[new], elements[new]
    return elements, np.searchsorted(row, np.arange(chunk.rows + 1))


def _signatures(rule: Rule):
    bands = SIZE // rule.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch.column(1)):
                elements, begin = sets_of(chunk, rule.shingle)
                count = np.diff(begin)
                owner = np.repeat(np.arange(chunk.rows), count)
                signature = superminhash(elements, owner, chunk.rows)
                sums = [np.r_[np.uint64(0), np.cumsum(grams.mix64(elements * grams.MIXERS[i, 3] + np.uint64(i + 1)))] for i in (0, 1)]
                one, two = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)
                band = np.zeros((chunk.rows, bands), np.uint64)
                for i in range(rule.rows):
                    band = grams.pair(grams.mix64(signature[:, i : bands * rule.rows : rule.rows]), band, 0, 5 + i)
                band = grams.mix64(band + np.arange(bands, dtype=np.uint64) * grams.MIX_B).view(np.int64)
                bytes_ = grams.mix64(signature).astype(np.uint8)
                full = count > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(chunk.first, chunk.rows) for i in (0, 2, 3)),
                        pa.array(count, pa.int64()),
                        pa.array(one),
                        pa.array(two),
                        pa.array([x.tobytes() if k else None for x, k in zip(bytes_, full, strict=True)], pa.binary()),
                        pa.array([x.tolist() if k else None for x, k in zip(band, full, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=[*ROW, "n", "one", "two", "signature", "bands"],
                )

    return run


#: Names a row by its id and 128 bits of its text; rows with the same name are repeats.
ROW = ["doc", "h1", "h2"]
SIGNED = "doc bigint, h1 bigint, h2 bigint, n bigint, one bigint, two bigint, signature binary, bands array<bigint>"


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from 8-bit components, less what agrees by chance."""
    agree = (a == b).mean(axis=-1)
    return (agree - 1 / 256) / (1 - 1 / 256)


def leaders(nodes: np.ndarray, signatures: np.ndarray, near: float, ball: float = BALL) -> tuple[np.ndarray, np.ndarray]:
    """(component of each node as an index, indices of the leaders) of a bucket."""
    n = len(nodes)
    label = np.arange(n)
    free = np.ones(n, bool)
    led = []
    while free.any():
        at = int(np.argmax(free))
        led.append(at)
        close = estimate(signatures, signatures[at])
        free &= close < ball
        free[at] = False
        touched = np.unique(label[close >= near])
        touched = np.append(touched, label[at])
        if len(touched) > 1:
            label[np.isin(label, touched)] = touched.min()
    return label, np.array(led)


def _rough_links(near: float, tell_leaders: bool, ball: float = BALL):
    """Sorted (bucket, x, y, node, signature, blocks) rows to links (a, b), and to leaders of buckets with several blocks.

    With a ball above 1 no row is absorbed, and all are compared.
    """
    names = ["a", "b", "bucket", "signature"]

    def links(a, b):
        pairs = np.unique(np.stack([a, b]), axis=1)
        none = pa.nulls(pairs.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none.cast(pa.int64()), none.cast(pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for t in runs(batches, 3):
            nodes = t.column("node").to_numpy()
            signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
            label, led = leaders(nodes, signatures, near, ball)
            least = np.full(len(nodes), NO_DOC)
            np.minimum.at(least, label, nodes)
            far = nodes != least[label]
            held.append((nodes[far], least[label][far]))
            count += int(far.sum()) + 1
            if tell_leaders and t.column("blocks")[0].as_py() > 1:
                own = pa.array(nodes[led])
                yield pa.RecordBatch.from_arrays([own, own, t.column("bucket").combine_chunks().slice(0, len(led)), pa.array([x.tobytes() for x in signatures[led]], pa.binary())], names=names)
            if count > 20000:
                yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, count = [], 0
        if held:
            yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _active(near: float):
    """Sorted (bucket, x, y, node, component, signature) rows to nodes (bucket, node) with a close partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            component = t.column("component").to_numpy()
            names, place, size = np.unique(component, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(component), -1)
            alive = np.zeros(len(component), bool)
            # Pairs inside the largest component are many, and not asked for.
            asking = np.flatnonzero(place != size.argmax())
            for low in range(0, len(asking), 64):
                q = asking[low : low + 64]
                for left in range(0, len(component), 2048):
                    e = slice(left, left + 2048)
                    hit = (estimate(signatures[q, None, :], signatures[None, e, :]) >= near) & (place[q, None] != place[None, e])
                    alive[q] |= hit.any(axis=1)
                    alive[e] |= hit.any(axis=0)
            if alive.any():
                yield from t.filter(pa.array(alive)).select(["bucket", "node"]).combine_chunks().to_batches()

    return run


def in_blocks(rows: DataFrame, blocks: Column, node: str) -> DataFrame:
    """``rows`` for each pair of blocks (x, y) that they take part in, x < y; (0, 0) if there is one block."""
    rows = rows.withColumn("blocks", blocks.cast("bigint")).withColumn("_mine", F.pmod(F.xxhash64(node), F.col("blocks")))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: o != F.col("_mine")))
    rows = rows.withColumn("_other", F.explode(others))
    return rows.withColumns({"x": F.least("_mine", "_other"), "y": F.greatest("_mine", "_other")}).drop("_mine", "_other")


def _sets(n_words: int):
    """(id, groups, text) to (family, x, y, doc, elements), a row for each group of a node."""
    names, types = ["family", "x", "y", "doc", "elements"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for chunk in words.chunks(batch.column(2)):
                elements, begin = sets_of(chunk, n_words)
                out: list[tuple] = []
                size = 0
                for i in range(chunk.rows):
                    row = chunk.first + i
                    blob = elements[begin[i] : begin[i + 1]].tobytes()
                    for g in groups[row]:
                        out.append((g["family"], g["x"], g["y"], ids[row], blob))
                        size += len(blob)
                        if size > 1 << 22:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

    return run


def exact_forest(docs: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (a, b) of the graph of sets with 100 * intersection >= percent * union.

    Breadth first: a reached set is compared with all sets not reached yet, so sets that are found
    early are never compared again.
    """
    count = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int32)
    begin = np.r_[0, np.cumsum(count)]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    own = [flat[begin[i] : begin[i + 1]] for i in range(len(sets))]
    left = np.arange(len(sets))
    pool, at = flat, begin[:-1]
    stale = 0
    out_a, out_b = [], []
    gone = np.zeros(len(sets), bool)
    queue: list[int] = []
    for seed in range(len(sets)):
        if gone[seed]:
            continue
        gone[seed] = True
        queue.append(seed)
        while queue:
            i = queue.pop()
            if stale >= max(8, len(left) // 8):
                left = left[~gone[left]]
                stale = 0
                pool = np.concatenate([own[j] for j in left]) if len(left) else flat[:0]
                at = np.r_[0, np.cumsum(count[left])][:-1] if len(left) else left
            if not len(left):
                continue
            mark[own[i]] = True
            common = np.add.reduceat(mark[pool], at, dtype=np.int64)
            mark[own[i]] = False
            hit = left[(100 * common >= percent * (count[left] + count[i] - common)) & ~gone[left]]
            gone[hit] = True
            stale += len(hit) + 1
            out_a.append(docs[hit])
            out_b.append(np.full(len(hit), docs[i]))
            queue += hit.tolist()
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _verify(percent: int):
    """Rows sorted by (family, x, y) to verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            a, b = exact_forest(t.column(3).to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column(4).to_pylist()], percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; others are ignored).

    Linked are documents whose sets of shingles of ``shingle`` words have a Jaccard similarity of
    ``percent`` / 100 or more. Words are lower-cased (A to Z). Texts without words are empty sets, linked with nothing. A null
    doc_id counts as the greatest; component_id is null where no row of the component has an id.
    Rows that repeat a doc_id are judged by their own texts, so two components may have the same
    least id.
    """
    out, _ = judged(docs, shingle, percent)
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("top.doc").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.withColumns({c: F.nullif(c, F.lit(NO_DOC)) for c in ("doc_id", "component_id")})


def named_rows(docs: DataFrame, prefix: str = "") -> list[Column]:
    """The columns of ``ROW`` for rows of ``docs``."""
    text = F.col("text").cast("binary")
    columns = F.coalesce(F.col("doc_id"), F.lit(NO_DOC)).cast("bigint"), F.xxhash64(text), F.xxhash64(F.lit(1), text)
    return [c.alias(prefix + name) for c, name in zip(columns, ROW, strict=True)]


def judged(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc, h1, h2, n, top) for every row of ``docs``, and the names of rows with words that repeat.

    ``top`` is the least name of a row (id first) in the row's component.
    """
    spark = docs.sparkSession
    ship(spark)
    rule = Rule(shingle, percent)
    doc, h1, h2 = named_rows(docs)
    src = docs.select(doc, F.col("text").cast("binary").alias("text"), h1, h2)
    signed = cut(src.mapInArrow(_signatures(rule), SIGNED))
    repeats = cut(signed.where("n > 0").groupBy(*ROW).count().where("count > 1").select(*ROW))
    links, nodes = rough_links(signed, rule)
    # The families of nodes come from rough links.
    family = cut(components(links).withColumnRenamed("component", "family"))
    exact = components(verified_links(src, nodes, family, rule, not repeats.isEmpty()))
    linked = cut(exact.join(nodes.select("node", "row"), F.col("id") == F.col("node")).select("node", "component", "row"))
    tops = cut(linked.groupBy("component").agg(F.min("row").alias("top")))
    keys = ["one", "two", "n"]
    # The small sides are made first, so that the join with all rows has tables of exchanges on both
    # sides: the key of a set with very many copies is then a partition that can be split.
    linked = linked.join(tops, "component").select("node", "top")
    named = nodes.join(linked, "node", "left").select(*keys, F.coalesce("top", "row").alias("top"))
    out = signed.select(*ROW, *keys).join(named, keys, "left")
    top = F.when(F.col("n") > 0, F.col("top")).otherwise(F.struct(*ROW))
    return out.select(*ROW, "n", top.alias("top")), repeats


def rough_links(signed: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all nodes that might be similar, and the nodes (one, two, n, node, row)."""
    nodes = signed.where("n > 0").groupBy("one", "two", "n").agg(F.min(F.struct(*ROW)).alias("row"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    company = bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = bands.join(company, "bucket").withColumn("blocks", F.ceil(F.col("c") / BUCKET_BLOCK).cast("bigint"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = members.join(nodes.select("node", "signature"), "node").select("bucket", block.alias("x"), block.alias("y"), "node", "signature", "blocks")
    kind = "a bigint, b bigint, bucket bigint, signature binary"
    found = cut(dealt(rows).mapInArrow(_rough_links(rule.near, True), kind))
    first = found.where("bucket is null").select("a", "b")
    # Leaders of the blocks of a bucket are compared too, in pairs of blocks if they are many.
    led = found.where("bucket is not null").select("bucket", F.col("a").alias("node"), "signature")
    many = led.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("b"))
    led = in_blocks(led.join(many, "bucket"), F.col("b"), "node").select("bucket", "x", "y", "node", "signature", "blocks")
    second = dealt(led).mapInArrow(_rough_links(rule.far, False, ALL), kind).select("a", "b")
    return first.union(second), nodes


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by (bucket, x, y), each group in one task.

    A number of partitions is given, for these rows are few bytes but much work, and would be coalesced by bytes.
    """
    key = ["bucket", "x", "y"]
    return rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "node")


def verified(src: DataFrame, groups: DataFrame, rule: Rule, repeated: bool) -> DataFrame:
    """Tree links (a, b) of exactly verified pairs inside ``groups`` (id, row, family, x, y).

    A node's set is read from its least row, once; ``repeated`` tells that this row may stand there
    many times.
    """
    placed = cut(groups.groupBy("id").agg(F.first("row").alias("row"), F.collect_set(F.struct("family", "x", "y")).alias("groups")).select("id", "groups", "row.*"))
    if (placed.agg(F.sum(F.size("groups") + 2)).first()[0] or 0) <= MOST_BROADCAST:
        placed = F.broadcast(placed)
    texts = src.join(placed, ROW)
    if repeated:
        texts = texts.dropDuplicates(["id"])
    sets = texts.select("id", "groups", "text").mapInArrow(_sets(rule.shingle), "family bigint, x bigint, y bigint, doc bigint, elements binary")
    key = ["family", "x", "y"]
    return sets.repartition(partitions(src.sparkSession), *key).sortWithinPartitions(*key, "doc").mapInArrow(_verify(rule.percent), "a bigint, b bigint")


def verified_links(src: DataFrame, nodes: DataFrame, family: DataFrame, rule: Rule = Rule(), repeated: bool = True) -> DataFrame:
    """Tree links (a, b) of exactly verified pairs inside the families."""
    sized = family.join(nodes.select(F.col("node").alias("id"), "n", "row"), "id")
    sized = cut(sized.join(sized.groupBy("family").agg(F.sum("n").alias("total")), "family"))
    zero = F.lit(0).cast("bigint")
    links = verified(src, sized.where(F.col("total") <= FAMILY_BLOCK).select("id", "row", "family", zero.alias("x"), zero.alias("y")), rule, repeated)
    large = sized.where(F.col("total") > FAMILY_BLOCK).select("id", "n", "row")
    return links if large.isEmpty() else links.unionAll(large_links(src, nodes, large, rule, repeated))


def large_links(src: DataFrame, nodes: DataFrame, large: DataFrame, rule: Rule, repeated: bool) -> DataFrame:
    """The same for ``large`` (id, n, row), nodes of families that are not compared as a whole."""
    chunks = lambda n: F.ceil(n / FAMILY_BLOCK).cast("bigint")
    members = large.join(nodes.select(F.col("node").alias("id"), "bands"), "id").select("id", "n", F.explode("bands").alias("bucket"))
    company = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("centre")).where("c > 1")
    members = cut(members.join(company, "bucket"))
    # Every node in its largest bucket, in chunks that all hold the bucket's least node.
    chosen = members.groupBy("id", "n").agg(F.max_by(F.struct("bucket", "centre"), F.struct("c", "bucket")).alias("b")).select("id", "n", "b.*")
    sized = chosen.groupBy("bucket", "centre").agg(chunks(F.sum("n")).alias("chunks"))
    own = chosen.join(sized.select("bucket", "chunks"), "bucket").select("id", "bucket", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("x"))
    centres = sized.select(F.col("centre").alias("id"), "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("x"))
    rows = large.select("id", "row")
    groups = own.unionAll(centres).distinct().join(rows, "id").select("id", "row", F.col("bucket").alias("family"), "x", F.col("x").alias("y"))
    stars = cut(verified(src, groups, rule, repeated))
    # What is left: buckets of several components, and in them nodes close to one of another component.
    joined = components(stars).withColumnRenamed("component", "_c")
    rest = members.select("bucket", "id", "n").join(joined, "id", "left").select("bucket", "id", "n", F.coalesce("_c", "id").alias("component"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BUCKET_BLOCK).alias("b")).where("lo <> hi").select("bucket", "b")
    rest = in_blocks(rest.join(mixed, "bucket"), F.col("b"), "id").select("bucket", "x", "y", F.col("id").alias("node"), "component")
    rest = rest.join(nodes.select("node", "signature"), "node").select("bucket", "x", "y", "node", "component", "signature")
    active = cut(dealt(rest).mapInArrow(_active(rule.pair), "bucket bigint, node bigint").distinct())
    same = active.groupBy("bucket").agg(F.sum(F.xxhash64("node") % (1 << 40)).alias("s"), F.sum(F.xxhash64(F.lit(1), "node") % (1 << 40)).alias("t"), F.count("*").alias("c"))
    once = same.groupBy("s", "t", "c").agg(F.min("bucket").alias("bucket")).select("bucket")
    active = active.join(once, "bucket").join(large, F.col("node") == F.col("id")).select("bucket", "id", "n", "row")
    sized = active.groupBy("bucket").agg(chunks(F.sum("n")).alias("b"))
    groups = in_blocks(active.join(sized, "bucket"), F.col("b"), "id").select("id", "row", F.col("bucket").alias("family"), "x", "y")
    return stars.unionAll(verified(src, groups, rule, repeated))


def op3_superminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.b), d.doc_id) AS component_id, d.doc_id = coalesce(least(d.doc_id, m.b), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
