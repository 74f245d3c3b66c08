"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

Every source gets a share of the mix by its weight, but at most ``max_epochs`` times its own size;
what a source can't take is shared out again by weight. The fixed point of that is a water level:
target = min(cap, level x weight). With the sources sorted by cap / weight, the level follows from
two running sums, so no rounds are needed. Whole repetitions go to every document of a source, the
fractional one to a seeded sample of them: documents in the order of a hash, until the words are used
up. The bin of the hash in which that happens is found in two steps, each by sums over bins, and only
what is in the last one (1 of 16 million of a source) is sorted; other texts take part in no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Bits of the hash that orders documents, of its bins within a source, and of the bins within the bin at the edge.
HASH_BITS, BIN_BITS, EDGE_BITS = 60, 12, 24
#: The plan (about 60 bytes a source) is sent to all executors for at most so many sources.
MOST_BROADCAST = 1 << 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(seed: str = SEED) -> Column:
    """The seeded order: 60 bits of the md5 of seed, doc_id and text; nulls count as ''.

    The text takes part so that rows which share an id, or have none, are spread out too.
    """
    part = lambda c: F.coalesce(c, F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), part(F.col("doc_id").cast("string")), F.lit(":"), part(F.col("text"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bin_of(u: Column, bits: int = BIN_BITS) -> Column:
    return F.shiftright(u, HASH_BITS - bits)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order of code point, null last, take the weights in turn. The windows without a
    partition key run over one row for each source, after the aggregation: some 50 bytes each, which
    a task sorts on disk if need be.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k + 1).cast("int")).cast("bigint")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    rows = rows.withColumns({"total": F.sum("source_size").over(everything) * F.lit(float(share)), "all_w": F.sum("w").over(everything)})
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(below), F.lit(0)))
    rows = rows.withColumn("level", level)
    # The first source that its level doesn't fill sets the level of all that follow.
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"]
    rows = rows.withColumn("found", found)
    target = F.when(F.col("found").isNull() | (F.col("ratio") < F.col("found")), F.col("cap").cast("double")).otherwise(F.least(F.col("found") * F.col("w"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def edge_of(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, edge, below): the bin of ``sizes`` (source, bin, words) in which a source's ``rest`` words are used up.

    ``below`` words stand before the bin; ``goals`` has ``base``, the words before a source's first bin.
    """
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sizes.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    below = F.col("g.base") + F.col("b.below")
    inside = (below <= F.col("g.rest")) & (F.col("g.rest") < below + F.col("b.words"))
    joined = bins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).where(inside)
    return joined.select("b.source", F.col("bin").alias("edge"), below.alias("below"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, _u) to one row a source: source_size, target, repeats, rest, edge and below.

    Every document is taken ``repeats`` times whole; ``rest`` words more come from the documents
    before bin ``edge`` of ``EDGE_BITS`` (null: from all) and from those in it, before which stand
    ``below`` words. ``rows`` is gone through twice, so it is best a checkpoint.
    """
    sizes = cut(rows.groupBy("source", bin_of(F.col("_u")).alias("bin")).agg(F.sum("size").alias("words")))
    goals = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    repeats = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("bigint")
    goals = goals.withColumn("repeats", repeats).withColumn("rest", F.floor(F.col("target") + F.lit(0.5)).cast("bigint") - F.col("repeats") * F.col("source_size"))
    goals = small(goals)
    wide = small(edge_of(sizes, goals.withColumn("base", F.lit(0).cast("bigint"))))
    # The bin is taken apart by the bits that follow.
    inside = F.col("r.source").eqNullSafe(F.col("w.source")) & (bin_of(F.col("r._u")) == F.col("w.edge"))
    within = rows.alias("r").join(wide.alias("w"), inside).groupBy("r.source", bin_of(F.col("r._u"), EDGE_BITS).alias("bin")).agg(F.sum("r.size").alias("words"))
    based = goals.alias("g").join(wide.alias("w"), F.col("g.source").eqNullSafe(F.col("w.source"))).select("g.source", "rest", F.col("below").alias("base"))
    edges = edge_of(within, based)
    out = goals.alias("g").join(edges.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    return small(out.select("g.source", "source_size", "target", "repeats", "rest", "edge", "below"))


def small(by_source: DataFrame) -> DataFrame:
    """Rows of sources, kept by a checkpoint, and sent to all executors if they are few."""
    by_source = cut(by_source)
    return F.broadcast(by_source) if by_source.count() <= MOST_BROADCAST else by_source


def planned(rows: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with source and _u) that the edge of their source doesn't cut, and the others, with the plan's columns.

    The first have ``_full``: whether the fractional repetition takes them.
    """
    joined = rows.alias("r").join(goals.withColumnRenamed("source", "_source").alias("g"), F.col("r.source").eqNullSafe(F.col("_source")))
    joined = joined.select("r.*", *[F.col(f"g.{c}").alias(f"_{c}") for c in ("source_size", "target", "repeats", "rest", "edge", "below")])
    at = bin_of(F.col("_u"), EDGE_BITS)
    away = joined.where(F.col("_edge").isNull() | (at != F.col("_edge"))).withColumn("_full", F.coalesce(at < F.col("_edge"), F.lit(True)))
    return away, joined.where(at == F.col("_edge"))


def part_taken(size: Column) -> Column:
    """Words that the fractional repetition takes from a row in its source's edge."""
    inner = Window.partitionBy("source").orderBy("_u", "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_below") - F.coalesce(F.sum(size).over(inner), F.lit(0))
    return F.greatest(F.lit(0).cast("bigint"), F.least(left, size))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken for all of ``docs`` (doc_id, text, source; others are ignored).

    ``taken`` is the words that the mix takes from a document: size times the whole repetitions of
    its source, plus size, nothing or, for one document of each source, a part of it for the
    fractional repetition. The sum over a source is its target to the nearest word. The sample's
    order is a hash of seed, doc_id and text (null as ''), so reruns agree. Rows that repeat a doc_id
    stay separate rows; equal rows share what the edge leaves them in any order. A null text has size
    0, a source of size 0 has target 0, no rows give none. Texts of any length are counted whole.

    Texts are read once: ids, sources, sizes and hashes are kept by a checkpoint. A hot source is no
    hot task: sums are taken by (source, bin of the hash), and only the fine bin at the edge is sorted.
    """
    rows = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), place(seed).alias("_u")))
    goals = plan(rows, weights, share, max_epochs)
    away, edge = planned(rows, goals)
    size = F.col("size")
    away = away.withColumn("_part", F.when(F.col("_full"), size).otherwise(F.lit(0)))
    edge = edge.withColumn("_part", part_taken(size))
    taken = (F.col("_repeats") * size + F.col("_part")).alias("taken")
    columns = ["doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken]
    return away.select(*columns).unionAll(edge.select(*columns))


def repeated_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as the mix takes them, with the same columns.

    A document whose last repetition is a part has that part's words, joined by blanks, in one row
    more; where there is a column n_chars, that row has the part's length. Texts without words are in
    no mix. Texts are read twice: for sizes and hashes, kept by a checkpoint, and for the mix. Only texts
    in the fine bin at the edge of a source are shuffled.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "source", "text", place(seed).alias("_u"))
    sizes = cut(rows.select("source", words(F.col("text")).alias("size"), "_u"))
    away, edge = planned(rows, plan(sizes, weights, share, max_epochs))
    copies = F.col("_repeats") + F.when(F.col("_full"), 1).otherwise(0)
    out = away.where(F.col("text").rlike(WORD)).select("_row", F.explode(F.array_repeat(F.lit(None).cast("string"), copies.cast("int"))).alias("_text"))
    edge = edge.withColumn("size", words(F.col("text")))
    edge = edge.withColumn("_part", part_taken(F.col("size")))
    whole = F.when(F.col("size") > 0, F.col("_repeats") + F.when(F.col("_part") == F.col("size"), 1).otherwise(0)).otherwise(0).cast("int")
    first = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest("_part", F.lit(1)).cast("int"))
    rest = F.when((F.col("_part") > 0) & (F.col("_part") < F.col("size")), F.array(F.array_join(first, " "))).otherwise(F.array().cast("array<string>"))
    cuts = edge.select("_row", F.explode(F.concat(F.array_repeat(F.lit(None).cast("string"), whole), rest)).alias("_text"))
    out = out.unionAll(cuts)
    own = {"text": F.coalesce("_text", F.col("_row.text"))}
    if "n_chars" in columns:
        own["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.length("_row.text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


def op5_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substring(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM s),
r AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (total - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE)) / CAST(all_w - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS found FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN found IS NULL OR ratio < found THEN CAST(cap AS DOUBLE) ELSE least(found * w, CAST(cap AS DOUBLE)) END AS target
      FROM l, f),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
c AS (SELECT d.*, g.source_size, g.target, g.whole, CAST(floor(g.target + 0.5) AS BIGINT) - g.whole * g.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(rest - below, size)) AS BIGINT) AS taken FROM c
"""
