"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

A key's shard among ``n`` follows from the key alone, with no table of ring positions. Going from
``n`` to ``n + 1`` shards moves about ``1 / (n + 1)`` of the keys, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import table

SHARDS = 16
#: Slots are counted within so many bins of a shard, so that no task sorts a whole shard.
BINS = 4096
#: Fixed values of the published algorithm: multiplier of its generator, 2^64 and 2^31.
MULTIPLIER, WORD_SIZE, HALF_WORD = "2862933555777941757", "18446744073709551616", "2147483648"


def key_of(column: Column) -> Column:
    """64 unsigned bits from the md5 of the key as text, as DECIMAL(20); a null key counts as ''."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of an unsigned 64-bit key, by at most ``shards`` steps of the generator.

    64-bit products would overflow a BIGINT, so the generator runs on exact DECIMAL(38).
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"), key.cast("decimal(38,0)").alias("k"))

    def step(acc: Column, _: Column) -> Column:
        k = ((acc["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.lit(WORD_SIZE).cast("decimal(20,0)")).cast("decimal(38,0)")
        top = F.floor(k / F.lit("8589934592").cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        jumped = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(HALF_WORD)) / top)).cast("bigint")
        return F.when(acc["j"] < shards, F.struct(acc["j"].alias("b"), jumped.alias("j"), k.alias("k"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def assign(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard``, and ``grown_shard`` for one shard more. No shuffle."""
    k = key_of(F.col(key))
    return df.withColumns({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)})


def slots(df: DataFrame, order: list[str], key: str, salt: Column, bins: int = BINS) -> DataFrame:
    """``df`` (with ``shard``) plus ``slot``, gapless from 0 in each shard.

    Rows are counted by (shard, bin) with partial aggregation; a bin's offset is the running sum over
    that table of shards x bins rows at most. Rows are ranked inside their bin only, so a task sorts
    1 / (shards x bins) of them. The join with the offsets and the ranking go by the same key, so
    they share one exchange. A row's bin follows from its key's hash and ``salt`` (a whole number), so
    rows that share a key, or have none, share a bin only if they have the same salt too; equal rows
    get consecutive slots in either order.
    """
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 17, 8), 16, 10).cast("bigint")
    df = df.withColumn("_bin", (bucket + salt) % bins)
    per_bin = df.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = Window.partitionBy("shard", "_bin").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = df.join(offsets, ["shard", "_bin"])
    return out.withColumn("slot", (F.col("_offset") + F.row_number().over(ranked) - 1).cast("bigint")).drop("_bin", "_offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bins: int = BINS) -> DataFrame:
    """Manifest of ``docs`` over ``shards``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and crc 0, like an empty one; a null doc_id hashes as an empty key.
    Rows that repeat a doc_id go to the same shard. Columns other than doc_id and text are ignored;
    no rows give none. Texts of any length take part by their size and crc only.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = slots(assign(rows, "doc_id", shards), ["doc_id", "text_crc32", "size"], "doc_id", F.col("text_crc32"), bins)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE c0(n, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM c0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM c0 WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
b AS (SELECT d.*, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS h FROM d),
s AS (SELECT r, doc_id, strlen(text) + 1 AS size, ('0x' || substring(m, 17, 8))::BIGINT AS half,
             xor(4294967295, list_reduce(h, lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)]), 4294967295::BIGINT)) AS text_crc32 FROM b, tab),
j(r, n, b, j, k) AS (
  SELECT r, n, -1::BIGINT, 0::BIGINT, ('0x' || substring(m, 1, 16))::UBIGINT::HUGEINT FROM d, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT r, n, j, floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592 AS DOUBLE) + 1.0)))::BIGINT, k2
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE j < n)),
p AS (SELECT r, max(b) FILTER (WHERE n = 16) AS shard, max(b) FILTER (WHERE n = 17) AS grown FROM j WHERE j >= n GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY (half + text_crc32) % 4096, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM s JOIN p USING (r)
"""
