"""TF-IDF search: any query word may match, repeated query words count again.

A text is taken apart once for a search. For many searches, ``build`` stores an inverted index: a
table of postings by token, of which a search reads the buckets of its words only.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import tokens

#: Folders that the postings are dealt out to.
BUCKETS = 64
#: Bytes of text whose postings one task for each folder writes; more texts are dealt out to more tasks.
TASK_TEXT = 2 << 30
#: Counts of so many searches at most are kept at a time; older ones are made again if asked for.
SEARCHES = 4
_kept: deque[DataFrame] = deque()


def query_words(spark: SparkSession, query: str) -> Counter:
    """Words of a query and how often they stand in it, taken apart as texts are."""
    return Counter(spark.range(1).select(tokens(F.lit(query))).first()[0]) if query else Counter()


def _counted(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, token, n, length) for each row and its tokens: ends of equal tokens in the sorted ones, without a shuffle."""
    taken = df.select(F.col(id_col), F.explode(F.array(F.struct(F.sort_array(tokens(F.col(text))).alias("t")))).alias("_s")).select(id_col, F.col("_s.t").alias("_t"))
    size = F.size("_t")
    ends = F.filter(F.sequence(F.lit(0), size), lambda i: (i > 0) & ((i == size) | (F.get("_t", i - 1) != F.get("_t", i))))
    each = taken.select(id_col, "_t", size.alias("length"), ends.alias("_ends")).select(id_col, "length", "_t", "_ends", F.posexplode("_ends").alias("_p", "_end"))
    before = F.coalesce(F.get("_ends", F.col("_p") - 1), F.lit(0))
    return each.select(id_col, F.get("_t", F.col("_end") - 1).alias("token"), (F.col("_end") - before).alias("n"), "length")


def frequencies(df: DataFrame, text: str = "text", id_col: str = "_id") -> DataFrame:
    """(id, token, n, length): how often a token stands in a document, and the document's tokens."""
    return _counted(df, text, id_col).groupBy(id_col, "length", "token").agg(F.sum("n").alias("n"))


def _top(out: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    return out if limit is None else out.orderBy(F.desc("score"), F.asc(id_col)).limit(limit)


def _none(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))


def _keep(hits: DataFrame) -> None:
    """Remember what is persisted, and let go of what is too old; a stopped session has let go already."""
    for old in [x for x in _kept if x.sparkSession is not hits.sparkSession]:
        _kept.remove(old)
    _kept.append(hits)
    while len(_kept) > SEARCHES:
        _kept.popleft().unpersist()


def search(df: DataFrame, query: str, limit: int | None = 10, text: str = "text", id_col: str = "_id") -> DataFrame:
    """(id, score) by falling score, ties in order of id.

    score = sum over query words of n / length x ln(N / df), with N all rows of ``df``. Documents
    without a token count in N. One pass takes apart the texts that have a query word as a part, and
    leaves a row of counts for each that has one as a token; these rows, some ten bytes a word, are
    kept in memory or on disk, for the numbers of documents with a word come from them too.
    """
    words = query_words(df.sparkSession, query)
    if not words:
        return _none(df, id_col)
    terms = sorted(words)
    lower = F.lower(F.col(text))
    maybe = F.lit(False)
    for w in terms:
        maybe = maybe | lower.contains(w)
    counts = F.transform("_t.found", lambda t: F.array_position(F.array(*[F.lit(w) for w in terms]), t))
    # A generator stands between the tokens and the conditions on them, or these would be pushed
    # below it and take the text apart again.
    taken = df.where(maybe).select(F.col(id_col), F.explode(F.array(F.struct(tokens(F.col(text)).alias("found")))).alias("_t"))
    hits = taken.select(id_col, F.size("_t.found").alias("n"), F.explode(F.array(F.filter(counts, lambda p: p > 0))).alias("at")).where(F.size("at") > 0)
    hits = hits.select(id_col, "n", *[F.size(F.filter("at", _equal_to(i + 1))).alias(f"_{i}") for i in range(len(terms))]).persist()
    _keep(hits)
    known = hits.agg(*[F.count_if(F.col(f"_{i}") > 0) for i in range(len(terms))]).first()
    total = df.count()
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        if known[i]:
            score = score + F.when(F.col(f"_{i}") > 0, F.col(f"_{i}") / F.col("n") * F.lit(float(words[w])) * F.ln(F.lit(total / known[i]))).otherwise(0.0)
    return _top(hits.select(id_col, score.alias("score")), id_col, limit)


def _equal_to(value: int):
    return lambda x: x == value


def bucket_of(word: Column | str, buckets: int = BUCKETS) -> Column | int:
    """The folder of a token's postings: its crc32 over UTF-8, in Spark or in Python."""
    if isinstance(word, str):
        return zlib.crc32(word.encode()) % buckets
    return (F.crc32(word.cast("binary")) % buckets).cast("int")


@dataclass
class Index:
    """A stored inverted index: postings (token, id, n, length) by bucket of the token, and the number of documents."""

    spark: SparkSession
    path: str

    def postings(self, words: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if words is None:
            return rows
        return rows.where(F.col("bucket").isin(sorted({bucket_of(w) for w in words})) & F.col("token").isin(words))

    def documents(self) -> int:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])["documents"]

    def search(self, query: str, limit: int | None = 10) -> DataFrame:
        """Like ``search`` over the documents that were indexed: (id, score).

        Folders of other words are pruned and files skipped by token; postings meet by document in
        one aggregation with partial sums.
        """
        words = query_words(self.spark, query)
        rows = self.postings(sorted(words))
        if not words:
            return _none(rows, "id")
        found = rows.groupBy("token").agg(F.count("*").alias("df"))
        known = {r["token"]: r["df"] for r in found.collect()}  # a row for each query word
        n = self.documents()
        weight = F.create_map(*[x for w, k in sorted(known.items()) for x in (F.lit(w), F.lit(words[w] * math.log(n / k)))]) if known else F.create_map().cast("map<string,double>")
        scored = rows.select("id", (F.col("n") / F.col("length") * F.try_element_at(weight, F.col("token"))).alias("s"))
        return _top(scored.groupBy("id").agg(F.sum("s").alias("score")), "id", limit)


def build(df: DataFrame, path: str, text: str = "text", id_col: str = "_id", mode: str = "error", spread: int | None = None) -> Index:
    """Store the inverted index of ``df``; documents without a token only count.

    Within a file rows are sorted by token, so a search skips all row groups but those of its words. A
    folder is written by ``spread`` tasks (one for each TASK_TEXT bytes of all texts), to which documents
    are dealt out, so no token is a hot key. Postings are shuffled once; only where ids repeat are those
    of equal ids and lengths added up before.
    """
    spark = df.sparkSession
    ids = df.groupBy(id_col).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size"))
    total = ids.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("size").alias("size")).first()
    spread = spread or max(1, -(-(total["size"] or 0) // TASK_TEXT))
    rows = frequencies(df, text, id_col) if (total["most"] or 0) > 1 else _counted(df, text, id_col)
    rows = rows.select("token", F.col(id_col).alias("id"), F.col("n").cast("int").alias("n"), "length")
    rows = rows.withColumn("bucket", bucket_of(F.col("token")))
    rows = rows.repartitionById(BUCKETS * spread, (F.col("bucket") * spread + F.pmod(F.xxhash64("id"), F.lit(spread))).cast("int"))
    rows.sortWithinPartitions("bucket", "token", "id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(json.dumps({"documents": total["n"] or 0}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")
    return Index(spark, path)


def top_tokens(df: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """(token, n): the most frequent tokens, ties in order of the token."""
    return df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def top_items(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(item, n): the most frequent elements of an array column."""
    return df.select(F.explode(column).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(n)
