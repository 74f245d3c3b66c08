"""Captures of web archives as a table: WARC files by Spark's own text reader.

Records begin at a line ``WARC/1.x``. Files are split there by the reader, so it opens plain and gzipped
files on any file system; plain ones are read in parallel parts. A payload may hold such a line too: a
piece that is shorter than its record's Content-Length is joined with those that follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The line that begins a record, up to the digit of its version, and the end of headers.
BEGIN, BLANK_LINE = "WARC/1.", "\r\n\r\n"
RECORDS = "record_id string, kind string, url string, ts bigint, status int, etag string, last_modified string, digest string, headers map<string,string>, refers_to string, payload binary"


def header_map(block: Column) -> Column:
    """Header lines as a map of lower-case names; of several lines of a name the last stays."""
    lines = F.filter(F.split(block, "\r\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    last = lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(pairs, last))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def _block_bytes(piece: Column) -> Column:
    """Bytes of a record's block in a piece, with the two line ends that close it."""
    return F.octet_length(_after(piece, BLANK_LINE))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of WARC files under ``path``, in the columns that ``revisits.resolve`` takes.

    ``kind`` is 'response' or 'revisit', ``ts`` in seconds, ``digest`` the payload's, ``headers`` those of the
    HTTP message by lower-case names, ``payload`` its body (null for a revisit). Other records are left out.
    A record that ends before its Content-Length, or has no HTTP message, keeps what it has, with nulls.
    """
    pieces = spark.read.option("lineSep", BEGIN).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    wanted = F.coalesce(F.regexp_extract("value", r"(?i)\r\ncontent-length:[ \t]*(\d+)", 1), F.lit("")).try_cast("bigint")
    head = F.col("value").rlike(r"(?is)^\d\r\nwarc-|^\d\r\ncontent-")
    pieces = pieces.withColumns({"wanted": F.when(head, wanted), "have": F.when(head, _block_bytes(F.col("value")))})
    # Whole records, nearly all, pass as they are; only files that have a short one put pieces together.
    short = F.col("wanted").isNull() | (F.coalesce(F.col("have"), F.lit(0)) < F.col("wanted"))
    broken = pieces.where(short & (F.length(F.trim("value")) > 0)).select("file").distinct()
    whole = pieces.join(broken, "file", "left_anti").select("value", "wanted")
    records = whole.unionAll(_joined(pieces.join(broken, "file", "left_semi")))
    return _captures(records)


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of files with payloads that hold the mark, put together by length: (value, wanted).

    A piece belongs to the record before it while that one's length is not reached. The bytes up to a
    piece are a running sum within its file, and a record begins where those asked for are there.
    """
    w = Window.partitionBy("file").orderBy("at")
    size = F.octet_length("value") + len(BEGIN)
    rows = pieces.withColumn("end", F.sum(size).over(w))
    # Where the record that begins with this piece ends, at the earliest.
    needs = F.when(F.col("wanted").isNotNull(), F.col("end") - F.coalesce("have", F.lit(0)) + F.col("wanted"))
    rows = rows.withColumn("needs", F.max(needs).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("wanted").isNotNull() & (F.coalesce(F.col("needs"), F.lit(0)) <= F.col("end") - size)
    rows = rows.withColumn("record", F.sum(begins.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("at", "value", "wanted")))
    grouped = rows.where("record > 0").groupBy("file", "record").agg(parts.alias("p"))
    return grouped.select(F.array_join(F.transform("p", lambda x: x["value"]), BEGIN).alias("value"), F.col("p")[0]["wanted"].alias("wanted"))


def _captures(records: DataFrame) -> DataFrame:
    rows = records.where("wanted is not null").withColumn("_h", header_map(F.substring_index("value", BLANK_LINE, 1)))
    kind = F.col("_h")["warc-type"]
    rows = rows.where(kind.isin("response", "revisit"))
    block = F.substring(_after(F.col("value"), BLANK_LINE).cast("binary"), F.lit(1), F.col("wanted").cast("int"))
    rows = rows.withColumn("_block", block).withColumn("_text", F.col("_block").cast("string"))
    http = F.col("_text").startswith("HTTP/")
    rows = rows.withColumn("headers", F.when(http, header_map(F.substring_index("_text", BLANK_LINE, 1))).otherwise(F.create_map().cast("map<string,string>")))
    body = _after(F.col("_text"), BLANK_LINE).cast("binary")
    h = F.col("_h")
    return rows.select(
        h["warc-record-id"].alias("record_id"), kind.alias("kind"), h["warc-target-uri"].alias("url"),
        F.unix_seconds(F.try_to_timestamp(h["warc-date"])).alias("ts"),
        F.when(http, F.regexp_extract("_text", r"^HTTP/\S+ (\d{3})", 1).try_cast("int")).alias("status"),
        F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"), h["warc-payload-digest"].alias("digest"), "headers",
        h["warc-refers-to"].alias("refers_to"), F.when(http & (kind == "response"), body).alias("payload"),
    )
