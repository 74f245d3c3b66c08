"""Resolution of not-modified revisits of a web archive: an as-of join with checks, in expressions.

A revisit stands for a response that the server did not send again (status 304). It is resolved to
the latest earlier full response of the same canonical URL, if the validators agree; permitted
headers of the revisit then replace those of the response.

A URL may have very many captures, so the as-of join works on blocks of time within blocks of time:
the last response of each block comes from an aggregation with partial results, the last response
before each block from a running window over the blocks of the next wider one, and the exact one
from a window inside the narrowest. So a task orders a URL's widest blocks, the blocks of one, or the
captures of a narrowest one. ``warc.read`` makes the table of captures from archives.
Payloads take no part; ``attach`` fetches them by the record they were resolved to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import table

#: Query parameters that never change a page (fixed values, by name or beginning of a name).
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"
#: Headers of a 304 that replace those of the stored response (fixed values, RFC 9110, section 15.4.5,
#: with Last-Modified); all others describe a message that was not sent.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Widths of blocks of time, each a divisor of the one before, in the unit of ``ts`` (days and half
#: minutes if that is a second).
BLOCKS = (86400, 30)


def canonical_url(url: Column) -> Column:
    """Host without www., user and default port, path without a last slash, sorted parameters without tracking.

    Scheme and fragment are dropped. What is no URL with a scheme and host stays as it is, trimmed.
    """
    url = F.trim(url)
    whole = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[.]", ""), ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(whole, r"[?]([^#]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host == "", url).otherwise(F.concat(host, path, asked))


def _same(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return out


def lower_names(headers: Column) -> Column:
    """A map with lower-case keys; of several spellings of a name the last by code point stays."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, last))


def resolve(records: DataFrame, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Every revisit of ``records`` with its response.

    records: record_id, kind ('response' or 'revisit'), url, ts (bigint), status, etag,
    last_modified, digest (of the payload), headers (map of names in either case; of names that
    differ in case only, the last by code point counts). Other columns are ignored. Returns, for each revisit, record_id, url (canonical), ts, ref_id, ref_ts, outcome,
    status, digest and headers (merged).

    outcome: 'resolved'; 'mismatch' if the latest earlier response has other validators;
    'unverifiable' if the two have no validator in common; 'missing' if there is no earlier
    response. Only responses of status 200 are full. Entity tags compare weakly and come before the
    date, the date before the digest. Captures at the same ts are not earlier; of responses at the
    same ts, the greatest record_id counts. A null URL or ts finds nothing.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", "status", "etag", "last_modified", "digest", lower_names(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("url").isNotNull()
    rows = rows.where(full | (F.col("kind") == "revisit"))
    # Revisits without a URL or a time stay, spread out, and find nothing.
    lost = F.col("url").isNull() | F.col("ts").isNull()
    # A block's key holds the wider ones too, so that a narrower window keeps to them.
    levels = [f"_b{i}" for i in range(len(blocks))]
    rows = rows.withColumns({name: F.floor(F.col("ts") / width) for name, width in zip(levels, blocks, strict=True)})
    rows = rows.withColumn("_spread", F.when(lost, F.xxhash64("record_id")))
    response = F.when(full, F.struct("ts", F.col("record_id").alias("id"), "etag", "last_modified", "digest", "headers"))
    key = F.when(full, F.struct("ts", "record_id"))
    own = ["url", "_spread", *levels]
    lasts = [rows.groupBy(*own).agg(F.max_by(response, key).alias("_last"))]
    order = F.when(F.col("_last").isNotNull(), F.struct("_last.ts", "_last.id"))
    for i in range(len(blocks) - 1, 0, -1):
        lasts.insert(0, lasts[0].groupBy("url", "_spread", *levels[:i]).agg(F.max_by("_last", order).alias("_last")))
    before = None
    for i, last in enumerate(lasts):
        above = ["url", "_spread", *levels[:i]]
        w = Window.partitionBy(*above).orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)
        found = last.withColumn("_near", F.last("_last", ignorenulls=True).over(w))
        if before is not None:
            found = found.alias("x").join(before.alias("y"), _same(above), "left").select("x.*", "y._before")
            found = found.withColumn("_near", F.coalesce("_near", "_before"))
        before = found.select(*above, levels[i], F.col("_near").alias("_before"))
    rows = rows.alias("x").join(before.alias("y"), _same(own)).select("x.*", "y._before")
    # By ts alone: a range up to ts - 1 leaves out captures at the same time.
    earlier = Window.partitionBy(*own).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max_by(response, key).over(earlier), F.col("_before"))
    rows = rows.withColumn("_ref", F.when(~lost, held)).where("kind = 'revisit'")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agree = (
        F.when(F.col("etag").isNotNull() & F.col("_ref.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("_ref.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("_ref.last_modified").isNotNull(), F.col("last_modified") == F.col("_ref.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("_ref.digest").isNotNull(), F.col("digest") == F.col("_ref.digest"))
    )
    outcome = F.when(F.col("_ref").isNull(), "missing").when(agree.isNull(), "unverifiable").when(agree, "resolved").otherwise("mismatch")
    rows = rows.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(own, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    stored = F.map_filter(F.coalesce(F.col("_ref.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(fresh, k))
    return rows.select(
        "record_id", "url", "ts",
        F.col("_ref.id").alias("ref_id"), F.col("_ref.ts").alias("ref_ts"), "outcome",
        F.when(resolved, 200).otherwise(F.col("status")).cast("int").alias("status"),
        F.when(resolved, F.col("_ref.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(resolved, F.map_concat(stored, fresh)).otherwise(own).alias("headers"),
    )


def attach(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the ``payload`` of (record_id, payload); others get null.

    A response with very many revisits is a skewed key of a plain join, which adaptive execution splits.
    """
    p = payloads.select(F.col("record_id").alias("_id"), "payload")
    wanted = F.when(F.col("outcome") == "resolved", F.col("ref_id"))
    return resolved.join(p, wanted == F.col("_id"), "left").drop("_id")


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made of ``pages``: of each page a full response, and one revisit by another spelling of its URL.

    By page_id mod 5 the revisit repeats the entity tag, repeats it weakly, has another one, has the
    date only, or the digest only; for every eleventh page it comes before the response.
    """
    p = F.coalesce(F.col("page_id"), F.lit(-1))
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(p.alias("p"), "url", digest.alias("digest"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.pmod("p", F.lit(28)) + 1).cast("string"), 2, "0"))
    k = F.pmod(F.col("p"), F.lit(5))
    headers = F.create_map(F.lit("date"), day, F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("s1"), F.lit("cache-control"), F.lit("no-cache"))
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    response = F.struct(
        (F.col("p") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), (F.col("p") * 3600).alias("ts"), F.lit(200).alias("status"),
        text(tag).alias("etag"), text(day).alias("last_modified"), F.col("digest").alias("digest"), headers.alias("headers"),
    )
    new_tag = F.when(k == 0, tag).when(k == 1, F.concat(F.lit("W/"), tag)).when(k == 2, F.lit('"changed"'))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.instr("url", "?") > 0, F.lit("&")).otherwise(F.lit("?")), F.lit("utm_medium=again#top"))
    when = F.when(F.pmod(F.col("p"), F.lit(11)) == 0, F.col("p") * 3600 - 1800).otherwise(F.col("p") * 3600 + 90000)
    revisit = F.struct(
        (F.col("p") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), when.alias("ts"), F.lit(304).alias("status"),
        text(new_tag).alias("etag"), F.when(k == 3, day).otherwise(none).alias("last_modified"), F.when(k == 4, F.col("digest")).otherwise(none).alias("digest"),
        F.create_map(F.lit("date"), F.lit("2024-02-01"), F.lit("server"), F.lit("s2"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    return rows.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    names = {"date": "date_header", "server": "server_header", "cache-control": "cache_control", "content-type": "content_type"}
    return out.select("record_id", "url", "ts", "ref_id", "ref_ts", "outcome", "status", "digest", *[F.try_element_at("headers", F.lit(k)).alias(v) for k, v in names.items()])


OP4_SQL = r"""
WITH p AS (SELECT coalesce(page_id, -1) AS p, url, md5(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, '"' || substring(digest, 1, 16) || '"' AS tag, '2024-01-' || lpad(CAST(((p % 28) + 28) % 28 + 1 AS VARCHAR), 2, '0') AS day FROM p),
c AS (
  SELECT p * 2 AS record_id, 'response' AS kind, url, p * 3600 AS ts, tag AS etag, day AS lm, digest FROM q
  UNION ALL
  SELECT p * 2 + 1, 'revisit', regexp_replace(url, '#.*$', '') || CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END || 'utm_medium=again#top',
         CASE WHEN p % 11 = 0 THEN p * 3600 - 1800 ELSE p * 3600 + 90000 END,
         CASE (p % 5 + 5) % 5 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"changed"' END,
         CASE WHEN (p % 5 + 5) % 5 = 3 THEN day END, CASE WHEN (p % 5 + 5) % 5 = 4 THEN digest END FROM q),
u AS (SELECT * REPLACE (trim(url) AS url), regexp_replace(trim(url), '#.*$', '') AS whole FROM c),
v AS (SELECT *,
        regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), '^www[.]', ''), ':(80|443)?$', '') AS host,
        regexp_replace(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(whole, '[?]([^#]*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))) AS kept FROM u),
w AS (SELECT * EXCLUDE (url), CASE WHEN host = '' THEN url ELSE host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM v),
r AS (SELECT *, max(CASE WHEN kind = 'response' THEN {'ts': ts, 'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest} END)
        OVER (PARTITION BY url ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM w),
o AS (SELECT *, CASE WHEN etag IS NOT NULL AND ref.etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(ref.etag, '^W/', '')
                     WHEN lm IS NOT NULL AND ref.lm IS NOT NULL THEN lm = ref.lm
                     WHEN digest IS NOT NULL AND ref.digest IS NOT NULL THEN digest = ref.digest END AS agree
      FROM r WHERE kind = 'revisit'),
f AS (SELECT *, CASE WHEN url IS NULL OR ref IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unverifiable' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM o)
SELECT record_id, url, ts, ref.id AS ref_id, ref.ts AS ref_ts, outcome, CAST(CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END AS INT) AS status,
       CASE WHEN outcome = 'resolved' THEN ref.digest ELSE digest END AS digest, '2024-02-01' AS date_header,
       CASE WHEN outcome = 'resolved' THEN 's1' ELSE 's2' END AS server_header, 'max-age=60' AS cache_control,
       CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type FROM f
"""
