"""Queries over the test tables, one for each operator, each with SQL that must agree where SQL can say it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars
from docloom.operators import access, fulltext, vector
from docloom.operators.latest import latest_per_key
from docloom.plans.filters import find
from docloom.plans.pipeline import aggregate, distinct

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with the quality and toxicity of labels, null where there are none."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def finding(name: str, source: str, where: dict, columns: list[str], sql_where: str) -> None:
    """A filter over a table, and its SQL."""
    rows = LABELLED if source == "labelled" else source

    @query(name, f"SELECT {', '.join(columns)} FROM {rows} t WHERE {sql_where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = labelled(spark, d) if source == "labelled" else table(spark, d, source)
        return find(df, where).select(*columns)


E3 = ["event_id", "user_id", "event_type"]
finding("find_all", "nation", {}, ["n_nationkey", "n_name"], "true")
finding("find_eq", "events", {"event_type": "error"}, E3, "event_type = 'error'")
finding("find_eq_operator", "events", {"user_id": {"$eq": 13}}, E3, "user_id = 13")
finding("find_and", "events", {"event_type": "error", "user_id": {"$lt": 50}}, E3, "event_type = 'error' AND user_id < 50")
finding("find_gt", "lineitem", {"l_quantity": {"$gt": 45}}, ["l_orderkey", "l_linenumber"], "l_quantity > 45")
finding("find_gte", "lineitem", {"l_discount": {"$gte": 0.09}}, ["l_orderkey", "l_linenumber"], "l_discount >= 0.09")
finding("find_lt", "orders", {"o_totalprice": {"$lt": 20000}}, ["o_orderkey"], "o_totalprice < 20000")
finding("find_lte", "part", {"p_size": {"$lte": 5}}, ["p_partkey", "p_size"], "p_size <= 5")
finding("find_range", "lineitem", {"l_quantity": {"$gte": 10, "$lte": 12}}, ["l_orderkey", "l_linenumber"], "l_quantity BETWEEN 10 AND 12")
finding("find_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, ["o_orderkey"], "o_orderstatus IS DISTINCT FROM 'F'")
finding("find_ne_missing", "labelled", {"quality": {"$ne": 1}}, ["doc_id"], "quality IS DISTINCT FROM 1")
finding("find_eq_null", "labelled", {"quality": None}, ["doc_id"], "quality IS NULL")
finding("find_in", "labelled", {"quality": {"$in": [0]}}, ["doc_id"], "coalesce(quality IN (0), false)")
finding("find_in_null", "labelled", {"quality": {"$in": [0, None]}}, ["doc_id"], "coalesce(quality IN (0), false) OR quality IS NULL")
finding("find_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, ["o_orderkey"], "NOT coalesce(o_orderstatus IN ('F', 'P'), false)")
finding("find_nin_missing", "labelled", {"quality": {"$nin": [1]}}, ["doc_id"], "NOT coalesce(quality IN (1), false)")
finding("find_nin_null", "labelled", {"quality": {"$nin": [1, None]}}, ["doc_id"], "NOT (coalesce(quality IN (1), false) OR quality IS NULL)")
finding("find_regex", "part", {"p_name": {"$regex": "a.e"}}, ["p_partkey"], "regexp_matches(p_name, 'a.e')")
finding("find_regex_anchored", "orders", {"o_orderpriority": {"$regex": "^1-"}}, ["o_orderkey"], "regexp_matches(o_orderpriority, '^1-')")
finding("find_exists_true", "labelled", {"toxic": {"$exists": True}}, ["doc_id"], "toxic IS NOT NULL")
finding("find_exists_false", "labelled", {"toxic": {"$exists": False}}, ["doc_id"], "toxic IS NULL")
finding("find_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, ["o_orderkey"], "o_orderstatus = 'P' OR o_totalprice > 300000")
finding("find_and_list", "orders", {"$and": [{"o_orderstatus": "O"}, {"o_orderpriority": {"$regex": "URGENT$"}}]}, ["o_orderkey"], "o_orderstatus = 'O' AND regexp_matches(o_orderpriority, 'URGENT$')")
finding("find_not_nested_bool", "orders", {"$nor": [{"o_orderstatus": "F"}, {"$and": [{"o_totalprice": {"$lt": 100000}}, {"o_orderpriority": {"$not": {"$regex": "LOW"}}}]}]}, ["o_orderkey"], "NOT (o_orderstatus = 'F' OR (o_totalprice < 100000 AND NOT regexp_matches(o_orderpriority, 'LOW')))")
finding("find_not_missing", "labelled", {"quality": {"$not": {"$gte": 1}}}, ["doc_id"], "NOT coalesce(quality >= 1, false)")
finding("find_type_mismatch", "events", {"user_id": {"$gt": "5"}}, E3, "false")
finding("find_mod", "events", {"event_id": {"$mod": [7, 3]}}, E3, "event_id % 7 = 3")
finding("find_point", "orders", {"o_orderkey": 77}, ["o_orderkey", "o_custkey"], "o_orderkey = 77")
finding("find_key_range", "orders", {"o_orderkey": {"$gte": 100, "$lt": 200}}, ["o_orderkey", "o_custkey"], "o_orderkey >= 100 AND o_orderkey < 200")
finding("find_array_size", "embeddings", {"embedding": {"$size": 64}, "label": 3}, ["vec_id"], "len(embedding) = 64 AND label = 3")
finding("change_filter", "events", {"event_type": {"$in": ["purchase", "signup"]}}, E3, "event_type IN ('purchase', 'signup')")

PROPS = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("find_nested", f"SELECT event_id FROM events WHERE {PROPS} >= 50")
def find_nested(spark, d):
    return find(table(spark, d, "events").withColumn("props", F.from_json("props", "k bigint")), {"props.k": {"$gte": 50}}).select("event_id")


def as_documents(df: DataFrame, id_col: str) -> DataFrame:
    """Rows as schema-free documents (_id, doc)."""
    return df.select(F.col(id_col).alias("_id"), F.to_variant_object(F.struct(*df.columns)).alias("doc"))


@query("find_nested_variant", f"SELECT event_id AS _id FROM events WHERE {PROPS} >= 50 AND event_type <> 'view'")
def find_nested_variant(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("_id"), F.parse_json(F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))).alias("doc"))
    return find(df, {"props.k": {"$gte": 50}, "type": {"$ne": "view"}}).select("_id")


@query("find_variant_missing", f"SELECT doc_id AS _id FROM {LABELLED} WHERE quality IS DISTINCT FROM 1 AND regexp_matches(source, '1$')")
def find_variant_missing(spark, d):
    return find(as_documents(labelled(spark, d), "doc_id"), {"quality": {"$ne": 1}, "source": {"$regex": "1$"}}).select("_id")


@query("find_variant_in_or", f"SELECT doc_id AS _id FROM {LABELLED} WHERE lang IN ('de', 'fr') OR coalesce(toxic = 1, false)")
def find_variant_in_or(spark, d):
    return find(as_documents(labelled(spark, d), "doc_id"), {"$or": [{"lang": {"$in": ["de", "fr", 5]}}, {"toxic": 1}]}).select("_id")


@query("find_limit_by_id", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def find_limit_by_id(spark, d):
    return find(table(spark, d, "orders"), {"o_orderstatus": "O"}, limit=100, id_col="o_orderkey").select("o_orderkey", "o_custkey")


@query("page_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_skip_limit(spark, d):
    return find(table(spark, d, "orders"), None, 20, 40, [("o_totalprice", -1)], "o_orderkey").select("o_orderkey", "o_totalprice")


@query("key_scan", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 50 ORDER BY c_custkey LIMIT 25")
def key_scan(spark, d):
    return find(table(spark, d, "customer"), {"c_custkey": {"$gte": 50}}, 25, id_col="c_custkey").select("c_custkey", "c_name")


@query("count_filtered", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R'")
def count_filtered(spark, d):
    return aggregate(table(spark, d, "lineitem"), [{"$match": {"l_quantity": {"$gte": 25}, "l_returnflag": "R"}}, {"$count": "n"}])


def grouping(name: str, source: str, stages: list[dict], sql: str, rounded: list[str] = (), id_col: str = "_id") -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = labelled(spark, d) if source == "labelled" else table(spark, d, source)
        out = aggregate(df, stages, id_col=id_col)
        return out.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else out


grouping("group_count", "events", [{"$group": {"_id": "$event_type", "n": {"$sum": 1}}}], "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1")
grouping("group_null_key", "labelled", [{"$group": {"_id": "$quality", "n": {"$sum": 1}}}], f"SELECT quality AS _id, count(*) AS n FROM {LABELLED} GROUP BY 1")
grouping("group_compound", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}], "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
grouping("group_global", "lineitem", [{"$group": {"_id": None, "n": {"$sum": 1}, "most": {"$max": "$l_quantity"}}}], "SELECT count(*) AS n, max(l_quantity) AS most FROM lineitem")
grouping(
    "group_avg_min_max_sum",
    "lineitem",
    [{"$group": {"_id": "$l_returnflag", "a": {"$avg": "$l_extendedprice"}, "lo": {"$min": "$l_discount"}, "hi": {"$max": "$l_tax"}, "s": {"$sum": "$l_quantity"}}}],
    "SELECT l_returnflag AS _id, round(avg(l_extendedprice), 6) AS a, min(l_discount) AS lo, max(l_tax) AS hi, round(sum(l_quantity), 6) AS s FROM lineitem GROUP BY 1",
    ["a", "s"],
)
grouping("group_first_last", "events", [{"$group": {"_id": "$user_id", "f": {"$first": "$event_type"}, "l": {"$last": "$event_type"}}}], "SELECT user_id AS _id, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l FROM events GROUP BY 1", id_col="event_id")
grouping("distinct_pairs", "customer", [{"$group": {"_id": {"seg": "$c_mktsegment", "nation": "$c_nationkey"}}}], "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nation FROM customer")
grouping(
    "pipeline_match_group_sort_limit",
    "orders",
    [{"$match": {"o_totalprice": {"$gte": 50000}}}, {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}, "spent": {"$max": "$o_totalprice"}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}],
    "SELECT o_custkey AS _id, count(*) AS n, max(o_totalprice) AS spent FROM orders WHERE o_totalprice >= 50000 GROUP BY 1 ORDER BY n DESC, _id LIMIT 10",
)
SORT = [{"$sort": {"o_orderstatus": 1, "o_totalprice": -1}}, {"$limit": 50}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}]
grouping("sort_multi", "orders", SORT, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50", id_col="o_orderkey")


@query("sort_multi_legacy", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderstatus, o_orderkey LIMIT 50")
def sort_multi_legacy(spark, d):
    return aggregate(table(spark, d, "orders"), SORT, id_col="o_orderkey", legacy_sort=True)


grouping("sort_nulls", "labelled", [{"$sort": {"quality": 1}}, {"$limit": 30}, {"$project": {"doc_id": 1, "quality": 1}}], f"SELECT doc_id, quality FROM {LABELLED} ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 30", id_col="doc_id")
grouping("skip_stage", "nation", [{"$sort": {"n_name": 1}}, {"$skip": 5}, {"$limit": 5}, {"$project": {"n_name": 1}}], "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 5", id_col="n_nationkey")
grouping("project_fields", "events", [{"$project": {"event_id": 1, "event_type": 1, "value": 0, "nothing": 1}}], "SELECT event_id, event_type, NULL AS nothing FROM events")


@query("project_nested", f'SELECT event_id, {PROPS} AS "props.k" FROM events')
def project_nested(spark, d):
    return aggregate(table(spark, d, "events").withColumn("props", F.from_json("props", "k bigint")), [{"$project": {"event_id": 1, "props.k": 1}}])


@query("group_variant", "SELECT lang AS _id, count(*) AS n, CAST(round(sum(n_chars), 6) AS DOUBLE) AS chars FROM documents GROUP BY 1")
def group_variant(spark, d):
    return aggregate(as_documents(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id"), [{"$group": {"_id": "$lang", "n": {"$sum": 1}, "chars": {"$sum": "$n_chars"}}}]).withColumn("chars", F.round("chars", 6))


@query("unwind_count", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unwind_count(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("word"))
    return aggregate(df, [{"$unwind": "$word"}, {"$group": {"_id": {"word": "$word"}, "n": {"$count": {}}}}], id_col="p_partkey")


@query("lookup_size", "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
def lookup_size(spark, d):
    out = aggregate(table(spark, d, "nation"), [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "cs"}}], tables={"customer": table(spark, d, "customer").select("c_custkey", "c_nationkey")})
    return out.select("n_nationkey", "n_name", F.size("cs").cast("bigint").alias("n"))


@query("union_collections", "SELECT name, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) GROUP BY 1")
def union_collections(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return aggregate(a, [{"$unionWith": "s"}, {"$group": {"_id": {"name": "$name"}, "n": {"$sum": 1}}}], tables={"s": b})


@query("distinct_values", "SELECT DISTINCT event_type AS value FROM events")
def distinct_values(spark, d):
    return distinct(table(spark, d, "events"), "event_type")


@query("group_count_distinct", "SELECT event_type AS _id, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def group_count_distinct(spark, d):
    out = aggregate(table(spark, d, "events"), [{"$group": {"_id": {"t": "$event_type", "u": "$user_id"}}}, {"$group": {"_id": "$t", "n": {"$sum": 1}}}])
    return out


grouping("conditional_counts", "events", [{"$group": {"_id": None, "total": {"$count": {}}, "errors": {"$countIf": {"event_type": "error"}}, "large": {"$countIf": {"value": {"$gte": 100}}}}}], "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value >= 100) AS large FROM events")


@query("topk_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_desc(spark, d):
    return find(table(spark, d, "orders"), None, 25, 0, [("o_totalprice", -1)], "o_orderkey").select("o_orderkey", "o_totalprice")


def probe(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
V = "CAST(embedding AS DOUBLE[])"
COSINE = f"list_dot_product({V}, q) / (sqrt(list_dot_product({V}, {V})) * sqrt(list_dot_product(q, q)) + 1e-10)"
DISTANCE = f"(list_dot_product({V}, {V}) + list_dot_product(q, q) - 2 * list_dot_product({V}, q))"
SCORES = {"cosine": COSINE, "l2": f"1 / (1 + list_sum(list_transform(list_zip({V}, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", "ip": f"list_dot_product({V}, q)"}

for _metric, _score in SCORES.items():

    @query(f"knn_{_metric}", f"SELECT vec_id, label, round({_score}, 6) AS similarity FROM embeddings, {Q} ORDER BY {_score} DESC, vec_id LIMIT 10")
    def knn(spark, d, metric=_metric):
        out = vector.knn(table(spark, d, "embeddings"), probe(spark, d), 10, metric, "embedding", "vec_id")
        return out.withColumn("similarity", F.round("similarity", 6))


@query("knn_post_filter", f"SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT *, {COSINE} AS s FROM embeddings, {Q} ORDER BY s DESC, vec_id LIMIT 50) WHERE label = 3")
def knn_post_filter(spark, d):
    return vector.knn(table(spark, d, "embeddings"), probe(spark, d), 50, "cosine", "embedding", "vec_id", {"label": 3}).withColumn("similarity", F.round("similarity", 6))


@query("knn_pre_filter", f"SELECT vec_id, label, round({COSINE}, 6) AS similarity FROM embeddings, {Q} WHERE label = 3 ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def knn_pre_filter(spark, d):
    return vector.knn(table(spark, d, "embeddings"), probe(spark, d), 10, "cosine", "embedding", "vec_id", {"label": 3}, "pre").withColumn("similarity", F.round("similarity", 6))


@query(
    "knn_batch",
    """SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM (
      SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
        SELECT a.vec_id, b.vec_id AS query_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) + 1e-10) AS s
        FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)) WHERE rank <= 5""",
)
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    out = vector.knn_batch(e, queries, 5, "cosine", "embedding", "vec_id")
    return out.select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("vector_stats", "SELECT count(*) AS n, max(len(embedding)) AS dims, min(len(embedding)) AS least_dims FROM embeddings")
def vector_stats(spark, d):
    return vector.stats(table(spark, d, "embeddings"), "embedding")


@query("vector_split", "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY 1")
def vector_split(spark, d):
    good, _ = vector.split_by_dims(table(spark, d, "embeddings"), 64, "embedding")
    return good.groupBy("label").agg(F.count("*").alias("n"))


TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in scalars.STOP_WORDS) + "))"


@query(
    "fulltext_tfidf",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n FROM t),
    q AS (SELECT unnest(['tion', 'with', 'hethe', 'what', 'what', 'nicht']) AS token),
    qq AS (SELECT token, count(*) AS m FROM q WHERE length(token) > 2 AND token <> 'with' GROUP BY 1),
    f AS (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM t), c AS (SELECT doc_id, len, token, count(*) AS c FROM f JOIN qq USING (token) GROUP BY 1, 2, 3),
    df AS (SELECT token, count(*) AS df FROM c GROUP BY 1)
    SELECT doc_id, round(sum(m * c / len * ln(n / df)), 6) AS score FROM c JOIN df USING (token) JOIN qq USING (token), n GROUP BY doc_id""",
)
def fulltext_tfidf(spark, d):
    out = fulltext.search(table(spark, d, "documents"), "Tion with hethe, what what nicht", None, "text", "doc_id")
    return out.withColumn("score", F.round("score", 6))


@query("text_contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thation')")
def text_contains_ci(spark, d):
    return table(spark, d, "documents").where(scalars.contains_ci(F.col("text"), "Thation")).select("doc_id")


@query("token_top10", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 10")
def token_top10(spark, d):
    return fulltext.top_tokens(table(spark, d, "documents"))


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(spark, d):
    return latest_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("recent_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def recent_n(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id", "user_id")


@query("conv_last_turn", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def conv_last_turn(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("role_counts", "SELECT role AS _id, count(*) AS n FROM conversations GROUP BY 1")
def role_counts(spark, d):
    return aggregate(table(spark, d, "conversations"), [{"$group": {"_id": "$role", "n": {"$sum": 1}}}])


@query("short_ids", "SELECT c_custkey, substring(sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name), 1, 16) AS id FROM customer")
def short_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.short_id(F.col("c_custkey"), F.col("c_name")).alias("id"))


@query("encrypt_roundtrip", "SELECT c_custkey, c_name, length(c_name) + 28 AS size FROM customer")
def encrypt_roundtrip(spark, d):
    key = bytes(range(32))
    rows = table(spark, d, "customer").select("c_custkey", scalars.encrypt(F.col("c_name"), key).alias("e"))
    return rows.select("c_custkey", scalars.decrypt(F.col("e"), key).alias("c_name"), F.length("e").cast("bigint").alias("size"))


@query("permitted_rows", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3)")
def permitted_rows(spark, d):
    grants = spark.createDataFrame([("ann", "1", "read"), ("ann", "2", "write"), ("ann", "3", "admin"), ("ann", "4", "guest"), ("bob", "5", "admin")], "user string, database string, role string")
    rows = table(spark, d, "customer").withColumn("database", F.col("c_nationkey").cast("string"))
    return access.permitted(rows, grants, "ann").select("c_custkey")


@query("toon_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def toon_roundtrip(spark, d):
    from docloom.sources.toon_files import read_toon, write_toon

    rows = table(spark, d, "customer")
    folder = _folder(spark, "toon")
    write_toon(rows, folder, "customer")
    return read_toon(spark, folder, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


@query("collection_state", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'closed' ELSE 'open' END AS state, c_nationkey FROM customer WHERE NOT c_acctbal < 0")
def collection_state(spark, d):
    c = _collection(spark, d)
    from docloom.functions.fields import VariantField

    doc = F.col("doc")
    return c.frame().select("_id", VariantField(doc, "state").as_kind("string", "").alias("state"), VariantField(doc, "c_nationkey").as_kind("number", 0).cast("int").alias("c_nationkey"))


@query(
    "change_stream",
    """SELECT op, n FROM (SELECT 'insert' AS op, count(*) AS n FROM customer UNION ALL SELECT 'update', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT 'delete', count(*) FROM customer WHERE c_acctbal < 0)""",
)
def change_stream(spark, d):
    from docloom.streaming import changes

    c = _collection(spark, d)
    out = _folder(spark, "changes")
    changes.subscribe(changes.watch(c), lambda batch, n: batch.select("operationType").write.mode("overwrite").parquet(f"{out}/batch={n}"), _folder(spark, "resume"), once=True).awaitTermination()
    return spark.read.schema("operationType string").parquet(out).groupBy(F.col("operationType").alias("op")).agg(F.count("*").alias("n"))


# -- collections, catalog, streams and access: each through the engine's own calls


def shown(c) -> DataFrame:
    """_id, state and nation of a collection of customers."""
    from docloom.functions.fields import VariantField

    doc = F.col("doc")
    return c.frame().select("_id", VariantField(doc, "state").as_kind("string", "").alias("state"), VariantField(doc, "c_nationkey").as_kind("number", 0).cast("int").alias("c_nationkey"))


KEPT = "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'closed' ELSE 'open' END AS state, c_nationkey FROM customer WHERE NOT c_acctbal < 0"


@query("find_by_id", f"SELECT _id, state FROM ({KEPT}) WHERE _id = '7'")
def find_by_id(spark, d):
    found = _collection(spark, d).find_by_id("7")
    return spark.createDataFrame([(found["_id"], found["state"])] if found else [], "_id string, state string")


@query("find_one", f"SELECT _id, c_nationkey FROM ({KEPT}) WHERE c_nationkey >= 10 ORDER BY _id LIMIT 1")
def find_one(spark, d):
    found = _collection(spark, d).find_one({"c_nationkey": {"$gte": 10}})
    return spark.createDataFrame([(found["_id"], found["c_nationkey"])] if found else [], "_id string, c_nationkey int")


@query("compacted_state", f"SELECT _id, CASE WHEN c_nationkey = 5 THEN 'moved' ELSE state END AS state, c_nationkey FROM ({KEPT}) UNION ALL SELECT 'new', 'fresh', 99")
def compacted_state(spark, d):
    c = _collection(spark, d)
    c.compact()
    c.update_many({"c_nationkey": 5}, {"state": "moved"})
    c.insert({"_id": "new", "state": "fresh", "c_nationkey": 99})
    return shown(c)


@query("indexed_find", f"SELECT _id, c_nationkey FROM ({KEPT}) WHERE c_nationkey BETWEEN 3 AND 6")
def indexed_find(spark, d):
    c = _collection(spark, d)
    c.create_index("c_nationkey")
    c.compact()
    from docloom.functions.fields import VariantField

    return c.find({"c_nationkey": {"$gte": 3, "$lte": 6}}, None).select("_id", VariantField(F.col("doc"), "c_nationkey").as_kind("number", 0).cast("int").alias("c_nationkey"))


@query("encrypted_collection", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation WHERE n_regionkey = 1")
def encrypted_collection(spark, d):
    from docloom.functions.fields import VariantField
    from docloom.sources.collections import Store

    c = Store(spark, _folder(spark, "store")).create_database("shop").create_collection("nations", password="secret")
    c.insert_many(table(spark, d, "nation").withColumn("_id", F.col("n_nationkey").cast("string")))
    return c.find({"n_regionkey": 1}, None).select("_id", VariantField(F.col("doc"), "n_name").as_kind("string", "").alias("n_name"))


@query("page_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 15 AS has_more FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def page_total(spark, d):
    from docloom.plans.filters import page

    p = page(table(spark, d, "orders"), {"o_orderstatus": "P"}, 5, 10, id_col="o_orderkey")
    return p["rows"].select("o_orderkey", F.lit(p["total"]).cast("bigint").alias("total"), F.lit(p["has_more"]).alias("has_more"))


@query("json_ingest", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus, o_totalprice FROM orders")
def json_ingest(spark, d):
    from docloom.functions.fields import VariantField
    from docloom.sources.collections import Store, ingest_json

    folder = _folder(spark, "json")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_totalprice").write.json(folder)
    c = Store(spark, _folder(spark, "store")).create_database("shop").create_collection("orders")
    c.insert_many(ingest_json(spark, folder, "key"))
    doc = F.col("doc")
    return c.frame().select("_id", VariantField(doc, "o_orderstatus").as_kind("string", "").alias("o_orderstatus"), VariantField(doc, "o_totalprice").as_kind("number", 0).alias("o_totalprice"))


@query("foreign_import", "SELECT 'id' || CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer")
def foreign_import(spark, d):
    from docloom.functions.fields import VariantField
    from docloom.sources.collections import ingest_json

    folder = _folder(spark, "json")
    table(spark, d, "customer").select(F.struct(F.concat(F.lit("id"), "c_custkey").alias("$oid")).alias("_id"), "c_name").write.json(folder)
    return ingest_json(spark, folder, "_id").select("_id", VariantField(F.col("doc"), "c_name").as_kind("string", "").alias("c_name"))


@query("store_stats", "SELECT 3 AS databases, 2 AS collections, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS documents, true AS has_bytes")
def store_stats(spark, d):
    s = _catalog(spark, d).stats()
    return spark.createDataFrame([(s["databases"], s["collections"], s["documents"], s["bytes"] > 0)], "databases int, collections int, documents bigint, has_bytes boolean")


@query("catalog_listing", "SELECT * FROM (VALUES ('default', NULL), ('one', 'nation'), ('two', 'region')) t(db, coll)")
def catalog_listing(spark, d):
    s = _catalog(spark, d)
    rows = [(db, coll) for db in s.databases() for coll in (s.database(db).collections() or [None])]
    return spark.createDataFrame(rows, "db string, coll string")


@query("dropped", "SELECT * FROM (VALUES ('drop', 'one', 'nation')) t(op, db, coll)")
def dropped(spark, d):
    s = _catalog(spark, d)
    s.database("one").drop_collection("nation")
    return s.events().select("op", "db", "coll")


@query("vector_collection", "SELECT label AS _id, count(*) AS n, 64 AS dims, count(*) AS failed FROM embeddings GROUP BY 1")
def vector_collection(spark, d):
    """A collection for each label, written with as many rows of another length, which come back."""
    from docloom.sources.collections import Store

    db = Store(spark, _folder(spark, "store")).create_database("v")
    e = table(spark, d, "embeddings").withColumn("_id", F.col("vec_id").cast("string"))
    failed = []
    for (label,) in e.select("label").distinct().collect():
        own = e.where(F.col("label") == label)
        short = own.withColumn("_id", F.concat(F.lit("short"), "_id")).withColumn("embedding", F.slice("embedding", 1, 5))
        out = db.create_collection(str(label), dims=64).insert_vectors(own.unionByName(short).select("_id", F.col("embedding").alias("vector")))
        failed.append((label, out["failed"].count()))
    stats = db.vector_stats().select(F.col("collection").cast("int").alias("_id"), "n", "dims")
    return stats.join(spark.createDataFrame(failed, "_id int, failed bigint"), "_id")


@query("collection_knn", f"SELECT CAST(vec_id AS VARCHAR) AS _id, round({COSINE}, 6) AS similarity FROM embeddings, {Q} ORDER BY {COSINE} DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def collection_knn(spark, d):
    from docloom.sources.collections import Store

    c = Store(spark, _folder(spark, "store")).create_database("v").create_collection("e", dims=64)
    c.insert_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("_id"), F.col("embedding").alias("vector")))
    return c.search(probe(spark, d), 10).select("_id", F.round("similarity", 6).alias("similarity"))


@query("ivf_every_50th", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ivf_every_50th(spark, d):
    """Recall of the stored index with the probes that it chose, against the exact search, at 10 neighbours."""
    from docloom.operators import ivf

    e = table(spark, d, "embeddings")
    index = ivf.build(e, _folder(spark, "ivf"), vector_col="embedding", id_col="vec_id")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = index.search_batch(spark, queries, 10, vector_col="embedding", id_col="vec_id").select("query_id", "vec_id", F.lit(1).alias("found"))
    exact = vector.knn_batch(e, queries, 10, "cosine", "embedding", "vec_id").select("query_id", "vec_id")
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


@query("fulltext_index", SQL["fulltext_tfidf"])
def fulltext_index(spark, d):
    index = fulltext.build(table(spark, d, "documents"), _folder(spark, "postings"), "text", "doc_id")
    out = index.search("Tion with hethe, what what nicht", None)
    return out.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("inverted_postings", f"SELECT token, doc_id AS id, count(*) AS n, len AS length FROM (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) WHERE token IN ('license', 'nicht', 'tion') GROUP BY 1, 2, 4")
def inverted_postings(spark, d):
    index = fulltext.build(table(spark, d, "documents"), _folder(spark, "postings"), "text", "doc_id")
    return index.postings(["license", "nicht", "tion"]).select("token", "id", F.col("n").cast("bigint").alias("n"), F.col("length").cast("bigint").alias("length"))


finding("find_time_range", "events", {"ts": {"$gte": "2024-01-02T03:04:05.5", "$lt": "2024-01-09"}}, E3, "ts >= TIMESTAMP '2024-01-02 03:04:05.5' AND ts < TIMESTAMP '2024-01-09'")
finding("find_time_eq", "orders", {"o_orderdate": {"$in": ["1995-01-01", "1996-06-06T00:00:00", None]}}, ["o_orderkey"], "o_orderdate IN (TIMESTAMP '1995-01-01', TIMESTAMP '1996-06-06') OR o_orderdate IS NULL")

WORDS = "string_split(p_name, ' ')"


def finding_words(name: str, where: dict, sql: str) -> None:
    @query(name, f"SELECT p_partkey FROM part WHERE {sql}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return find(table(spark, d, "part").withColumn("words", F.split("p_name", " ")), where).select("p_partkey")


finding_words("find_all_of", {"words": {"$all": ["red", "bolt"]}}, f"list_has_all({WORDS}, ['red', 'bolt'])")
finding_words("find_elem_match", {"words": {"$elemMatch": {"$regex": "^gi"}}}, f"len(list_filter({WORDS}, lambda w: regexp_matches(w, '^gi'))) > 0")
finding_words("find_tag", {"words": {"$contains": "gear"}}, f"list_contains({WORDS}, 'gear')")
finding_words("find_overlaps", {"words": {"$overlaps": ["ring", "old"]}}, f"list_has_any({WORDS}, ['ring', 'old'])")


@query("find_type", f"SELECT doc_id AS _id FROM {LABELLED} WHERE quality IS NOT NULL")
def find_type(spark, d):
    return find(as_documents(labelled(spark, d), "doc_id"), {"quality": {"$type": "number"}, "lang": {"$not": {"$type": "array"}}}).select("_id")


@query("group_push", "SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY event_id) AS types, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1")
def group_push(spark, d):
    out = aggregate(table(spark, d, "events"), [{"$group": {"_id": "$user_id", "types": {"$push": "$event_type"}, "kinds": {"$addToSet": "$event_type"}}}], id_col="event_id")
    return out.select("_id", F.array_join("types", ",").alias("types"), F.array_join("kinds", ",").alias("kinds"))


grouping("group_after_sort", "events", [{"$sort": {"value": 1}}, {"$group": {"_id": "$event_type", "least": {"$first": "$event_id"}, "most": {"$last": "$event_id"}}}], "SELECT event_type AS _id, arg_min(event_id, (value, event_id)) AS least, arg_max(event_id, (value, event_id)) AS most FROM events GROUP BY 1", id_col="event_id")
grouping("group_count_if", "events", [{"$group": {"_id": "$event_type", "n": {"$count": {}}, "large": {"$countIf": {"value": {"$gte": 20}, "user_id": {"$lt": 50}}}, "users": {"$countDistinct": "$user_id"}}}], "SELECT event_type AS _id, count(*) AS n, count(*) FILTER (WHERE value >= 20 AND user_id < 50) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
grouping("add_fields", "nation", [{"$addFields": {"region": "$n_regionkey", "world": 1}}, {"$project": {"key": "$n_nationkey", "region": 1, "world": 1}}], "SELECT n_nationkey AS key, n_regionkey AS region, 1 AS world FROM nation")
grouping("project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")


def set_stage(name: str, stage: str, word: str) -> None:
    @query(name, f"SELECT c_nationkey AS nation FROM customer {word} SELECT s_nationkey FROM supplier")
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
        return aggregate(a, [{stage: "s"}], tables={"s": b})


set_stage("intersect_collections", "$intersectWith", "INTERSECT")
set_stage("except_collections", "$exceptWith", "EXCEPT")


@query("array_union", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({WORDS}, string_split(p_type, ' ')))), ',') AS words FROM part")
def array_union(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    out = aggregate(rows, [{"$addFields": {"words": {"$setUnion": ["$a", "$b"]}}}], id_col="p_partkey")
    return out.select("p_partkey", F.array_join(F.array_sort("words"), ",").alias("words"))


@query("normalise", f"SELECT vec_id, round(list_extract({V}, 1) / sqrt(list_dot_product({V}, {V})), 6) AS first, 1.0::DOUBLE AS length FROM embeddings")
def normalise(spark, d):
    unit = scalars.normalise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(unit[0], 6).alias("first"), F.round(scalars.norm(unit), 6).alias("length"))


@query("letter_embedding", "SELECT n_nationkey, round(ascii(n_name) / sqrt(list_sum(list_transform(string_split(n_name, ''), lambda c: ascii(c) * ascii(c)))), 6) AS first, 128 AS dims FROM nation")
def letter_embedding(spark, d):
    e = scalars.letter_embedding(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.round(e[0], 6).alias("first"), F.size(e).alias("dims"))


@query("half_even", "SELECT event_id, CAST(round_even(CAST(event_id AS DECIMAL(18, 1)) / 2, 0) AS BIGINT) AS half FROM events")
def half_even(spark, d):
    return table(spark, d, "events").select("event_id", scalars.half_even(F.col("event_id").cast("decimal(18,1)") / 2, 0).cast("bigint").alias("half"))


@query("toon_query", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation WHERE n_regionkey = 2 ORDER BY 1 LIMIT 100")
def toon_query(spark, d):
    """Found documents in the compact text form, read back; its sizes must add up."""
    from docloom.sources import toon

    text, sizes = _catalog(spark, d).database("one").collection("nation").query_text({"n_regionkey": 2})
    if sizes["toon_size"] != len(text) or not 0 < sizes["reduction_percent"] < 100:
        raise AssertionError(sizes)
    return spark.createDataFrame([(x["_id"], x["n_name"]) for x in toon.documents_of(text)], "_id string, n_name string")


@query("toon_import", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation")
def toon_import(spark, d):
    from docloom.functions.fields import VariantField

    s = _catalog(spark, d)
    text, _ = s.database("one").collection("nation").export_text()
    c = s.database("two").create_collection("copy")
    c.insert({"_id": "old"})
    c.import_text(text, replace=True)
    return c.frame().select("_id", VariantField(F.col("doc"), "n_name").as_kind("string", "").alias("n_name"))


@query("toon_format", "SELECT c_custkey, c_name FROM customer")
def toon_format(spark, d):
    """The second write replaces the first."""
    from docloom.sources.toon_files import register

    register(spark)
    folder = _folder(spark, "toon")
    for name in (F.lit("old"), F.col("c_name")):
        table(spark, d, "customer").select("c_custkey", name.alias("c_name")).write.format("toon").mode("overwrite").save(folder)
    return spark.read.format("toon").schema("c_custkey bigint, c_name string").load(folder)


@query("kept_state", f"SELECT _id, state FROM ({KEPT})")
def kept_state(spark, d):
    from docloom.streaming import changes

    c = _collection(spark, d)
    path = _folder(spark, "state")
    changes.keep_state(spark, changes.watch(c, per_trigger=1), path, _folder(spark, "resume"), once=True, merge_every=2).awaitTermination()
    return changes.state(spark, path).where("op <> 'delete'").select("_id", F.get_json_object("json", "$.state").alias("state"))


@query(
    "handlers",
    """SELECT 'any' AS handler, 'insert' AS op, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n
       UNION ALL SELECT 'region', 'insert', count(*) FROM region UNION ALL SELECT 'gone', 'drop', 1""",
)
def handlers(spark, d):
    from docloom.streaming import changes

    s = _catalog(spark, d)
    out = _folder(spark, "calls")
    note = lambda name: lambda rows: rows.groupBy(F.lit(name).alias("handler"), F.col("operationType").alias("op")).agg(F.count("*").alias("n")).write.mode("append").parquet(out)
    h = changes.Handlers()
    h.on("insert", note("any"))
    h.on("insert", note("region"), "region")
    h.on("drop", note("gone"))
    stream, resume = changes.watch_store(s), _folder(spark, "resume")
    h.start(stream, resume, once=True).awaitTermination()
    s.database("two").drop_collection("region")
    h.start(changes.watch_store(s), resume, once=True).awaitTermination()
    return spark.read.schema("handler string, op string, n bigint").parquet(out).groupBy("handler", "op").agg(F.sum("n").alias("n"))


@query("windowed_rate", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS operationType, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_rate(spark, d):
    from docloom.streaming import changes

    rows = table(spark, d, "events").select(F.col("event_type").alias("operationType"), F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")).alias("timestamp"))
    return changes.rate(rows, "1 hour").select(F.unix_seconds("start").alias("start"), "operationType", "n")


@query("request_rate", "SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, count(*) AS requests, greatest(0, least(count(*), 20 - (sum(count(*)) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts)) - count(*)))) AS allowed FROM events GROUP BY user_id, date_trunc('second', ts)")
def request_rate(spark, d):
    """A bucket of 20 tokens that never fills again."""
    rows = table(spark, d, "events").select("user_id", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")).alias("ts"))
    return access.over_rate(rows, "user_id", per_second=0.0, burst=20.0).select("user_id", F.unix_seconds("second").alias("second"), "requests", "allowed")


@query("permissions", "SELECT c_custkey, c_nationkey <> 3 AND (c_nationkey % 4 = 0 OR (c_nationkey % 4 = 1 AND c_custkey % 2 = 0) OR (c_nationkey = 2 AND c_custkey % 2 = 1)) AS allowed FROM customer")
def permissions(spark, d):
    """Customers ask to read or to drop; roles go by nation, and nation 2 has a grant to drop."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("user"))
    role = F.element_at(F.array(*[F.lit(r) for r in ("admin", "read", "guest", "guest")]), (F.col("user").cast("int") % 4 + 1).cast("int"))
    roles = n.where("user <> '3'").select("user", role.alias("role"))
    grants = spark.createDataFrame([("2", "drop_collection", "orders"), ("3", "drop_collection", "other")], "user string, permission string, collection string")
    asked = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("user"), F.when(F.col("c_custkey") % 2 == 0, "read").otherwise("drop_collection").alias("permission"), F.lit("orders").alias("collection"))
    return access.may(roles, grants, asked).select("c_custkey", "allowed")


@query("audit_search", "SELECT event_type, username FROM (VALUES ('login', 'ann'), ('read', 'ann'), ('read', 'bob')) t(event_type, username) WHERE username = 'ann'")
def audit_search(spark, d):
    folder = _folder(spark, "audit")
    for entry in ({"event_type": "login", "username": "ann"}, {"event_type": "read", "username": "ann"}, {"event_type": "read", "username": "bob"}):
        access.audit(spark, folder, [entry])
    return access.search_audit(spark, folder, user="ann").select("event_type", "username")


@query("derived_key", "SELECT n_nationkey, n_name FROM nation")
def derived_key(spark, d):
    """Encrypted with a key from a password, decrypted with the key derived again."""
    key = lambda: scalars.derive_key("a password", b"some salt", 1000)
    rows = table(spark, d, "nation").select("n_nationkey", scalars.encrypt(F.col("n_name"), key()).alias("e"))
    return rows.select("n_nationkey", scalars.decrypt(F.col("e"), key()).alias("n_name"))


def _catalog(spark: SparkSession, d: str):
    """Two databases with a collection each, beside the default one."""
    from docloom.sources.collections import Store

    s = Store(spark, _folder(spark, "store"))
    for db, name, key in (("one", "nation", "n_nationkey"), ("two", "region", "r_regionkey")):
        rows = table(spark, d, name).withColumn("_id", F.col(key).cast("string"))
        s.create_database(db).create_collection(name).insert_many(rows)
    return s


def million_documents(spark: SparkSession) -> DataFrame:
    """A collection's rows for the benchmark: a million documents of some 200 bytes, written once and read back."""
    folder = _folder(spark, "million")
    rows = spark.range(1_000_000).selectExpr(
        "cast(id AS string) AS _id",
        """parse_json(concat('{"name":"user', id, '","age":', id % 90, ',"city":"city', id % 50, '","address":{"street":"', sha2(cast(id AS string), 256), '","zip":', id % 99999, '},"tags":["a', id % 7, '","b', id % 11, '"]}')) AS doc""",
    )
    from docloom.sources.collections import Store

    c = Store(spark, folder).create_database("bench").create_collection("users")
    c.insert_many(rows)
    c.compact()
    return c

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a local session without one gets a temporary one."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _collection(spark: SparkSession, d: str):
    """Customers as a collection, with an update and a deletion."""
    from docloom.sources.collections import Store

    c = Store(spark, _folder(spark, "store")).create_database("shop").create_collection("customers")
    rows = table(spark, d, "customer").withColumn("_id", F.col("c_custkey").cast("string")).withColumn("state", F.lit("open"))
    c.insert_many(rows)
    c.update_many({"c_mktsegment": "BUILDING"}, {"state": "closed"})
    c.delete_many({"c_acctbal": {"$lt": 0}})
    return c
