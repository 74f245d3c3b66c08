"""Roles, grants, audit entries and request rates, as data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.workers import ready

#: Roles from the least to the greatest, and the rate limit (tokens a second, burst).
ROLES = ["guest", "read", "write", "admin"]
RATE, BURST = 100.0, 200.0
#: What each role may do everywhere.
PERMISSIONS = {
    "admin": ["read", "write", "delete", "create_collection", "drop_collection", "manage_users", "manage_indexes", "backup", "admin"],
    "write": ["read", "write", "delete", "create_collection"],
    "read": ["read"],
    "guest": [],
}


def allowed(role: str, needed: str, grants: dict[str, str] | None = None, database: str | None = None) -> bool:
    """Whether a user may act: admins always; others by the grant for the database, or else not at all.

    Without a database the role alone decides.
    """
    if role not in ROLES or needed not in ROLES:
        raise ValueError(f"roles are {ROLES}")
    if role == "admin":
        return True
    own = role if database is None else (grants or {}).get(database)
    return own is not None and ROLES.index(own) >= ROLES.index(needed)


def permitted(rows: DataFrame, grants: DataFrame, user: str, needed: str = "read") -> DataFrame:
    """Rows (with ``database``) of the databases that ``grants`` (user, database, role) opens to a user."""
    good = grants.where((F.col("user") == user) & F.col("role").isin(ROLES[ROLES.index(needed) :])).select("database").distinct()
    return rows.join(good, "database", "left_semi")


def may(roles: DataFrame, grants: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (user, permission, collection, ...) with ``allowed``.

    By the user's role in ``roles`` (user, role; none: guest; several: any), or by a grant (user,
    permission, collection) for the collection. Semi-joins: a hot user is split as any skewed join.
    """
    known = asked.sparkSession.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role string, permission string")
    by_role = roles.join(F.broadcast(known), "role").select("user", "permission").distinct().withColumn("_role", F.lit(True))
    by_grant = grants.where(F.col("permission").isin(PERMISSIONS["admin"])).select("user", "permission", "collection").distinct().withColumn("_grant", F.lit(True))
    out = asked.join(by_role, ["user", "permission"], "left").join(by_grant, ["user", "permission", "collection"], "left")
    return out.select(*asked.columns, (F.col("_role").isNotNull() | F.col("_grant").isNotNull()).alias("allowed"))


AUDIT = "timestamp timestamp, event_type string, username string, collection string, document_id string, status string, details string"


def audit(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """Append entries as JSON lines."""
    rows = spark.createDataFrame([tuple(e.get(f.split()[0]) for f in AUDIT.split(", ")) for e in entries], AUDIT)
    rows.coalesce(1).write.mode("append").json(path)


def search_audit(spark: SparkSession, path: str, user: str | None = None, event_type: str | None = None, collection: str | None = None, limit: int = 100) -> DataFrame:
    rows = spark.read.schema(AUDIT).json(path)
    for name, value in (("username", user), ("event_type", event_type), ("collection", collection)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy("timestamp", "event_type", "document_id").limit(limit)


def over_rate(requests: DataFrame, key: str = "user", ts: str = "ts", per_second: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, second, requests, allowed): requests of each second against a bucket of tokens.

    The bucket holds ``burst`` tokens and gains ``per_second`` a second, seen second by second. Requests
    are counted by second before the shuffle; a key's seconds then pass in order, one number held for it.
    """
    by = requests.groupBy(key, F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("requests"))
    rows = by.select(key, F.unix_seconds(F.col("second").cast("timestamp")).alias("s"), "requests").repartition(key).sortWithinPartitions(key, "s")
    kind = dict(by.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, level = object(), 0, burst
        for batch in batches:
            allowed = np.zeros(batch.num_rows, np.int64)
            times, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, who in enumerate(batch.column(0).to_pylist()):
                if who != own:
                    own, last, level = who, times[i], burst
                level = min(burst, level + (times[i] - last) * per_second)
                last, used = times[i], min(level, counts[i])
                allowed[i] = int(used)
                level -= used
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed)], names=[key, "s", "requests", "allowed"])

    ready(requests.sparkSession)
    out = rows.mapInArrow(run, f"`{key}` {kind}, s bigint, requests bigint, allowed bigint")
    return out.select(key, F.timestamp_seconds("s").alias("second"), "requests", "allowed")
