"""Change streams over collections' logs of commits, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.access import BURST, RATE
from docloom.operators.latest import latest_per_key
from docloom.plans.filters import Fields, predicate
from docloom.sources.collections import EVENTS, LOG, Collection, Files, Store
from docloom.workers import ready

OPERATIONS = ("insert", "update", "delete", "drop")
MARK = "_COMPLETE"


def events(rows: DataFrame, database: str | None = None, collection: str | None = None) -> DataFrame:
    """Log rows as change events; an update's fields are those of the new version.

    Without names these are columns ``db`` and ``coll`` of the rows.
    """
    body = F.when(F.col("_op") != "delete", F.to_json("doc"))
    db, coll = (F.col(c) if v is None else F.lit(v) for c, v in (("db", database), ("coll", collection)))
    return rows.select(
        F.col("_op").alias("operationType"),
        F.struct(db.alias("db"), coll.alias("coll")).alias("ns"),
        F.col("_ts").alias("timestamp"),
        F.struct("_id").alias("documentKey"),
        F.when(F.col("_op") == "insert", body).alias("fullDocument"),
        F.struct(F.when(F.col("_op") == "update", body).alias("updatedFields")).alias("updateDescription"),
        "doc",
        F.col("_seq").alias("seq"),
    )


def only(stream: DataFrame, operations: list[str] | None = None, collections: list[str] | None = None, match: dict | None = None) -> DataFrame:
    """Events of these operations and collections whose document matches."""
    if operations:
        if unknown := set(operations) - set(OPERATIONS):
            raise ValueError(f"unknown operations {sorted(unknown)}")
        stream = stream.where(F.col("operationType").isin(operations))
    if collections:
        stream = stream.where(F.col("ns.coll").isin(collections))
    return stream.where(predicate(match, Fields(stream))) if match else stream


def watch(collection: Collection, operations: list[str] | None = None, match: dict | None = None, per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the collection's changes, each once; a checkpoint is its resume token.

    Compaction adds nothing to the log, so it is not seen.
    """
    reader = collection.spark.readStream.schema(LOG)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = collection._opened(reader.parquet(collection.log_path))
    return only(events(rows, collection.database.name, collection.name), operations, match=match)


def watch_store(store: Store, operations: list[str] | None = None, collections: list[str] | None = None, match: dict | None = None) -> DataFrame:
    """The changes of all collections of all databases, also of those made later, and of dropped collections.

    Documents of encrypted collections stay sealed.
    """
    # Names of folders tell database, collection and commit: with a pattern for a path there are no partition columns.
    plain = LOG.rsplit(",", 1)[0]
    files = store.spark.readStream.schema(plain).option("ignoreMissingFiles", "true").parquet(f"{store.root}/[^_]*/[^_]*/commits/*/*.parquet")
    at = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/commits/_seq=(\d+)/[^/]+$", k)
    changed = events(files.select("*", at(1).alias("db"), at(2).alias("coll"), at(3).cast("bigint").alias("_seq")))
    if not Files(store.spark).exists(f"{store.root}/_events"):
        store.spark.createDataFrame([], EVENTS).coalesce(1).write.mode("append").parquet(f"{store.root}/_events")
    dropped = store.spark.readStream.schema(EVENTS).parquet(f"{store.root}/_events")
    none = F.lit(None).cast("string")
    dropped = dropped.select(
        F.col("op").alias("operationType"), F.struct("db", "coll").alias("ns"), F.col("ts").alias("timestamp"), F.struct(none.alias("_id")).alias("documentKey"),
        none.alias("fullDocument"), F.struct(none.alias("updatedFields")).alias("updateDescription"), F.lit(None).cast("variant").alias("doc"), F.lit(None).cast("bigint").alias("seq"),
    )
    return only(changed.unionByName(dropped), operations, collections, match)


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``handler(batch, batch_id)`` for every micro-batch; ``once`` stops when all is read."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass
class Handlers:
    """Functions that are called with the events of one operation, of one collection or of all.

    Each is called once a micro-batch with a DataFrame, so a handler decides what leaves the executors.
    """

    by: dict[tuple[str, str | None], list[Callable[[DataFrame], None]]] = field(default_factory=dict)

    def on(self, operation: str, handler: Callable[[DataFrame], None], collection: str | None = None) -> None:
        if operation not in OPERATIONS:
            raise ValueError(f"operations are {OPERATIONS}")
        self.by.setdefault((operation, collection), []).append(handler)

    def off(self, operation: str, handler: Callable[[DataFrame], None] | None = None, collection: str | None = None) -> None:
        """Take back a handler, or all of this operation and collection."""
        key = (operation, collection)
        self.by[key] = [h for h in self.by.get(key, []) if handler is not None and h is not handler]

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        # Handlers of a collection come before those of all.
        for (operation, collection), handlers in sorted(self.by.items(), key=lambda x: (x[0][1] is None, x[0][0], x[0][1] or "")):
            for handler in handlers:
                handler(only(batch, [operation], [collection] if collection else None))
        batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return subscribe(stream, self, checkpoint, once)


def keep_state(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, once: bool = False, merge_every: int = 50) -> StreamingQuery:
    """Keep the last version of every document under ``path``; ``state`` reads it.

    A micro-batch writes its own newest versions only, to a folder that it overwrites if it is tried
    again. Every ``merge_every`` batches these are merged into a run, every ``merge_every`` runs into a
    longer one and so on, so a version is written again as often as a logarithm of the batches says. A run
    from the first batch on is a base, without deletions. What a run holds goes when the next one stands.
    """
    files = Files(spark)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("documentKey._id").alias("_id"), "seq", F.col("operationType").alias("op"), "timestamp", F.to_json("doc").alias("json"))
        latest_per_key(new, ["_id"], ["seq", "timestamp"]).write.mode("overwrite").parquet(f"{path}/changes/batch={number:012d}")
        first = _run_from(number, merge_every)
        runs = _runs(files, path)
        if first is None or any(r.last == number for r in runs):
            return
        parts = [p for p in _parts(files, path) if p.last >= first]
        first = parts[0].first
        rows = _newest(spark, parts)
        folder = f"{path}/runs/run={first:012d}-{number:012d}" if first else f"{path}/base/upto={number:012d}"
        (rows if first else rows.where("op <> 'delete'")).write.mode("overwrite").parquet(folder)
        files.write(f"{folder}/{MARK}", "")
        _forget(files, path, runs)

    return subscribe(stream, merge, checkpoint, once)


class Part(NamedTuple):
    """A folder with the newest versions of the batches from ``first`` to ``last``."""

    first: int
    last: int
    kind: str
    folder: str


def _run_from(number: int, every: int) -> int | None:
    """The first batch of the run that ends with this one: ``every`` batches, or that times ``every`` as often as it divides."""
    n, size = number + 1, every
    if n % every:
        return None
    while 1 < every and n % (size * every) == 0:
        size *= every
    return n - size if every > 1 else 0


def _number(name: str) -> int:
    return int(name.split("=")[1])


def _runs(files: Files, path: str) -> list[Part]:
    """Complete bases and runs."""
    bases = [Part(0, _number(n), "base", f"{path}/base/{n}") for n in files.names(f"{path}/base")]
    runs = [Part(*map(int, n.split("=")[1].split("-")), "run", f"{path}/runs/{n}") for n in files.names(f"{path}/runs")]
    return [r for r in bases + runs if files.exists(f"{r.folder}/{MARK}")]


def _batches(files: Files, path: str) -> list[Part]:
    return [Part(_number(n), _number(n), "batch", f"{path}/changes/{n}") for n in files.names(f"{path}/changes")]


def _parts(files: Files, path: str) -> list[Part]:
    """The fewest folders that hold all batches, oldest first."""
    out: list[Part] = []
    for p in sorted(_runs(files, path) + _batches(files, path), key=lambda p: (p.first, -p.last, p.kind == "batch")):
        if not out or p.last > out[-1].last:
            out.append(p)
    return out


def _forget(files: Files, path: str, runs: list[Part]) -> None:
    """Remove what readers of ``runs`` don't need."""
    for p in runs + _batches(files, path):
        if any(r.first <= p.first and p.last <= r.last and p != r for r in runs):
            files.delete(p.folder)


def _newest(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """The last version of every document in ``parts``; a base's give way to all later ones."""
    schema = "_id string, seq bigint, op string, timestamp timestamp, json string"
    read = lambda folders: spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    based = bool(parts) and parts[0].kind == "base"
    new = read([p.folder for p in parts[based:]])
    new = latest_per_key(new, ["_id"], ["seq", "timestamp"]) if len(parts) > based else new
    return read([parts[0].folder]).join(new.select("_id"), "_id", "left_anti").unionByName(new) if based else new


def state(spark: SparkSession, path: str) -> DataFrame:
    """(_id, seq, op, timestamp, json): the last version of every document that ``keep_state`` has seen; deletions show until they are merged."""
    return _newest(spark, _parts(Files(spark), path))


def rate(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by window and operation, complete when the watermark has passed."""
    counted = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window).alias("w"), "operationType")
    return counted.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "operationType", "n")


def limit_rate(requests: DataFrame, key: str = "user", ts: str = "ts", per_second: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, ts, allowed) for a stream of requests: a bucket of tokens for each key, kept between micro-batches.

    The bucket holds ``burst`` tokens at first and at most, and gains ``per_second`` tokens a second of
    the requests' own time; a request takes one or is refused. Requests of a micro-batch count in the
    order of their times; one that comes late adds no tokens.
    """
    ready(requests.sparkSession)
    name = dict(requests.dtypes)[key]

    def step(who, parts, bucket: GroupState):
        level, last = bucket.get if bucket.exists else (burst, None)
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        allowed = []
        for now in rows[ts].astype("int64").tolist():
            if last is not None and now > last:
                level = min(burst, level + (now - last) / 1e9 * per_second)
            last = now if last is None else max(last, now)
            allowed.append(level >= 1)
            level -= allowed[-1]
        bucket.update((float(level), int(last)))
        yield pd.DataFrame({key: who[0], ts: rows[ts], "allowed": allowed})

    rows = requests.select(key, F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {name}, `{ts}` timestamp, allowed boolean", "level double, last bigint", "append", GroupStateTimeout.NoTimeout)
