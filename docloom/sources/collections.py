"""Databases and collections over a log of commits.

A collection is a folder with

* ``commits/_seq=N``: immutable Parquet commits with rows ``(_id, _n, _op, _ts, _created, doc VARIANT,
  vector ARRAY<FLOAT>)``. A commit is written aside and appears as a whole by one rename. The log is
  the change stream; nothing but ``forget`` removes from it.
* ``base/upto=N``: the state after commit N, sorted by ``_id``, made by ``compact``. A base counts once
  its mark is written, so an interrupted compaction changes nothing.
* ``collection.json``: dimensions, indexed fields, the salt of an encrypted collection.

The state is the newest base without the ids that later commits name, and the last version of each
of those. Versions are picked by ``(_id, _seq, _n)`` alone; filters reach the base's scan. Fields with an
index are kept in typed columns of the base too, so conditions on them skip files and row groups.
One writer at a time: of two writers of the same commit one fails.
"""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
import zlib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars
from docloom.functions.fields import VariantField
from docloom.operators import fulltext, ivf, vector
from docloom.plans import explain, filters, pipeline
from docloom.sources import toon

LOG = "_id string, _n bigint, _op string, _ts timestamp, _created timestamp, doc variant, vector array<float>, _seq bigint"
EVENTS = "op string, db string, coll string, ts timestamp"
STATE = ["_id", "_created_at", "_updated_at", "doc", "vector"]
DEFAULT_LIMIT = 100
EXPORT_LIMIT = 10_000
DEFAULT_DATABASE = "default"
#: A log of more bytes than this is not joined with its newest versions, but rid of the older ones, if these are
#: no more than so many (they are sent to all executors, 16 bytes each).
LARGE_LOG, MOST_OLDER = 1 << 30, 1 << 21
#: A commit of many small files is packed into files of about so many bytes: readers and streams pay for each file.
FILE_BYTES = 8 << 20
MARK = "_COMPLETE"
_NAME = re.compile(r"^[^\W_][\w.-]*$")


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"bad name {name!r}")
    return name


class Files:
    """The few file operations that a catalog needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def sizes(self, path: str) -> list[int]:
        """Bytes of each data file in a folder."""
        fs, p = self._at(path)
        return [s.getLen() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"]

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def move(self, a: str, b: str) -> bool:
        """Rename a folder to a name that must be free."""
        fs, p = self._at(a)
        to = self._at(b)[1]
        if fs.exists(to):
            return False
        fs.mkdirs(to.getParent())
        return fs.rename(p, to)


class Store:
    """All databases under a root folder. Names that begin with ``_`` are its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def database(self, name: str = DEFAULT_DATABASE) -> Database:
        return Database(self, _checked(name))

    def create_database(self, name: str) -> Database:
        db = self.database(name)
        if not self.files.exists(f"{db.path}/database.json"):
            self.files.write(f"{db.path}/database.json", json.dumps({"name": name, "version": 1}))
        return db

    def databases(self) -> list[str]:
        return sorted({DEFAULT_DATABASE, *(n for n in self.files.names(self.root) if not n.startswith("_"))})

    def drop_database(self, name: str) -> bool:
        if name == DEFAULT_DATABASE:
            raise ValueError("the default database can't be dropped")
        db = self.database(name)
        for c in db.collections():
            self.record("drop", name, c)
        return self.files.delete(db.path)

    def record(self, op: str, db: str, coll: str) -> None:
        """Add an event that is no change of a document to the store's own log."""
        rows = self.spark.createDataFrame([(op, db, coll)], "op string, db string, coll string")
        rows.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_events")

    def events(self) -> DataFrame:
        path = f"{self.root}/_events"
        return self.spark.read.schema(EVENTS).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], EVENTS)

    def stats(self) -> dict[str, Any]:
        rows = {d: self.database(d).stats() for d in self.databases()}
        return {"databases": len(rows), "collections": sum(r["collections"] for r in rows.values()), "documents": sum(r["documents"] for r in rows.values()), "bytes": self.files.size(self.root)}


class Database:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.path = store, name, f"{store.root}/{name}"

    def collection(self, name: str, dims: int | None = None, password: str | None = None) -> Collection:
        return Collection(self, _checked(name), dims, password)

    def create_collection(self, name: str, dims: int | None = None, password: str | None = None) -> Collection:
        """With a password the documents (not ids, times and vectors) are encrypted in all files."""
        c = self.collection(name, password=password)
        if not c.files.exists(f"{c.path}/collection.json"):
            salt = base64.b64encode(os.urandom(16)).decode() if password else None
            c.files.write(f"{c.path}/collection.json", json.dumps({"name": name, "vector_dimensions": dims, "indexes": [], "salt": salt}))
        return c

    def collections(self) -> list[str]:
        return [n for n in self.store.files.names(self.path) if not n.startswith("_")]

    def drop_collection(self, name: str) -> bool:
        gone = self.store.files.delete(f"{self.path}/{_checked(name)}")
        if gone:
            self.store.record("drop", self.name, name)
        return gone

    def stats(self) -> dict[str, Any]:
        names = self.collections()
        return {"database": self.name, "collections": len(names), "documents": sum(self.collection(n).count() for n in names)}

    def vector_stats(self) -> DataFrame:
        """(collection, n, dims) of the collections that hold vectors."""
        spark = self.store.spark
        parts = [self.collection(n).frame().select(F.lit(n).alias("collection"), "vector") for n in self.collections()]
        rows = parts[0] if parts else spark.createDataFrame([], "collection string, vector array<float>")
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.where("vector is not null").groupBy("collection").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"))


class IndexedField(VariantField):
    """A path whose typed values stand in columns of their own."""

    def __init__(self, base: Column, path: str):
        super().__init__(base, path)
        self.name = index_name(path)

    def as_kind(self, kind: str, value: Any) -> Column | None:
        big = isinstance(value, int) and not isinstance(value, bool) and abs(value) > 1 << 53
        return F.col(f"{self.name}_{kind}") if kind in INDEXED and not big else super().as_kind(kind, value)


#: Kinds of values that an index keeps, with a value of each.
INDEXED = {"number": 0, "string": "", "bool": True}


def index_name(path: str) -> str:
    return f"_ix{zlib.crc32(path.encode()):08x}"


def index_columns(paths: list[str]) -> dict[str, Column]:
    return {f"{index_name(p)}_{kind}": VariantField(F.col("doc"), p).as_kind(kind, value) for p in paths for kind, value in INDEXED.items()}


class IndexedFields(filters.Fields):
    """Paths of a collection: indexed ones lead to their columns."""

    def __init__(self, df: DataFrame, paths: list[str]):
        super().__init__(df)
        self.paths = {p for p in paths if f"{index_name(p)}_number" in df.columns}

    def __call__(self, path: str):
        return IndexedField(F.col(self.doc), path) if path in self.paths else super().__call__(path)


class Collection:
    def __init__(self, database: Database, name: str, dims: int | None = None, password: str | None = None):
        self.database, self.name = database, name
        self.spark, self.files = database.store.spark, database.store.files
        self.path = f"{database.path}/{name}"
        self.log_path = f"{self.path}/commits"
        self._dims, self._password, self._secret = dims, password, None

    # -- catalog

    def meta(self) -> dict[str, Any]:
        path = f"{self.path}/collection.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {"name": self.name, "vector_dimensions": self._dims, "indexes": []}

    @property
    def dims(self) -> int | None:
        return self._dims or self.meta()["vector_dimensions"]

    def create_index(self, field: str) -> None:
        """Keep a field's values in typed columns from the next ``compact`` on, by which scans are pruned."""
        self._set_indexes({*self.indexes(), field})

    def drop_index(self, field: str) -> None:
        self._set_indexes({*self.indexes()} - {field})

    def _set_indexes(self, fields: set[str]) -> None:
        self.files.write(f"{self.path}/collection.json", json.dumps(self.meta() | {"indexes": sorted(fields)}))

    def indexes(self) -> list[str]:
        return self.meta()["indexes"]

    # -- encryption

    def _key(self) -> bytes | None:
        """The key of an encrypted collection, derived once from password and salt."""
        if self._secret is None:
            salt = self.meta().get("salt")
            if not salt:
                return None
            if self._password is None:
                raise PermissionError(f"collection {self.name!r} is encrypted")
            self._secret = scalars.derive_key(self._password, base64.b64decode(salt))
        return self._secret

    def _sealed(self, rows: DataFrame) -> DataFrame:
        key = self._key()
        if key is None:
            return rows
        text = F.base64(scalars.encrypt(F.to_json("doc"), key))
        return rows.withColumn("doc", F.when(F.col("doc").isNotNull(), F.parse_json(F.concat(F.lit('"'), F.translate(text, "\r\n", ""), F.lit('"')))))

    def _opened(self, rows: DataFrame) -> DataFrame:
        key = self._key()
        if key is None:
            return rows
        return rows.withColumn("doc", F.parse_json(scalars.decrypt(F.unbase64(F.try_variant_get("doc", "$", "string")), key)))

    # -- reading

    def _commits(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names(self.log_path) if n.startswith("_seq="))

    def log(self) -> DataFrame:
        """All versions, oldest first by (_seq, _n)."""
        if not self.files.names(self.log_path):
            return self.spark.createDataFrame([], LOG)
        return self._opened(self.spark.read.schema(LOG).parquet(self.log_path))

    def _base(self) -> tuple[int, str | None]:
        """The last commit in the newest complete base, and its folder."""
        done = [n for n in self.files.names(f"{self.path}/base") if self.files.exists(f"{self.path}/base/{n}/{MARK}")]
        return (int(done[-1].split("=")[1]), f"{self.path}/base/{done[-1]}") if done else (0, None)

    def _newest(self, log: DataFrame, versions: DataFrame) -> DataFrame:
        """Rows of ``log`` that are the newest of their id, by ``versions`` (_k, _s, _m)."""
        same = (F.col("_id") == F.col("_k")) & (F.col("_seq") == F.col("_s")) & (F.col("_n") == F.col("_m"))
        if explain.estimated_bytes(log) <= LARGE_LOG:
            return log.join(versions, same)
        older = log.select("_id", "_seq", "_n").join(versions, F.col("_id") == F.col("_k")).where(~((F.col("_seq") == F.col("_s")) & (F.col("_n") == F.col("_m"))))
        older = older.select(F.col("_seq").alias("_os"), F.col("_n").alias("_on"))
        if older.count() > MOST_OLDER:
            return log.join(versions, same)
        return log.join(F.broadcast(older), (F.col("_seq") == F.col("_os")) & (F.col("_n") == F.col("_on")), "left_anti")

    def _state(self) -> tuple[DataFrame, list[str]]:
        """The state with the columns of indexes, and the fields that have them."""
        upto, folder = self._base()
        paths: list[str] = json.loads(self.files.read(f"{folder}/{MARK}"))["indexes"] if folder else []
        columns = [*STATE, *index_columns(paths)]
        base = self._opened(self.spark.read.parquet(folder)).select(*columns) if folder else None
        if base is not None and not any(s > upto for s in self._commits()):
            return base, paths
        log = self.log().where(F.col("_seq") > upto)
        thin = self.spark.read.schema(LOG).parquet(self.log_path).where(F.col("_seq") > upto) if self._commits() else log
        versions = thin.groupBy("_id").agg(F.max(F.struct("_seq", "_n")).alias("_v")).select(F.col("_id").alias("_k"), F.col("_v._seq").alias("_s"), F.col("_v._n").alias("_m"))
        delta = self._newest(log, versions).where("_op <> 'delete'").withColumnsRenamed({"_created": "_created_at", "_ts": "_updated_at"})
        delta = delta.withColumns(index_columns(paths)).select(*columns) if paths else delta.select(*columns)
        if base is None:
            return delta, paths
        return base.join(versions.select("_k"), F.col("_id") == F.col("_k"), "left_anti").unionByName(delta), paths

    def frame(self) -> DataFrame:
        """The state: _id, _created_at, _updated_at, doc, vector."""
        return self._state()[0].select(*STATE)

    def find(self, query: dict[str, Any] | None = None, limit: int | None = DEFAULT_LIMIT, skip: int = 0, sort: list[tuple[str, int]] | None = None, **flags) -> DataFrame:
        rows, paths = self._state()
        if query:
            rows = rows.where(filters.predicate(query, IndexedFields(rows, paths), **flags))
        return filters.find(rows.select(*STATE), None, limit, skip, sort)

    def find_one(self, query: dict[str, Any] | None = None) -> dict[str, Any] | None:
        rows = documents(self.find(query, 1))
        return rows[0] if rows else None

    def find_by_id(self, id: str) -> dict[str, Any] | None:
        rows = documents(self.frame().where(F.col("_id") == id))
        return rows[0] if rows else None

    def scan(self, start: str, n: int) -> DataFrame:
        """The first n documents from an id on."""
        return self.frame().where(F.col("_id") >= start).orderBy("_id").limit(n)

    def count(self, query: dict[str, Any] | None = None) -> int:
        return self.find(query, None).count()

    def aggregate(self, stages: list[dict[str, Any]], **kw) -> DataFrame:
        """A pipeline over the state; a first ``$match`` uses the indexes."""
        if stages and list(stages[0]) == ["$match"]:
            return pipeline.aggregate(self.find(stages[0]["$match"], None), stages[1:], **kw)
        return pipeline.aggregate(self.frame(), stages, **kw)

    def explain(self, query: dict[str, Any]) -> dict[str, Any]:
        """What Spark will do for a find: pushed filters, pruning, exchanges, estimated bytes, the plan."""
        return explain.explain(self.find(query, None), self.indexes(), {index_name(p): p for p in self.indexes()})

    # -- text and vector search

    def _texts(self, field: str) -> DataFrame:
        text = filters.Fields(self.frame())(field).as_kind("string", "")
        return self.frame().select("_id", text.alias("text"))

    def create_text_index(self, field: str) -> fulltext.Index:
        """Store postings of a field for ``search_text``; they count until the next commit."""
        folder = f"{self.path}/text/{index_name(field)}/upto={max(self._commits(), default=0):012d}"
        index = fulltext.build(self._texts(field), folder, mode="overwrite")
        self.files.write(f"{folder}/{MARK}", "{}")
        return index

    def search_text(self, field: str, query: str, limit: int = 10) -> DataFrame:
        """(_id, score): from postings that are up to date, or else from the texts."""
        folder = f"{self.path}/text/{index_name(field)}/upto={max(self._commits(), default=0):012d}"
        if self.files.exists(f"{folder}/{MARK}"):
            return fulltext.Index(self.spark, folder).search(query, limit).withColumnRenamed("id", "_id")
        return fulltext.search(self._texts(field), query, limit)

    def build_vector_index(self, lists: int = ivf.LISTS) -> dict[str, Any]:
        """Store (or store again) an inverted file of the vectors, for ``search`` with ``approximate``."""
        upto = max(self._commits(), default=0)
        folder = f"{self.path}/vectors/upto={upto:012d}"
        rows = self.frame().select("_id", "vector").where("vector is not null")
        index = ivf.build(rows, folder, lists, mode="overwrite")
        self.files.write(f"{folder}/{MARK}", index.to_json())
        for old in self.files.names(f"{self.path}/vectors"):
            if old != f"upto={upto:012d}":
                self.files.delete(f"{self.path}/vectors/{old}")
        return {"status": "built", "num_vectors": rows.count(), "lists": len(index.centroids), "probes": index.probes, "upto": upto}

    rebuild_vector_index = build_vector_index

    def vector_index(self) -> tuple[int, ivf.Index] | None:
        """The last commit in the stored index, and the index."""
        done = [n for n in self.files.names(f"{self.path}/vectors") if self.files.exists(f"{self.path}/vectors/{n}/{MARK}")]
        if not done:
            return None
        folder = f"{self.path}/vectors/{done[-1]}"
        return int(done[-1].split("=")[1]), ivf.Index.from_json(folder, self.files.read(f"{folder}/{MARK}"))

    def search(self, query: list[float], k: int = 10, metric: str = "cosine", filter: dict[str, Any] | None = None, filter_mode: str = "post", approximate: bool = False, probes: int | None = None) -> DataFrame:
        """The k documents with the closest vectors, exactly; ``approximate`` reads some lists of the index only.

        Documents that changed since the index was built are searched exactly.
        """
        stored = self.vector_index() if approximate else None
        if stored is None or (filter and filter_mode == "pre"):
            return vector.knn(self.frame(), query, k, metric, filter=filter, filter_mode=filter_mode, dims=self.dims)
        upto, index = stored
        rows = index.rows(self.spark, query, probes).select("_id", "vector")
        if any(s > upto for s in self._commits()):
            changed = self.log().where(F.col("_seq") > upto).select(F.col("_id").alias("_k")).distinct()
            fresh = self.frame().join(changed, F.col("_id") == F.col("_k"), "left_semi").select("_id", "vector")
            rows = rows.join(changed, F.col("_id") == F.col("_k"), "left_anti").unionByName(fresh)
        best = vector.knn(rows, query, k, metric, dims=self.dims)
        out = self.frame().drop("vector").join(F.broadcast(best), "_id").orderBy(F.desc("similarity"), "_id")
        return filters.find(out, filter) if filter else out

    # -- writing

    def _commit(self, rows: DataFrame) -> int:
        """Append one commit of (_id, _n, _op, _created, doc, vector); its number."""
        aside = f"{self.path}/_writing/{uuid.uuid4().hex}"
        rows = self._sealed(rows.withColumn("_ts", F.current_timestamp()))
        rows.select("_id", "_n", "_op", "_ts", "_created", "doc", "vector").write.parquet(aside)
        aside = self._packed(aside)
        seq = 1 + max([*self._commits(), self._base()[0]], default=0)
        if not self.files.move(aside, f"{self.log_path}/_seq={seq:012d}"):
            self.files.delete(aside)
            raise RuntimeError(f"commit {seq} of {self.name!r} was written by another writer")
        return seq

    def _packed(self, folder: str) -> str:
        """A folder with the same rows in files of about FILE_BYTES, if they were written as many small ones."""
        sizes = self.files.sizes(folder)
        n = max(1, round(sum(sizes) / FILE_BYTES))
        if len(sizes) <= 1.5 * n:
            return folder
        packed = f"{self.path}/_writing/{uuid.uuid4().hex}"
        self.spark.read.schema(LOG.rsplit(",", 1)[0]).parquet(folder).coalesce(n).write.parquet(packed)
        self.files.delete(folder)
        return packed

    def insert_many(self, rows: DataFrame | list[dict[str, Any]]) -> int:
        """Documents as dicts, or a DataFrame whose columns are fields (``vector`` and ``_id`` apart).

        An own ``_id`` is kept and replaces an older document of that id; others get a random one.
        """
        if isinstance(rows, list):
            data = [(r.get("_id"), json.dumps({k: v for k, v in r.items() if k not in ("_id", "vector")}), [float(x) for x in r["vector"]] if isinstance(r.get("vector"), (list, tuple)) else None) for r in rows]
            df = self.spark.createDataFrame(data, "_id string, json string, vector array<float>").select("_id", F.parse_json("json").alias("doc"), "vector")
        else:
            fields = [c for c in rows.columns if c not in ("_id", "vector")]
            own = F.col("_id").cast("string") if "_id" in rows.columns else F.lit(None).cast("string")
            vec = F.col("vector").cast("array<float>") if "vector" in rows.columns else F.lit(None).cast("array<float>")
            doc = F.col("doc") if fields == ["doc"] and rows.schema["doc"].dataType.typeName() == "variant" else F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in fields]))
            df = rows.select(own.alias("_id"), doc.alias("doc"), vec.alias("vector"))
        if self.dims is not None:
            wrong = df.where(F.col("vector").isNotNull() & (F.size("vector") != self.dims)).limit(1).count()
            if wrong:
                raise ValueError(f"a vector has not {self.dims} dimensions")
        new = F.substring(F.sha2(F.uuid(), 256), 1, 16)
        return self._commit(df.select(F.coalesce("_id", new).alias("_id"), F.monotonically_increasing_id().alias("_n"), F.lit("insert").alias("_op"), F.current_timestamp().alias("_created"), "doc", "vector"))

    def insert(self, document: dict[str, Any]) -> str:
        id = document.get("_id") or uuid.uuid4().hex[:16]
        self.insert_many([document | {"_id": id}])
        return id

    def insert_vectors(self, rows: DataFrame) -> dict[str, Any]:
        """Rows with a vector of the right length are written; the others come back with an error."""
        if self.dims is None:
            raise ValueError("the collection has no dimensions")
        good, bad = vector.split_by_dims(rows, self.dims)
        n = good.count()
        if n:
            self.insert_many(good)
        return {"successful": n, "failed": bad, "count": n}

    def _change(self, found: DataFrame, doc: Column, op: str) -> int:
        rows = found.select("_id", F.monotonically_increasing_id().alias("_n"), F.lit(op).alias("_op"), F.col("_created_at").alias("_created"), doc.alias("doc"), "vector")
        rows = rows.persist()
        n = rows.count()
        if n:
            self._commit(rows)
        rows.unpersist()
        return n

    def update_many(self, query: dict[str, Any], changes: dict[str, Any], limit: int | None = None) -> int:
        """Merge ``changes`` into the top level of all matching documents; how many there were."""
        if any("." in k or k.startswith("$") for k in changes):
            raise ValueError("changes are top-level fields")
        found = self.find(query, limit)
        old = F.col("doc").cast("map<string,variant>")
        kept = F.map_filter(old, lambda k, _: ~k.isin(list(changes)))
        merged = F.to_variant_object(F.map_concat(kept, F.parse_json(F.lit(json.dumps(changes))).cast("map<string,variant>")))
        return self._change(found, merged, "update") if changes else found.count()

    def update(self, id: str, changes: dict[str, Any]) -> bool:
        return self.update_many({"_id": id}, changes) > 0

    def delete_many(self, query: dict[str, Any], limit: int | None = None) -> int:
        return self._change(self.find(query, limit), F.lit(None).cast("variant"), "delete")

    def delete(self, id: str) -> bool:
        return self.delete_many({"_id": id}) > 0

    def compact(self) -> int:
        """Store the state after the last commit as a new base; the log stays as it is. The commit's number.

        Bases before the last one are removed, for readers of that one may still be at work.
        """
        upto = max([*self._commits(), self._base()[0]], default=0)
        folder = f"{self.path}/base/upto={upto:012d}"
        if not upto or self.files.exists(f"{folder}/{MARK}"):
            return upto
        paths = self.indexes()
        if paths and self._key() is not None:
            raise ValueError("an index would store fields of an encrypted collection in the clear")
        rows = self.frame()
        rows = rows.withColumns(index_columns(paths)) if paths else rows
        self._sealed(rows).repartitionByRange("_id").sortWithinPartitions("_id").write.mode("overwrite").parquet(folder)
        self.files.write(f"{folder}/{MARK}", json.dumps({"indexes": paths}))
        for old in self.files.names(f"{self.path}/base")[:-2]:
            self.files.delete(f"{self.path}/base/{old}")
        return upto

    def forget(self, upto: int | None = None) -> int:
        """Remove commits that are in the base (and no later than ``upto``) from the log; how many.

        Readers of the change stream must be past them.
        """
        known = self._base()[0]
        gone = [s for s in self._commits() if s <= (known if upto is None else min(known, upto))]
        for s in gone:
            self.files.delete(f"{self.log_path}/_seq={s:012d}")
        return len(gone)

    # -- the compact text form

    def query_text(self, query: dict[str, Any] | None = None, limit: int = DEFAULT_LIMIT) -> tuple[str, dict[str, Any]]:
        """Found documents in the compact text form, and its sizes against JSON."""
        found = [_plain(d) for d in documents(self.find(query, limit))]
        text = toon.export(self.name, found)
        return text, toon.stats({"collection": self.name, "documents": found, "count": len(found)}, text)

    def export_text(self, limit: int = EXPORT_LIMIT) -> tuple[str, dict[str, Any]]:
        """At most ``limit`` documents as one text; ``write_toon`` exports a collection of any size."""
        return self.query_text(None, limit)

    def import_text(self, data: str | dict | list, replace: bool = False) -> int:
        """Insert the documents of a text (or of what it says); ``replace`` deletes all others first."""
        rows = toon.documents_of(data)
        if replace:
            self.delete_many({})
        if rows:
            self.insert_many([{k: v for k, v in r.items() if k not in ("_created_at", "_updated_at")} for r in rows])
        return len(rows)


def _plain(document: dict[str, Any]) -> dict[str, Any]:
    """Times as ISO text."""
    return {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in document.items()}


def documents(df: DataFrame) -> list[dict[str, Any]]:
    """The (few) rows of a found page as dicts."""
    out = []
    for r in df.select(*[c for c in df.columns if c != "doc"], F.to_json("doc").alias("_json")).collect():
        d = r.asDict()
        out.append(json.loads(d.pop("_json") or "{}") | {k: v for k, v in d.items() if v is not None})
    return out


def ingest_json(spark: SparkSession, path: str, id_field: str | None = None, multiline: bool = False) -> DataFrame:
    """JSON documents (lines, or arrays with ``multiline``) as (_id, doc), e.g. an export of another store.

    The id is text: plain, or the hex of an exported object id under ``$oid``.
    """
    if multiline:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        rows = whole.select(F.explode(items).alias("doc"))
    else:
        rows = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("doc"))
    rows = rows.where("doc is not null")
    if id_field is None:
        return rows.select(F.lit(None).cast("string").alias("_id"), "doc")
    plain = F.try_variant_get("doc", f'$["{id_field}"]', "variant")
    oid = F.try_variant_get("doc", f'$["{id_field}"]["$oid"]', "string")
    fields = F.map_filter(F.col("doc").cast("map<string,variant>"), lambda k, _: k != id_field)
    return rows.select(F.coalesce(oid, plain.cast("string")).alias("_id"), F.to_variant_object(fields).alias("doc"))
