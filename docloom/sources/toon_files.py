"""Files of the compact text form as a source and a sink.

``read_toon`` and ``write_toon`` go through Spark's own text files, so any path that Spark opens will
do. ``format("toon")`` is the same for callers of the reader and writer API; its files are opened by
Arrow's file systems (local and mounted paths, hdfs, s3, gs), for Python sources have no others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from docloom.sources import toon
from docloom.workers import ready

#: Documents of a file at most.
ROWS_PER_FILE = 100_000


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            rows = [json.dumps(d) for d in toon.documents_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["doc"])


def read_toon(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents of all files under ``path``: as VARIANT column ``doc``, or as columns of ``schema``.

    A file is one task's work; write many files for much data.
    """
    ready(spark)
    rows = spark.read.text(path, wholetext=True).mapInArrow(_documents, "doc string")
    if schema is None:
        return rows.select(F.parse_json("doc").alias("doc"))
    return rows.select(F.from_json("doc", schema).alias("d")).select("d.*")


def _texts(collection: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [json.loads(x) for batch in batches for x in batch.column(0).to_pylist()]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([toon.export(collection, docs)], pa.string())], names=["value"])

    return run


def write_toon(df: DataFrame, path: str, collection: str = "documents", mode: str = "error", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One file for each partition of about ``rows_per_file`` documents."""
    ready(df.sparkSession)
    as_json = F.to_json("doc") if df.columns == ["doc"] else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows = df.select(as_json.alias("json"))
    files = max(1, -(-df.count() // rows_per_file))
    rows.repartition(files).mapInArrow(_texts(collection), "value string").write.mode(mode).option("lineSep", "\n").text(path)


def _opened(path: str):
    """(file system, path in it) by Arrow, for a path with or without a scheme."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: list[str]):
        self.path, self.fields = options["path"], fields

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.value) as f:
            text = f.read().decode()
        for d in toon.documents_of(text):
            yield (json.dumps(d),) if self.fields == ["doc"] else tuple(d.get(k) for k in self.fields)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Tasks write to a folder aside; the driver moves the files of those that ended well."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.collection, self.overwrite = options["path"], options.get("collection", "documents"), overwrite
        self.rows = int(options.get("rowsPerFile", ROWS_PER_FILE))
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows):
        system, at = _opened(self.path)
        names: list[str] = []
        held: list[dict] = []

        def flush():
            name = f"part-{uuid.uuid4().hex}.toon"
            system.create_dir(f"{at}/{self.aside}", recursive=True)
            with system.open_output_stream(f"{at}/{self.aside}/{name}") as f:
                f.write(toon.export(self.collection, held).encode())
            names.append(name)
            held.clear()

        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) >= self.rows:
                flush()
        if held:
            flush()
        return _Written(names)

    def commit(self, messages):
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{at}/{self.aside}/{name}", f"{at}/{name}")
        for f in old:
            system.delete_file(f)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        system, at = _opened(self.path)
        if system.get_file_info(f"{at}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.aside}")


class ToonDataSource(DataSource):
    """``spark.read.format("toon")`` and ``df.write.format("toon")``, for paths that every executor sees.

    Without a schema a row is the JSON of a document in column ``doc``. Mode ``overwrite`` replaces the
    files of the folder, ``append`` adds to them; an aborted write leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "toon"

    def schema(self):
        return "doc string"

    def reader(self, schema):
        return _Reader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(ToonDataSource)
