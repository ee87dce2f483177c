"""Warehouse tables as a Spark data source, over a client that can be exchanged.

`register(spark)` adds the format `factloom_warehouse`. Its options name the table and the client (`module:Class`); all options are given to the client, which
knows how to list a table's splits, read one, and write rows:

    spark.read.format("factloom_warehouse").option("root", "/data").option("table", "documents").load()
    df.write.format("factloom_warehouse").option("root", "/data").option("table", "answers").mode("append").save()

Reading: each split is a partition. Filters are pushed down as far as a split's bounds can rule it out; Spark evaluates them as well.

Writing: each task stages its rows, in requests of `chunk` rows, under a name that no other attempt has, and the driver commits what the successful
attempts staged, all at once, by one record. So a task that runs twice inserts once, a job that fails inserts nothing, and a commit that comes
twice is one. Any error of any request fails its task.

`FolderClient` keeps tables as Parquet files in any of pyarrow's file systems. A table's commits are files in its folder `_commits`; a file without a commit isn't part of
the table. A folder without commits, or a single file, is a table as it is.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "factloom_warehouse"
FOLDER_CLIENT = "factloom.sources.warehouse:FolderClient"


@dataclass(frozen=True)
class Split:
    """A part of a table. bounds: column -> (least, most), where known."""

    name: str
    bounds: dict = field(default_factory=dict)


class FolderClient:
    """Tables as Parquet files below `root`; a split is a row group."""

    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _files(self, store, table: str) -> list[str]:
        from pyarrow import fs

        files, base = store, self._store()[1]
        found = files.get_file_info([f"{base}/{table}", f"{base}/{table}.parquet"])
        at = next((f.path for f in found if f.type != fs.FileType.NotFound), None)
        if at is None:
            raise ValueError(f"no table {table} in {self.root}")
        if files.get_file_info(at).type == fs.FileType.File:
            return [at]
        commits = self._commits(files, at)
        if commits is not None:
            gone = {name for c in commits.values() for name in c["replaces"]}
            return [f"{at}/{f}" for name, c in sorted(commits.items()) if name not in gone for f in c["files"]]
        inside = files.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(f.path for f in inside if f.type == fs.FileType.File and f.path.endswith(".parquet"))

    def _commits(self, files, at: str) -> dict | None:
        from pyarrow import fs

        if files.get_file_info(f"{at}/_commits").type == fs.FileType.NotFound:
            return None
        listed = files.get_file_info(fs.FileSelector(f"{at}/_commits"))
        return {f.base_name: json.loads(files.open_input_stream(f.path).read()) for f in listed if f.path.endswith(".json")}

    def schema(self, table: str) -> StructType:
        import pyarrow.parquet as pq

        store = self._store()[0]
        files = self._files(store, table)
        if not files:
            raise ValueError(f"table {table} has no file yet")
        return from_arrow_schema(pq.read_schema(store.open_input_file(files[0])))

    def splits(self, table: str) -> list[Split]:
        import pyarrow.parquet as pq

        store = self._store()[0]
        found = []
        for f in self._files(store, table):
            meta = pq.read_metadata(store.open_input_file(f))
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                columns = [group.column(k) for k in range(group.num_columns)]
                bounds = {c.path_in_schema: (c.statistics.min, c.statistics.max) for c in columns if c.is_stats_set and c.statistics.has_min_max}
                found.append(Split(f"{f}#{g}", bounds))
        return found

    def read(self, table: str, split: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        path, _, group = split.rpartition("#")
        with self._store()[0].open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=4096, row_groups=[int(group)])

    def stage(self, table: str, token: str, requests: Iterator[pa.RecordBatch], schema: pa.Schema) -> str | None:
        """Write rows so that nobody sees them yet; a name for what was written, if any."""
        import pyarrow.parquet as pq

        store, base = self._store()
        name = f"{token}.parquet"
        store.create_dir(f"{base}/{table}/_commits", recursive=True)
        n = 0
        with store.open_output_stream(f"{base}/{table}/{name}") as out, pq.ParquetWriter(out, schema) as writer:
            for r in requests:
                writer.write_batch(r)
                n += r.num_rows
        return name if n else None

    def commit(self, table: str, job: str, staged: list[str], overwrite: bool) -> None:
        """Make what was staged part of the table, in one step; the same job again changes nothing."""
        store, base = self._store()
        at = f"{base}/{table}"
        store.create_dir(f"{at}/_commits", recursive=True)
        known = self._commits(store, at) or {}
        if f"{job}.json" in known:
            return
        with store.open_output_stream(f"{at}/_commits/{job}.tmp") as out:
            out.write(json.dumps({"files": sorted(staged), "replaces": sorted(known) if overwrite else []}).encode())
        store.move(f"{at}/_commits/{job}.tmp", f"{at}/_commits/{job}.json")

    def abort(self, table: str, job: str, staged: list[str]) -> None:
        store, base = self._store()
        for name in staged:
            store.delete_file(f"{base}/{table}/{name}")


def _client(options: dict):
    module, _, name = options.get("client", FOLDER_CLIENT).partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def may_hold(bounds: dict, f: ds.Filter) -> bool:
    """False if no row within the bounds can pass the filter. Comparisons of other types than the bounds' own rule nothing out."""
    column = ".".join(getattr(f, "attribute", ()))
    if column not in bounds:
        return True
    least, most = bounds[column]
    try:
        match f:
            case ds.EqualTo():
                return least <= f.value <= most
            case ds.In():
                return any(least <= v <= most for v in f.value if v is not None)
            case ds.GreaterThan():
                return most > f.value
            case ds.GreaterThanOrEqual():
                return most >= f.value
            case ds.LessThan():
                return least < f.value
            case ds.LessThanOrEqual():
                return least <= f.value
            case ds.StringStartsWith():
                return least[: len(f.value)] <= f.value <= most[: len(f.value)]
    except TypeError:
        pass
    return True


@dataclass
class Part(ds.InputPartition):
    split: str


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.filters = dict(options), schema, []

    def pushFilters(self, filters):
        self.filters = list(filters)
        return self.filters  # bounds rule splits out, not rows

    def partitions(self) -> list[Part]:
        splits = _client(self.options).splits(self.options["table"])
        return [Part(s.name) for s in splits if all(may_hold(s.bounds, f) for f in self.filters)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "split"):
            return
        want = to_arrow_schema(self.schema)
        for batch in _client(self.options).read(self.options["table"], partition.split):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in want], schema=want)


@dataclass
class Staged(ds.WriterCommitMessage):
    name: str | None
    n: int


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite, self.job = dict(options), schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context, chunk, n = TaskContext.get(), int(self.options.get("chunk", 200)), 0
        part = context.partitionId() if context else 0
        want = to_arrow_schema(self.schema)

        def requests() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for batch in iterator:
                batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, want)], schema=want)
                for k in range(0, batch.num_rows, chunk):
                    n += min(chunk, batch.num_rows - k)
                    yield batch.slice(k, chunk)

        name = _client(self.options).stage(self.options["table"], f"{self.job}-{part:06d}-{uuid.uuid4().hex}", requests(), want)
        return Staged(name, n)

    def commit(self, messages: list) -> None:
        staged = [m.name for m in messages if m is not None and m.name]
        _client(self.options).commit(self.options["table"], self.job, staged, self.overwrite)

    def abort(self, messages: list) -> None:
        _client(self.options).abort(self.options["table"], self.job, [m.name for m in messages if m is not None and m.name])


class WarehouseSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return _client(self.options).schema(self.options["table"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Once in each session. Filters are only given to such a source where the session says so."""
    spark.dataSource.register(WarehouseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_table(spark: SparkSession, table: str, **options: str):
    register(spark)
    return spark.read.format(FORMAT).options(table=table, **options).load()


def insert(df, table: str, overwrite: bool = False, **options: str) -> None:
    register(df.sparkSession)
    df.write.format(FORMAT).options(table=table, **options).mode("overwrite" if overwrite else "append").save()
