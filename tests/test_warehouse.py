"""The warehouse source over its file-backed client."""

import subprocess
import sys
import textwrap

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from factloom.sources import warehouse as wh


def ordered(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def folder(tmp_path):
    rows = pa.table({"id": list(range(1000)), "name": [f"n{i:04d}" for i in range(1000)], "score": [i / 7 for i in range(1000)]})
    pq.write_table(rows, tmp_path / "things.parquet", row_group_size=100)
    return str(tmp_path)


def test_scan_prunes_splits(spark, folder):
    t = wh.read_table(spark, "things", root=folder)
    assert t.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and t.count() == 1000
    assert t.rdd.getNumPartitions() == 10
    for where, parts, n in (("id = 250", 1, 1), ("id >= 300 and id < 420", 2, 120), ("name like 'n09%'", 1, 100), ("id in (5, 950)", 2, 2), ("score > 1e9", 0, 0)):
        some = t.where(where)
        assert some.count() == n and some.rdd.getNumPartitions() == max(parts, 0 if n == 0 else 1) or n == 0
    assert "PythonScan" in t.where("id = 250")._jdf.queryExecution().toString() or "BatchScan" in t._jdf.queryExecution().toString()


def test_insert_append_overwrite(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(1000).select("id", F.concat(F.lit("x"), "id").alias("v"), F.array(F.lit(1)).alias("a"))
    wh.insert(df.repartition(3), "t", root=root)
    wh.insert(spark.range(1000, 1200).select("id", F.lit("y").alias("v"), F.array(F.lit(2)).alias("a")), "t", root=root)
    got = wh.read_table(spark, "t", root=root)
    assert got.count() == 1200 and got.where("id < 1000").distinct().count() == 1000
    groups = sum(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "t").glob("*.parquet"))
    assert groups >= 6  # requests of 200 rows
    wh.insert(df.limit(5), "t", overwrite=True, root=root)
    assert wh.read_table(spark, "t", root=root).count() == 5


def test_attempts_and_commits(tmp_path):
    """Two attempts of one task, of which one dies half-way; a commit that comes twice."""
    from pyspark.sql.types import LongType, StructField, StructType

    writer = wh.Writer({"root": str(tmp_path), "table": "t"}, StructType([StructField("id", LongType())]), False)
    batch = pa.RecordBatch.from_pydict({"id": list(range(500))})

    def dies():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    lost, message = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.name != message.name
    for _ in range(2):
        writer.commit([message])
    client = wh.FolderClient({"root": str(tmp_path)})
    rows = [r for s in client.splits("t") for b in client.read("t", s.name) for r in b.column(0).to_pylist()]
    assert sorted(rows) == list(range(500)) and message.n == 500
    writer.abort([lost])


def test_failed_job_inserts_nothing(spark, tmp_path):
    root = str(tmp_path)
    wh.insert(spark.range(10), "t", root=root)
    with pytest.raises(Exception):
        bad = spark.range(1000).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id"))
        wh.insert(bad, "t", root=root)
    assert wh.read_table(spark, "t", root=root).count() == 10


def test_task_that_runs_twice(tmp_path):
    """Spark itself runs a task again that failed in the middle of its rows."""
    script = f"""
        import sys; sys.path.insert(0, {ROOT!r})
        from pathlib import Path
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from factloom.sources import warehouse as wh
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        def run(batches):
            for n, b in enumerate(batches):
                yield b
                if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
                    raise RuntimeError("in the middle")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        df = spark.range(0, 2000, 1, 2).mapInArrow(run, "id bigint")
        wh.insert(df, "t", root={str(tmp_path)!r})
        got = wh.read_table(spark, "t", root={str(tmp_path)!r})
        print("ROWS", got.count(), got.distinct().count(), len(list(Path({str(tmp_path)!r}, "t").glob("*.parquet"))))
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=120)
    assert "ROWS 2000 2000" in out.stdout, out.stderr[-2000:]
