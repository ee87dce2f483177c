"""Files cut by many tasks against whole-file reads."""

import csv
import gzip
import random

import pytest

from factloom.sources import parallel_csv as pc
from factloom.sources import readers as rd

SCHEMA = "id bigint, note string, tail string"


def notes(n, seed=0):
    rng = random.Random(seed)
    bits = ["word", '"', '""', "\n", ",", "é", " ", "\n\n", "日本", '",\n"', "x" * 50]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))), rng.choice(("end", 'q"', "a\nb"))) for i in range(n)]


def written(path, rows, end="\n", last=True):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "note", "tail"])
        w.writerows(rows)
    if not last:
        data = path.read_bytes()
        path.write_bytes(data[: -len(end)])
    return path.read_bytes()


def ordered(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end,last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_blocks(spark, tmp_path, small_splits, end, last):
    rows = notes(300)
    written(tmp_path / "a.csv", rows, end, last)
    more = [(i + 1000, t, x) for i, t, x in notes(5, 2)] + [(2000, "long " * 5000 + '"\n' * 3000, "end")]
    written(tmp_path / "b.csv", more)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    got = pc.read_csv_blocks(spark, str(tmp_path), SCHEMA)
    assert ordered(got) == sorted(rows + more)
    assert ordered(got) == ordered(rd.read_csv(spark, str(tmp_path), SCHEMA))


def test_names_of_the_header(spark, tmp_path):
    written(tmp_path / "a.csv", [(1, "x", "y")])
    got = pc.read_csv_blocks(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("id", "string"), ("note", "string"), ("tail", "string")] and ordered(got) == [("1", "x", "y")]


def test_header_alone_and_open_quote(spark, tmp_path):
    written(tmp_path / "a.csv", [])
    (tmp_path / "b.csv").write_bytes(b"")
    assert pc.read_csv_blocks(spark, str(tmp_path), SCHEMA).collect() == []
    (tmp_path / "c.csv").write_bytes(b'id,note,tail\n1,"open\n2,x,y\n')
    assert len(pc.read_csv_blocks(spark, str(tmp_path / "c.csv"), SCHEMA).collect()) == 1


def test_header_over_blocks(spark, tmp_path, small_splits):
    name = "n" + "\nx" * 4000
    (tmp_path / "a.csv").write_bytes(f'id,"{name}",tail\n1,"a\nb",c\n'.encode())
    assert ordered(pc.read_csv_blocks(spark, str(tmp_path / "a.csv"), SCHEMA)) == [(1, "a\nb", "c")]


def members(data, cuts):
    return b"".join(gzip.compress(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)]))


@pytest.mark.parametrize("span", [700, 32 << 20])
def test_gzip(spark, tmp_path, span):
    """Members begin anywhere, inside records, quotes and characters; some hold a gzip file as it is."""
    rows = notes(300)
    data = written(tmp_path / "plain.csv", rows)
    rng = random.Random(1)
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz/a.csv.gz").write_bytes(members(data, sorted(rng.sample(range(1, len(data)), 40))))
    (tmp_path / "gz/b.csv.gz").write_bytes(gzip.compress(data))
    found = pc.gzip_members(spark, str(tmp_path / "gz"), span).groupBy("file").count().collect()
    assert sorted(r["count"] for r in found) == [1, 41]
    got = pc.read_gzip_csv(spark, str(tmp_path / "gz"), SCHEMA, span=span)
    assert ordered(got) == sorted(rows + rows) == ordered(rd.read_csv(spark, str(tmp_path / "gz"), SCHEMA))


def test_gzip_in_gzip_and_broken(spark, tmp_path):
    inner = gzip.compress(b"inner")
    stored = gzip.compress(inner * 3, compresslevel=0)
    (tmp_path / "a.gz").write_bytes(stored + gzip.compress(b"x"))
    assert sorted(r.at for r in pc.gzip_members(spark, str(tmp_path / "a.gz"), 25).collect()) == [0, len(stored)]
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"x") + b"junk" + gzip.compress(b"y"))
    with pytest.raises(Exception, match="not gzip members alone"):
        pc.gzip_members(spark, str(tmp_path / "b.gz")).collect()
