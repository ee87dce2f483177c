"""Writers. One file per task unless said otherwise; names come from the caller."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    exact = {"header": True, "quoteAll": True, "escape": '"', "sep": sep, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**exact).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """mode append adds files, one for each task, and leaves those that are there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_completions(df: DataFrame, path: str, request: str, response: str, metadata: str | None = None, mode: str = "overwrite") -> None:
    """Lines `[request, response, {metadata}]` from columns of JSON text; two elements without metadata."""
    parts = [F.col(request), F.col(response)] + ([F.concat(F.lit('{"metadata": '), F.col(metadata), F.lit("}"))] if metadata else [])
    line = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def predictions_to_completions(df: DataFrame, prediction: str, request: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Warehouse predictions as completion lines, and the rows that can't be: (value), (rejected rows)."""
    text = F.try_variant_get(F.try_parse_json(prediction), "$.candidates[0].content.parts[0].text", "string")
    told = df.withColumn("__text", text)
    response = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("__text").alias("content"), F.lit("assistant").alias("role")).alias("message"))).alias("choices")))
    line = F.concat(F.lit("["), F.col(request), F.lit(", "), response, F.lit(", "), F.to_json(F.struct(F.struct(F.lit(model).alias("model")).alias("metadata"))), F.lit("]"))
    return told.where("__text IS NOT NULL").select(line.alias("value")), told.where("__text IS NULL").drop("__text")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_by_annotator(df: DataFrame, path: str, annotator: str = "annotator", files: int = 1) -> None:
    """A folder for each annotator, with up to `files` files, each one task's work."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(F.col(annotator), salt).write.mode("overwrite").partitionBy(annotator).option("header", True).option("quoteAll", True).csv(path)


def split_files(df: DataFrame, path: str, n: int) -> None:
    """n files of nearly equal size."""
    df.repartition(n).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def concat_files(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file from parts, in their order, which are gone afterwards.

    Stores that can join files by their blocks do that, without a byte moving; others get a plain copy, by streams of the driver's JVM.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, files = jvm.org.apache.hadoop.fs.Path(path), [jvm.org.apache.hadoop.fs.Path(p) for p in parts]
    store = target.getFileSystem(conf)
    store.delete(target, False)
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, max(len(files) - 1, 0))
    for k, f in enumerate(files[1:]):
        array[k] = f
    try:
        if not files or not store.rename(files[0], target):
            raise ValueError("there must be a part")
        if len(files) > 1:
            store.concat(target, array)
        return
    except UnsupportedOperationException:
        pass
    store.rename(target, files[0])
    out = store.create(target, True)
    try:
        for f in files:
            held = store.open(f)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, conf, False)
            finally:
                held.close()
    finally:
        out.close()
    for f in files:
        store.delete(f, False)


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The files that a Spark writer left in a folder, in order of its partitions, without empty ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-") and f.getLen())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_files(df: DataFrame, path: str, by: list[str]) -> None:
    """One file of JSON lines in the order of `by`: parts are written side by side, each in order, and then joined."""
    spark, folder = df.sparkSession, f"{path}-parts"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    concat_files(spark, part_files(spark, folder), path)
    remove(spark, folder)


def write_gzip_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One .csv.gz file with a member for each part, which are compressed side by side; the header is a member of its own."""
    spark, folder = df.sparkSession, f"{path}-parts"
    options = {"quoteAll": True, "escape": '"', "sep": sep, "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options, header=False).csv(f"{folder}/rows")
    spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{k} string" for k in range(len(df.columns)))).coalesce(1).write.mode("overwrite").options(**options, header=False).csv(f"{folder}/header")
    concat_files(spark, [*part_files(spark, f"{folder}/header"), *part_files(spark, f"{folder}/rows")], path)
    remove(spark, folder)


def send_in_batches(df: DataFrame, send: Callable[[list[dict]], list[str]], size: int = 200) -> DataFrame:
    """Send rows to a service in batches of `size` from each partition; returns part, batch, n and every error of every batch."""
    columns = df.columns

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held: list[dict] = []
        number = 0
        for f in frames:
            held += f.to_dict("records")
            while len(held) >= size:
                batch, held = held[:size], held[size:]
                yield pd.DataFrame({"part": [0], "batch": [number], "n": [len(batch)], "errors": [json.dumps(send(batch))]})
                number += 1
        if held:
            yield pd.DataFrame({"part": [0], "batch": [number], "n": [len(held)], "errors": [json.dumps(send(held))]})

    sent = df.select(*columns).mapInPandas(run, "part int, batch int, n int, errors string")
    return sent.withColumn("part", F.spark_partition_id())


def write_templates(spark: SparkSession, templates: dict[str, str], folder: str) -> None:
    """A file name.tmpl for each template, exactly as given, in any file system that Spark reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, body in templates.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.tmpl")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()


def dated(stem: str, day: date, suffix: str = "jsonl", fmt: str = "%Y%m%d") -> str:
    return f"{stem}_{day.strftime(fmt)}.{suffix}"
