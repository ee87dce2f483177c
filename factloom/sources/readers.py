"""Readers. All of them are Spark's own, so paths may be in any store that Spark reaches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETION = {"content": "$[1].choices[0].message.content", "model": "$[0].model", "metadata": "$[2].metadata"}


def read_csv(spark: SparkSession, path, schema: str | None = None, sep: str = ",", partitions: int | None = None) -> DataFrame:
    """Notes hold newlines and quotes. An empty field is null, quoted or not. A file is one task's work here; `partitions` deals its
    rows out for what follows. parallel_csv reads a file by many tasks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.repartition(partitions) if partitions else rows


def read_jsonl(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_completions(spark: SparkSession, path) -> DataFrame:
    """Lines `[request, response or errors, {metadata}]`, which the JSON reader would take apart.

    file, content, errors (JSON list, of failed requests), model, metadata (JSON text), and the line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    at = lambda p: F.get_json_object("value", p)
    failed = F.get_json_object("value", "$[1]").startswith("[")
    return lines.select("file", *[at(p).alias(n) for n, p in COMPLETION.items()], F.when(failed, at("$[1]")).alias("errors"), F.col("value").alias("line"))


def read_flat_completions(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    at = lambda p: F.get_json_object("value", p)
    return lines.select("file", at("$.choices[0].message.content").alias("content"), at("$.model").alias("model"), at("$.prompt").alias("prompt"), F.col("value").alias("line"))


def has_content(line: Column) -> Column:
    return F.get_json_object(line, "$[1].choices[0].message.content").isNotNull()


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path) -> DataFrame:
    """One row per file: file and note_text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("note_text"))


def read_zipped_texts(spark: SparkSession, path, suffix: str = ".txt") -> DataFrame:
    """One row per member of ZIP archives: archive, member, note_text. An archive is one task's work; members stream."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [m], "note_text": [z.read(m).decode("utf-8")]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(members, "archive string, member string, note_text string")


def read_large_zips(spark: SparkSession, path, suffix: str = ".txt", partitions: int | None = None) -> DataFrame:
    """As read_zipped_texts, for archives of any size: archive, member, note_text.

    One pass lists members (an archive's content isn't a column then), and a second one reads them where they were dealt to, so
    that one archive is many tasks' work. Archives are opened at their place by pyarrow's file systems (local, S3, GCS, HDFS).
    """
    from pyarrow import fs

    def opened(uri: str) -> zipfile.ZipFile:
        store, at = fs.FileSystem.from_uri(uri)
        return zipfile.ZipFile(store.open_input_file(at))

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["path"]:
                with opened(uri) as z:
                    yield pd.DataFrame({"archive": uri, "member": [m for m in z.namelist() if m.endswith(suffix)]})

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri, members in f.groupby("archive")["member"]:
                with opened(uri) as z:
                    for m in members:
                        yield pd.DataFrame({"archive": [uri], "member": [m], "note_text": [z.read(m).decode("utf-8")]})

    files = spark.read.format("binaryFile").load(path).select("path")
    listed = files.mapInPandas(names, "archive string, member string")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "archive", "member").mapInPandas(texts, "archive string, member string, note_text string")


def read_terms(spark: SparkSession, path, most: int = 100_000) -> frozenset[str]:
    """A tokenizer's own terms, one on each line, for `Lexicon(terms)`. Every task gets them, so there may be `most` at most."""
    found = spark.read.text(path).select(F.trim("value").alias("t")).where("t <> ''").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return frozenset(r.t for r in found)


def study_ids(member: Column) -> dict[str, Column]:
    """Subject and study numbers in a member's path."""
    number = lambda p: F.when(member.rlike(p), F.regexp_extract(member, p, 1).try_cast("bigint"))
    return {"subject_id": number(r"p(\d{3,})/"), "study_id": number(r"s(\d{3,})\.txt")}


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A dataset that is kept by split: its splits in one frame, with a column `split`."""
    frames = [spark.read.parquet(p).withColumn("split", F.lit(s)) for s, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_templates(spark: SparkSession, path) -> DataFrame:
    """name (a file's stem) and template, by name. A handful of small files."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("name"), F.col("value").alias("template"))
    return files.orderBy("name")


#: The parts of an experiment's path below the root: llm/dataset/note_type/file.
PROMPT_NAME, METRIC_NAME = r"(PROMPT[12](?:_ICL)*)", r"(precision|recall)"
SUBTYPES = {"pdac": "progress_note", "breastca": "progress_note"}


def path_metadata(path: Column) -> dict[str, Column]:
    """llm, dataset, note_type, note_subtype, prompt, metric and key from the last four parts of a path; null where absent."""
    parts = F.split(path, "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    name, kind = at(-1), at(-2)
    note_type = kind
    for sub, whole in SUBTYPES.items():
        note_type = F.when(kind == sub, whole).otherwise(note_type)
    found = lambda p: F.when(name.rlike(p), F.regexp_extract(name, p, 1))
    columns = {"llm": at(-4), "dataset": at(-3), "note_type": note_type, "note_subtype": F.when(kind.isin(*SUBTYPES), kind), "prompt": found(PROMPT_NAME), "metric": found(METRIC_NAME)}
    columns["key"] = F.concat_ws("|", columns["llm"], columns["dataset"], kind, columns["prompt"])
    return columns


def read_experiments(spark: SparkSession, root: str) -> DataFrame:
    """Judged items (ID, premise, entailment_pred, verdict) below root/llm/dataset/note_type/, with their path's columns."""
    items = spark.read.schema("ID string, premise string, entailment_pred int, verdict string").json(f"{root.rstrip('/')}/*/*/*/*.json")
    path = F.col("_metadata.file_path")
    return items.select("*", path.alias("file")).select("*", *[c.alias(n) for n, c in path_metadata(F.col("file")).items()])
