"""Completions as a stream: new files of judge answers are parsed as they come, kept once per id, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.ids import parse_custom_id
from factloom.functions.verdict import with_verdict
from factloom.sources.readers import COMPLETION


def read_completion_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    at = lambda p: F.get_json_object("value", p)
    return lines.select(at(COMPLETION["content"]).alias("content"), at(COMPLETION["model"]).alias("model"), at("$[2].metadata.custom_id").alias("custom_id"), at("$[2].metadata.label").try_cast("int").alias("label"), F.current_timestamp().alias("seen"))


def judged(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (custom_id, model) within the watermark: verdicts with the id's parts."""
    once = lines.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["custom_id", "model"])
    prompt = parse_custom_id(F.col("custom_id"))["prompt"]
    told = with_verdict(once.select("custom_id", "model", "label", "content", prompt.alias("prompt"), "seen"), "content")
    return told.select("custom_id", "model", "label", "raw", "not_parseable", "prediction", "prompt", "seen")


def running_accuracy(verdicts: DataFrame) -> DataFrame:
    """n, unparseable and right answers by model and prompt; for update or complete mode."""
    return verdicts.groupBy("model", "prompt").agg(F.count("*").alias("n"), F.count_if("not_parseable").alias("n_unparseable"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right"))
