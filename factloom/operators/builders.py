"""Composite flows: sampled corpora, combined notes, recovered provenance, result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.ids import compose, hash_text, parse_custom_id
from factloom.functions.text import token_estimate
from factloom.functions.names import unused
from factloom.functions.verdict import with_verdict
from factloom.operators.relational import keep_first, keep_last, semi_join_by_hash, text_fallback, union_all
from factloom.operators.sampling import stratified_sample, token_band

NOTE_COLUMNS = ("doc_id", "note_text", "est_token_count", "note_type", "dataset_name")


@dataclass(frozen=True)
class Stratum:
    """One source's stratum: which rows it takes, and whether copies of a text go first."""

    dataset_name: str
    note_type: str
    rows: Column
    dedup: bool = False


def sample_corpus(notes: DataFrame, strata: list[Stratum], n: int = 250, least: float = 64, most: float = 3840, seed: int = 123456) -> DataFrame:
    """Notes (doc_id, note_text) of all strata: predicate, dedup by text, token band, hash-rank sample.

    One pass over the notes for all strata: a row belongs to the first stratum that takes it.
    """
    which = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(strata))):
        which = F.when(F.coalesce(s.rows, F.lit(False)), i).otherwise(which)
    (stratum,) = unused([*notes.columns, "est_token_count"], "stratum")
    kept = notes.withColumn(stratum, which).where(F.col(stratum).isNotNull())
    kept = token_band(kept, "note_text", least, most)
    dedup = [i for i, s in enumerate(strata) if s.dedup]
    if dedup:
        once = keep_first(kept.where(F.col(stratum).isin(dedup)), [stratum, hash_text(F.col("note_text"))], [F.col("doc_id")])
        kept = union_all(kept.where(~F.col(stratum).isin(dedup)), once)
    named = lambda f: F.element_at(F.array(*[F.lit(f(s)) for s in strata]), F.col(stratum) + 1)
    sampled = stratified_sample(kept, [stratum], n, seed)
    return sampled.select("doc_id", "note_text", "est_token_count", named(lambda s: s.note_type).alias("note_type"), named(lambda s: s.dataset_name).alias("dataset_name"))


def combine_notes(frames: list[DataFrame]) -> DataFrame:
    """Source tables as one, in the five published columns; the other name of the text column is accepted."""
    whole = [text_fallback(f) for f in frames]
    whole = [f if "est_token_count" in f.columns else f.withColumn("est_token_count", token_estimate(F.col("note_text"))) for f in whole]
    return union_all(*[f.select(*NOTE_COLUMNS) for f in whole])


def provenance(legacy: DataFrame, source: DataFrame, source_text: str, source_id: str) -> DataFrame:
    """Source rows whose text's digest is one of the legacy documents' ids."""
    return semi_join_by_hash(source, source_text, legacy, "doc_id").select(F.col(source_id), hash_text(F.col(source_text)).alias("doc_id"))


_VERDICT = ("entailment_pred_raw", "not_parseable", "entailment_pred")


def verdict_table(answers: DataFrame, answer: str = "model_output", custom_id: str = "custom_id") -> DataFrame:
    """Judge's answers with the parts of their ids and their verdicts; no dedup."""
    ids = parse_custom_id(F.col(custom_id))
    told = answers.select("*", *[ids[n].alias(n) for n in ("doc_id", "dataset_name", "note_type", "prompt", "index", "entailment_type")])
    return with_verdict(told, answer, _VERDICT)


def nli_table(answers: DataFrame, order: list[Column], answer: str = "model_output") -> tuple[DataFrame, DataFrame]:
    """Natural-language-inference results: the last answer of each id and model, and apart from them the rows without a label."""
    last = keep_last(answers, ["custom_id", "model"], order)
    ids = parse_custom_id(F.col("custom_id"))
    told = with_verdict(last.select("*", *[ids[n].alias(n) for n in ("dataset", "split", "uid", "prompt")]), answer, _VERDICT)
    return told.where(F.col("label").isNotNull()), told.where(F.col("label").isNull())


def pair_records(pairs: DataFrame, model: str) -> DataFrame:
    """The JSON record of each filled pair: {metadata, messages}."""
    metadata = F.struct(F.col("custom_id"), F.col("premise"), F.col("hypothesis"), F.lit(model).alias("model_name"))
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    return pairs.select("custom_id", F.to_json(F.struct(metadata.alias("metadata"), F.array(message).alias("messages"))).alias("value"))


def experiment_key(*parts: str) -> Column:
    return compose(*parts)
