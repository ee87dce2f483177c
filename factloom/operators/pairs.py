"""Prompt sets and entailment pairs.

Pairs refer to their premise by id: texts of premises aren't copied into a million pairs, and are joined where an inference
step needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.ids import compose, hash_text
from factloom.functions.text import fill_template, hypothesis, split_delimited


def prompt_set(docs: DataFrame, templates: dict[str, str], text: str = "note_text", id_parts: tuple = ("doc_id", "dataset_name", "note_type"), count=None, max_tokens: int = 4096) -> DataFrame:
    """Every document under every template: uid, doc_id, template name, filled prompt, token counts.

    Templates are literals of one array, which is exploded: one scan of the documents, no shuffle, and no join.
    """
    filled = [F.struct(F.lit(name).alias("name"), fill_template(body, text=F.col(text)).alias("prompt")) for name, body in sorted(templates.items())]
    rows = docs.select(*id_parts, *([count(F.col(text)).alias("n_tokens")] if count else []), F.explode(F.array(*filled)).alias("t"))
    counted = [F.col("n_tokens"), count(F.col("t.prompt")).alias("n_prompt_tokens")] if count else []
    return rows.select(
        compose(*id_parts, F.col("t.name")).alias("uid"), *id_parts, F.col("t.name").alias("prompt_template_name"), F.col("t.prompt").alias("prompt"), F.lit(max_tokens).alias("max_tokens"), *counted
    )


def chat_messages(prompt: Column, system: str | None = None) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([one("system", F.lit(system))] if system else []), one("user", prompt))


def label_rule(dataset: Column, gold: Column, code: Column, human: Column) -> Column:
    """0/1 labels of the natural-language-inference sets; other sets have none."""
    return (
        F.when(dataset.isin("mednli", "scitail"), (gold == "entailment").cast("int"))
        .when(dataset.isin("snli", "multinli"), (code == 0).cast("int"))
        .when(dataset == "factsdev", human.cast("int"))
    )


def _numbered(df: DataFrame, uid: str, items: Column, kind: str, carry: list[str]) -> DataFrame:
    out = df.select(uid, *carry, F.posexplode(items).alias("index", "hypothesis"))
    return out.select(compose(uid, "index", F.lit(kind)).alias("custom_id"), F.col(uid), *carry, "index", F.lit(kind).alias("entailment_type"), hypothesis(F.col("hypothesis")).alias("hypothesis"))


def precision_pairs(decompositions: DataFrame, uid: str = "uid", facts: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """The note entails each fact: one pair per fact."""
    return _numbered(decompositions, uid, split_delimited(F.col("fact_decomp")) if facts is None else facts, "precision", carry or [])


def recall_pairs(decompositions: DataFrame, sentences: Column, uid: str = "uid", carry: list[str] | None = None) -> DataFrame:
    """The facts entail each sentence of the note: one pair per sentence."""
    return _numbered(decompositions, uid, sentences, "recall", carry or [])


def all_pairs(decompositions: DataFrame, facts: Column, sentences: Column, uid: str = "uid", carry: list[str] | None = None) -> DataFrame:
    """Both kinds of pairs from one scan: the two lists are exploded as one array of (kind, items)."""
    carry = carry or []
    kinds = F.array(F.struct(F.lit("precision").alias("kind"), facts.alias("items")), F.struct(F.lit("recall").alias("kind"), sentences.alias("items")))
    lists = decompositions.select(uid, *carry, F.explode(kinds).alias("list")).select(uid, *carry, F.col("list.kind").alias("entailment_type"), F.col("list.items").alias("items"))
    out = lists.select(uid, *carry, "entailment_type", F.posexplode("items").alias("index", "hypothesis"))
    return out.select(compose(uid, "index", "entailment_type").alias("custom_id"), F.col(uid), *carry, "index", "entailment_type", hypothesis(F.col("hypothesis")).alias("hypothesis"))


def filled_pairs(decompositions: DataFrame, facts: Column, sentences: Column, template: str, note: str = "note_text", decomposition: str = "fact_decomp", uid: str = "uid", carry: list[str] | None = None) -> DataFrame:
    """Both kinds of pairs with their premise and the judge's filled template, where a row has the note and its decomposition: one scan, and no text moves."""
    carry = carry or []
    kind = lambda name, premise, items: F.struct(F.lit(name).alias("kind"), F.col(premise).alias("premise"), items.alias("items"))
    lists = decompositions.select(uid, *carry, F.explode(F.array(kind("precision", note, facts), kind("recall", decomposition, sentences))).alias("list"))
    apart = lists.select(uid, *carry, F.col("list.kind").alias("entailment_type"), F.col("list.premise").alias("premise"), F.col("list.items").alias("items"))
    out = apart.select(uid, *carry, "entailment_type", "premise", F.posexplode("items").alias("index", "hypothesis"))
    out = out.select(compose(uid, "index", "entailment_type").alias("custom_id"), F.col(uid), *carry, "index", "entailment_type", hypothesis(F.col("hypothesis")).alias("hypothesis"), "premise")
    return out.withColumn("prompt", fill_template(template, premise=F.col("premise"), hypothesis=F.col("hypothesis")))


def with_premises(pairs: DataFrame, notes: DataFrame, decompositions: DataFrame, template: str, uid: str = "uid") -> DataFrame:
    """Fill the judge's template for pairs that came without texts: precision pairs get the note, recall pairs the decomposition."""
    texts = decompositions.join(notes.select("doc_id", "note_text"), "doc_id").select(uid, "note_text", "fact_decomp")
    premise = F.when(F.col("entailment_type") == "precision", F.col("note_text")).otherwise(F.col("fact_decomp"))
    joined = pairs.join(texts, uid).withColumn("premise", premise)
    return joined.select(*pairs.columns, "premise", fill_template(template, premise=F.col("premise"), hypothesis=F.col("hypothesis")).alias("prompt"))


def hypotheses(pairs: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Distinct hypotheses of one kind. Those for recall don't depend on the model, so its column is left out of keys."""
    return pairs.where(F.col("entailment_type") == kind).select(*keys, "hypothesis").distinct()


def merge_decompositions(completions: DataFrame, content: str = "content", model: str = "model", note: str = "note_uid") -> DataFrame:
    """uid, decomp_id, model, note_uid, fact_decomp of the completions that have a content."""
    rows = completions.where(F.col(content).isNotNull())
    decomp = hash_text(F.col(content))
    return rows.select(compose(decomp, model, note).alias("uid"), decomp.alias("decomp_id"), F.col(model).alias("model"), F.col(note).alias("note_uid"), F.col(content).alias("fact_decomp"))
