"""Queries over readers, writers and inference flows: what is written to the shared folder and read back, with its SQL.

Importing this module registers them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions.ids import compose, hash_text
from factloom.functions.text import fill_template
from factloom.operators import builders as bd
from factloom.operators import inference as inf
from factloom.operators import pairs as pr
from factloom.operators import relational as rel
from factloom.operators import sampling as sm
from factloom.operators.numbering import materialise, number_rows, shared_folder
from factloom.plans.base import _WORDS, _judge, _judge_sql, _verdict_sql
from factloom.plans.catalog import register, table
from factloom.sources import parallel_csv as pc
from factloom.sources import readers as rd
from factloom.sources import warehouse as wh
from factloom.sources import writers as wr


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _read(spark, path: str, result):
    """The result once it has been read, so that the files in `path` can go; what stays is a checkpoint, which is Spark's to clean."""
    held = materialise(result)
    wr.remove(spark, path)
    return held


def _ddl(df) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


_TURNS = "conv_id bigint, turn bigint, role string, text string"


@register("csv_round_trip", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_hash FROM documents")
def csv_round_trip(spark, sf_dir):
    path = _place(spark, "csv")
    wr.write_csv(table(spark, sf_dir, "documents"), path)
    back = rd.read_csv(spark, path, _ddl(table(spark, sf_dir, "documents")))
    return _read(spark, path, back.select("doc_id", "lang", "source", "n_chars", hash_text(F.col("text")).alias("text_hash")))


@register("tsv_round_trip", "SELECT conv_id, turn, role, md5(text) AS text_hash FROM conversations")
def tsv_round_trip(spark, sf_dir):
    path = _place(spark, "tsv")
    wr.write_tsv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = rd.read_csv(spark, path, _TURNS, "\t")
    return _read(spark, path, back.select("conv_id", "turn", "role", hash_text(F.col("text")).alias("text_hash")))


@register("jsonl_append", "SELECT conv_id, turn, role, md5(text) AS text_hash, CASE WHEN role = 'system' THEN 'first' ELSE 'second' END AS run FROM conversations")
def jsonl_append(spark, sf_dir):
    """Runs write into folders of their own, the second one in two goes; one glob reads them all, and the path tells the run."""
    path, t = _place(spark, "jsonl"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = F.coalesce(F.col("role") == "system", F.lit(False))
    wr.write_jsonl(t.where(first), f"{path}/first")
    wr.write_jsonl(t.where(~first & (F.col("turn") < 2)), f"{path}/second")
    wr.write_jsonl(t.where(~first & F.coalesce(F.col("turn") >= 2, F.lit(True))), f"{path}/second", mode="append")
    back = rd.read_jsonl(spark, f"{path}/*/*.json", _TURNS)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(first|second)/[^/]*$", 1)
    return _read(spark, path, back.select("conv_id", "turn", "role", hash_text(F.col("text")).alias("text_hash"), run.alias("run")))


@register("parquet_splits", "SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS split FROM documents")
def parquet_splits(spark, sf_dir):
    path, d = _place(spark, "splits"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    short = F.coalesce(F.col("n_chars") < 1000, F.lit(False))
    for name, rows in (("short", short), ("long", ~short)):
        wr.write_parquet(d.where(rows), f"{path}/{name}")
    return _read(spark, path, rd.read_splits(spark, {n: f"{path}/{n}" for n in ("short", "long")}).select("doc_id", "lang", "split"))


@register("files_by_annotator", "SELECT doc_id, lang, source AS annotator FROM documents")
def files_by_annotator(spark, sf_dir):
    path, d = _place(spark, "annotators"), table(spark, sf_dir, "documents")
    wr.write_by_annotator(d.select("doc_id", "lang", F.col("source").alias("annotator")), path, files=4)
    return _read(spark, path, rd.read_csv(spark, path, "doc_id bigint, lang string, annotator string").select("doc_id", "lang", "annotator"))


@register("csv_in_blocks", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_hash FROM documents")
def csv_in_blocks(spark, sf_dir):
    """The same rows as csv_round_trip; each split of a file is cut into records by a task of its own."""
    path, d = _place(spark, "blocks"), table(spark, sf_dir, "documents")
    wr.write_csv(d, path)
    back = pc.read_csv_blocks(spark, path, _ddl(d))
    return _read(spark, path, back.select("doc_id", "lang", "source", "n_chars", hash_text(F.col("text")).alias("text_hash")))


@register("gzip_in_members", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_hash FROM documents")
def gzip_in_members(spark, sf_dir):
    """All documents in one compressed file, which many tasks write and read."""
    path, d = _place(spark, "members"), table(spark, sf_dir, "documents")
    wr.write_gzip_csv(d.repartition(8), f"{path}/all.csv.gz")
    back = pc.read_gzip_csv(spark, f"{path}/all.csv.gz", _ddl(d))
    return _read(spark, path, back.select("doc_id", "lang", "source", "n_chars", hash_text(F.col("text")).alias("text_hash")))


@register("files_split_and_merged", "SELECT conv_id, turn, role, md5(text) AS text_hash, row_number() OVER (ORDER BY conv_id, turn) AS line FROM conversations")
def files_split_and_merged(spark, sf_dir):
    """Seven files, then one that holds all lines in order; the line's number is its place in that file."""
    path = _place(spark, "pieces")
    wr.split_files(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), f"{path}/split", 7)
    wr.merge_files(rd.read_jsonl(spark, f"{path}/split", _TURNS), f"{path}/merged.jsonl", ["conv_id", "turn"])
    lines = spark.read.text(f"{path}/merged.jsonl").select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    placed = number_rows(lines, ["at", "k"], "line").select(F.from_json("value", _TURNS).alias("r"), "line")
    return _read(spark, path, placed.select("r.conv_id", "r.turn", "r.role", hash_text(F.col("r.text")).alias("text_hash"), "line"))


@register("predictions_to_completions", """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN md5(text) END AS content_hash, role = 'system' AS rejected,
    CASE WHEN role <> 'system' THEN 'm' END AS model FROM conversations""")
def predictions_to_completions(spark, sf_dir):
    """Warehouse rows as completion lines, which the reader takes apart; rejected rows are told apart and not lost."""
    t = table(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.col("text").alias("text")))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    request = F.to_json(F.struct(F.col("conv_id"), F.col("turn")))
    rows = t.select("conv_id", "turn", F.when(F.col("role") != "system", answer).otherwise("broken").alias("prediction"), request.alias("request"))
    lines, rejects = wr.predictions_to_completions(rows, "prediction", "request", "m")
    path = _place(spark, "predictions")
    lines.write.text(path)
    back = rd.read_completions(spark, path)
    at = lambda name: F.get_json_object("line", f"$[0].{name}").cast("bigint").alias(name)
    good = back.select(at("conv_id"), at("turn"), hash_text(F.col("content")).alias("content_hash"), F.lit(False).alias("rejected"), F.get_json_object("metadata", "$.model").alias("model"))
    return rel.union_all(_read(spark, path, good), rejects.select("conv_id", "turn", F.lit(True).alias("rejected")))


@register("completion_files", "SELECT conv_id, turn, md5(text) AS content_hash, role AS model FROM conversations")
def completion_files(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    rows = t.select(F.to_json(F.struct(F.col("role").alias("model"))).alias("q"), answer.alias("r"), F.to_json(F.struct("conv_id", "turn")).alias("m"))
    path = _place(spark, "completions")
    wr.write_completions(rows, path, "q", "r", "m")
    back = rd.read_completions(spark, path)
    at = lambda name: F.get_json_object("metadata", f"$.{name}").cast("bigint").alias(name)
    good = back.where(rd.has_content(F.col("line"))).select(at("conv_id"), at("turn"), hash_text(F.col("content")).alias("content_hash"), "model")
    return _read(spark, path, good)


@register("verdict_table", f"""WITH a AS (SELECT conv_id, role, turn, {_judge_sql('text').replace('doc_id', 'conv_id')} AS answer FROM conversations), {_verdict_sql('answer')}
    SELECT conv_id::VARCHAR AS doc_id, role AS dataset_name, 'turn' AS note_type, 'P1' AS prompt, turn AS index, 'precision' AS entailment_type, raw AS entailment_pred_raw, not_parseable, prediction AS entailment_pred FROM verdicts""")
def verdict_table(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    rows = c.select(compose("conv_id", "role", F.lit("turn"), F.lit("P1"), "turn", F.lit("precision")).alias("custom_id"), _judge(F.col("text")).alias("model_output"))
    return bd.verdict_table(rows).drop("custom_id", "model_output")


@register("combine_notes", f"""SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_hash, {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE AS est_token_count, lang AS note_type, source AS dataset_name FROM documents
    UNION ALL SELECT conv_id || '-' || turn, md5(text), {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE, role, 'chat' FROM conversations""")
def combine_notes(spark, sf_dir):
    """One source names its text note_text, the other TEXT, which then takes the place of what note_text holds."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("text").alias("note_text"), F.col("lang").alias("note_type"), F.col("source").alias("dataset_name"))
    c = table(spark, sf_dir, "conversations")
    c = c.select(compose("conv_id", "turn", sep="-").alias("doc_id"), F.lit("").alias("note_text"), F.col("text").alias("TEXT"), F.col("role").alias("note_type"), F.lit("chat").alias("dataset_name"))
    return bd.combine_notes([d, c]).select("doc_id", hash_text(F.col("note_text")).alias("text_hash"), "est_token_count", "note_type", "dataset_name")


@register("nli_prompt_records", """SELECT doc_id, 'snli|test|' || doc_id || '|P1' AS custom_id, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS label, 'user' AS role,
    md5('Premise: ' || text || ' Hypothesis: ' || lang) AS content_hash FROM documents JOIN labels USING (doc_id)""")
def nli_prompt_records(spark, sf_dir):
    d = rel.lookup(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id").where(F.col("text").isNotNull())
    prompt = fill_template("Premise: {premise} Hypothesis: {hypothesis}", premise=F.col("text"), hypothesis=F.col("lang"))
    label = pr.label_rule(F.lit("snli"), F.lit(None).cast("string"), F.col("toxic"), F.lit(None).cast("int"))
    rows = d.select("doc_id", compose(F.lit("snli"), F.lit("test"), "doc_id", F.lit("P1")).alias("custom_id"), label.alias("label"), F.explode(pr.chat_messages(prompt)).alias("m"))
    return rows.select("doc_id", "custom_id", "label", F.col("m.role").alias("role"), hash_text(F.col("m.content")).alias("content_hash"))


@register("streamed_answers", """SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN 'SAFETY_HAZARD' ELSE text END, '' ORDER BY turn)) AS response_hash,
    CASE WHEN bool_or(role = 'system') THEN 'blocked' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id""")
def streamed_answers(spark, sf_dir):
    """Turns stand for the chunks of an answer, and those of the system for chunks that were held back."""
    events = table(spark, sf_dir, "conversations").withColumn("held", F.col("role") == "system")
    return inf.join_chunks(events, "conv_id", "turn", "text", "held").select("conv_id", hash_text(F.col("response")).alias("response_hash"), "status")


@register("batch_jobs", """SELECT doc_id, '{"entailment_prediction": ' || (1 - length(text) % 2) || '}' AS response, 'ok' AS status FROM documents""")
def batch_jobs(spark, sf_dir):
    """Jobs are opened, listed in a table, waited for and read."""
    service, path = inf.stub_service(), _place(spark, "jobs")
    inf.submit_batches(table(spark, sf_dir, "documents"), service, path, "doc_id", "text", 200)
    got = inf.collect_batches(spark.read.parquet(path), service, "bigint")
    return _read(spark, path, got.select(F.col("key").alias("doc_id"), "response", "status"))


@register("template_files", """SELECT doc_id, t.lang AS template, md5('In ' || t.lang || ': ' || text || chr(10) || '{done}') AS prompt_hash
    FROM documents, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) t WHERE text IS NOT NULL""")
def template_files(spark, sf_dir):
    """A template file for each language of the documents, written and read back; every document under every template."""
    path, d = _place(spark, "templates"), table(spark, sf_dir, "documents")
    names = [r.lang for r in d.select("lang").where("lang IS NOT NULL").distinct().limit(rel.MOST_TEMPLATES + 1).collect()]
    wr.write_templates(spark, {n: f"In {n}: {{text}}\n{{{{done}}}}" for n in names}, path)
    templates = {r.name: r.template for r in rd.read_templates(spark, f"{path}/*.tmpl").collect()}
    wr.remove(spark, path)
    filled = pr.prompt_set(d.where(F.col("text").isNotNull()), templates, "text", ("doc_id",))
    return filled.select("doc_id", F.col("prompt_template_name").alias("template"), hash_text(F.col("prompt")).alias("prompt_hash"))


@register("warehouse_scan", "SELECT doc_id, lang, n_chars, md5(text) AS text_hash FROM documents WHERE n_chars >= 2000")
def warehouse_scan(spark, sf_dir):
    """The given files as a warehouse: splits whose longest text is shorter aren't read."""
    long = wh.read_table(spark, "documents", root=sf_dir).where(F.col("n_chars") >= 2000)
    return long.select("doc_id", "lang", "n_chars", hash_text(F.col("text")).alias("text_hash"))


@register("warehouse_insert", """SELECT conv_id, turn, md5(text) AS text_hash FROM conversations WHERE role = 'system' UNION ALL
    SELECT conv_id, turn, md5(text) FROM conversations WHERE role IS DISTINCT FROM 'system'""")
def warehouse_insert(spark, sf_dir):
    """Two jobs insert into a table, after an earlier state of it is replaced."""
    path, t = _place(spark, "warehouse"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    wh.insert(t, "turns", root=path)
    wh.insert(t.where(system), "turns", overwrite=True, root=path)
    wh.insert(t.where(~system), "turns", root=path)
    return _read(spark, path, wh.read_table(spark, "turns", root=path).select("conv_id", "turn", hash_text(F.col("text")).alias("text_hash")))


@register("capped_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def capped_rows(spark, sf_dir):
    """The cap is the feature: the first hundred rows in order."""
    return sm.cap_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@register("grid_of_runs", "SELECT lang AS language, kind, count(*) AS n FROM documents, (VALUES ('precision'), ('recall')) k(kind) WHERE lang IS NOT NULL GROUP BY ALL")
def grid_of_runs(spark, sf_dir):
    """A run for each language of the documents, whatever they are, and each kind."""
    d, path = table(spark, sf_dir, "documents"), _place(spark, "grid")
    languages = sorted(r.lang for r in d.select("lang").where("lang IS NOT NULL").distinct().collect())
    step = lambda config: d.where(F.col("lang") == config["language"]).agg(F.count("*").alias("n")).where("n > 0")
    return _read(spark, path, inf.run_grid(spark, {"language": languages, "kind": ["precision", "recall"]}, step, path).select("language", "kind", "n"))
