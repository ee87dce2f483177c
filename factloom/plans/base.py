"""Queries over the base operators, each with the SQL it must agree with.

Importing this module registers them. Where an operator needs model output, a deterministic judge's answer is built from the
documents, by the same rule on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import tokens as tk
from factloom.functions.ids import compose, hash_text, parse_custom_id
from factloom.functions.verdict import with_verdict
from factloom.nlp.sentences import annotate
from factloom.operators import annotate as an
from factloom.operators import builders as bd
from factloom.operators import inference as inf
from factloom.operators import metrics as mt
from factloom.operators import pairs as pr
from factloom.operators import relational as rel
from factloom.operators import sampling as sm
from factloom.operators.bloom import bloom_filter, filter_bits, may_be_in
from factloom.operators.numbering import number_rows
from factloom.operators.packing import dynamic_batches as dynamic_batches_of
from factloom.plans.catalog import register, table
from factloom.sources.readers import path_metadata
from factloom.streaming.resume import completions, resume

_WS = r"[ \t\n\r\f]"
_STRIP = rf"regexp_replace({{}}, '^{_WS}+|{_WS}+$', '', 'g')"
_WORDS = rf"len(list_filter(regexp_split_to_array({{}}, '{_WS}+'), lambda w: w <> ''))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- the stand-in judge: lines of a document are facts, and an answer is one of eight by (doc_id + length + index) % 8

_ANSWERS = (
    '{"entailment_prediction": 0}', 'Sure: ```{"entailment_prediction": 1}```', "Answer: 1", "not entailment",
    "neutral", '{"entailment_prediction": "1"}', "maybe", "Yes.",
)


def _judge(h, extra=None):
    k = (F.col("doc_id") + F.length(h) + (extra if extra is not None else F.lit(0))) % 8
    answer = F.lit(None).cast("string")
    for i, a in reversed(list(enumerate(_ANSWERS))):
        answer = F.when(k == i, a).otherwise(answer)
    return answer


def _judge_sql(h: str, extra: str = "0") -> str:
    whens = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANSWERS))
    return f"CASE (doc_id + length({h}) + {extra}) % 8 {whens} END"


_LINES_SQL = f"""
    lines AS (
        SELECT doc_id, lang, source, (i - 1)::INTEGER AS idx, {_STRIP.format('parts[i]')} AS hypothesis
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) d,
             LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
    )"""


def _lines(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("idx", "h"))
    return d.select("doc_id", "lang", "source", "idx", tx.strip(F.col("h")).alias("hypothesis"))


def _verdict_sql(m: str) -> str:
    """raw, not_parseable, prediction from an answer column of a CTE `a`."""
    return f"""
    j AS (
        SELECT *, CASE WHEN json_valid({m}) THEN {m}
                       WHEN json_valid(nullif(regexp_extract({m}, '(?s)(\\{{.*\\}})', 1), '')) THEN regexp_extract({m}, '(?s)(\\{{.*\\}})', 1) END AS js
        FROM a
    ), k AS (
        SELECT *, coalesce(json_exists(js, '$.entailment_prediction'), false) AS present,
               json_type(js, '$.entailment_prediction') AS kind, json_extract_string(js, '$.entailment_prediction') AS val,
               CASE WHEN regexp_matches({m}, '[0-9]$') THEN right({m}, 1)::INTEGER
                    WHEN lower({m}) LIKE '%entailment%' THEN 1 WHEN lower({m}) LIKE '%neutral%' THEN 0
                    WHEN lower({m}) LIKE '%yes%' THEN 1 WHEN lower({m}) LIKE '%no%' THEN 0 END AS said
        FROM j
    ), v AS (
        SELECT *, CASE WHEN present THEN val ELSE said::VARCHAR END AS raw,
               CASE WHEN present THEN CASE kind WHEN 'BOOLEAN' THEN CASE val WHEN 'true' THEN 1.0 ELSE 0.0 END
                                      WHEN 'VARCHAR' THEN NULL ELSE TRY_CAST(val AS DOUBLE) END
                    ELSE said::DOUBLE END AS num
        FROM k
    ), verdicts AS (
        SELECT * EXCLUDE (num), NOT coalesce(num IN (0, 1), false) AS not_parseable, CASE WHEN num IN (0, 1) THEN num::INTEGER ELSE 0 END AS prediction
        FROM v
    )"""


def _judged_lines(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("answer", _judge(F.col("hypothesis"), F.col("idx")))
    return with_verdict(rows, "answer")


_JUDGED_SQL = f"""WITH {_LINES_SQL}, a AS (SELECT *, {_judge_sql('hypothesis', 'idx')} AS answer FROM lines), {_verdict_sql('answer')}"""


@register("fact_precision_by_group", f"""{_JUDGED_SQL}, per AS (
    SELECT doc_id, lang, source, avg(prediction) AS p FROM verdicts GROUP BY ALL)
    SELECT lang, source, count(*) AS n_docs, round(avg(p), 6) AS fact_precision FROM per GROUP BY ALL""")
def fact_precision_by_group(spark, sf_dir):
    per = _judged_lines(spark, sf_dir).groupBy("doc_id", "lang", "source").agg(mt.proportion(F.col("prediction")).alias("p"))
    return per.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.round(F.avg("p"), 6).alias("fact_precision"))


@register("parse_verdicts", f"{_JUDGED_SQL} SELECT doc_id, idx, answer, raw, not_parseable, prediction FROM verdicts")
def parse_verdicts(spark, sf_dir):
    return _judged_lines(spark, sf_dir).select("doc_id", "idx", "answer", "raw", "not_parseable", "prediction")


@register("hash_ids", """SELECT doc_id, md5(text) AS text_hash, doc_id || '|' || lang || '|' || source AS uid,
    md5(text) || '|' || source || '|' || (doc_id || '|' || lang) AS decomp_uid FROM documents""")
def hash_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", hash_text(F.col("text")).alias("text_hash"), compose("doc_id", "lang", "source").alias("uid"), compose(hash_text(F.col("text")), "source", compose("doc_id", "lang")).alias("decomp_uid"))


@register("dedup_keep_first", """SELECT doc_id, lang, source, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    narrow = _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", hash_text(F.col("text")).alias("h"))
    return rel.keep_first(narrow, ["h"], [F.col("doc_id")]).drop("h")


@register("dedup_keep_last", """SELECT conv_id, role, turn, md5(text) AS text_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text_hash", hash_text(F.col("text"))).drop("text")
    return rel.keep_last(rows, ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", "text_hash")


@register("token_band_filter", f"""SELECT doc_id, est_token_count FROM (
    SELECT doc_id, {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE AS est_token_count FROM documents)
    WHERE est_token_count > 64 AND est_token_count < 3840""")
def token_band_filter(spark, sf_dir):
    return sm.token_band(_docs(spark, sf_dir), "text", 64, 3840).select("doc_id", "est_token_count")


@register("stratified_sample", """SELECT doc_id, lang, source FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('123456|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5""")
def stratified_sample(spark, sf_dir):
    return sm.stratified_sample(_docs(spark, sf_dir).select("doc_id", "lang", "source"), ["lang", "source"], 5)


@register("global_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 120""")
def global_sample(spark, sf_dir):
    return sm.global_sample(_docs(spark, sf_dir).select("doc_id"), 120)


@register("sample_fraction", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('12345|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(0.25 * n)""")
def sample_fraction(spark, sf_dir):
    return sm.global_sample(_docs(spark, sf_dir).select("doc_id"), fraction=0.25, seed=12345)


@register("sample_with_replacement", """WITH r AS (
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents
    ), d AS (SELECT lang, any_value(n) AS n, unnest(range(50)) AS draw FROM r GROUP BY lang)
    SELECT d.draw::INTEGER AS draw, d.lang, doc_id FROM d JOIN r ON r.lang = d.lang AND r.place = ('0x' || substr(md5('7|' || draw || '|' || d.lang), 1, 8))::BIGINT % d.n""")
def sample_with_replacement(spark, sf_dir):
    return sm.sample_with_replacement(_docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], 50).select("draw", "lang", "doc_id")


@register("strata_disjoint_guard", """SELECT doc_id, CASE WHEN lang = 'de' THEN 'german' WHEN n_chars < 200 AND lang <> 'de' THEN 'short' END AS stratum
    FROM documents WHERE lang = 'de' OR (n_chars < 200 AND lang <> 'de')""")
def strata_disjoint_guard(spark, sf_dir):
    strata = [("german", F.col("lang") == "de"), ("first", F.col("lang").isin("de", "fr")), ("short", (F.col("n_chars") < 200) & (F.col("lang") != "de"))]
    return sm.disjoint_strata(_docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), strata).select("doc_id", "stratum")


_TEMPLATES = {"PROMPT1": "List the facts of this note.\n\n{text}\n\nFacts:", "PROMPT2": "Note: {text}\nWrite {{one}} fact per line.", "PROMPT2_ICL": "Like the examples, decompose:\n{text}"}


@register("prompt_cross_templates", f"""SELECT d.doc_id || '|' || lang || '|' || source || '|' || name AS uid, d.doc_id, name AS prompt_template_name,
    md5(body) AS prompt_hash, {_WORDS.format('body')} * 4.0::DOUBLE / 3.0::DOUBLE AS n_prompt_tokens, 4096 AS max_tokens FROM (
        SELECT *, CASE name WHEN 'PROMPT1' THEN 'List the facts of this note.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Facts:'
            WHEN 'PROMPT2' THEN 'Note: ' || text || chr(10) || 'Write {{one}} fact per line.' ELSE 'Like the examples, decompose:' || chr(10) || text END AS body
        FROM documents, (VALUES ('PROMPT1'), ('PROMPT2'), ('PROMPT2_ICL')) t(name)) d""")
def prompt_cross_templates(spark, sf_dir):
    out = pr.prompt_set(_docs(spark, sf_dir), _TEMPLATES, "text", ("doc_id", "lang", "source"), tx.token_estimate)
    return out.select("uid", "doc_id", "prompt_template_name", hash_text(F.col("prompt")).alias("prompt_hash"), "n_prompt_tokens", "max_tokens")


@register("facts_split_delim", f"""SELECT doc_id, len(f) AS n_facts, md5(array_to_string(f, '##')) AS facts_hash FROM (
    SELECT doc_id, list_transform(string_split(replace(text, chr(10), '//'), '//'), lambda x: replace({_STRIP.format('x')}, chr(10), ' ')) AS f FROM documents)""")
def facts_split_delim(spark, sf_dir):
    facts = tx.split_delimited(F.replace(F.col("text"), F.lit("\n"), F.lit("//")))
    return _docs(spark, sf_dir).select("doc_id", facts.alias("f")).select("doc_id", F.size("f").cast("bigint").alias("n_facts"), hash_text(F.array_join("f", "##")).alias("facts_hash"))


@register("facts_split_list", f"""SELECT doc_id, len(f) AS n_facts, md5(array_to_string(f, '##')) AS facts_hash FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '' AND x <> ':') AS f FROM documents)""")
def facts_split_list(spark, sf_dir):
    """Each line is marked `N.`, under a header; the facts are the lines again."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda s: s != "")
    marked = F.concat(F.lit("## The Facts:\n"), F.array_join(F.transform(lines, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"))
    return _docs(spark, sf_dir).select("doc_id", tx.split_facts(marked).alias("f")).select("doc_id", F.size("f").cast("bigint").alias("n_facts"), hash_text(F.array_join("f", "##")).alias("facts_hash"))


@register("facts_split_plain", f"""SELECT doc_id, len(f) AS n_facts, md5(array_to_string(f, '##')) AS facts_hash FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || '* '), '\\n\\s*(?:\\d+\\.|\\*)\\s*'), lambda x: {_STRIP.format('x')}), lambda x: x <> '' AND x <> ':') AS f FROM documents)""")
def facts_split_plain(spark, sf_dir):
    f = tx.split_facts_plain(F.replace(F.col("text"), F.lit("\n"), F.lit("\n* ")))
    return _docs(spark, sf_dir).select("doc_id", f.alias("f")).select("doc_id", F.size("f").cast("bigint").alias("n_facts"), hash_text(F.array_join("f", "##")).alias("facts_hash"))


def _decompositions(spark, sf_dir, *more) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select(compose("doc_id", "lang", "source", F.lit("PROMPT1")).alias("uid"), "doc_id", "lang", "source", *more, F.split(F.replace(F.col("text"), F.lit(". "), F.lit("//")), "//", -1).alias("facts"), F.split("text", "\n").alias("sentences"))


_UID_SQL = "doc_id || '|' || lang || '|' || source || '|PROMPT1'"


def _pairs_sql(kind: str) -> str:
    parts = "string_split(replace(text, '. ', '//'), '//')" if kind == "precision" else "string_split(text, chr(10))"
    return f"""SELECT uid || '|' || (i - 1) || '|{kind}' AS custom_id, doc_id, lang, source, (i - 1)::INTEGER AS index, '{kind}' AS entailment_type,
        replace({_STRIP.format('parts[i]')}, chr(10), ' ') AS hypothesis
        FROM (SELECT {_UID_SQL} AS uid, doc_id, lang, source, {parts} AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u"""


_PAIR_COLUMNS = ("custom_id", "doc_id", "lang", "source", "index", "entailment_type", "hypothesis")


@register("precision_pairs", _pairs_sql("precision"))
def precision_pairs(spark, sf_dir):
    return pr.precision_pairs(_decompositions(spark, sf_dir), facts=F.col("facts"), carry=["doc_id", "lang", "source"]).select(*_PAIR_COLUMNS)


@register("recall_pairs_lines", _pairs_sql("recall"))
def recall_pairs_lines(spark, sf_dir):
    return pr.recall_pairs(_decompositions(spark, sf_dir), F.col("sentences"), carry=["doc_id", "lang", "source"]).select(*_PAIR_COLUMNS)


def _all_pairs(spark, sf_dir) -> DataFrame:
    return pr.all_pairs(_decompositions(spark, sf_dir), F.col("facts"), F.col("sentences"), carry=["doc_id", "lang", "source"]).select(*_PAIR_COLUMNS)


_ALL_PAIRS_SQL = f"{_pairs_sql('precision')} UNION ALL {_pairs_sql('recall')}"


@register("all_pairs", _ALL_PAIRS_SQL)
def all_pairs(spark, sf_dir):
    return _all_pairs(spark, sf_dir)


@register("pairs_with_premises", f"""SELECT p.custom_id, md5('Premise: ' || CASE p.entailment_type WHEN 'precision' THEN d.text ELSE replace(d.text, '. ', '//') END
    || chr(10) || 'Hypothesis: ' || p.hypothesis) AS prompt_hash FROM ({_ALL_PAIRS_SQL}) p JOIN documents d USING (doc_id)""")
def pairs_with_premises(spark, sf_dir):
    d = _decompositions(spark, sf_dir, F.col("text").alias("note_text"), F.replace(F.col("text"), F.lit(". "), F.lit("//")).alias("fact_decomp"))
    told = pr.filled_pairs(d, F.col("facts"), F.col("sentences"), "Premise: {premise}\nHypothesis: {hypothesis}")
    return told.select("custom_id", hash_text(F.col("prompt")).alias("prompt_hash"))


@register("precision_hypotheses", f"SELECT DISTINCT lang, source, hypothesis FROM ({_pairs_sql('precision')})")
def precision_hypotheses(spark, sf_dir):
    return pr.hypotheses(_all_pairs(spark, sf_dir), "precision", ["lang", "source"])


@register("recall_hypotheses", f"SELECT DISTINCT lang, hypothesis FROM ({_pairs_sql('recall')})")
def recall_hypotheses(spark, sf_dir):
    return pr.hypotheses(_all_pairs(spark, sf_dir), "recall", ["lang"])


_IDS = {0: "doc_id || '|' || lang || '|' || source || '|PROMPT1|' || n_chars || '|recall'", 1: "lang || '|' || source || '|' || doc_id || '|PROMPT2'", 2: "lang || '|' || source || '|x|PROMPT2'", 3: "'a|b|c|d|e'", 4: "NULL"}


@register("parse_custom_ids", f"""WITH c AS (SELECT doc_id AS row_id, CASE doc_id % 5 {' '.join(f"WHEN {k} THEN {v}" for k, v in _IDS.items())} END AS custom_id FROM documents),
    p AS (SELECT *, string_split(custom_id, '|') AS p FROM c), q AS (SELECT *, len(p) = 4 AND TRY_CAST(p[3] AS BIGINT) IS NOT NULL AS four, len(p) = 6 AND TRY_CAST(p[5] AS BIGINT) IS NOT NULL AS six FROM p)
    SELECT row_id, CASE WHEN four THEN p[1] END AS dataset, CASE WHEN four THEN p[2] END AS split, CASE WHEN four THEN TRY_CAST(p[3] AS BIGINT) END AS uid,
        CASE WHEN six THEN p[1] END AS doc_id, CASE WHEN six THEN p[2] END AS dataset_name, CASE WHEN six THEN p[3] END AS note_type,
        CASE WHEN four OR six THEN p[4] END AS prompt, CASE WHEN six THEN TRY_CAST(p[5] AS BIGINT) END AS index, CASE WHEN six THEN p[6] END AS entailment_type FROM q""")
def parse_custom_ids(spark, sf_dir):
    made = F.when(F.col("doc_id") % 5 == 0, compose("doc_id", "lang", "source", F.lit("PROMPT1"), "n_chars", F.lit("recall"))).when(F.col("doc_id") % 5 == 1, compose("lang", "source", "doc_id", F.lit("PROMPT2")))
    made = made.when(F.col("doc_id") % 5 == 2, compose("lang", "source", F.lit("x"), F.lit("PROMPT2"))).when(F.col("doc_id") % 5 == 3, "a|b|c|d|e")
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), made.alias("custom_id"))
    return rows.select("row_id", *[c.alias(n) for n, c in parse_custom_id(F.col("custom_id")).items()])


@register("decomp_merge", """SELECT md5(text) || '|' || role || '|' || (conv_id || '|' || turn) AS uid, md5(text) AS decomp_id, role AS model, conv_id || '|' || turn AS note_uid, text AS fact_decomp
    FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""")
def decomp_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "assistant", F.col("text")).alias("content"), F.col("role").alias("model"), compose("conv_id", "turn").alias("note_uid"))
    return pr.merge_decompositions(c)


@register("nli_labels", """SELECT doc_id, dataset, CASE WHEN dataset IN ('mednli', 'scitail') THEN (gold = 'entailment')::INTEGER WHEN dataset IN ('snli', 'multinli') THEN (code = 0)::INTEGER WHEN dataset = 'factsdev' THEN code END AS label FROM (
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'mednli' WHEN 1 THEN 'scitail' WHEN 2 THEN 'snli' WHEN 3 THEN 'multinli' WHEN 4 THEN 'factsdev' ELSE 'other' END AS dataset,
           CASE quality WHEN 1 THEN 'entailment' ELSE 'neutral' END AS gold, toxic AS code FROM labels)""")
def nli_labels(spark, sf_dir):
    names = ("mednli", "scitail", "snli", "multinli", "factsdev")
    dataset = F.lit("other")
    for i, n in enumerate(names):
        dataset = F.when(F.col("doc_id") % 6 == i, n).otherwise(dataset)
    rows = table(spark, sf_dir, "labels").select("doc_id", dataset.alias("dataset"), F.when(F.col("quality") == 1, "entailment").otherwise("neutral").alias("gold"), F.col("toxic").alias("code"))
    return rows.select("doc_id", "dataset", pr.label_rule(F.col("dataset"), F.col("gold"), F.col("code"), F.col("code")).alias("label"))


def _labelled(spark, sf_dir) -> DataFrame:
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("answer", _judge(F.col("text")))
    split = F.when(F.col("lang") != "de", F.concat(F.lit("part"), (F.col("doc_id") % 2).cast("string")))
    rows = rows.select("doc_id", "lang", "source", "quality", "toxic", split.alias("split"), "answer")
    return with_verdict(rows, "answer").drop("answer")


_LABELLED_SQL = f"""WITH a AS (SELECT d.doc_id, lang, source, quality, toxic, CASE WHEN lang <> 'de' THEN 'part' || (d.doc_id % 2) END AS split,
    {_judge_sql('text').replace('doc_id', 'd.doc_id')} AS answer FROM documents d JOIN labels l ON l.doc_id = d.doc_id), {_verdict_sql('answer')}"""


def _metrics_sql(keys: str) -> str:
    drop = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"""{_LABELLED_SQL}, s AS (SELECT {keys}, count(*) AS n, avg(not_parseable::INTEGER) AS np,
        count(*) FILTER (quality = 1 AND prediction = 1) AS tp, count(*) FILTER (quality = 0 AND prediction = 1) AS fp,
        count(*) FILTER (quality = 1 AND prediction = 0) AS fn, count(*) FILTER (quality = 0 AND prediction = 0) AS tn FROM verdicts WHERE {drop} GROUP BY {keys})
        SELECT {keys}, n, round(np, 9) AS not_parseable, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 9) AS accuracy,
            round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
            round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score FROM s"""


@register("classification_metrics_by_group", _metrics_sql("lang, source, split"))
def classification_metrics_by_group(spark, sf_dir):
    return mt.classification_by_group(_labelled(spark, sf_dir), ["lang", "source", "split"], "quality", "prediction", "not_parseable")


@register("classification_metrics_by_model_prompt", _metrics_sql("lang, source"))
def classification_metrics_by_model_prompt(spark, sf_dir):
    return mt.classification_by_group(_labelled(spark, sf_dir), ["lang", "source"], "quality", "prediction", "not_parseable")


@register("confusion_metrics", """WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
    count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
    SELECT tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 9) AS specificity, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS ppv,
        round(tn::DOUBLE / nullif(tn + fn, 0), 9) AS npv, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 9) AS accuracy FROM s""")
def confusion_metrics(spark, sf_dir):
    return mt.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("weighted_proportion", """SELECT l_returnflag, l_linestatus, round(sum(w * p)::DOUBLE / sum(w), 9) AS proportion, round(avg(p), 9) AS unweighted FROM (
    SELECT *, l_quantity::BIGINT AS w, (l_discount > 0.05)::INTEGER AS p FROM lineitem) GROUP BY ALL""")
def weighted_proportion(spark, sf_dir):
    p = (F.col("l_discount") > 0.05).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", p.alias("p"), F.col("l_quantity").cast("bigint").alias("w"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(mt.proportion(F.col("p"), F.col("w")), 9).alias("proportion"), F.round(mt.proportion(F.col("p")), 9).alias("unweighted"))


def _judged_pairs(spark, sf_dir, to: int | None = None) -> DataFrame:
    rows = _all_pairs(spark, sf_dir).withColumn("answer", _judge(F.col("hypothesis"), F.col("index")))
    rows = with_verdict(rows.select("doc_id", "lang", "source", "entailment_type", "answer"), "answer")
    pred = F.col("prediction")
    if to is not None:
        from factloom.functions.verdict import map_unparseable

        pred = map_unparseable(pred, F.col("not_parseable"), to)
    return rows.select("doc_id", "lang", "source", "entailment_type", pred.alias("entailment_pred"))


def _judged_pairs_sql(to: str | None = None) -> str:
    pred = "prediction" if to is None else f"CASE WHEN not_parseable THEN {to} ELSE prediction END"
    return f"""WITH a AS (SELECT *, {_judge_sql('hypothesis', 'index')} AS answer FROM ({_ALL_PAIRS_SQL})), {_verdict_sql('answer')},
        judged AS (SELECT doc_id, lang, source, entailment_type, {pred} AS entailment_pred FROM verdicts)"""


def _prf_sql(head: str, keys: str) -> str:
    return f"""{head}, s AS (SELECT {keys}, count(*) FILTER (entailment_type = 'precision') AS np, count(*) FILTER (entailment_type = 'precision' AND entailment_pred = 0) AS fp,
            sum(entailment_pred) FILTER (entailment_type = 'precision') AS p1, count(*) FILTER (entailment_type = 'recall') AS nr,
            count(*) FILTER (entailment_type = 'recall' AND entailment_pred = 0) AS fn, sum(entailment_pred) FILTER (entailment_type = 'recall') AS r1
        FROM judged WHERE entailment_pred IS NOT NULL GROUP BY {keys}), t AS (SELECT *, p1::DOUBLE / nullif(np, 0) AS p, r1::DOUBLE / nullif(nr, 0) AS r FROM s),
        scores AS (SELECT {keys}, round(p, 9) AS fact_precision, CASE WHEN np > 0 THEN fp END AS fact_fp, CASE WHEN np > 0 THEN np END AS n_facts,
        round(r, 9) AS fact_recall, CASE WHEN nr > 0 THEN fn END AS fact_fn, CASE WHEN nr > 0 THEN nr END AS n_sents,
        round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / nullif(p + r, 0) END, 9) AS fact_f1 FROM t)"""


def _scores(spark, sf_dir) -> DataFrame:
    return mt.document_scores(_judged_pairs(spark, sf_dir), ["doc_id", "lang", "source"])


_SCORES_SQL = _prf_sql(_judged_pairs_sql(), "doc_id, lang, source")


@register("doc_prf", f"{_SCORES_SQL} SELECT * FROM scores")
def doc_prf(spark, sf_dir):
    return _scores(spark, sf_dir)


@register("doc_prf_skip_unparseable", f"{_prf_sql(_judged_pairs_sql('NULL'), 'doc_id')} SELECT * FROM scores")
def doc_prf_skip_unparseable(spark, sf_dir):
    return mt.document_scores(_judged_pairs(spark, sf_dir, -1), ["doc_id"])


@register("doc_prf_map_unparseable", f"{_prf_sql(_judged_pairs_sql('1'), 'doc_id')} SELECT * FROM scores")
def doc_prf_map_unparseable(spark, sf_dir):
    return mt.document_scores(_judged_pairs(spark, sf_dir, 1), ["doc_id"])


_STATS = {"fact_precision": "fact_p", "fact_recall": "fact_r", "fact_f1": "fact_f1", "n_facts": "n_facts", "n_sents": "n_sents"}
_STATS_SQL = ", ".join(f"round(avg({c}), 6) AS {s}_mean, round(var_samp({c}), 6) AS {s}_var, round(min({c})::DOUBLE, 6) AS {s}_min, round(max({c})::DOUBLE, 6) AS {s}_max" for c, s in _STATS.items())


@register("metric_rollup_stats", f"{_SCORES_SQL} SELECT source, {_STATS_SQL} FROM scores WHERE fact_f1 IS NOT NULL GROUP BY source")
def metric_rollup_stats(spark, sf_dir):
    return mt.rollup_stats(_scores(spark, sf_dir).na.drop(subset=["fact_f1"]), "source", _STATS).orderBy(F.desc("fact_f1_mean"))


@register("min_max_facts", f"{_SCORES_SQL} SELECT lang, source, min(n_facts) AS min_facts, max(n_facts) AS max_facts FROM scores GROUP BY ALL")
def min_max_facts(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("lang", "source").agg(F.min("n_facts").alias("min_facts"), F.max("n_facts").alias("max_facts"))


@register("weighted_metric_mean", f"""{_SCORES_SQL} SELECT lang, round(sum(n_facts * fact_precision) / sum(n_facts), 9) AS fact_precision, round(sum(n_facts * fact_f1) / sum(n_facts), 9) AS fact_f1,
    sum(n_facts)::BIGINT AS n_facts FROM scores WHERE fact_f1 IS NOT NULL GROUP BY lang""")
def weighted_metric_mean(spark, sf_dir):
    return mt.weighted_means(_scores(spark, sf_dir).na.drop(subset=["fact_f1"]), ["lang"], "n_facts", ["fact_precision", "fact_f1"])


@register("macro_entailment", f"""{_judged_pairs_sql()}, m AS (SELECT doc_id, lang, source, entailment_type, avg(entailment_pred) AS m, count(*) AS n FROM judged GROUP BY ALL)
    SELECT lang, entailment_type, round(avg(m), 9) AS value, sum(n)::BIGINT AS n FROM m GROUP BY ALL""")
def macro_entailment(spark, sf_dir):
    return mt.macro_mean(_judged_pairs(spark, sf_dir), ["doc_id", "lang", "source", "entailment_type"], ["lang", "entailment_type"], "entailment_pred")


@register("pivot_entailment", f"""{_judged_pairs_sql()}, m AS (SELECT doc_id, lang, entailment_type, avg(entailment_pred) AS m, count(*) AS n FROM judged GROUP BY ALL), g AS (
    SELECT lang, entailment_type, round(avg(m), 9) AS value, sum(n)::BIGINT AS n FROM m GROUP BY ALL)
    SELECT lang, max(value) FILTER (entailment_type = 'precision') AS value_precision, max(value) FILTER (entailment_type = 'recall') AS value_recall,
        max(n) FILTER (entailment_type = 'precision') AS n_precision, max(n) FILTER (entailment_type = 'recall') AS n_recall FROM g GROUP BY lang""")
def pivot_entailment(spark, sf_dir):
    m = mt.macro_mean(_judged_pairs(spark, sf_dir), ["doc_id", "lang", "entailment_type"], ["lang", "entailment_type"], "entailment_pred")
    return rel.wide_form(m, ["lang"], "entailment_type", ["precision", "recall"], ["value", "n"])


@register("unpivot_metrics", f"""{_SCORES_SQL}, u AS (SELECT doc_id, fact_precision, fact_recall, fact_f1 FROM scores)
    SELECT doc_id, unnest(['fact_precision', 'fact_recall', 'fact_f1']) AS variable, unnest([fact_precision, fact_recall, fact_f1]) AS value FROM u""")
def unpivot_metrics(spark, sf_dir):
    return rel.long_form(_scores(spark, sf_dir), ["doc_id"], ["fact_precision", "fact_recall", "fact_f1"])


@register("majority_label", """WITH r AS (SELECT conv_id, turn AS ord, length(text) % 2 AS label FROM conversations), c AS (SELECT conv_id, label, count(*) AS n, min(ord) AS seen FROM r GROUP BY ALL)
    SELECT conv_id, label::INTEGER AS label FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen, label) AS rn FROM c) WHERE rn = 1""")
def majority_label(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), (F.length("text") % 2).alias("label"))
    return rel.majority(rows, "conv_id", "label", "ord")


@register("fleiss_kappa", """WITH r AS (SELECT doc_id, unnest([0, 1, 2]) AS rater, unnest([(n_chars % 3 = 0)::INTEGER, (n_chars % 3 = 0 OR doc_id % 5 = 0)::INTEGER, CASE WHEN lang <> 'de' THEN (length(text) % 2)::INTEGER END]) AS label FROM documents),
    u AS (SELECT doc_id, count(*) AS m, count(*) FILTER (label = 1) AS k1, count(*) FILTER (label = 0) AS k0 FROM r WHERE label IS NOT NULL GROUP BY doc_id HAVING count(*) = 3),
    s AS (SELECT count(*) AS n_units, avg((k1 * (k1 - 1) + k0 * (k0 - 1)) / 6.0) AS p, sum(k1) / (count(*) * 3.0) AS p1, sum(k0) / (count(*) * 3.0) AS p0 FROM u)
    SELECT n_units, round((p - (p1 * p1 + p0 * p0)) / (1 - (p1 * p1 + p0 * p0)), 9) AS kappa FROM s""")
def fleiss_kappa(spark, sf_dir):
    a, b = (F.col("n_chars") % 3 == 0).cast("int"), ((F.col("n_chars") % 3 == 0) | (F.col("doc_id") % 5 == 0)).cast("int")
    c = F.when(F.col("lang") != "de", (F.length("text") % 2).cast("int"))
    long = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.array(a, b, c)).alias("rater", "label"))
    return mt.fleiss_kappa(long, "doc_id", "rater", "label", 3)


@register("missing_pairs", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'b' ELSE 'a' END AS side
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def missing_pairs(spark, sf_dir):
    return rel.missing_ids(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@register("missing_rate", """WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels)
    SELECT count(*) FILTER (d.doc_id IS NULL OR l.doc_id IS NULL) AS n_missing, count(*) AS n_ids, round(count(*) FILTER (d.doc_id IS NULL OR l.doc_id IS NULL)::DOUBLE / nullif(count(*), 0), 9) AS rate FROM d FULL JOIN l ON d.doc_id = l.doc_id""")
def missing_rate(spark, sf_dir):
    a, b = (x.select("doc_id").distinct() for x in (_docs(spark, sf_dir), table(spark, sf_dir, "labels")))
    n = rel.missing_ids(a, b, "doc_id").agg(F.count("*").alias("n_missing"))
    ids = a.union(b).distinct().agg(F.count("*")).scalar()
    return n.select("n_missing", ids.alias("n_ids")).select("n_missing", "n_ids", F.round(F.try_divide(F.col("n_missing").cast("double"), F.col("n_ids")), 9).alias("rate"))


@register("hash_semi_join", "SELECT doc_id, lang FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src2')")
def hash_semi_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return rel.semi_join_by_hash(d, "text", d.where("source = 'src2'").select(hash_text(F.col("text")).alias("h")), "h").select("doc_id", "lang")


@register("bloom_semi_join", "SELECT doc_id, lang FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src2')")
def bloom_semi_join(spark, sf_dir):
    """hash_semi_join as it runs beyond the bound of a broadcast."""
    d = _docs(spark, sf_dir).withColumn("h", hash_text(F.col("text")))
    keys = d.where("source = 'src2'").select(F.col("h").alias("key")).distinct()
    bits = filter_bits(keys.count())
    passed = d.where(may_be_in(F.col("h"), bloom_filter(keys, "key", bits), bits))
    return passed.join(keys, F.col("h") == F.col("key"), "left_semi").select("doc_id", "lang")


@register("resumed_stream", f"SELECT doc_id, {_judge_sql('text')} AS response FROM documents WHERE doc_id IS NOT NULL")
def resumed_stream(spark, sf_dir):
    """All documents as a stream of prompts, completed in two runs, of which the second one finds nothing left to do."""
    from factloom.operators.numbering import shared_folder

    d, folder = _docs(spark, sf_dir), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = "doc_id bigint, response string"
    for run in ("first", "second"):
        prompts = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
        resume(prompts, lambda rows: rows.select("doc_id", _judge(F.col("text")).alias("response")), f"{folder}/done", f"{folder}/{run}", schema, "doc_id").awaitTermination()
    return completions(spark, f"{folder}/done", schema)


@register("resume_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return rel.not_done(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@register("lookup_join", """SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def lookup_join(spark, sf_dir):
    return rel.lookup(table(spark, sf_dir, "labels").select("doc_id", "quality"), _docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "doc_id")


@register("natural_left_join_nullsafe", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, n_chars FROM documents), b AS (
    SELECT lang, count(*) AS n_lang FROM (SELECT CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents WHERE source <> 'src1') GROUP BY lang)
    SELECT a.doc_id, a.lang, a.n_chars, b.n_lang FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang""")
def natural_left_join_nullsafe(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")
    d = _docs(spark, sf_dir)
    b = d.where("source <> 'src1'").select(lang).groupBy("lang").agg(F.count("*").alias("n_lang"))
    return rel.natural_left_join(d.select("doc_id", lang, "n_chars"), b)


@register("annotation_join_chain", """WITH p AS (SELECT doc_id, md5(text) AS hyp FROM documents WHERE lang <> 'de'), r AS (SELECT doc_id, md5(lang || '|' || text) AS hyp FROM documents)
    SELECT DISTINCT l.doc_id, coalesce(p.hyp, r.hyp) AS hypothesis, d.source FROM labels l LEFT JOIN p ON p.doc_id = l.doc_id LEFT JOIN r ON r.doc_id = l.doc_id LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def annotation_join_chain(spark, sf_dir):
    """Two hypothesis tables, of which the first has gaps, and the notes; hypotheses are told as hashes of whole texts."""
    d = _docs(spark, sf_dir)
    p = d.where("lang <> 'de'").select(F.col("doc_id").alias("id"), hash_text(F.col("text")).alias("hyp_p"))
    r = d.select(F.col("doc_id").alias("id"), hash_text(compose("lang", "text")).alias("hyp_r"))
    out = table(spark, sf_dir, "labels").select("doc_id")
    for other in (p, r, d.select(F.col("doc_id").alias("id"), "source")):
        out = rel.natural_join_renamed(out, other, {"doc_id": "id"})
    return out.select("doc_id", F.coalesce("hyp_p", "hyp_r").alias("hypothesis"), "source").distinct()


@register("exclude_filter", "SELECT doc_id, lang, source FROM documents WHERE NOT (coalesce(lang IN ('de', 'fr'), false) OR coalesce(source = 'src1', false))")
def exclude_filter(spark, sf_dir):
    return rel.exclude(_docs(spark, sf_dir).select("doc_id", "lang", "source"), {"lang": ["de", "fr"], "source": ["src1"]})


@register("any_of_filter", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de') OR source IN ('src1', 'src2')")
def any_of_filter(spark, sf_dir):
    return rel.any_of(_docs(spark, sf_dir).select("doc_id", "lang", "source"), {"lang": ["de"], "source": ["src1", "src2"]})


@register("case_insensitive_filter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under')")
def case_insensitive_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").rlike("(?i)licensed under")).select("doc_id")


@register("group_size_filter", "SELECT doc_id, md5(text) AS h FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def group_size_filter(spark, sf_dir):
    return rel.in_groups_larger_than(_docs(spark, sf_dir).select("doc_id", hash_text(F.col("text")).alias("h")), ["h"], 1).select("doc_id", "h")


@register("set_difference", "SELECT lang, source FROM documents EXCEPT SELECT lang, source FROM documents WHERE n_chars < 1000")
def set_difference(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return rel.without(d.select("lang", "source"), d.where("n_chars < 1000").select("lang", "source"))


@register("set_intersection", "SELECT doc_id FROM documents WHERE n_chars > 500 INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, sf_dir):
    return rel.shared(_docs(spark, sf_dir).where("n_chars > 500").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@register("union_by_name", "SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def union_by_name(spark, sf_dir):
    return rel.union_all(_docs(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels").select("quality", "doc_id"))


@register("row_numbers", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents")
def row_numbers(spark, sf_dir):
    return number_rows(_docs(spark, sf_dir).select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "rn")


_ANNOTATORS = (["ann", "bea"], ["cyd", "dan", "eve"])


@register("annotator_assignment", """WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY (source IN ('src0', 'src1')), doc_id) AS rn, ceil(count(*) OVER () / 5.0)::BIGINT AS b FROM documents)
    SELECT doc_id, source, CASE WHEN rn <= 2 * b THEN ['ann', 'bea'][(rn - 1) % 2 + 1] ELSE ['cyd', 'dan', 'eve'][(rn - 1 - 2 * b) % 3 + 1] END AS annotator FROM r""")
def annotator_assignment(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.col("source").isin("src0", "src1").alias("restricted"))
    return an.assign(rows, "restricted", "doc_id", *_ANNOTATORS).select("doc_id", "source", "annotator")


@register("human_label_merge", """WITH r AS (SELECT doc_id AS unique_id, i AS ord, CASE i WHEN 0 THEN quality WHEN 1 THEN toxic ELSE CASE WHEN doc_id % 4 = 0 THEN 1 END END AS x FROM labels, (VALUES (0), (1), (2)) t(i)),
    c AS (SELECT unique_id, coalesce(x, 0) AS y, count(*) AS n, min(ord) AS seen FROM r JOIN labels l ON l.doc_id = unique_id WHERE l.toxic = 0 GROUP BY ALL),
    m AS (SELECT unique_id, y AS human_label FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY n DESC, seen, y) AS rn FROM c) WHERE rn = 1
        UNION ALL SELECT doc_id, coalesce(quality, 0) FROM labels WHERE toxic <> 0)
    SELECT m.unique_id, m.human_label, (d.n_chars % 2)::INTEGER AS entailment_pred FROM m JOIN documents d ON d.doc_id = m.unique_id""")
def human_label_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    third = F.when(F.col("doc_id") % 4 == 0, 1)
    shared = labels.where("toxic = 0").select(F.col("doc_id").alias("unique_id"), F.posexplode(F.array("quality", "toxic", third)).alias("ord", "inferrable"))
    single = labels.where("toxic <> 0").select(F.col("doc_id").alias("unique_id"), F.col("quality").alias("inferrable"))
    verdicts = _docs(spark, sf_dir).select(F.col("doc_id").alias("unique_id"), (F.col("n_chars") % 2).cast("int").alias("entailment_pred"))
    return an.human_labels(shared, single, verdicts)


_RULES = [("urgent", "top"), ("high", "upper"), ("medium|low", "rest")]


@register("model_name_canonical", """SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '(?i)urgent') THEN 'top' WHEN regexp_matches(o_orderpriority, '(?i)high') THEN 'upper'
    WHEN regexp_matches(o_orderpriority, '(?i)medium|low') THEN 'rest' END AS tier, replace(o_orderpriority, '-', '/') AS safe FROM orders""")
def model_name_canonical(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.first_match(F.col("o_orderpriority"), _RULES).alias("tier"), F.translate("o_orderpriority", "-", "/").alias("safe"))


@register("length_histogram", f"""WITH t AS (SELECT DISTINCT text FROM documents), x AS (SELECT {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE AS v FROM t), b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS total FROM x)
    SELECT bin, round(lo + bin * ((hi - lo) / 10), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS high, count(*) AS n, round(count(*) / total, 6) AS share FROM (
        SELECT lo, hi, total, least(floor((v - lo) * 10 / (hi - lo)), 9)::INTEGER AS bin FROM x, b) GROUP BY bin, lo, hi, total""")
def length_histogram(spark, sf_dir):
    words = _docs(spark, sf_dir).select(hash_text(F.col("text")).alias("h"), tx.token_estimate(F.col("text")).alias("v"))
    return mt.histogram(words.distinct().select("v"), "v")


@register("group_shares", "SELECT lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def group_shares(spark, sf_dir):
    return mt.shares(_docs(spark, sf_dir), ["lang"])


@register("category_summary", """SELECT variable, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY variable), 6) AS percent FROM (
    SELECT 'quality' AS variable, quality::VARCHAR AS level, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY ALL)""")
def category_summary(spark, sf_dir):
    return mt.category_summary(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@register("null_census", """WITH l AS (SELECT d.doc_id, d.lang, q.quality, q.toxic FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id)
    SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(quality), count(*) - count(toxic)]) AS n_null FROM l""")
def null_census(spark, sf_dir):
    return rel.null_census(_docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@register("distinct_counts", "SELECT count(DISTINCT md5(text)) AS n_texts, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM documents")
def distinct_counts(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.countDistinct(hash_text(F.col("text"))).alias("n_texts"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))


@register("token_cost_estimate", f"""WITH t AS (SELECT {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE + 4 + 1 * 4.0::DOUBLE / 3.0::DOUBLE + 2 + 16 AS t FROM conversations),
    s AS (SELECT count(*) AS n, sum(t) AS total, min(t) AS least, max(t) AS most, avg(t) AS mean, stddev_pop(t) AS spread FROM t)
    SELECT n, round(total, 6) AS total, round(least, 6) AS least, round(most, 6) AS most, round(mean, 6) AS mean, round(spread, 6) AS spread,
        round(16 + mean + 2 * (most - least) / 4, 6) AS tokens_per_request, round(total / 1000 * 0.003::DOUBLE + n * 16 / 1000.0::DOUBLE * 0.015::DOUBLE, 6) AS worst_cost,
        floor(80000 / (16 + mean + 2 * (most - least) / 4))::BIGINT AS requests_per_minute FROM s""")
def token_cost_estimate(spark, sf_dir):
    one = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = table(spark, sf_dir, "conversations").select(tk.chat_tokens(one, tx.token_estimate, 1, 16).alias("t"))
    out = tk.cost_estimate(rows, "t", "medium")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("total", "least", "most", "mean", "spread", "tokens_per_request", "worst_cost")], "requests_per_minute")


@register("path_metadata", """SELECT doc_id, lang AS llm, source AS dataset, CASE WHEN doc_id % 3 = 0 THEN 'progress_note' ELSE 'discharge' END AS note_type, CASE WHEN doc_id % 3 = 0 THEN 'pdac' END AS note_subtype,
    CASE doc_id % 4 WHEN 0 THEN 'PROMPT1_ICL' WHEN 1 THEN 'PROMPT2' WHEN 2 THEN 'PROMPT1' END AS prompt, CASE WHEN doc_id % 2 = 0 THEN 'precision' ELSE 'recall' END AS metric FROM documents""")
def path_metadata_query(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "pdac").otherwise("discharge")
    prompt = F.when(F.col("doc_id") % 4 == 0, "PROMPT1_ICL").when(F.col("doc_id") % 4 == 1, "PROMPT2").when(F.col("doc_id") % 4 == 2, "PROMPT1").otherwise("OTHER")
    path = F.concat_ws("/", F.lit("file:/data/root"), "lang", "source", kind, F.concat(prompt, F.lit("_x_"), F.when(F.col("doc_id") % 2 == 0, "precision").otherwise("recall"), F.lit(".json")))
    rows = _docs(spark, sf_dir).select("doc_id", path.alias("path"))
    return rows.select("doc_id", *[c.alias(n) for n, c in path_metadata(F.col("path")).items() if n != "key"])


@register("paired_files", "SELECT md5(text) AS key FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) = 2")
def paired_files(spark, sf_dir):
    """Documents are the files, and those of one text belong together."""
    rows = _docs(spark, sf_dir).select(hash_text(F.col("text")).alias("key"), F.col("doc_id").alias("file"))
    return rel.paired_files(rows, "key", "file")


@register("tuple_completions", """SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN text END AS content, CASE WHEN turn % 5 = 0 THEN 'timeout//' || role END AS errors, role AS model FROM conversations""")
def tuple_completions(spark, sf_dir):
    """Completion tuples are written as JSON lines inside the plan and taken apart again."""
    t = table(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    bad = F.to_json(F.array(F.lit("timeout"), F.col("role")))
    line = F.concat(F.lit("["), F.to_json(F.struct(F.col("role").alias("model"))), F.lit(","), F.when(F.col("turn") % 5 == 0, bad).otherwise(good), F.lit("]"))
    rows = t.select("conv_id", "turn", line.alias("line"))
    second = F.get_json_object("line", "$[1]")
    return rows.select("conv_id", "turn", F.get_json_object("line", "$[1].choices[0].message.content").alias("content"), F.when(second.startswith("["), tx.error_text(second)).alias("errors"), F.get_json_object("line", "$[0].model").alias("model"))


@register("stub_inference", """SELECT doc_id, '{"entailment_prediction": ' || (1 - length(text) % 2) || '}' AS response, 1 AS attempts, 'ok' AS status FROM documents""")
def stub_inference(spark, sf_dir):
    calls = inf.Calls(requests_per_minute=1e9, tokens_per_minute=1e12)
    out = inf.infer(_docs(spark, sf_dir), inf.stub_provider, calls, "doc_id", "text")
    return out.select("doc_id", "response", "attempts", "status")


@register("arranged_rows", "SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY lang DESC NULLS LAST, n_chars NULLS FIRST, doc_id) AS place FROM documents")
def arranged_rows(spark, sf_dir):
    """All rows in an order of several keys: each row's place, without a task that holds them all."""
    rows = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    return number_rows(rows, [F.desc_nulls_last("lang"), F.asc_nulls_first("n_chars"), F.col("doc_id")], "place")


@register("shared_annotation_rows", """WITH s AS (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 30),
    r AS (SELECT doc_id, source, row_number() OVER (ORDER BY (source IN ('src0', 'src1')), doc_id) AS rn, ceil(count(*) OVER () / 5.0)::BIGINT AS b FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s))
    SELECT d.doc_id, d.source, a.annotator FROM documents d JOIN s USING (doc_id), (VALUES ('ann'), ('bea'), ('cyd'), ('dan'), ('eve')) a(annotator)
    UNION ALL SELECT doc_id, source, CASE WHEN rn <= 2 * b THEN ['ann', 'bea'][(rn - 1) % 2 + 1] ELSE ['cyd', 'dan', 'eve'][(rn - 1 - 2 * b) % 3 + 1] END FROM r""")
def shared_annotation_rows(spark, sf_dir):
    """A sample goes to every annotator, all other rows to one of them."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.col("source").isin("src0", "src1").alias("restricted"))
    return an.with_shared_rows(rows, 30, _ANNOTATORS[0] + _ANNOTATORS[1], "restricted", "doc_id", _ANNOTATORS[0]).select("doc_id", "source", "annotator")


_BATCH = 2000


@register("dynamic_batches", f"""WITH RECURSIVE s AS (SELECT conv_id, turn, ceil({_WORDS.format("coalesce(text, '')")} * 4.0::DOUBLE / 3.0::DOUBLE)::INTEGER AS n_tokens FROM conversations),
    n AS (SELECT *, row_number() OVER (ORDER BY n_tokens, conv_id, turn) AS rn FROM s),
    o AS (SELECT *, sum(n_tokens) OVER (ORDER BY rn) AS upto, sum(n_tokens) OVER (ORDER BY rn) - n_tokens AS before FROM n),
    closing AS (SELECT i.rn, min(j.rn) AS closed_by FROM o i LEFT JOIN o j ON j.upto > i.before + {_BATCH} AND j.rn > i.rn AND j.before > i.before GROUP BY i.rn),
    starts AS (SELECT 1::BIGINT AS rn, 0::BIGINT AS batch UNION ALL SELECT c.closed_by, starts.batch + 1 FROM starts JOIN closing c USING (rn) WHERE c.closed_by IS NOT NULL),
    b AS (SELECT o.*, starts.batch FROM o ASOF JOIN starts ON o.rn >= starts.rn)
    SELECT conv_id, turn, n_tokens, batch, least(4096, floor(max(n_tokens) OVER (PARTITION BY batch) * 1.3::DOUBLE))::INTEGER AS max_new_tokens FROM b""")
def dynamic_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(tx.token_estimate(F.coalesce("text", F.lit("")))).cast("int").alias("n_tokens"))
    return dynamic_batches_of(rows, "n_tokens", ["conv_id", "turn"], _BATCH)


def _sentences(rules: str):
    def run(spark, sf_dir):
        return annotate(_docs(spark, sf_dir).select("doc_id", "text"), "text", rules).select("doc_id", F.inline("sentences")).withColumnsRenamed({"start": "sent_start", "stop": "sent_stop", "text": "sentence"})

    return run


register("sentences_fast")(_sentences("fast"))
register("sentences_full")(_sentences("full"))


@register("corpus_sample", f"""WITH n AS (SELECT *, {_WORDS.format('text')} * 4.0::DOUBLE / 3.0::DOUBLE AS est_token_count, CASE WHEN lang = 'en' AND source IN ('src0', 'src1') THEN 0 WHEN lang = 'de' THEN 1 END AS s FROM documents),
    b AS (SELECT * FROM n WHERE s IS NOT NULL AND est_token_count > 64 AND est_token_count < 3840), d AS (
    SELECT *, row_number() OVER (PARTITION BY s, md5(text) ORDER BY doc_id) AS nth FROM b), r AS (
    SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('123456|' || doc_id), doc_id) AS rn FROM d WHERE s = 1 OR nth = 1)
    SELECT doc_id, md5(text) AS text_hash, est_token_count, CASE s WHEN 0 THEN 'report' ELSE 'letter' END AS note_type, CASE s WHEN 0 THEN 'one' ELSE 'two' END AS dataset_name FROM r WHERE rn <= 25""")
def corpus_sample(spark, sf_dir):
    strata = [bd.Stratum("one", "report", (F.col("lang") == "en") & F.col("source").isin("src0", "src1"), True), bd.Stratum("two", "letter", F.col("lang") == "de")]
    out = bd.sample_corpus(_docs(spark, sf_dir).withColumnRenamed("text", "note_text"), strata, 25)
    return out.select("doc_id", hash_text(F.col("note_text")).alias("text_hash"), "est_token_count", "note_type", "dataset_name")


@register("provenance", """SELECT doc_id AS note_id, md5(text) AS doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src3')""")
def provenance(spark, sf_dir):
    d = _docs(spark, sf_dir)
    legacy = d.where("source = 'src3'").select(hash_text(F.col("text")).alias("doc_id"))
    return bd.provenance(legacy, d.withColumnRenamed("doc_id", "note_id"), "text", "note_id")


@register("nli_results_keep_last", f"""WITH a AS (SELECT c.conv_id, c.turn, 'snli|test|' || c.conv_id || '|P1' AS custom_id, c.role AS model, {_judge_sql('text').replace('doc_id', 'c.conv_id')} AS answer FROM conversations c), {_verdict_sql('answer')}
    SELECT custom_id, model, turn, conv_id AS uid, not_parseable, prediction AS entailment_pred FROM (SELECT *, row_number() OVER (PARTITION BY custom_id, model ORDER BY turn DESC) AS rn FROM verdicts) WHERE rn = 1 AND model <> 'system'""")
def nli_results_keep_last(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    rows = c.select("turn", compose(F.lit("snli"), F.lit("test"), "conv_id", F.lit("P1")).alias("custom_id"), F.col("role").alias("model"), _judge(F.col("text")).alias("model_output"), F.when(F.col("role") != "system", 1).alias("label"))
    good, _ = bd.nli_table(rows, [F.col("turn")])
    return good.select("custom_id", "model", "turn", "uid", "not_parseable", "entailment_pred")


@register("pair_records", f"""SELECT custom_id, json_extract_string(v, '$.messages[0].role') AS role, md5(json_extract_string(v, '$.metadata.hypothesis')) AS hypothesis_hash FROM (
    SELECT custom_id, to_json({{'messages': [{{'role': 'user'}}], 'metadata': {{'hypothesis': hypothesis}}}}) AS v FROM ({_pairs_sql('precision')}))""")
def pair_records(spark, sf_dir):
    pairs = precision_pairs(spark, sf_dir).withColumns({"premise": F.lit("p"), "prompt": F.col("hypothesis")})
    told = bd.pair_records(pairs, "m")
    return told.select("custom_id", F.get_json_object("value", "$.messages[0].role").alias("role"), hash_text(F.get_json_object("value", "$.metadata.hypothesis")).alias("hypothesis_hash"))
