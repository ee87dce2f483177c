"""Readers and writers over temporary folders, and completions as a stream."""

import json
import zipfile
from datetime import date

from pyspark.sql import functions as F

from factloom.sources import readers as rd
from factloom.sources import writers as wr
from factloom.streaming.completions import judged, read_completion_stream, running_accuracy


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line one\nline "two", x'), (2, "plain")], "id int, note_text string")
    wr.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, rd.read_csv(spark, str(tmp_path / "c"), "id int, note_text string").collect())) == sorted(map(tuple, df.collect()))
    wr.write_tsv(df.where("id = 2"), str(tmp_path / "t"))
    assert rd.read_csv(spark, str(tmp_path / "t"), "id int, note_text string", "\t").first().note_text == "plain"


def test_completion_tuples(spark, tmp_path):
    lines = [
        [{"model": "m"}, {"choices": [{"message": {"content": "a//b", "role": "assistant"}}]}, {"metadata": {"uid": "u1"}}],
        [{"model": "m"}, ["timeout", "again"], {"metadata": {"uid": "u2"}}],
        [{"model": "m"}, {"choices": []}],
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = rd.read_completions(spark, str(tmp_path / "x.jsonl")).collect()
    assert [r.content for r in got] == ["a//b", None, None] and json.loads(got[1].errors) == ["timeout", "again"] and got[0].errors is None
    assert json.loads(got[0].metadata) == {"uid": "u1"} and got[2].metadata is None
    df = spark.createDataFrame([('{"model": "m"}', '{"choices": []}', '{"uid": 1}')], "q string, r string, m string")
    wr.write_completions(df, str(tmp_path / "o"), "q", "r", "m")
    assert json.loads(spark.read.text(str(tmp_path / "o")).first().value) == [{"model": "m"}, {"choices": []}, {"metadata": {"uid": 1}}]


def test_predictions_keep_rejects(spark):
    good = json.dumps({"candidates": [{"content": {"parts": [{"text": "yes"}]}}]})
    df = spark.createDataFrame([(good, '{"p": 1}'), ("broken", '{"p": 2}')], "prediction string, request string")
    lines, rejects = wr.predictions_to_completions(df, "prediction", "request", "m")
    assert json.loads(lines.first().value)[1]["choices"][0]["message"]["content"] == "yes" and rejects.count() == 1


def test_zip_text_templates_and_splits(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("files/p100/p10032/s50414267.txt", "Findings: é")
        z.writestr("files/readme.md", "no")
    rows = rd.read_zipped_texts(spark, str(tmp_path / "n.zip"))
    r = rows.select("note_text", *[c.alias(n) for n, c in rd.study_ids(F.col("member")).items()]).collect()
    assert [tuple(x) for x in r] == [("Findings: é", 100, 50414267)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.tmpl").write_text("B {text}\n")
    (tmp_path / "t" / "a.tmpl").write_text("A {text}")
    assert [tuple(x) for x in rd.read_templates(spark, str(tmp_path / "t")).collect()] == [("a", "A {text}"), ("b", "B {text}\n")]
    assert rd.read_texts(spark, str(tmp_path / "t")).count() == 2
    for s in ("train", "test"):
        spark.range(2).write.parquet(str(tmp_path / s))
    assert rd.read_splits(spark, {s: str(tmp_path / s) for s in ("train", "test")}).groupBy("split").count().count() == 2


def test_experiments(spark, tmp_path):
    for metric, pred in (("precision", 1), ("recall", 0)):
        f = tmp_path / "llm1" / "ds" / "pdac" / f"run_PROMPT1_{metric}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps({"ID": "1", "premise": "p", "entailment_pred": pred}))
    got = {r.metric: r for r in rd.read_experiments(spark, str(tmp_path)).collect()}
    assert got["precision"].llm == "llm1" and got["recall"].note_type == "progress_note" and got["recall"].entailment_pred == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(49)], "i int, annotator string")
    wr.write_by_annotator(df, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"annotator=a", "annotator=b"}
    wr.split_files(df, str(tmp_path / "s"), 7)
    assert len(list((tmp_path / "s").glob("part-*"))) == 7
    for _ in range(2):
        wr.merge_files(df.repartition(5), str(tmp_path / "m"), ["annotator", "i"])
        lines = [json.loads(x) for x in (tmp_path / "m").read_text().splitlines()]
        assert [(x["annotator"], x["i"]) for x in lines] == sorted(("ab"[i % 2], i) for i in range(49)) and not (tmp_path / "m-parts").exists()
    wr.write_parquet(df, str(tmp_path / "p"), ["annotator"])
    assert rd.read_parquet(spark, str(tmp_path / "p")).count() == 49
    sent = wr.send_in_batches(df.repartition(2), lambda rows: ["late"] if len(rows) < 10 else [], 10).collect()
    assert sum(r.n for r in sent) == 49 and max(r.n for r in sent) == 10 and any(json.loads(r.errors) for r in sent)
    assert wr.dated("pairs", date(2024, 3, 5)) == "pairs_20240305.jsonl"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, text: json.dumps([{"model": "m"}, {"choices": [{"message": {"content": text}}]}, {"metadata": {"custom_id": f"d|s|{i}|p", "label": 1}}])
    (src / "1.jsonl").write_text("\n".join([line(1, "Yes."), line(1, "Yes."), line(2, "maybe")]))
    (src / "2.jsonl").write_text(line(3, '{"entailment_prediction": 1}'))
    query = running_accuracy(judged(read_completion_stream(spark, str(src), 1))).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("acc").collect()] == [("m", "p", 3, 1, 2)]
