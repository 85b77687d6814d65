"""The command line, the store and the stream, over a small folder."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from medspan import cli
from medspan.functions import contract
from medspan.plans import process, sinks
from medspan.sources import documents
from medspan.streaming.ingest import ingest

TEXT = "Пациент: Рябинина Вера, 73 года\nДиагноз: ХОБЛ. Killip II\nЭКГ: ритм синусовый, ЧСС 70"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    here = tmp_path_factory.mktemp("in")
    (here / "a.md").write_text(TEXT)
    (here / "b.txt").write_bytes(TEXT.replace("II", "III").encode("cp1251"))
    (here / "c.docx").write_bytes(b"no archive")
    return here


def test_batch_then_score(spark, folder, tmp_path, capsys):
    where = {n: f"{tmp_path}/{n}" for n in ("output", "evidence", "logs", "db")}
    args = ["batch", "--input", str(folder), "--no-llm", *[x for n, p in where.items() for x in (f"--{n}", p)]]
    assert cli.main(args, spark) == 1  # one document could not be read
    summary = json.loads(capsys.readouterr().out)
    assert (summary["documents"], summary["ok"], summary["failed"], summary["mode"]) == (3, 2, 1, "rules-only")
    result = json.loads((tmp_path / "output" / "b.json").read_text())
    assert list(result) == list(contract.GROUPS) and result["диагноз"]["killip"] == "3" and result["ЭКГ"]["ecg_bpm"] == "70"
    assert "Рябинина" not in (tmp_path / "evidence" / "a.json").read_text()
    assert spark.read.option("header", True).csv(f"{tmp_path}/logs/failed").collect()[0].asDict() == {"doc_id": "c", "error": "bad_docx"}
    assert sinks.load(spark, where["db"], "extractions").count() == 100

    assert cli.main(args, spark) == 1
    assert json.loads(capsys.readouterr().out)["cached"] == 2
    gold = tmp_path / "gold"
    gold.mkdir()
    result["диагноз"]["killip"] = "1"
    (gold / "b.json").write_text(json.dumps(result, ensure_ascii=False))
    assert cli.main(["score", "--pred", where["output"], "--gold", str(gold), "--evidence", where["evidence"], "--mismatches", f"{tmp_path}/mismatches"], spark) == 0
    scored = json.loads(capsys.readouterr().out)
    assert scored["valid_json"] == 1 and scored["evidence_rate"] == 1 and scored["accuracy"]["all:all"] == 0.98
    assert [(r["doc_id"], r["field"]) for r in spark.read.parquet(f"{tmp_path}/mismatches").collect()] == [("b", "killip")]


def test_preprocess(spark, folder, tmp_path, capsys):
    assert cli.main(["preprocess", "--input", str(folder), "--output", f"{tmp_path}/pre"], spark) == 1
    summary = json.loads(capsys.readouterr().out)
    assert summary["documents"] == 3 and summary["errors"] == 1 and summary["documents_with_section"]["ecg"] == 2
    assert json.loads(spark.read.text(f"{tmp_path}/pre/summary").first()["value"]) == summary
    assert all("Рябинина" not in (r["anon_text"] or "") for r in spark.read.parquet(f"{tmp_path}/pre/anon").collect())


def test_missing_folder(spark, tmp_path, capsys):
    assert cli.main(["batch", "--input", f"{tmp_path}/none", "--no-llm"], spark) == 2
    assert "input_dir_not_found" in capsys.readouterr().err


def test_stream_into_the_store(spark, folder, tmp_path):
    store, source = f"{tmp_path}/store", tmp_path / "in"
    shutil.copytree(folder, source)
    (source / "d.md").write_bytes(b"x" * (documents.MAX_BYTES + 1))
    log = lambda: sorted((r["doc_id"], r["status"], r["error"]) for r in spark.read.parquet(f"{store}/log/*/*").collect())
    run = lambda checkpoint: ingest(spark, str(source), store, f"{tmp_path}/{checkpoint}").awaitTermination()
    run("one")
    first = [("a", "ok", None), ("b", "ok", None), ("c", "failed", "bad_docx"), ("d", "failed", "document_too_large")]
    assert log() == first
    assert sinks.load(spark, store, "documents").count() == 2 and sinks.load(spark, store, "extractions").count() == 100

    (source / "late.md").write_text(TEXT + " поздно")
    long_ago = time.time() - 3000 * 86400
    os.utime(source / "late.md", (long_ago, long_ago))  # an old file that comes late
    run("one")
    assert log() == sorted([*first, ("late", "ok", None)])

    run("two")  # another query reads everything again; what the store has is left out
    cached = [("a", "cached", None), ("b", "cached", None), ("late", "cached", None)]
    assert log() == sorted([*first, *first[2:], ("late", "ok", None), *cached])
    assert spark.read.parquet(f"{store}/documents").count() == 3


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit('{"n": '), "id", F.lit("}")).alias("json")).repartition(4)
    fails = F.udf(lambda x: x if x != "17" else 1 // 0)
    target = tmp_path / "out"
    with pytest.raises(Exception, match="ZeroDivisionError"):
        sinks.write_files(rows.withColumn("doc_id", fails("doc_id")), str(target))
    # a task that outlives its job may leave a hidden folder, never a file
    files = lambda: [p for p in target.iterdir() if not (p.is_dir() and p.name.startswith("_staging"))]
    assert not target.exists() or files() == []
    for folder in (str(target), f"file://{target}"):  # written again, files are replaced as wholes
        sinks.write_files(rows, folder)
        assert {p.name: json.loads(p.read_text())["n"] for p in files()} == {f"{i}.json": i for i in range(40)}


def test_the_table_of_done_documents_is_not_shuffled(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.when(F.col("id") % 10 == 0, "failed").otherwise("ok").alias("status"))
    spark.sql("DROP TABLE IF EXISTS done_documents")
    for part in (rows.filter("doc_id < '3'"), rows.filter("doc_id >= '3'")):
        process.remember(part, "done_documents", 6)
    new = rows.select("doc_id", "sha256").withColumn("sha256", F.when(F.col("doc_id") == "11", "changed").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("new", "x"), (None, None)], "doc_id string, sha256 string"))
    new = spark.createDataFrame(new.collect(), new.schema)
    todo = process.pending_in(new, "done_documents")
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in todo.collect()} == {str(i) for i in range(0, 500, 10)} | {"11", "new", None}
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the one of the new side
    spark.sql("DROP TABLE done_documents")
