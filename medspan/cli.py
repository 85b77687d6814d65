"""Command line: `batch`, `preprocess` and `score` over directories."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from medspan.functions.contract import RESULT, flatten, violations
from medspan.operators import model_fill
from medspan.plans import process, score, sinks
from medspan.plans.shared import settled
from medspan.sources.documents import SourceError, file_name, read_directory


def _batch(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = read_directory(spark, args.input).persist()
    todo = docs
    if not args.force:
        old = _json_files(spark, args.evidence)
        if old is not None:
            done = old.select("doc_id", F.get_json_object("json", "$.sha256").alias("sha256"), F.get_json_object("json", "$.pipeline_version").alias("pipeline_version"), F.lit("ok").alias("status"))
            todo = process.pending(docs, done)
    client = None if args.no_llm else model_fill.from_env()
    done = settled(process.process(todo, (lambda: client) if client else None, args.answers or None, client.model if client else ""), f"{args.logs}/processed")
    sinks.write_files(sinks.result_json(done), args.output)
    sinks.write_files(sinks.evidence_json(done), args.evidence)
    log = process.batch_log(docs, done).persist()
    sinks.write_failures(log, f"{args.logs}/failed")
    if args.db:
        sinks.save(sinks.store_tables(done), args.db)
    summary = process.batch_summary(log, "hybrid" if client else "rules-only").first().asDict()
    print(json.dumps(summary, ensure_ascii=False, indent=2))
    return 1 if summary["failed"] else 0


def _preprocess(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = read_directory(spark, args.input)
    ready = settled(process.prepare(docs), f"{args.output}/prepared")
    ready.select("doc_id", F.to_json(F.struct("doc_id", "encoding", "sha256", "spans", "sections", "audit")).alias("json")).write.mode("overwrite").parquet(f"{args.output}/reports")
    ready.select("doc_id", "anon_text").write.mode("overwrite").parquet(f"{args.output}/anon")
    counts = {r[0]: r[1] for r in process.section_counts(ready).collect()}
    bad = F.col("error").isNotNull()
    total = ready.agg(F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("errors"), F.count_if(~bad & (F.size("audit") > 0)).alias("needs_review")).first().asDict()
    summary = json.dumps(total | {"documents_with_section": counts, "warnings": {r[0]: r[1] for r in process.warning_counts(ready).collect()}}, ensure_ascii=False)
    spark.createDataFrame([(summary,)], "value string").repartition(1).write.mode("overwrite").text(f"{args.output}/summary")
    print(summary)
    return 1 if total["errors"] else 0


def _json_files(spark: SparkSession, folder: str):
    try:
        rows = spark.read.text(f"{folder}/*.json", wholetext=True)
    except Exception as error:  # the folder may not be there yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return rows.select(F.regexp_extract(file_name(F.col("_metadata.file_path")), r"^(.*)\.json\z", 1).alias("doc_id"), F.col("value").alias("json"))


def _flat(rows):
    nested = F.from_json("json", "map<string,map<string,string>>")
    typed = F.from_json("json", RESULT)
    each = rows.select("doc_id", (F.size(violations(nested)) == 0).alias("valid"), F.explode(flatten(typed)).alias("field", "value"))
    return each


def _score(spark: SparkSession, args: argparse.Namespace) -> int:
    pred = _flat(_json_files(spark, args.pred)).persist()
    expected = pred.select("doc_id").distinct()
    if args.docs:
        expected = spark.read.format("binaryFile").load(args.docs).select(F.regexp_extract(file_name(F.col("path")), r"^(.*)\.(?:md|txt|docx|json)\z", 1).alias("doc_id")).filter("doc_id <> ''")
    ev = _json_files(spark, args.evidence)
    quotes = None if ev is None else ev.select("doc_id", F.explode(F.from_json(F.get_json_object("json", "$.fields"), "map<string,struct<evidence:string>>")).alias("field", "e")).select("doc_id", "field", "e.evidence")
    rows = pred.withColumn("evidence", F.lit(None).cast("string")) if quotes is None else pred.join(quotes, ["doc_id", "field"], "left")
    summary = score.rates(expected, rows).first().asDict()
    gold = _json_files(spark, args.gold)
    if gold is not None:
        compared = score.compared(pred.filter("valid"), _flat(gold)).persist()
        summary["accuracy"] = {f"{r['level']}:{r['name']}": r["accuracy"] for r in score.accuracy(compared).collect()}
        # all of them, as a table: their number grows with the documents
        score.mismatches(compared).write.mode("overwrite").parquet(args.mismatches)
        summary["mismatches"] = args.mismatches
    print(json.dumps(summary, ensure_ascii=False, indent=2))
    return 0 if summary["valid_json"] == 1 else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    batch = sub.add_parser("batch")
    batch.add_argument("--input", required=True)
    for name, value in (("output", "result"), ("evidence", "result_evidence"), ("logs", "logs"), ("db", ""), ("answers", "")):
        batch.add_argument(f"--{name}", default=value)
    batch.add_argument("--force", action="store_true")
    batch.add_argument("--no-llm", action="store_true")
    pre = sub.add_parser("preprocess")
    pre.add_argument("--input", required=True)
    pre.add_argument("--output", default="out/preprocessed")
    marks = sub.add_parser("score")
    for name, value in (("pred", "result"), ("docs", ""), ("gold", "eval/gold"), ("evidence", "result_evidence"), ("mismatches", "logs/mismatches")):
        marks.add_argument(f"--{name}", default=value)
    args = parser.parse_args(argv)
    # call sites of columns are not recorded: the rules are some thousands of columns, and it would double the time to build them
    spark = spark or SparkSession.builder.appName("medspan").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    try:
        return {"batch": _batch, "preprocess": _preprocess, "score": _score}[args.command](spark, args)
    except SourceError as error:
        print(f"cannot start: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
