"""Continuous ingest: files that arrive in a folder, processed in micro-batches into the store, known texts skipped."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from medspan.plans import sinks
from medspan.plans.process import batch_log, pending, process
from medspan.plans.shared import settled
from medspan.sources.documents import MAX_BYTES, file_name, read_files

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, available_now: bool = True, remember: str = "30 days", oldest: str = "3650d") -> StreamingQuery:
    """Start a query over a folder. Every file gets a row in the log (doc_id, status, error, filled, warnings) below the store.

    Files that came before with the same bytes are known to the query's own state, for as long as `remember` says, and cost nothing;
    what lies longer back, or was seen by another query, is looked up among the documents of the store. Files up to `oldest` older than
    the newest one still count, when they come late; paths are remembered for as long. A batch that is run again changes nothing: the store has its documents, and its log is written anew.
    Files over the size limit are never opened, and logged."""
    source = lambda: spark.readStream.format("binaryFile").schema(FILES).option("maxFileAge", oldest).load(folder)
    fit = source().filter(F.col("length") <= MAX_BYTES).select("path", "content", F.sha2("content", 256).alias("hash"))
    large = source().filter(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("binary").alias("content"), F.concat(F.lit("large:"), F.col("length").cast("string")).alias("hash"))
    files = fit.unionByName(large).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["path", "hash"])
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        named = rows.withColumn("name", file_name(F.col("path")))
        none = F.lit(None).cast("string")
        too_large = named.filter(F.startswith("hash", F.lit("large:"))).select(F.regexp_extract("name", r"^(.*)\.[^.]*\z", 1).alias("doc_id"), "name", none.alias("text"), none.alias("encoding"), none.alias("sha256"), F.lit("document_too_large").alias("error"))
        docs = read_files(named.filter("content is not null").select("name", "content")).unionByName(too_large).persist()
        todo = docs.filter("error is null")
        try:
            done = sinks.load(rows.sparkSession, store, "documents").select(F.regexp_extract("filename", r"^(.*)\.[^.]*\z", 1).alias("doc_id"), "sha256", "pipeline_version", "status")
            todo = pending(todo, done)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        ready = settled(process(todo), f"{store}/ready/query={own}")  # the tables and the log come from one pass over the rules
        sinks.save(sinks.store_tables(ready), store)
        batch_log(docs, ready).write.mode("overwrite").parquet(f"{store}/log/query={own}/batch={number}")
        docs.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
