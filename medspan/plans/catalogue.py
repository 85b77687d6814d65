"""The queries that this library registers, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions import normal
from medspan.functions.contract import VERSION, check_value
from medspan.functions.search import CLAUSE_END, cs, marked
from medspan.operators import deid, intervals
from medspan.operators.verify import locate
from medspan.plans import operator_queries, process, render, score, sinks
from medspan.sources.documents import duplicate_keys, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a source reads them: line ends, hash, error code."""
    return read_table(_table(spark, sf_dir, "documents")).select("doc_id", "encoding", "sha256", "error")


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one document has (S3)."""
    hashed = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"))
    return duplicate_keys(hashed, "sha256")


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses masked by span, union and splice."""
    kind = next(k for k in deid.KINDS if k.name == "email")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = docs.withColumn("spans", deid.merge(deid.spans_of(F.col("text"), F.lower("text"), kind)))
    masked = spans.withColumn("m", deid.mask(F.col("text"), F.col("spans")))
    return masked.select("doc_id", F.size("m.spans").cast("long").alias("n_spans"), F.sha2("m.text", 256).alias("masked_sha256"))


def pii_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each self-contained kind of personal data in all texts."""
    docs = _table(spark, sf_dir, "documents")
    kinds = {k.name: k.core for k in deid.KINDS if k.name in ("email", "phone", "snils")}
    counts = [F.sum(F.size(marked(F.col("text"), cs(p)))).alias(k) for k, p in kinds.items()]
    return docs.agg(*counts).select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("kind", "n"))


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of overlapping intervals of each user's events (A17, over a long table)."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    spans = _table(spark, sf_dir, "events").select("user_id", minute.alias("start"), (minute + 1 + F.pmod("event_id", F.lit(600))).alias("end"), "event_type", "event_id")
    return intervals.merge_spans(spans, "user_id", "start", "end", "event_type", "event_id")


def content_hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to process, given a store that has every third, some of an older version."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    done = docs.filter("doc_id % 3 = 0").withColumns({"pipeline_version": F.when(F.col("doc_id") % 2 == 0, VERSION).otherwise("0"), "status": F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("ok")})
    return process.pending(docs, done).select("doc_id", "sha256")


def section_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one speaker: a heading of the kind of its section opens no new one."""
    return intervals.runs(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every line of every text begins."""
    return intervals.line_offsets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each turn, split at commas, semicolons and line ends, and how many of them hold a word."""
    parts = F.split(F.translate("text", ".", ";"), cs(CLAUSE_END))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("parts"))
    return turns.select("conv_id", "turn", F.size("parts").cast("long").alias("n_parts"), F.size(F.filter("parts", lambda p: p.rlike(r"\S"))).cast("long").alias("n_clauses"))


def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three ways, normalised."""
    d = F.col("o_orderdate")
    worded = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.get(F.array(*[F.lit(m) for m in render.MONTHS]), F.month(d) - 1), F.lit(" "), F.year(d).cast("string"))
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "d-M-yyyy")).otherwise(worded)
    return _table(spark, sf_dir, "orders").select("o_orderkey", normal.date(written).alias("value"))


def norm_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with blanks and decimal commas, normalised."""
    written = F.concat(F.col("l_partkey").cast("string"), F.lit(" "), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(","), F.col("l_suppkey").cast("string"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", normal.number(written).alias("value"))


def stenosis_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by grade of a percentage."""
    percent = (F.col("l_quantity") * 2).cast("int")
    return _table(spark, sf_dir, "lineitem").groupBy(normal.stenosis(percent).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of values against the contract (V1)."""
    e = _table(spark, sf_dir, "events")
    killip, bpm, dm = (F.col("user_id") % 6).cast("string"), F.concat((F.col("event_id") % 200).cast("string"), F.when(F.col("event_id") % 4 == 0, F.lit(",5")).otherwise("")), F.when(F.col("event_id") % 3 == 0, F.lit("не указано")).otherwise((F.col("event_id") % 3).cast("string"))
    return e.select("event_id", check_value("killip", killip).alias("killip"), check_value("bpm", bpm).alias("bpm"), check_value("dm", dm).alias("dm"))


def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in all, by group and by field, in one pass of grouping sets (Q4)."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    return score.accuracy(rows.select(F.col("lang").alias("group_name"), F.col("source").alias("field"), ((F.col("n_chars") > 1000).cast("int") == F.col("quality")).alias("ok")))


def eval_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where prediction and gold differ (Q5)."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    pred, gold = (F.col("n_chars") > 1000).cast("int").cast("string"), F.col("quality").cast("string")
    return score.mismatches(rows.select("doc_id", F.lit("quality").alias("field"), pred.alias("pred"), gold.alias("gold"), (pred == gold).alias("ok")))


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest documents of a store."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"), F.col("o_orderstatus").alias("status"), F.lit(VERSION).alias("pipeline_version"), F.col("o_orderdate").cast("string").alias("created_at"))
    return sinks.latest(rows, 100).select("id", "filename", "status")


def store_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their results and their fields as one value (K10, over all documents)."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    each = lines.select(F.col("l_orderkey").alias("document_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("field"), *[F.lit(None).cast("string").alias(c) for c in ("value", "evidence", "ev_start", "ev_end", "source")])
    rows = sinks.joined(orders.select(F.col("o_orderkey").alias("id")), each, orders.select(F.col("o_orderkey").alias("document_id"), F.lit("").alias("json")))
    names = F.array_sort(F.transform(F.coalesce(F.map_keys("fields"), F.array().cast("array<string>")), lambda f: F.substring_index(f, "/", 1)))
    return rows.select(F.col("id").alias("o_orderkey"), F.size(names).cast("long").alias("n_fields"), F.array_join(names, ",").alias("fields"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a batch log (Q6)."""
    k = F.col("doc_id") % 10
    status = F.when(k == 0, "failed").when(k < 3, "cached").otherwise("ok")
    warned = F.when(k == 5, F.array(F.lit("missing_section_ecg"))).otherwise(F.array().cast("array<string>"))
    log = _table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), (F.col("n_chars") % 51).alias("filled"), warned.alias("warnings"))
    return process.batch_summary(log)


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries rendered from all customers, through masking, sections, rules and verification (A, G, X, N, F, V)."""
    done = process.process(render.summaries(spread(_table(spark, sf_dir, "customer"))))
    return done.select("doc_id", *[F.col("fields")[f]["value"].alias(f) for f in render.FIELDS])


def masked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking takes out of rendered summaries, by kind, and whether anything is left."""
    docs = deid.deidentify(render.summaries(spread(_table(spark, sf_dir, "customer"))))
    kinds = F.transform("spans", lambda s: s["kind"])
    return docs.select("doc_id", F.array_join(F.array_sort(kinds), ",").alias("kinds"), F.size("residual").cast("long").alias("n_residual"), F.col("anon_text").rlike("|".join(render.STEMS)).alias("name_left"))


def near_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title-like quotation, case changed, found again in its text (V2)."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.translate(F.substring("html", 120, 60), *LETTERS).alias("quote"))
    return locate(pages, "text", "quote", "at").select("page_id", F.col("at.start").alias("start"), F.col("at.end").alias("end"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        q.__name__: q
        for q in (
            read_documents, duplicate_texts, mask_email, pii_kind_counts, span_merge, content_hash_cache, section_runs, line_offsets, clause_counts, norm_date, norm_number, stenosis_grades,
            contract_checks, eval_accuracy, eval_mismatches, store_latest, store_join, batch_summary, extract_fields, masked_summaries, near_quotes,
        )
    } | operator_queries.queries()


LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"


def oracle_sql() -> dict[str, str]:
    return operator_queries.oracle_sql() | {
        "read_documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'utf-8' AS encoding, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents",
        "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "mask_email": f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n_spans, sha256(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g')) AS masked_sha256 FROM documents",
        "pii_kind_counts": rf"""
            SELECT 'email' AS kind, CAST(sum(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS n FROM documents
            UNION ALL SELECT 'phone', CAST(sum(len(regexp_extract_all(text, '(?:\+7|\b8)[ \t(-]*\d{{3}}[ \t)-]*\d{{3}}[ \t-]*\d{{2}}[ \t-]*\d{{2}}\b'))) AS BIGINT) FROM documents
            UNION ALL SELECT 'snils', CAST(sum(len(regexp_extract_all(text, '\b\d{{3}}-\d{{3}}-\d{{3}}[ -]\d{{2}}\b'))) AS BIGINT) FROM documents""",
        "span_merge": """
            WITH s AS (SELECT user_id, epoch_us(ts) // 60000000 AS a, epoch_us(ts) // 60000000 + 1 + event_id % 600 AS b, event_type, event_id FROM events),
            m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
            g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b DESC, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
            SELECT user_id, min(a) AS start, max(b) AS "end", first(event_type ORDER BY a, b DESC, event_id) AS event_type FROM g GROUP BY user_id, island""",
        "content_hash_cache": "SELECT doc_id, sha256(text) AS sha256 FROM documents d WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0)",
        "section_runs": """
            WITH n AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM n)
            SELECT conv_id, role, min(turn) AS first, max(turn) AS last FROM r GROUP BY conv_id, run, role""",
        "line_offsets": """
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
            SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(line) AS length FROM l""",
        "clause_counts": r"""
            SELECT conv_id, turn, len(string_split_regex(text, '[.;,\n]')) AS n_parts, len(list_filter(string_split_regex(text, '[.;,\n]'), lambda p: regexp_matches(p, '\S'))) AS n_clauses FROM conversations""",
        "norm_date": "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS value FROM orders",
        "norm_number": "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.' || CAST(l_suppkey AS VARCHAR) AS value FROM lineitem",
        "stenosis_grades": "SELECT CASE WHEN l_quantity * 2 < 50 THEN '0' WHEN l_quantity * 2 < 90 THEN '1' ELSE '2' END AS grade, count(*) AS n FROM lineitem GROUP BY 1",
        "contract_checks": """
            SELECT event_id, CASE WHEN user_id % 6 NOT IN (1, 2, 3, 4) THEN 'not_in_enum' END AS killip, CASE WHEN event_id % 4 = 0 THEN 'bad_format' END AS bpm,
              CASE WHEN event_id % 3 = 0 THEN 'not_found_for_binary' WHEN event_id % 3 = 2 THEN 'not_in_enum' END AS dm FROM events""",
        "eval_accuracy": """
            WITH r AS (SELECT lang, source, CASE WHEN CAST(n_chars > 1000 AS INT) = quality THEN 1 ELSE 0 END AS ok FROM labels JOIN documents USING (doc_id))
            SELECT CASE WHEN grouping(lang) = 0 THEN 'group' WHEN grouping(source) = 0 THEN 'field' ELSE 'all' END AS level, coalesce(source, lang, 'all') AS name, count(*) AS n, round(avg(ok), 4) AS accuracy
            FROM r GROUP BY GROUPING SETS ((lang), (source), ())""",
        "eval_mismatches": """
            SELECT doc_id, 'quality' AS field, CAST(CAST(n_chars > 1000 AS INT) AS VARCHAR) AS pred, CAST(quality AS VARCHAR) AS gold FROM labels JOIN documents USING (doc_id)
            WHERE CAST(n_chars > 1000 AS INT) <> quality""",
        "store_latest": "SELECT o_orderkey AS id, o_orderpriority AS filename, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
        "store_join": """
            SELECT o_orderkey, coalesce(n_fields, 0) AS n_fields, coalesce(fields, '') AS fields FROM orders LEFT JOIN (
              SELECT l_orderkey, count(*) AS n_fields, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS fields FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
        "batch_summary": f"""
            SELECT count(*) AS documents, count(*) FILTER (doc_id % 10 > 2) AS ok, count(*) FILTER (doc_id % 10 IN (1, 2)) AS cached, count(*) FILTER (doc_id % 10 = 0) AS failed, 'rules-only' AS mode,
              '{VERSION}' AS pipeline_version, round(sum(n_chars % 51) FILTER (doc_id % 10 > 2) / (count(*) FILTER (doc_id % 10 > 2) * 50.0), 3) AS evidence_rate, count(*) FILTER (doc_id % 10 = 5) AS with_warnings FROM documents""",
        "near_quotes": r"""
            WITH q AS (SELECT page_id, html, regexp_replace(translate(substring(html, 120, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS q FROM pages)
            SELECT page_id, CASE WHEN q <> '' AND instr(lower(html), lower(q)) > 0 THEN CAST(instr(lower(html), lower(q)) - 1 AS INT) END AS start, CASE WHEN q <> '' AND instr(lower(html), lower(q)) > 0 THEN CAST(instr(lower(html), lower(q)) - 1 + length(q) AS INT) END AS "end" FROM q""",
        "extract_fields": render.EXPECTED_SQL,
        "masked_summaries": """
            SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'address,age,dob,email,fio,fio,' || CASE WHEN c_custkey % 2 = 0 THEN 'fio,' ELSE '' END || 'id,phone,policy,snils' AS kinds, CAST(0 AS BIGINT) AS n_residual, false AS name_left
            FROM customer""",
    }
