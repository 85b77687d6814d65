"""Queries of single operators of the clinical lineage: texts made from the tables' columns, the library's own functions over
them, and SQL that says what must come out."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions import contract, normal, search
from medspan.operators import deid, intervals, model_fill, sections, verify
from medspan.plans import process, score, sinks
from medspan.plans.shared import shared_folder
from medspan.sources.documents import read_directory, read_files, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, *options):
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(key, F.lit(len(options))).cast("int"))


def _sql_pick(key: str, *options) -> str:
    quoted = ", ".join("NULL" if o is None else "'" + str(o).replace("'", "''") + "'" if isinstance(o, str) else str(o) for o in options)
    return f"list_value({quoted})[({key}) % {len(options)} + 1]"


# --- sections

# a line, the kind of section that it opens (none: it opens no section), and how much of it is heading
HEADS = (("Диагноз: боль", "diagnosis", 9), ("Жалобы", "history", 6), ("Жалобы на боль", None, 0), ("## Эхо-КГ", "echo", 9), ("**КАГ** — норма", "ca", 10), ("ПРОЧИЕ СВЕДЕНИЯ", "other", 15), ("ВЫПИСКА ИЗ КАРТЫ", None, 0), ("Анамнез заболевания. Болен", "history", 21), ("Дополнительно: калий", None, 0))


def section_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts with two heading-like lines: kinds, bounds and bodies; they tile the text."""
    k = F.col("o_orderkey")
    line = lambda key: _pick(key, *[h[0] for h in HEADS])
    text = F.concat(F.lit("Шапка "), k.cast("string"), F.lit("\n"), line(k), F.lit("\nтекст\n"), line(F.floor(k / 9)), F.lit("\nконец"))
    docs = _table(spark, sf_dir, "orders").select(k, text.alias("anon_text"))
    each = docs.select("o_orderkey", F.explode(sections.sections_of(F.col("anon_text"))).alias("s"))
    return each.select("o_orderkey", "s.kind", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.length("s.body").cast("long").alias("body_length"))


_LINES, _KINDS, _SIZES = (_sql_pick("{k}", *[h[i] for h in HEADS]) for i in range(3))
SECTION_SQL = f"""
WITH t AS (
  SELECT o_orderkey AS k, 'Шапка ' || o_orderkey AS l0, {_LINES.format(k="o_orderkey")} AS l1, {_KINDS.format(k="o_orderkey")} AS k1, {_SIZES.format(k="o_orderkey")} AS n1,
    {_LINES.format(k="o_orderkey // 9")} AS l2, {_KINDS.format(k="o_orderkey // 9")} AS k2, {_SIZES.format(k="o_orderkey // 9")} AS n2 FROM orders
), p AS (SELECT *, length(l0) + 1 AS s1, length(l0) + 1 + length(l1) + 1 + 6 AS s2, length(l0) + 1 + length(l1) + 1 + 6 + length(l2) + 1 + 5 AS total FROM t),
h AS (
  SELECT k, 'header' AS kind, 0 AS start, 0 AS body, total FROM p
  UNION ALL SELECT k, k1, s1, s1 + n1 + CASE WHEN n1 < length(l1) AND l1[n1 + 1] = ' ' THEN 1 ELSE 0 END, total FROM p WHERE k1 IS NOT NULL
  UNION ALL SELECT k, k2, s2, s2 + n2 + CASE WHEN n2 < length(l2) AND l2[n2 + 1] = ' ' THEN 1 ELSE 0 END, total FROM p WHERE k2 IS NOT NULL AND k2 IS DISTINCT FROM k1
), e AS (SELECT *, lead(start, 1, total) OVER (PARTITION BY k ORDER BY start) AS fin FROM h)
SELECT k AS o_orderkey, kind, CAST(start AS BIGINT) AS start, CAST(fin AS BIGINT) AS "end", CAST(greatest(0, fin - body) AS BIGINT) AS body_length FROM e
"""


def section_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of the audit: required kinds that are missing, unknown headings, personal data that is left."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Шапка\n"), _pick(k, "Диагноз: боль", "ПРОЧЕЕ", "ЭКГ: норма"), F.lit("\n"), _pick(F.floor(k / 3), "Рекомендации: покой", "Осмотр при поступлении: норма", "-"))
    docs = _table(spark, sf_dir, "orders").select(k, text.alias("anon_text"), F.when(k % 5 == 0, F.array(F.lit("phone"))).otherwise(F.array().cast("array<string>")).alias("residual"))
    return sections.segment(docs).select("o_orderkey", F.array_join("audit", ";").alias("audit"))


_MISSING = lambda kind, there: f"CASE WHEN {there} THEN NULL ELSE 'missing_section_{kind}' END"
AUDIT_SQL = f"""
SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 5 = 0 THEN 'residual_phone' END, {_MISSING("diagnosis", "o_orderkey % 3 = 0")}, {_MISSING("exam", "o_orderkey // 3 % 3 = 1")}, {_MISSING("ecg", "o_orderkey % 3 = 2")},
  'missing_section_labs', {_MISSING("therapy", "o_orderkey // 3 % 3 = 0")}, CASE WHEN o_orderkey % 3 = 1 THEN 'unknown_heading:ПРОЧЕЕ' END) AS audit FROM orders
"""

# --- de-identification

# a line with personal data (# stands for digits of the key), and the line masked
PERSONAL = (
    ("Больной: да Сильва Иван Петрович оглы лечился", "Больной: [ФИО] лечился"), ("Лечащий врач: Осина П. А. принял", "Лечащий врач: [ФИО] принял"), ("Вызван Зимин-Край Л.Д. срочно", "Вызван [ФИО] срочно"), ("д. р. 5.03.48", "д. р. [ДР]"),
    ("Родилась 1950 в селе", "Родилась [ДР] в селе"), ("1951 г. р.", "[ДР] г. р."), ("Дата рождения: 01/02/1950; возраст: 71 год", "Дата рождения: [ДР]; возраст: [ВОЗРАСТ]"), ("в возрасте 45 лет", "в возрасте [ВОЗРАСТ]"),
    ("Медицинская карта № #/7-а", "Медицинская карта № [ID]"), ("№ истории болезни: #", "№ истории болезни: [ID]"), ("тел. 8(912)345-67-89 дом.", "тел. [ТЕЛЕФОН] дом."), ("почта a.b_c+d@e-f.ru", "почта [EMAIL]"),
    ("СНИЛС 123-456-789 01", "СНИЛС [СНИЛС]"), ("полис ОМС №: 1234 5678 9012 3456", "полис ОМС №: [ПОЛИС]"), ("Место жительства: Лесная, #", "Место жительства: [АДРЕС]"),
    ("Пациентка: Рябинина Вера, 1948 г., 73 года; поступила 05.05.2021. Рябининой лучше", "Пациентка: [ФИО], [ДР] г., [ВОЗРАСТ]; поступила 05.05.2021. [ФИО] лучше"), ("Палата 12, ХСН 2 ст., 05.05.2021", "Палата 12, ХСН 2 ст., 05.05.2021"),
)


def personal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each way in which personal data shows, masked, and what is left of it."""
    k = F.col("o_orderkey")
    text = F.replace(_pick(k, *[p[0] for p in PERSONAL]), F.lit("#"), k.cast("string"))
    docs = deid.deidentify(_table(spark, sf_dir, "orders").select(k, text.alias("text")))
    return docs.select("o_orderkey", "anon_text", F.size("residual").cast("long").alias("n_residual"))


PERSONAL_SQL = f"SELECT o_orderkey, {_sql_pick('o_orderkey', *[p[1] for p in PERSONAL])} AS anon_text, CAST(0 AS BIGINT) AS n_residual FROM orders"


def residual_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over texts that were masked badly."""
    k = F.col("o_orderkey")
    text = _pick(k, "Пациент: [ФИО], [ДР]", "Пациент: иванов", "почта a@b.ru, СНИЛС 123-456-789 01", "[ТЕЛЕФОН] и 8 912 345 67 89")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(deid.residual(text), ",").alias("kinds"))


RESIDUAL_SQL = f"SELECT o_orderkey, {_sql_pick('o_orderkey', '', 'fio', 'email,snils', 'phone')} AS kinds FROM orders"


def spans_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of overlapping spans inside a row, the lines of each order being its spans."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.pmod("l_partkey", F.lit(40)).cast("int").alias("start"), (F.pmod("l_partkey", F.lit(40)) + 1 + F.pmod("l_suppkey", F.lit(9))).cast("int").alias("end"), F.lit("x").alias("kind")).alias("s"))
    merged = lines.groupBy("l_orderkey").agg(deid.merge(F.array_sort(F.collect_list("s"))).alias("m"))
    return merged.select("l_orderkey", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long").alias("covered"))


SPANS_SQL = """
WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS a, l_partkey % 40 + 1 + l_suppkey % 9 AS b FROM lineitem), -- equal spans are one: two windows may order ties differently
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT l_orderkey, island, min(a) AS a, max(b) AS b FROM g GROUP BY l_orderkey, island)
SELECT l_orderkey, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS covered FROM u GROUP BY l_orderkey
"""

# --- search

SAYINGS = (
    ("Тромбоз вен.", True, "Тромбоз", False), ("Тромбоза нет.", True, "Тромбоза", True), ("Признаков тромбоза не выявлено", True, "тромбоза", True), ("Без отёка, тромбоз левый", True, "тромбоз", False), ("Тромбоз, отёка нет", True, "Тромбоз", False),
    ("Тромбоз исключён", True, "Тромбоз", True), ("ХСН 2.5 ст. без тромбоза", True, "тромбоза", True), ("Тромбоз; нет боли", True, "Тромбоз", False), ("Боль", False, None, None), ("Тромбоз отрицает", True, "Тромбоз", True), ("Нетромбозный, безтромбоз", True, "тромбозный", False),
)


def clause_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a rule and whether their clause negates them."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Первое не то. "), _pick(k, *[s[0] for s in SAYINGS]))
    piece = F.array(F.struct(F.lit("exam").alias("kind"), text.alias("t"), F.lower(text).alias("low"), F.lit(0).alias("at")))
    rule = search.Rule("thrombus", search.any_of("тромбоз*"), (("exam",),), search.words_of("тромбоз*"))
    hit = search.head(search.scan(piece, (rule,)))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", hit.alias("h"))
    return rows.select("o_orderkey", F.col("h.m").alias("m"), F.when(F.col("h").isNotNull(), search.negated(F.col("h"), F.col("h.m"))).alias("negated"))


NEGATION_SQL = f"SELECT o_orderkey, {_sql_pick('o_orderkey', *[s[2] for s in SAYINGS])} AS m, {_sql_pick('o_orderkey', *['NULL' if s[3] is None else str(s[3]).lower() for s in SAYINGS])} AS negated FROM orders"
NEGATION_SQL = f"SELECT o_orderkey, m, CASE negated WHEN 'true' THEN true WHEN 'false' THEN false END AS negated FROM ({NEGATION_SQL})"


def scope_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred kind of piece goes first, then the others by place."""
    k = F.col("o_orderkey")
    piece = lambda kind, text, at: F.struct(F.lit(kind).alias("kind"), text.alias("t"), F.lower(text).alias("low"), at.cast("int").alias("at"))
    first, second = F.concat(F.lit(" вес "), (k % 50 + 50).cast("string"), F.lit(" кг")), F.when(k % 3 > 0, F.concat(F.lit("вес "), (k % 40 + 40).cast("string"), F.lit(" кг"))).otherwise(F.lit("рост"))
    noisy = F.concat(F.lit("вес "), k.cast("string"), F.lit(" кг"))
    pieces = F.array(piece("therapy", noisy, F.lit(0)), piece("header", first, F.lit(100)), piece("exam", second, F.lit(200)))
    rule = search.Rule("weight", r"вес\s+(\d+)\s+кг", (("exam",), ("header", "exam")), ("вес",))
    hit = search.head(search.scan(pieces, (rule,)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", hit.alias("h")).select("o_orderkey", F.col("h.g")[0].alias("value"), F.col("h.at").cast("long").alias("at"))


SCOPE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 40 + 40 AS VARCHAR) ELSE CAST(o_orderkey % 50 + 50 AS VARCHAR) END AS value, CAST(CASE WHEN o_orderkey % 3 > 0 THEN 200 ELSE 101 END AS BIGINT) AS at FROM orders"


def sentence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts with numbers and degrees, and where they begin."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("ФВ 4"), F.lit("."), (k % 10).cast("string"), F.lit(" см. "), _pick(k, "ХСН 2 ст. есть", "Отёк; боль", "Отёк\nболь"), F.lit(". Конец"))
    piece = F.array(F.struct(F.lit("x").alias("kind"), text.alias("t"), F.lower(text).alias("low"), F.lit(10).alias("at")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(search.sentences(piece, "s")).alias("n", "s"))
    return rows.select("o_orderkey", F.col("n").cast("long").alias("n"), F.col("s.t").alias("t"), F.col("s.at").cast("long").alias("at"))


_FIRST = "'ФВ 4.' || (o_orderkey % 10) || ' см'"
SENTENCE_SQL = f"""
SELECT o_orderkey, CAST(0 AS BIGINT) AS n, {_FIRST} AS t, CAST(10 AS BIGINT) AS at FROM orders
UNION ALL SELECT o_orderkey, 1, {_sql_pick("o_orderkey", " ХСН 2 ст", " Отёк", " Отёк")}, 20 FROM orders
UNION ALL SELECT o_orderkey, 2, {_sql_pick("o_orderkey", " есть", " боль", "боль")}, {_sql_pick("o_orderkey", 30, 26, 26)} FROM orders
UNION ALL SELECT o_orderkey, 3, ' Конец', {_sql_pick("o_orderkey", 36, 32, 31)} FROM orders
"""


def norm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numbers, phrases, look-alike letters, comparable values."""
    k = F.col("o_orderkey")
    roman = _pick(k, " iv ", "ІІ", "V", "7")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", normal.arabic(roman).alias("arabic"), normal.phrase(F.concat(F.lit(" -умеренная   регургитация "), k.cast("string"), F.lit(" ст.; "))).alias("phrase"), normal.latin(_pick(k, "і21.4", "Н10", "С34")).alias("latin"),
        normal.stage_letter(_pick(k, "a", "Б", "B")).alias("letter"), normal.comparable(F.concat(F.lit(" Ёж  №"), k.cast("string"), F.lit(". "))).alias("comparable"), normal.squash(F.concat(F.lit(" A\n\tB "), k.cast("string"))).alias("squash"),
    )


WORDS_SQL = f"""
SELECT o_orderkey, {_sql_pick("o_orderkey", "4", "2", "5", "7")} AS arabic, 'Умеренная регургитация ' || o_orderkey || ' ст.' AS phrase, {_sql_pick("o_orderkey", "I21.4", "H10", "C34")} AS latin,
  {_sql_pick("o_orderkey", "А", "Б", "Б")} AS letter, 'еж №' || o_orderkey AS comparable, 'a b ' || o_orderkey AS squash FROM orders
"""

# --- contract, verification, scoring


def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with results: groups and keys that are missing, extra or no object, and values (V1, V4)."""
    k = F.col("event_id")
    whole = F.create_map(*[F.lit(x) if isinstance(x, str) else x for g, fields in contract.GROUPS.items() for x in (g, F.create_map(*[F.lit(y) for f in fields for y in (f, contract.default(f))]))])
    ecg = "ЭКГ"
    changed = F.map_from_arrays(F.map_keys(whole), F.map_values(whole))
    odd = F.map_concat(F.map_filter(whole, lambda g, v: g != ecg), F.create_map(F.lit("лишняя"), F.create_map(F.lit("a"), F.lit("b"))))
    value = F.transform_values(whole, lambda g, v: F.when(g == ecg, F.map_concat(F.map_filter(v, lambda f, x: f != "ecg_bpm"), F.create_map(F.lit("ecg_x"), F.lit("1")))).otherwise(v))
    none = F.transform_values(whole, lambda g, v: F.when(g != ecg, v))
    result = F.when(k % 5 == 0, changed).when(k % 5 == 1, odd).when(k % 5 == 2, value).when(k % 5 == 3, none)
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(contract.violations(result), ";").alias("violations"))


VIOLATION_SQL = f"SELECT event_id, {_sql_pick('event_id', '', 'missing_group:ЭКГ;extra_group:лишняя', 'missing_key:ecg_bpm;extra_key:ecg_x', 'group_not_object:ЭКГ', 'root_not_object')} AS violations FROM events"


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as the nested contract and back, as JSON (V5, K1)."""
    k = F.col("o_orderkey")
    nested = contract.nest(F.create_map(F.lit("killip"), (k % 4 + 1).cast("string"), F.lit("crea"), k.cast("string")))
    back = contract.flatten(F.from_json(F.to_json(nested), contract.RESULT))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", back.alias("b"))
    return rows.select("o_orderkey", F.size("b").cast("long").alias("n"), F.col("b")["killip"].alias("killip"), F.col("b")["crea"].alias("crea"), F.col("b")["ca_fact"].alias("ca_fact"), F.col("b")["bp"].alias("bp"))


NESTED_SQL = "SELECT o_orderkey, CAST(50 AS BIGINT) AS n, CAST(o_orderkey % 4 + 1 AS VARCHAR) AS killip, CAST(o_orderkey AS VARCHAR) AS crea, 'N' AS ca_fact, 'не указано' AS bp FROM orders"


def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose value or quotation is wrong, or stands elsewhere (V2, V3)."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Заказ "), k.cast("string"), F.lit(". ЧСС 70 в минуту"))
    at = F.instr(text, "ЧСС") - 1
    quote = _pick(k, "ЧСС 70", "чсс   70", "ЧСС 70", "ЧСС 99", "ЧСС 70")
    finding = F.struct(_pick(k, "70", "70", "много", "70", "70").alias("value"), quote.alias("evidence"), F.when(k % 5 == 4, 0).otherwise(at).cast("int").alias("start"), F.when(k % 5 == 4, 6).otherwise(at + 6).cast("int").alias("end"), F.lit("llm").alias("source"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), F.create_map(F.lit("bpm"), finding.cast(contract.FINDING)).alias("f")).withColumn("j", verify.judged(F.col("text"), F.col("f")))
    f = F.col("j.fields")["bpm"]
    return rows.select("o_orderkey", f["value"].alias("value"), f["evidence"].alias("evidence"), f["start"].cast("long").alias("start"), f["source"].alias("source"), F.array_join("j.warnings", ";").alias("warnings"))


_GOOD = "o_orderkey % 5 IN (0, 1, 4)"
JUDGED_SQL = f"""
SELECT o_orderkey, CASE WHEN {_GOOD} THEN '70' ELSE 'не указано' END AS value, CASE WHEN {_GOOD} THEN 'ЧСС 70' ELSE '' END AS evidence, CAST(CASE WHEN {_GOOD} THEN length('Заказ ' || o_orderkey || '. ') ELSE -1 END AS BIGINT) AS start,
  CASE WHEN {_GOOD} THEN 'llm' ELSE 'default' END AS source, {_sql_pick("o_orderkey", "", "", "bad_format:bpm", "evidence_not_found:bpm", "")} AS warnings FROM orders
"""


def score_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, filled and quoted shares over all expected documents (Q1-Q3, Q9)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    value = F.when(F.col("quality") == 1, "1").otherwise("0")
    pred = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", F.lit("dm").alias("field"), value.alias("value"), F.when(F.col("doc_id") % 2 == 0, "q").otherwise("").alias("evidence"), (F.col("toxic") == 0).alias("valid"))
    return score.rates(docs, pred)


RATES_SQL = """
WITH p AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), r AS (SELECT d.doc_id, p.quality, coalesce(p.toxic = 0, false) AS good FROM documents d LEFT JOIN p USING (doc_id))
SELECT count(*) AS documents, count(*) FILTER (good) AS valid, round(count(*) FILTER (good) / count(*), 4) AS valid_json, round(count(*) FILTER (good AND quality = 1) / (count(*) FILTER (good) * 50.0), 4) AS fill_rate,
  round(count(*) FILTER (good AND quality = 1 AND doc_id % 2 = 0) / count(*) FILTER (good AND quality = 1), 4) AS evidence_rate FROM r
"""


def gold_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and gold values of all fifty fields, defaults where either has none."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    pred = orders.select("doc_id", F.lit("crea").alias("field"), (F.col("doc_id") % 7).cast("string").alias("value"))
    gold = orders.filter("doc_id % 2 = 0").select("doc_id", F.lit("crea").alias("field"), F.concat((F.col("doc_id") % 5).cast("string"), F.lit(",0")).alias("value"))
    return score.accuracy(score.compared(pred, gold)).filter("level <> 'field' or name in ('crea', 'dm')")


COMPARED_SQL = """
WITH r AS (SELECT (o_orderkey % 7 = o_orderkey % 5)::INT AS ok FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT count(*) AS n, sum(ok) AS ok FROM r),
g AS (SELECT * FROM (VALUES ('даты эпизода', 2, 0), ('диагноз', 11, 0), ('осмотр при поступлении', 8, 0), ('ЭКГ', 4, 0), ('ЭХО-КГ', 5, 0), ('рентген грудной полости', 2, 0), ('коронарография', 4, 0), ('Лабораторные данные', 8, 1), ('медикаментозная терапия', 6, 0)) AS t(name, f, own))
SELECT 'all' AS level, 'all' AS name, n * 50 AS n, round((n * 49 + ok) / (n * 50.0), 4) AS accuracy FROM s
UNION ALL SELECT 'group', name, n * f, round((n * (f - own) + own * ok) / (n * f * 1.0), 4) FROM s, g
UNION ALL SELECT 'field', 'crea', n, round(ok / n, 4) FROM s UNION ALL SELECT 'field', 'dm', n, 1.0 FROM s
"""


def warning_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a batch, unknown headings as one kind, and kinds of sections by documents (Q7, Q8)."""
    k = F.col("o_orderkey")
    made = _table(spark, sf_dir, "orders").select(
        F.array(F.concat(F.lit("unknown_heading:"), k.cast("string")), _pick(k, "missing_section_ecg", "residual_fio")).alias("audit"), F.array(F.struct(_pick(k, "ecg", "echo", "ca").alias("kind")), F.struct(F.lit("ecg").alias("kind"))).alias("sections")
    )
    return process.warning_counts(made).select(F.col("warning").alias("name"), "n").unionByName(process.section_counts(made).select(F.col("kind").alias("name"), F.col("documents").alias("n")))


WARNING_SQL = """
SELECT 'unknown_heading' AS name, count(*) AS n FROM orders UNION ALL SELECT CASE o_orderkey % 2 WHEN 0 THEN 'missing_section_ecg' ELSE 'residual_fio' END, count(*) FROM orders GROUP BY 1
UNION ALL SELECT 'ecg', count(*) FROM orders UNION ALL SELECT CASE o_orderkey % 3 WHEN 1 THEN 'echo' ELSE 'ca' END, count(*) FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1
"""


def batch_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the log for every input: processed, cached or failed."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, "empty_document").alias("error"))
    done = docs.filter("error is null and doc_id % 3 > 0").select("doc_id", F.lit("ok").alias("status"), F.array(F.lit("w")).alias("warnings"), F.create_map(F.lit("dm"), F.struct(F.when(F.col("doc_id") % 2 == 0, "rule").otherwise("default").alias("source"))).alias("fields"))
    log = process.batch_log(docs, done)
    return log.select("doc_id", "status", "error", F.col("filled").cast("string").alias("filled"), F.array_join("warnings", ",").alias("warnings"))


STATUS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'empty_document' END AS error,
  CASE WHEN doc_id % 7 > 0 AND doc_id % 3 > 0 THEN CAST(CAST(doc_id % 2 = 0 AS INT) AS VARCHAR) END AS filled, CASE WHEN doc_id % 7 > 0 AND doc_id % 3 > 0 THEN 'w' END AS warnings FROM documents
"""


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    finding = F.struct(F.lit("1").alias("value"), F.col("source").alias("evidence"), F.lit(0).alias("start"), F.length("source").alias("end"), F.lit("rule").alias("source"))
    return _table(spark, sf_dir, "documents").select(
        d.cast("string").alias("doc_id"), F.concat(d.cast("string"), F.lit(".md")).alias("name"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("anon_text"), F.when(d % 5 == 0, "failed").otherwise("ok").alias("status"), F.array().cast("array<string>").alias("warnings"), F.create_map(F.lit("dm"), finding).alias("fields")
    )


def _joined(tables: dict[str, DataFrame]) -> DataFrame:
    joined = sinks.joined(*(tables[t] for t in ("documents", "extractions", "results")))
    value = F.col("fields")["dm"]
    return joined.select("filename", "status", value["value"].alias("value"), value["evidence"].alias("evidence"), F.get_json_object("json", "$.диагноз.dm").alias("dm"), F.get_json_object("json", "$.диагноз.copd").alias("copd"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of the store, made from processed documents and joined again."""
    return _joined(sinks.store_tables(_processed(spark, sf_dir)))


STORED_SQL = "SELECT doc_id || '.md' AS filename, 'ok' AS status, '1' AS value, source AS evidence, '1' AS dm, '0' AS copd FROM documents WHERE doc_id % 5 <> 0"


def read_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in several encodings, with every error, as a directory scan hands them over."""
    k, t = F.col("doc_id"), F.concat(F.lit("текст "), F.col("doc_id").cast("string"), F.lit("\r\nконец"))
    name = F.concat(k.cast("string"), _pick(k, ".md", ".TXT", ".txt", ".pdf", ".docx", ".md", ".md", ".txt"))
    content = F.get(F.array(t.cast("binary"), F.encode(t, "UTF-16"), F.concat(F.unhex(F.lit("EFBBBF")), t.cast("binary")), t.cast("binary"), t.cast("binary"), F.lit("a\0b").cast("binary"), F.lit(" \n").cast("binary"), F.unhex(F.lit("FFFE61"))), F.pmod(k, F.lit(8)).cast("int"))
    return read_files(_table(spark, sf_dir, "documents").select(name.alias("name"), content.alias("content"))).select("doc_id", "encoding", "sha256", "error")


ENCODING_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_sql_pick("doc_id", "utf-8", "utf-16", "utf-8-sig", None, None, None, None, None)} AS encoding,
  CASE WHEN doc_id % 8 < 3 THEN sha256('текст ' || doc_id || chr(10) || 'конец') END AS sha256, {_sql_pick("doc_id", None, None, None, "unsupported_extension", "bad_docx", "binary_content", "empty_document", "unknown_encoding")} AS error FROM documents
"""

# --- long tables

STEP, SIGN, CAPITAL, REACH = 97, "[.;,\\n]", "[A-Z]", 400


def line_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds each of a text's positions: tiles joined to positions by bins and a sweep (G9 over a long table)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tiles = intervals.line_offsets(docs, "doc_id", "text").withColumn("end", F.col("start") + F.col("length") + 1)
    positions = docs.filter(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(STEP).cast("long"))).alias("at"))
    return intervals.tile_at(positions, tiles, "doc_id", "at", "start", "end", ["line_no"]).select("doc_id", "at", F.col("line_no").cast("long").alias("line_no"))


LINE_AT_SQL = f"""
WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), {STEP})) AS "at" FROM documents)
SELECT doc_id, "at", length(substring(text, 1, "at")) - length(replace(substring(text, 1, "at"), chr(10), '')) AS line_no FROM p
"""


def section_kinds_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that holds each of a summary's positions."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Шапка\nДиагноз: "), F.repeat(F.lit("боль "), F.pmod(k, F.lit(7)).cast("int")), F.lit("\nЖалобы\n"), F.repeat(F.lit("а"), F.pmod(k, F.lit(11)).cast("int")), F.lit("\nЭКГ: норма"))
    docs = _table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("anon_text"))
    positions = docs.select("doc_id", F.explode(F.sequence(F.lit(-1).cast("long"), F.length("anon_text").cast("long"), F.lit(9).cast("long"))).alias("at"))
    found = sections.section_at(sections.segment(docs), positions)
    return found.select(F.col("doc_id").alias("o_orderkey"), "at", "kind", F.col("section_start").cast("long").alias("start"))


SECTION_AT_SQL = """
WITH t AS (SELECT o_orderkey, 6 AS d, 6 + 9 + 5 * (o_orderkey % 7) + 1 AS h, 6 + 9 + 5 * (o_orderkey % 7) + 1 + 7 + o_orderkey % 11 + 1 AS e FROM orders),
s AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS bare, e + 10 AS n FROM t),
p AS (SELECT *, unnest(range(-1, n + 1, 9)) AS "at" FROM s)
SELECT o_orderkey, "at", CASE WHEN "at" < 0 OR "at" >= n THEN NULL WHEN "at" < d THEN 'header' WHEN "at" < h THEN 'diagnosis' WHEN "at" < e THEN 'history' ELSE 'ecg' END AS kind,
  CAST(CASE WHEN "at" < 0 OR "at" >= n THEN NULL WHEN "at" < d THEN 0 WHEN "at" < h THEN d WHEN "at" < e THEN h ELSE e END AS BIGINT) AS start FROM p
"""


def left_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capital letter of a text, where its clause begins: the last sign before it, by an as-of join (X7 over long tables)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = lambda sign: intervals.line_offsets(docs, "doc_id", "text", sign).filter("line_no > 0").select("doc_id", (F.col("start") - 1).alias("at"), F.col("start").alias("end"))
    return intervals.left_bounds(ends(CAPITAL).drop("end"), ends(SIGN), "doc_id", "at", REACH)


LEFT_SQL = rf"""
WITH c AS (SELECT doc_id, text, unnest(string_split_regex(text, '{CAPITAL}')) AS part, generate_subscripts(string_split_regex(text, '{CAPITAL}'), 1) AS i FROM documents),
p AS (SELECT doc_id, text, i, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS "at" FROM c),
m AS (SELECT doc_id, "at", greatest("at" - {REACH}, 0) AS lo, substring(text, greatest("at" - {REACH}, 0) + 1, "at" - greatest("at" - {REACH}, 0)) AS before FROM p WHERE "at" < length(text))
SELECT doc_id, "at", "at" - length(regexp_extract(before, '[^.;,\n]*\z')) AS "left" FROM m
"""

# --- scopes of whole summaries


def therapy_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries whose drugs stand under recommendations, under treatment alone, under both, or under no heading, with values of
    each customer's own, through masking, sections, rules and verification (T1-T3, and documents without headings)."""
    k = F.col("c_custkey")
    dose, pulse = (F.pmod(k, F.lit(80)) + 10).cast("string"), (F.pmod(k, F.lit(90)) + 50).cast("string")
    drug = F.concat(F.lit("аспирин "), dose, F.lit(" мг утром"))
    other = F.concat(F.lit("аспирин "), F.lit("5"), F.lit(" мг"))
    lead = F.concat(F.lit("Выписка. Поступил 02.03.2023, выписан 09.03.2023. АД 130/80, пульс "), pulse, F.lit(". На ЭКГ синусовый ритм, ЧСС "), pulse, F.lit("."))
    text = F.get(F.array(
        F.concat(lead, F.lit("\nРекомендации:\n"), drug, F.lit("; диета")),
        F.concat(lead, F.lit("\nЛечение: "), drug, F.lit("; покой")),
        F.concat(lead, F.lit("\nЛечение: "), other, F.lit("\nРекомендации: "), drug, F.lit("; диета")),
        F.concat(lead, F.lit("\nЛечение: "), other, F.lit("\nРекомендации: диета")),
        F.concat(lead, F.lit(" Получал: "), drug, F.lit("; выписан домой")),
    ), F.pmod(k, F.lit(5)).cast("int"))
    docs = read_table(spread(_table(spark, sf_dir, "customer")).select(k.alias("doc_id"), text.alias("text")))
    done = process.process(docs)
    value = lambda f: F.col("fields")[f]["value"].alias(f)
    return done.select("doc_id", value("aspirin"), value("admission_date"), value("discharge_date"), value("bp"), value("bpm"), value("ecg_bpm"), value("ecg_rythm"))


THERAPY_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 5 = 3 THEN 'не указано' WHEN c_custkey % 5 = 4 THEN 'не указано' ELSE 'Аспирин ' || (c_custkey % 80 + 10) || ' мг утром' END AS aspirin,
  '02.03.2023' AS admission_date, '09.03.2023' AS discharge_date, '130/80' AS bp, CAST(c_custkey % 90 + 50 AS VARCHAR) AS bpm, CAST(c_custkey % 90 + 50 AS VARCHAR) AS ecg_bpm, 'синусовый' AS ecg_rythm FROM customer
"""

# --- failures, answers and the store

_XML = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>ЭКГ: норма</w:t></w:r></w:p></w:body></w:document>'


def _office(head: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), head + _XML)
    return out.getvalue()


def isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files of an unknown encoding among good ones and texts: each failure stays in its row."""
    k = F.col("doc_id")
    kind = F.pmod(k, F.lit(5)).cast("int")
    name = F.concat(k.cast("string"), F.when(kind < 3, ".docx").otherwise(".txt"))
    files = [F.lit(_office('<?xml version="1.0" encoding="no-such-code"?>')), F.lit(_office('<?xml version="1.0"?>')), F.lit(b"PK no archive"), F.col("text").cast("binary"), F.lit(b" ")]
    found = read_files(_table(spark, sf_dir, "documents").select(name.alias("name"), F.get(F.array(*files), kind).alias("content")))
    done = process.process(found)
    return done.select("doc_id", "status", "error", F.col("fields")["dm"]["value"].alias("dm"), F.col("encoding"))


ISOLATED_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 5 IN (1, 3) THEN 'ok' ELSE 'failed' END AS status, {_sql_pick("doc_id", "extract:LookupError", None, "bad_docx", None, "empty_document")} AS error, '0' AS dm,
  {_sql_pick("doc_id", None, "docx", None, "utf-8", None)} AS encoding FROM documents
"""


class ScriptedClient:
    """A model that finds the first number of a text, and fails as the number says."""

    def chat(self, messages: list[dict], schema: dict) -> str:
        asked = json.loads(messages[1]["content"])
        n = int(re.search(r"\d+", asked["text"])[0])
        if n % 5 == 1:
            raise ArithmeticError
        if n % 5 == 2:
            return "no JSON"
        if n % 5 == 3:
            raise model_fill.ModelUnavailable("TimeoutError")
        quote = f"пульс {n % 90 + 40}" if n % 5 == 0 else "пульс, которого нет в тексте"
        value = {"value": str(n % 90 + 40), "evidence": quote}
        return json.dumps({f: value if f == "ecg_bpm" else {"value": contract.default(f), "evidence": ""} for f in asked["fields"]})


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers with and without quotations, half answers, an absent model and failures, through the answer table."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<struct<field:string,value:string,evidence:string,start:int,end:int,source:string>>")
    text = F.concat(F.lit("Запись "), k.cast("string"), F.lit(": пульс "), F.pmod(k, F.lit(90)) + 40, F.lit(" в минуту"))
    docs = _table(spark, sf_dir, "orders").select(k, text.alias("anon_text"), none.alias("found"))
    done = model_fill.fill(docs, ScriptedClient, shared_folder(spark, "answers"), "scripted", pause=0.0)
    first = F.get("found", F.lit(0))
    return done.select("o_orderkey", F.size("found").cast("long").alias("n_found"), first["value"].alias("ecg_bpm"), first["start"].cast("long").alias("start"), first["evidence"].alias("evidence"), "model_warning", "model_failure")


MODEL_SQL = f"""
SELECT o_orderkey, CAST(o_orderkey % 5 = 0 AS BIGINT) AS n_found, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 90 + 40 AS VARCHAR) END AS ecg_bpm,
  CASE WHEN o_orderkey % 5 = 0 THEN 9 + length(CAST(o_orderkey AS VARCHAR)) END AS start, CASE WHEN o_orderkey % 5 = 0 THEN 'пульс ' || (o_orderkey % 90 + 40) END AS evidence,
  {_sql_pick("o_orderkey", None, None, "llm_partial", "llm_unavailable:TimeoutError", "llm_partial")} AS model_warning, {_sql_pick("o_orderkey", None, "extract:ArithmeticError", None, None, None)} AS model_failure FROM orders
"""


def saved_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a part, the whole, and the whole again were saved: each document once, with its fields and result."""
    tables = sinks.store_tables(_processed(spark, sf_dir))
    where = shared_folder(spark, "store")
    part = tables["documents"].filter(F.col("filename") < "5")
    of_part = lambda t: t.join(part.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    sinks.save({"documents": part, "extractions": of_part(tables["extractions"]), "results": of_part(tables["results"])}, where)
    for _ in range(2):
        sinks.save(tables, where)
    return _joined({name: spark.read.parquet(f"{where}/{name}") for name in sinks.KEYS})


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and evidence as one file a document, and the list of failures, written and read again (K1, K2, K3, K5)."""
    done, folder = _processed(spark, sf_dir), shared_folder(spark, "files")
    sinks.write_files(sinks.result_json(done), f"{folder}/result")
    sinks.write_files(sinks.evidence_json(done), f"{folder}/evidence")
    sinks.write_failures(done.withColumn("error", F.concat(F.lit("code:"), "name")), f"{folder}/failed")
    files = lambda kind: sinks.read_named(spark, f"{folder}/{kind}", ".json").select(F.col("name").alias("doc_id"), F.col("content").alias(kind))
    failed = spark.read.option("header", True).csv(f"{folder}/failed")
    rows = files("result").join(files("evidence"), "doc_id", "left").join(failed, "doc_id", "left")
    of = lambda column, path: F.get_json_object(column, path)
    return rows.select("doc_id", of("result", "$.диагноз.dm").alias("dm"), of("result", "$.диагноз.copd").alias("copd"), of("evidence", "$.sha256").alias("sha256"), of("evidence", "$.fields.dm.evidence").alias("evidence"), "error")


FILES_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, '1' AS dm, '0' AS copd, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 5 <> 0 THEN source END AS evidence,
  CASE WHEN doc_id % 5 = 0 THEN 'code:' || doc_id || '.md' END AS error FROM documents
"""


def read_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as files of a folder, with hidden, locked, foreign and too large ones among them, scanned and read."""
    k, folder = F.col("doc_id"), shared_folder(spark, "folder")
    kind = F.pmod(k, F.lit(9)).cast("int")
    before, after = F.get(F.array(*map(F.lit, ("", "", "", ".", "~$", "", "", "", ""))), kind), F.get(F.array(*map(F.lit, (".md", ".TXT", ".txt", ".md", ".md", ".pdf", ".docx", ".md", ".md"))), kind)
    content = F.when((kind == 7) & (k % 10 == 7), F.repeat("text", F.ceil(2_000_001 / F.greatest(F.octet_length("text"), F.lit(1))).cast("int"))).when(kind == 8, F.replace("text", F.lit(" "), F.lit("\r\n"))).otherwise(F.col("text"))
    files = _table(spark, sf_dir, "documents").select(F.concat(before, k.cast("string"), after).alias("name"), content.alias("content"))
    sinks.write_named(files, folder)
    return read_directory(spark, folder).select("doc_id", "name", "encoding", "sha256", "error")


_TOO_LARGE = "(doc_id % 9 = 7 AND doc_id % 10 = 7 AND text <> '')"
FOLDER_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || {_sql_pick("doc_id", ".md", ".TXT", ".txt", "", "", "", ".docx", ".md", ".md")} AS name, CASE WHEN doc_id % 9 <> 6 AND NOT {_TOO_LARGE} THEN 'utf-8' END AS encoding,
  CASE WHEN doc_id % 9 = 6 OR {_TOO_LARGE} THEN NULL WHEN doc_id % 9 = 8 THEN sha256(replace(text, ' ', chr(10))) ELSE sha256(text) END AS sha256,
  CASE WHEN doc_id % 9 = 6 THEN 'bad_docx' WHEN {_TOO_LARGE} THEN 'document_too_large' END AS error
FROM documents WHERE doc_id % 9 NOT IN (3, 4, 5)
"""

# code pages of old exports, and the letters of Latin prose as Russian ones of like frequency; bytes of a code page are written as Latin-1
PAGES = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")
LATIN, RUSSIAN = "etaoinshrdlcumwfgypbvkjxqz", "оеаинтсрвлкмдпуяыьгзбчйхжш"


def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in Russian letters, in four legacy code pages and in UTF-8 with letters taken apart."""
    k, both = F.col("doc_id"), (LATIN + LATIN.upper(), RUSSIAN + RUSSIAN.upper())
    plain = F.concat(F.lit("Явка в отделение: "), F.translate(F.regexp_replace("text", r"[^A-Za-z \n.,]", ""), *both))
    coded = [F.encode(F.translate(plain, both[1], both[1].encode(p).decode("latin-1")), "ISO-8859-1") for p in PAGES]
    content = F.get(F.array(*coded, F.replace(plain, F.lit("й"), F.lit("и\u0306")).cast("binary")), F.pmod(k, F.lit(5)).cast("int"))
    return read_files(_table(spark, sf_dir, "documents").select(F.concat(k.cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))).select("doc_id", "encoding", "sha256", "error")


PAGES_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_sql_pick("doc_id", *PAGES, "utf-8")} AS encoding, sha256('Явка в отделение: ' || translate(regexp_replace(text, '[^A-Za-z \n.,]', '', 'g'), '{LATIN + LATIN.upper()}', '{RUSSIAN + RUSSIAN.upper()}')) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents
"""


def approximate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations with a letter left out and one replaced, found again in the whole page (V2c); tested against all windows."""
    letters = lambda a, n: F.substring("html", a, n)
    rows = _table(spark, sf_dir, "pages").select("page_id", "html", F.concat(letters(120, 14), letters(135, 24), F.lit("#"), letters(160, 20)).alias("quote"))
    found = verify.locate(rows, "html", "quote", "at", "error")
    return found.select("page_id", F.col("at.start").alias("start"), F.col("at.end").alias("end"), "error")


PAIRS: tuple[tuple[Query, str], ...] = (
    (section_tiles, SECTION_SQL), (section_audit, AUDIT_SQL), (personal_lines, PERSONAL_SQL), (residual_kinds, RESIDUAL_SQL), (spans_in_rows, SPANS_SQL), (clause_negation, NEGATION_SQL), (scope_order, SCOPE_SQL), (sentence_places, SENTENCE_SQL),
    (norm_words, WORDS_SQL), (result_violations, VIOLATION_SQL), (nested_results, NESTED_SQL), (judged_findings, JUDGED_SQL), (score_rates, RATES_SQL), (gold_compared, COMPARED_SQL), (warning_kinds, WARNING_SQL), (batch_statuses, STATUS_SQL),
    (stored_documents, STORED_SQL), (read_encodings, ENCODING_SQL), (line_at, LINE_AT_SQL), (section_kinds_at, SECTION_AT_SQL), (left_boundaries, LEFT_SQL),
    (isolated_failures, ISOLATED_SQL), (model_findings, MODEL_SQL), (saved_twice, STORED_SQL), (code_pages, PAGES_SQL), (therapy_scopes, THERAPY_SQL), (result_files, FILES_SQL), (read_folder, FOLDER_SQL),
)


# tested against brute force
PLAIN: tuple[Query, ...] = (approximate_quotes,)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in (*[q for q, _ in PAIRS], *PLAIN)}


def oracle_sql() -> dict[str, str]:
    return {query.__name__: sql for query, sql in PAIRS}
