"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines are the non-blank lines of a text, compared after trimming blanks. Grams of K lines are hashed; of every window of
W grams the rightmost smallest is selected, so two places that share MIN_LINES = K + W - 1 lines in a row select the same
gram at the same offset in both: repeated runs cannot be missed. Selected grams that occur only once are dropped; the
windows around the others are joined by content, and windows that follow one another chain into runs, which is how a match
extends both ways. Shorter runs count too if they have LONG_RUN bytes or more, as passages of fifty words have that stand on
one or two lines: such a run is a fingerprint of its own. A run is kept where it occurs first, in order of (doc_id, line), and deleted wherever it occurs later,
in the same document too.

Very long texts are cut into lines within their row, once, in time in proportion. Null text has no lines and stays null. Blank lines are never compared or deleted. Documents under MIN_LINES lines and
LONG_RUN bytes keep all; a document all of whose lines are later repeats stays as an empty one. A null doc_id sorts first. Rows that repeat both doc_id and text are the same document and are treated alike. Extra columns
are kept by `dedup` and ignored otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, quoted, table

GRAM, WINDOW = 2, 2
MIN_LINES = GRAM + WINDOW - 1
# bytes, without the blanks around lines and the ends of lines, from which on a run counts however few lines it has
LONG_RUN = 200
# before the names of columns that are ours, so that none of the table clashes
OWN = "line dedup "


def _shifted(items: Column, n: int) -> Column:
    """Arrays of n neighbours at each place; those past the end are null."""
    return F.arrays_zip(*[F.slice(items, i + 1, 2**30).alias(f"x{i}") if i else items.alias("x0") for i in range(n)])


def _sized(x: Column, i: Column, n: int) -> Column:
    """The run of n lines in x, which begins at line i."""
    lines = [x[f"x{j}"] for j in range(n)]
    size = functools.reduce(lambda p, q: p + q, [y["size"] for y in lines])
    a, b = F.xxhash64(*[y["a"] for y in lines]), F.xxhash64(*[y["b"] for y in lines])
    return F.struct(i.alias("line"), F.array(*[y["place"] for y in lines]).alias("places"), a.alias("a"), b.alias("b"), size.alias("size"), F.greatest(lines[0]["size"], lines[-1]["size"]).alias("end"))


def windows(docs: DataFrame, key: str, text: str, gram: int, window: int, long: int | None) -> DataFrame:
    """A row for each window: its document, the numbers and places of its lines, the gram it selects, whether the window
    before it selected another one, and its content; and a row for each shorter run of `long` bytes, its content being its gram. A run that has `long` bytes
    without its first line, and without its last, is left out: the two shorter runs repeat wherever it does, and are deleted with
    the same lines. Each array is built once a row, in time linear in the lines."""
    run = gram + window - 1
    t = F.col(text)
    placed = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("place"))), lambda x: x["line"] != "")
    lines = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(t).alias("text_key"),
        F.transform(placed, lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b"), x["place"].alias("place"), F.octet_length(x["line"]).alias("size"))).alias("lines"),
    )
    covered = lambda s: F.lit(False) if long is None else s["size"] - s["end"] >= long
    all_of = lambda x, n, name: [x[f"x{i}"][name] for i in range(n)]
    grams = lines.select(
        "*",
        F.transform(_shifted(F.col("lines"), gram), lambda x, i: F.struct(F.xxhash64(*all_of(x, gram, "a")).alias("g"), (-i).alias("back"))).alias("grams"),
        F.transform(_shifted(F.col("lines"), run), lambda x, i: F.struct(F.xxhash64(*all_of(x, run, "a")).alias("a"), F.xxhash64(*all_of(x, run, "b")).alias("b"), i.alias("line"), F.array(*all_of(x, run, "place")).alias("places"), covered(_sized(x, i, run)).alias("covered"))).alias("runs"),
    )
    picked = grams.select("*", F.transform(_shifted(F.col("grams"), window), lambda x: F.array_min(F.array(*[x[f"x{i}"] for i in range(window)]))).alias("picks"))
    zipped = F.arrays_zip(F.col("runs").alias("run"), F.col("picks").alias("pick"), F.concat(F.array(F.lit(None).cast("struct<g:bigint,back:int>")), F.col("picks")).alias("last"), F.concat(F.array(F.lit(False)), F.transform("runs", lambda x: x["covered"])).alias("gap"))
    whole = F.slice(zipped, F.lit(1), F.greatest(F.lit(0), F.size("lines") - (run - 1)))
    row = lambda line, places, g, fresh, a, b: F.struct(line.alias("line"), places.alias("places"), g.alias("gram"), fresh.alias("fresh"), a.alias("a"), b.alias("b"))
    whole = F.filter(whole, lambda w: ~w["run"]["covered"])
    found = [F.transform(whole, lambda w: row(w["run"]["line"], w["run"]["places"], w["pick"]["g"], F.when((w["last"]["back"] == w["pick"]["back"]) & ~w["gap"], 0).otherwise(1), w["run"]["a"], w["run"]["b"]))]
    for n in range(1, run) if long is not None else ():
        sized = functools.partial(_sized, n=n)
        short = F.transform(_shifted(F.col("lines"), n), lambda x, i: sized(x, i))
        # past the end the size is null, and the run is not there
        heavy = F.filter(short, lambda s: s["size"] >= long)
        heavy = F.filter(heavy, lambda s: ~covered(s)) if n > 1 else heavy
        found.append(F.transform(heavy, lambda s: row(s["line"], s["places"], s["a"], F.lit(1), s["a"], s["b"])))
    return picked.select("key", "text_key", F.explode(F.concat(*found)).alias("w")).select("key", "text_key", "w.*")


def later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, long: int | None = LONG_RUN) -> DataFrame:
    """key, text_key, at: (number among the non-blank lines, place among all lines) of the lines to delete."""
    every = durable(windows(docs, key, text, gram, window, long))
    twice = every.groupBy("gram").agg(F.sum("fresh").alias("n")).filter("n > 1").select("gram")
    near = every.join(twice, "gram")
    place = F.struct("key", "text_key", "line")
    first = near.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("a", "b", "first")
    later = near.join(first, ["a", "b"]).filter(place != F.col("first"))
    each = F.transform("places", lambda p, i: F.struct((F.col("line") + i).alias("n"), p.alias("place")))
    return later.groupBy("key", "text_key").agg(F.array_distinct(F.flatten(F.collect_set(each))).alias("at"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, long: int | None = LONG_RUN) -> DataFrame:
    """docs with `text` less the later repeated runs, and three more columns: lines_before, lines_removed, runs_removed. With
    `long` None only the number of lines counts."""
    found = later_lines(docs, key, text, gram, window, long).select(F.col("key").alias(f"{OWN}key"), F.col("text_key").alias(f"{OWN}text_key"), "at")
    t = F.col(text)
    # the text crosses the join as its lines, once
    rows = docs.withColumns({f"{OWN}hash": F.xxhash64(t), f"{OWN}lines": F.split(t, "\n"), f"{OWN}solid": F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))}).drop(text)
    rows = rows.join(found.withColumnRenamed("at", f"{OWN}at"), F.col(key).eqNullSafe(F.col(f"{OWN}key")) & (F.col(f"{OWN}hash") == F.col(f"{OWN}text_key")), "left")
    numbers = F.transform(f"{OWN}at", lambda x: x["n"])
    kept = F.array_except(F.sequence(F.lit(0), F.size(f"{OWN}lines") - 1), F.transform(f"{OWN}at", lambda x: x["place"]))
    return rows.select(
        *[F.array_join(F.when(F.col(f"{OWN}at").isNull(), F.col(f"{OWN}lines")).otherwise(F.transform(kept, lambda i: F.get(f"{OWN}lines", i))), "\n").alias(text) if c == text else quoted(c) for c in docs.columns],
        F.greatest(F.lit(0), F.coalesce(f"{OWN}solid", F.lit(0))).cast("long").alias("lines_before"),
        F.when(F.col(f"{OWN}at").isNull(), 0).otherwise(F.size(f"{OWN}at")).cast("long").alias("lines_removed"),
        F.when(F.col(f"{OWN}at").isNull(), 0).otherwise(F.size(F.array_except(numbers, F.transform(f"{OWN}at", lambda x: x["n"] + 1)))).cast("long").alias("runs_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("lines_before").alias("n_lines"),
        F.col("lines_removed").alias("n_removed"),
        F.col("runs_removed").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH split_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), solid AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS num
  FROM split_lines WHERE trim(line, ' ') <> ''
), runs AS (
  SELECT doc_id, num, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY num)
), sized AS (
  SELECT doc_id, num, 3 AS n, l1, l2, l3 FROM runs WHERE l3 IS NOT NULL
  UNION ALL SELECT doc_id, num, 2, l1, l2, NULL FROM runs WHERE strlen(l1) + strlen(l2) >= 200
  UNION ALL SELECT doc_id, num, 1, l1, NULL, NULL FROM runs WHERE strlen(l1) >= 200
), ranked AS (
  SELECT doc_id, num, n, row_number() OVER (PARTITION BY n, l1, l2, l3 ORDER BY doc_id, num) AS nth FROM sized
), gone AS (
  SELECT DISTINCT doc_id, num + k AS num FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1 AND k < n
), starts AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p.num IS NULL) AS n_runs
  FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.num = g.num - 1 GROUP BY g.doc_id
), kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS text
  FROM split_lines s LEFT JOIN solid o ON o.doc_id = s.doc_id AND o.pos = s.pos
  LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.num = o.num WHERE g.num IS NULL GROUP BY s.doc_id
), counts AS (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_runs, 0) AS n_runs,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN starts s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
