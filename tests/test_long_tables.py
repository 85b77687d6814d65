"""Tiles, carried values and approximate quotations against plain loops; hot keys are split."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from medspan.functions.search import left_of
from medspan.operators import intervals, sections, verify
from medspan.plans import operator_queries


def test_positions_find_their_tile_and_hot_documents_are_split(spark):
    rng = random.Random(1)
    tiles, asked, want = [], [], {}
    for key in range(4):
        at = rng.randint(0, 9)
        while at < (3000 if key == 0 else 60):
            end = at + rng.choice([0, 1, 2, 9, 70])
            tiles.append((key, at, end, f"t{at}"))
            at = end + rng.choice([0, 0, 3]) + (end == at)
    for key in range(5):
        for at in [None, -3, *range(0, 3100 if key == 0 else 80, 3)]:
            asked += [(key, at, len(asked))]
            want[len(asked) - 1] = next((n for k, s, e, n in tiles if at is not None and k == key and s <= at < e), None)
    positions = spark.createDataFrame(asked, "key long, at long, row long").repartition(3)
    frame = spark.createDataFrame(tiles, "key long, start long, end long, name string")
    found = intervals.tile_at(positions, frame, "key", "at", "start", "end", ["name"], width=16)
    assert {r["row"]: r["name"] for r in found.collect()} == want
    per_task = [r["n"] for r in found.filter("key = 0").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_task) > 1
    none = intervals.tile_at(positions, frame.filter("false"), "key", "at", "start", "end", ["name"])
    assert none.count() == len(asked) and none.filter("name is not null").count() == 0


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_carried_values_cross_slices(spark, width):
    rng = random.Random(2)
    rows = sorted((k, a, rng.choice([None, None, f"v{k}-{a}"])) for k in range(3) for a in rng.sample(range(200), 60))
    got = intervals.carried(spark.createDataFrame(rows, "key long, at long, v string").repartition(3), ["key"], ["at"], "v", "last", width).collect()
    last, want = {}, {}
    for k, a, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[k, a] = last[k]
    assert {(r["key"], r["at"]): r["last"] for r in got} == want


def test_left_bounds_equal_left_of_in_the_row(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaaab;,\n") for _ in range(rng.randint(0, 900))) for _ in range(20)] + ["a" * 900 + "b", ";" + "a" * 399 + "b", ";" + "a" * 400 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = lambda sign: intervals.line_offsets(docs, "doc_id", "text", sign).filter("line_no > 0").select("doc_id", (F.col("start") - 1).alias("at"), F.col("start").alias("end"))
    matches = places("b").drop("end")
    got = intervals.left_bounds(matches, places("[;,\n]"), "doc_id", "at", 400, width=50)
    own = matches.join(docs, "doc_id").select("doc_id", "at", (F.col("at") - F.length(left_of(F.struct(F.col("at").cast("int").alias("s"), F.col("text").alias("t")), "[;,\n]"))).alias("left"))
    rows = lambda x: sorted(tuple(r) for r in x.select("doc_id", "at", "left").collect())
    assert rows(got) == rows(own) and len(rows(got)) > 100


def test_section_at(spark):
    text = "Шапка\nДиагноз: ХОБЛ\nЭКГ: норма"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, anon_text string")
    positions = spark.createDataFrame([(1, i) for i in range(-1, len(text) + 1)] + [(2, 0), (3, 0)], "doc_id long, at int")
    got = {(r["doc_id"], r["at"]): r["kind"] for r in sections.section_at(sections.segment(docs), positions).collect()}
    starts = {"header": 0, "diagnosis": text.index("Диагноз"), "ecg": text.index("ЭКГ")}
    want = lambda at: max((s, k) for k, s in starts.items() if s <= at)[1] if 0 <= at < len(text) else None
    assert got == {(1, i): want(i) for i in range(-1, len(text) + 1)} | {(2, 0): None, (3, 0): None}


def all_windows(text, quote):
    """The definition: every window compared."""
    quote = quote.strip()
    n = len(quote)
    if n < 8 or not text:
        return None
    like = lambda a, b: SequenceMatcher(None, a.lower(), b.lower(), autojunk=False)
    windows = [(like(quote, text[s : s + n + n // 4]).ratio(), -s) for s in range(0, max(1, len(text) - n + 1), max(1, n // 4))]
    ratio, at = max(windows)
    if not ratio:
        return None
    blocks = [b for b in like(quote, text[-at : -at + n + n // 4]).get_matching_blocks() if b.size]
    start, end = -at + blocks[0].b, -at + blocks[-1].b + blocks[-1].size
    return (start, end) if like(quote, text[start:end]).ratio() >= 0.9 else None


def test_near_equals_comparing_all_windows():
    rng, found = random.Random(4), 0
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh", "абвгдежзик лмнопрст"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 260)))
        if rng.random() < 0.4:
            text = text[: rng.randint(1, 30)] * rng.randint(1, 12)
        a = rng.randint(0, max(0, len(text) - 10))
        quote = list(text[a : a + rng.randint(5, 60)])
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(quote) + 1)
            quote[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        quote = "".join(quote).upper() if rng.random() < 0.2 else "".join(quote)
        assert verify.near(text, quote) == all_windows(text, quote)
        found += verify.near(text, quote) is not None
    assert found > 500
    assert verify.near("a" * 200_000, "a" * 50 + "bbb") == (199_940, 199_990)


def test_approximate_quotes_of_pages_equal_all_windows(spark):
    got = operator_queries.approximate_quotes(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        html = pages[r["page_id"]]
        quote = html[119:133] + html[134:158] + "#" + html[159:179]
        assert (r["start"], r["end"]) == (all_windows(html, quote) or (None, None)) and r["error"] is None
    assert any(r["start"] is not None for r in got)
