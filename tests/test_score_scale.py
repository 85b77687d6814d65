"""Predicted and gold values: only what is given is joined, whatever the number of fields."""

from pyspark.sql import functions as F

from medspan.functions.contract import FIELDS, NOT_FOUND
from medspan.plans import score

SCHEMA = "doc_id long, field string, value string"


def test_fields_on_neither_side_are_not_joined(spark):
    pred = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("crea").alias("field"), F.lit("1").alias("value"))
    shuffled = score.compared(pred, pred)._jdf.queryExecution().optimizedPlan().toString()
    # the fields are laid out after the last join and grouping: no join and no exchange carries fifty rows a document
    assert shuffled.index("Generate") < shuffled.index("Aggregate") < shuffled.index("Join")
    assert score.accuracy(score.compared(pred, pred)).filter("level = 'all'").first()["n"] == 40 * len(FIELDS)


def test_compared_as_by_plain_joins(spark):
    """Repeated values multiply, unknown fields and null ids drop out, null values count as missing, numbers go by value."""
    pred = [(1, "crea", "7"), (1, "crea", "8"), (1, "hb", None), (2, "odd", "x"), (3, "dm", "1"), (None, "dm", "1"), (4, None, "1"), (5, "bp", "Ёж.")]
    gold = [(1, "crea", "7,0"), (1, "glu", "5"), (2, "dm", "1"), (9, "dm", "1"), (None, "dm", "1"), (4, "hb", "2"), (5, "bp", "еж"), (5, "bp", "уж")]
    rows = score.compared(spark.createDataFrame(pred, SCHEMA), spark.createDataFrame(gold, SCHEMA)).collect()
    got = sorted((r["doc_id"], r["field"], r["pred"], r["gold"], r["ok"]) for r in rows if r["pred"] != r["gold"])
    assert got == sorted([(1, "crea", "7", "7,0", True), (1, "crea", "8", "7,0", False), (1, "glu", NOT_FOUND, "5", False), (2, "dm", "0", "1", False), (4, "hb", NOT_FOUND, "2", False), (5, "bp", "Ёж.", "еж", True), (5, "bp", "Ёж.", "уж", False)])
    n = {d: sum(r["doc_id"] == d for r in rows) for d in (1, 2, 3, 4, 5, 9)}
    assert n == {1: 51, 2: 50, 3: 0, 4: 50, 5: 51, 9: 0}
    assert all(r["ok"] and r["group_name"] for r in rows if r["pred"] == r["gold"])
