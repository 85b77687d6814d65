"""Scoring predictions against gold values: three levels of accuracy in one pass, and the rates of the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.functions.contract import FIELDS, GROUP_OF, default
from medspan.functions.normal import comparable


def _default_of(field: str):
    out = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.lit(default(f)))])
    return F.try_element_at(out, F.col(field))


def compared(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, group_name, field, pred, gold, ok for the documents that have gold; a missing gold value is the default.

    Only given values are joined and grouped; the fields that a document has on neither side are filled in its row, and equal values
    are not put in comparable form."""
    p = pred.select("doc_id", "field", F.col("value").alias("pred"), F.lit(True).alias("in_pred"))
    g = gold.select("doc_id", "field", F.col("value").alias("gold"), F.lit(True).alias("in_gold"))
    own = F.when(F.col("field").isin(*FIELDS), F.struct("field", "pred", "gold"))
    given = p.join(g, ["doc_id", "field"], "full_outer").filter(F.col("doc_id").isNotNull())
    known = given.groupBy("doc_id").agg(F.collect_list(own).alias("own"), F.bool_or("in_pred").alias("p"), F.bool_or("in_gold").alias("g")).filter("p and g")
    absent = F.array_except(F.array(*[F.lit(f) for f in FIELDS]), F.transform("own", lambda x: x["field"]))
    none = F.lit(None).cast("string")
    every = F.concat("own", F.transform(absent, lambda f: F.struct(f.alias("field"), none.alias("pred"), none.alias("gold"))))
    group = F.create_map(*[F.lit(x) for pair in GROUP_OF.items() for x in pair])
    rows = known.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.field", "x.pred", "x.gold")
    rows = rows.withColumn("default", F.when(F.col("pred").isNull() | F.col("gold").isNull(), _default_of("field")))
    rows = rows.withColumns({"pred": F.coalesce("pred", "default"), "gold": F.coalesce("gold", "default")})
    ok = F.when(F.col("pred") == F.col("gold"), True).otherwise(comparable(F.col("pred")) == comparable(F.col("gold")))
    return rows.select("doc_id", F.try_element_at(group, F.col("field")).alias("group_name"), "field", "pred", "gold", ok.alias("ok"))


def accuracy(rows: DataFrame) -> DataFrame:
    """level (all, group, field), name, n, accuracy. Rows are counted by group and field first, so that only these counts are laid out for the levels."""
    counts = rows.groupBy("group_name", "field").agg(F.count(F.lit(1)).alias("rows"), F.count("ok").alias("told"), F.count_if("ok").alias("right"))
    sets = counts.groupingSets([["group_name"], ["field"], []], "group_name", "field").agg(F.sum("rows").alias("n"), F.round(F.try_divide(F.sum("right").cast("double"), F.sum("told")), 4).alias("accuracy"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "group").otherwise("field")
    return sets.select(level.alias("level"), F.coalesce("field", "group_name", F.lit("all")).alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy")


def mismatches(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("ok")).select("doc_id", "field", "pred", "gold")


def rates(expected: DataFrame, pred: DataFrame) -> DataFrame:
    """documents, valid, valid_json, fill_rate, evidence_rate. pred: doc_id, field, value, evidence, valid (null evidence: none known)."""
    filled = F.col("value") != _default_of("field")
    each = pred.groupBy("doc_id").agg(
        F.bool_and("valid").alias("valid"),
        F.count_if(filled).alias("filled"),
        F.count_if(filled & F.col("evidence").isNotNull()).alias("asked"),
        F.count_if(filled & (F.length("evidence") > 0)).alias("quoted"),
    )
    rows = expected.select("doc_id").join(each, "doc_id", "left")
    good = F.coalesce("valid", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(good).alias("valid"),
        F.round(F.try_divide(F.count_if(good), F.count(F.lit(1))), 4).alias("valid_json"),
        F.round(F.try_divide(F.sum(F.when(good, F.col("filled"))), F.count_if(good) * len(FIELDS)), 4).alias("fill_rate"),
        F.round(F.try_divide(F.sum(F.when(good, F.col("quoted"))), F.sum(F.when(good, F.col("asked")))), 4).alias("evidence_rate"),
    )
