"""Results are checked and nested with each of their parts computed once, so that the work stays linear in the fields."""

import pytest
from pyspark.sql import functions as F

from medspan.functions import contract


def test_a_result_is_computed_once(spark):
    """A result stands once in the expression, however many fields are checked, nested or flattened."""
    for made in (contract.violations(F.map_from_entries(F.col("given"))), contract.nest(F.map_from_entries(F.col("given"))), contract.flatten(F.col("given"))):
        assert str(made).count("given") == 1
    assert "rlike" in str(contract.check(F.col("f"), F.col("v"))).lower()


@pytest.mark.parametrize("field", contract.FIELDS)
def test_checks_agree(spark, field):
    """The check of a field in a column, of a field that is known, and of one value outside Spark say the same."""
    values = [contract.NOT_FOUND, "0", "1", "4", "7", "A", "STEMI", "Y", "R", "01.02.2023", "1.2.2023", "12", "12.5", "12,5", "140/90", "1/2", "I21.4", "21", "ХБП С3А", "ХБП 3", "", "x\n", "12\n"]
    rows = spark.createDataFrame([(field, v) for v in [*values, None]], "f string, v string")
    got = rows.select("v", contract.check(F.col("f"), F.col("v")).alias("a"), contract.check_value(field, F.col("v")).alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"] == ("not_string" if r["v"] is None else contract.problem(field, r["v"]))


def test_violations_of_odd_results(spark):
    whole = {g: {f: contract.default(f) for f in fields} for g, fields in contract.GROUPS.items()}
    ecg = whole["ЭКГ"]
    odd = [
        (None, ["root_not_object"]), (whole, []), (whole | {"ЭКГ": None}, ["group_not_object:ЭКГ"]),
        (whole | {"ЭКГ": {k: v for k, v in ecg.items() if k != "ecg_avb"} | {"ecg_bpm": None, "ecg_elevation": "2", "y": "1"}}, ["missing_key:ecg_avb", "extra_key:y", "not_string:ecg_bpm", "not_in_enum:ecg_elevation"]),
        ({g: v for g, v in whole.items() if g != "ЭКГ"} | {"z": {}}, ["missing_group:ЭКГ", "extra_group:z"]),
    ]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(odd)], "i int, r map<string,map<string,string>>")
    got = {r["i"]: r["v"] for r in rows.select("i", contract.violations(F.col("r")).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(odd)}
