"""The result contract: nine groups, fifty string fields, their defaults and formats, and the checks on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from medspan.functions.search import let

VERSION = "1.0.0"

# The wording, order and formats of the output contract.
NOT_FOUND = "не указано"
GROUPS: dict[str, tuple[str, ...]] = {
    "даты эпизода": ("admission_date", "discharge_date"),
    "диагноз": ("art_hyper", "atr_fibril", "ckd", "copd", "diagnosis_icd", "dm", "hf", "killip", "mi_localisation", "tlt", "type_acs"),
    "осмотр при поступлении": ("bmi", "bp", "bpm", "height", "rr", "smoking", "spo2", "weight"),
    "ЭКГ": ("ecg_avb", "ecg_bpm", "ecg_elevation", "ecg_rythm"),
    "ЭХО-КГ": ("echo_ef", "echo_lvd", "echo_lvd_2", "echo_mr", "echo_zone"),
    "рентген грудной полости": ("rg_date", "rg_pc"),
    "коронарография": ("ca_date", "ca_fact", "ca_lad", "rca"),
    "Лабораторные данные": ("card_trop", "crea", "glu", "hb", "ldl", "leucocytes", "thrombocytes", "tot_chol"),
    "медикаментозная терапия": ("2_aag", "ace_ing_sartan", "anticoagulant", "aspirin", "bb", "statin"),
}
BINARY = ("art_hyper", "atr_fibril", "copd", "dm", "tlt", "ecg_avb", "ecg_elevation")
ENUMS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(BINARY, ("0", "1")),
    "killip": ("1", "2", "3", "4"),
    "mi_localisation": ("A", "I", "L", "N"),
    "type_acs": ("STEMI", "NSTEMI", "NA"),
    "ca_fact": ("Y", "R", "N"),
    "ca_lad": ("0", "1", "2"),
    "rca": ("0", "1", "2"),
}
DATES = ("admission_date", "discharge_date", "rg_date", "ca_date")
NUMBERS = ("bmi", "bpm", "height", "rr", "spo2", "weight", "ecg_bpm", "echo_ef", "echo_lvd", "echo_lvd_2", "crea", "glu", "hb", "ldl", "leucocytes", "thrombocytes", "tot_chol")
FORMATS: dict[str, str] = {
    **dict.fromkeys(DATES, r"\d{2}\.\d{2}\.\d{4}"),
    **dict.fromkeys(NUMBERS, r"\d+(?:\.\d+)?"),
    "bp": r"\d{2,3}/\d{2,3}",
    "diagnosis_icd": r"[A-Z]\d{2}(?:\.\d{1,2})?",
    "ckd": r"ХБП(?: С?\d[АБ]?)?",
}
FORBIDS_NOT_FOUND = (*BINARY, "ca_fact")

GROUP_OF = {field: group for group, fields in GROUPS.items() for field in fields}
FIELDS = tuple(GROUP_OF)
FINDING = "struct<value:string,evidence:string,start:int,end:int,source:string>"
RESULT = StructType([StructField(g, StructType([StructField(f, StringType()) for f in fields])) for g, fields in GROUPS.items()])


def default(field: str) -> str:
    return "0" if field in BINARY else "N" if field == "ca_fact" else NOT_FOUND


# What a field's value must look like, as one pattern a field; fields of free text have none.
PATTERNS = {**{f: "|".join(codes) for f, codes in ENUMS.items()}, **FORMATS}


def _fits(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(f"^(?U:{pattern})\\z"))


# The patterns, each with the fields that it is for: a pattern is a literal, which is compiled once and not for each row.
_SHARED = {pattern: [f for f in PATTERNS if PATTERNS[f] == pattern] for pattern in dict.fromkeys(PATTERNS.values())}


def check(field: Column, value: Column) -> Column:
    """The code of what is wrong with a field's value, or null. A null value is not a string."""
    wrong = F.when(field.isin(*ENUMS), "not_in_enum").otherwise("bad_format")
    absent = F.when(field.isin(*FORBIDS_NOT_FOUND), "not_found_for_binary")
    known = F.when(F.lit(False), True)
    for pattern, fields in _SHARED.items():
        known = known.when(field.isin(*fields), _fits(value, pattern))
    return F.when(value.isNull(), "not_string").when(value == NOT_FOUND, absent).when(~known, wrong)


def check_value(field: str, value: Column) -> Column:
    """`check` for a field that is known beforehand."""
    absent = F.lit("not_found_for_binary" if field in FORBIDS_NOT_FOUND else None).cast("string")
    out = F.when(value.isNull(), "not_string").when(value == NOT_FOUND, absent)
    return out.when(~_fits(value, PATTERNS[field]), "not_in_enum" if field in ENUMS else "bad_format") if field in PATTERNS else out


def problem(field: str, value: str) -> str | None:
    """`check` for one value outside Spark."""
    if value == NOT_FOUND:
        return "not_found_for_binary" if field in FORBIDS_NOT_FOUND else None
    fits = field not in PATTERNS or re.fullmatch(PATTERNS[field], value)
    return None if fits else "not_in_enum" if field in ENUMS else "bad_format"


def nest(flat: Column) -> Column:
    """map(field, value) as the struct of nine groups, in the contract's order; missing fields get their defaults."""
    value = lambda x, f: F.coalesce(F.try_element_at(x, F.lit(f)), F.lit(default(f))).alias(f)
    return let(flat, lambda x: F.struct(*[F.struct(*[value(x, f) for f in fields]).alias(group) for group, fields in GROUPS.items()]))


def flatten(nested: Column) -> Column:
    """The reverse of `nest`: map(field, value)."""
    return let(nested, lambda x: F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[x[GROUP_OF[f]][f] for f in FIELDS])))


def violations(result: Column) -> Column:
    """Everything wrong with map(group, map(field, value)), in the contract's order; empty for a valid result. The result, its groups
    and their names are each computed once."""
    known = F.array(*[F.lit(g) for g in GROUPS])
    tagged = lambda code, names: F.transform(names, lambda k: F.concat(F.lit(code), k))
    none = F.array().cast("array<string>")

    def of_group(values: Column, fields: tuple[str, ...]) -> Column:
        wanted, names = F.array(*[F.lit(f) for f in fields]), F.map_keys(values)

        def code(f: str) -> Column:
            # a field that is not there has no value to be wrong
            there = F.map_contains_key(values, F.lit(f))
            return let(F.try_element_at(values, F.lit(f)), lambda v: F.when(v.isNotNull() | there, F.concat(check_value(f, v), F.lit(f":{f}"))))

        codes = [code(f) for f in fields]
        return F.concat(tagged("missing_key:", F.array_except(wanted, names)), tagged("extra_key:", F.array_except(names, wanted)), F.filter(F.array(*codes), lambda c: c.isNotNull()))

    def of(whole: Column) -> Column:
        names = F.map_keys(whole)
        out = [tagged("missing_group:", F.array_except(known, names)), tagged("extra_group:", F.array_except(names, known))]
        for group, fields in GROUPS.items():
            no_group = F.array(F.lit(f"group_not_object:{group}"))
            found = let(F.try_element_at(whole, F.lit(group)), lambda values: F.when(values.isNull(), no_group).otherwise(of_group(values, fields)))  # noqa: B023
            out.append(F.when(F.map_contains_key(whole, F.lit(group)), found).otherwise(none))
        return F.when(whole.isNull(), F.array(F.lit("root_not_object"))).otherwise(F.concat(*out))

    return let(result, of)
