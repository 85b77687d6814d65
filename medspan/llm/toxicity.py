"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they stand for, and turns everything that is not
a letter into one blank. The lexicon is learned from labelled rows: whole words and word beginnings that are far more
frequent, by document, among toxic rows than among others. Each entry weighs its smoothed log odds. Near copies of one
document share a min-hash signature and count once, so that a much-copied toxic text does not make all its words lexicon.
A phrase of a lexicon word and a neighbour that clean rows use is an exception: hits inside it do not count.

The score is a logistic function of the summed weight of a text's hits, as such and for each hundred words, fitted to the
same labelled rows. TRAIN_ROWS bounds how many labelled rows are fitted to (those with the smallest hash of their id), and with
them lexicon and exceptions, which have no bound of their own;
everything else covers all rows and whole texts.

Very long texts are folded and scanned whole, in time in proportion; their score is by density as well as by weight. Null text counts as
empty. A text without hits gets the lowest score, an empty one too. Without labelled rows of both classes
every score is the share of toxic labels (0.5 without any). Repeated rows are scored alike. A null doc_id is never in the
training part. Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from medspan.llm.common import quoted, table

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
LEAST_DOCS, LEAST_WEIGHT = 6, 1.5
PREFIXES = (4, 5, 6)

# Letters that look like Latin ones (Cyrillic, Greek, full width), and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
INVISIBLE = "­​‌‍⁠﻿"


def fold(text: Column) -> Column:
    """' word word ' of a text: only letters, between single blanks."""
    pairs = HOMOGLYPHS | WIDE
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(pairs) + INVISIBLE, "".join(pairs.values()))
    # signs that end a word and numbers of their own stand for no letter
    bare = F.regexp_replace(low, r"[@$!|]+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}@$!|])\p{N}+(?![\p{L}\p{N}@$!|])", " ")
    leet = F.translate(bare, "".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(leet, r"[^\p{L}]+", " ")), F.lit(" "))


@dataclass
class Model:
    """entries: ' word ' or ' beginn' to weight; exceptions: ' phrase ' texts; coefficients of (1, weight, density)."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)


def _automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in model.entries.items():
        found.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        found.add_word(phrase, (len(phrase), -1.0))
    if len(found):
        found.make_automaton()
    return found


def _hits(automaton, folded: str) -> float:
    """Summed weight: the best entry for each word that none of the exception phrases covers."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight < 0:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))


def _features(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(model)
        for batch in batches:
            of = batch.schema.get_field_index
            texts = batch.column(of("folded")).to_pylist()
            weight = [_hits(automaton, t) if len(automaton) else 0.0 for t in texts]
            words = [max(1, t.count(" ") - 1) for t in texts]
            kept = [batch.column(of(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.float64()), pa.array(words, pa.int64())], names=[*keep, "weight", "words"])

    return run


def _signature(folded: Column) -> Column:
    """The smallest hash of three neighbouring words: the same, mostly, for near copies."""
    words = F.split(F.trim(folded), " ")
    threes = F.arrays_zip(words.alias("a"), F.slice(words, 2, 2**30).alias("b"), F.slice(words, 3, 2**30).alias("c"))
    return F.array_min(F.transform(threes, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows outside the held-out fold; labels and text are all it sees."""
    fold_of = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))
    chosen = labels.filter((fold_of != HELD_OUT) & F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__k"), "__k", "__y").limit(rows)  # TRAIN_ROWS bounds what is broadcast
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    seen = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__k")).select("__y", fold(F.col("__text")).alias("folded"))
    train = seen.withColumn("__s", _signature(F.col("folded"))).dropDuplicates(["__y", "__s"]).select("__y", "folded").persist()
    try:
        totals = {r["__y"]: r["count"] for r in train.groupBy("__y").count().collect()}
        pos, neg = totals.get(1, 0), totals.get(0, 0)
        if not pos or not neg:
            share = (pos + 1) / (pos + neg + 2)
            return Model(coefficients=(math.log(share / (1 - share)), 0.0, 0.0))
        words = F.array_distinct(F.filter(F.split("folded", " "), lambda w: F.length(w) > 2))
        begins = F.flatten(F.transform(words, lambda w: F.transform(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: F.when(F.length(w) >= n, F.concat(F.lit(" "), F.substring(w, F.lit(1), n))))))
        entries = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), F.filter(begins, lambda x: x.isNotNull())))
        p, n = F.sum("__y"), F.sum(1 - F.col("__y"))
        weight = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
        counted = train.select("__y", F.explode(entries).alias("entry")).groupBy("entry").agg(p.alias("p"), weight.alias("w"))
        top = counted.filter((F.col("p") >= LEAST_DOCS) & (F.col("w") >= LEAST_WEIGHT)).orderBy("entry").collect()
        model = Model(entries={r["entry"]: r["w"] for r in top})
        model.exceptions = _exceptions(train, model)
        return _calibrated(train, model)
    finally:
        train.unpersist()


def _exceptions(train: DataFrame, model: Model) -> list[str]:
    """Pairs of neighbouring words with a hit that two clean rows or more use, and clean rows more than toxic ones."""
    automaton_words = list(model.entries)
    if not automaton_words:
        return []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(Model(entries=model.entries))
        for batch in batches:
            ys, out = [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set()
                for end, (size, _) in automaton.iter(t):
                    start = end - size + 1
                    stop = t.index(" ", start + 1)
                    if before := t[:start].rpartition(" ")[2]:
                        found.add(f" {before}{t[start : stop + 1]}")
                    if after := t[stop + 1 :].partition(" ")[0]:
                        found.add(f"{t[start : stop + 1]}{after} ")
                ys += [y] * len(found)
                out += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.string())], names=["y", "phrase"])

    seen = train.select(F.col("__y").cast("int"), "folded").mapInArrow(pairs, "y int, phrase string")
    clean, toxic = F.sum(1 - F.col("y")), F.sum("y")
    found = seen.groupBy("phrase").agg(clean.alias("clean"), toxic.alias("toxic")).filter("clean >= 2 and clean > 2 * toxic")
    return [r["phrase"] for r in found.orderBy("phrase").collect()]


def _shape(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / words)], axis=1)


def _calibrated(train: DataFrame, model: Model, ridge: float = 0.05, rounds: int = 60) -> Model:
    """Ridge logistic regression by Newton's method on at most TRAIN_ROWS rows of two numbers."""
    got = train.select(F.col("__y").cast("long").alias("y"), "folded").mapInArrow(_features(model, ["y"]), "y long, weight double, words long").toPandas()
    x, y = _shape(got["weight"].to_numpy(), got["words"].to_numpy()), got["y"].to_numpy().astype(float)
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.coefficients = tuple(map(float, b))
    return model


def _probability(model: Model) -> Column:
    a, b, c = (F.lit(float(x)) for x in model.coefficients)
    return 1 / (1 + F.exp(-(a + b * F.log1p("weight") + c * F.log1p(100 * F.col("weight") / F.col("words")))))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and weight, words for each row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), fold(F.col(text)).alias("folded"))
    found = rows.mapInArrow(_features(model, ["key"]), "key long, weight double, words long")
    return found.select(F.col("key").alias(key), _probability(model).alias("score"), "weight", "words")


def keep(docs: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of docs that score under `below`, all columns as they are."""
    carried = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], fold(F.col(text)).alias("folded"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(n, carried.schema[n].dataType) for n in names] + [StructField("weight", DoubleType()), StructField("words", LongType())])
    found = carried.mapInArrow(_features(model, names), schema)
    return found.filter(_probability(model) < below).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
