"""URL filters: host rules first, then segmented host words and path tokens under multinomial naive Bayes.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; the path what follows up to `?`, `#` or
the end. A rule (host, path) fits its host and all subdomains when the url's path starts with the rule's; of those that fit the
longest wins. Urls without a rule are judged by the method: labels of the host are split into words by a Viterbi search under
a unigram model of the words of all pages' texts, and the words, with the tokens of the path, are scored by naive Bayes, which
learned from the urls that rules judge (over all of them, distributed counts; tokens that the rules themselves name are left
out). Nothing is broadcast by hand or cut short: words, tokens and their weights are tables, and each distinct url is judged once.

Null urls, and urls without `://`, have an empty host and path; no rule fits them. Where no rule fits any url, or all have one
verdict, the priors decide, and `allow` where there are none. Repeated rows are judged alike. A null page_id is an ordinary
value, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, table

LONGEST_LABEL = 63
ALLOW, BLOCK = "allow", "block"
RULES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def unigrams(texts: DataFrame, text: str) -> DataFrame:
    """w, n: how often each word occurs in all texts, markup taken off."""
    plain = F.regexp_replace(F.lower(text), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    return texts.select(F.explode(F.split(plain, "[^a-z]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


class Splitter:
    """Splits a name into words by Viterbi under a unigram model; unknown words cost more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) or 1
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.unknown = math.log(self.total + 1.0)

    def split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(min((best[start][0] + self._price(name[start:end]), start) for start in range(end)))
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        return tuple(reversed(out))

    def _price(self, word: str) -> float:
        return self.cost.get(word, self.unknown + 2.3 * len(word))


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, known = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "known"))
            words = [Splitter({k["w"]: k["n"] for k in ks or () if k["w"]}, total).split(x) for x, ks in zip(labels, known)]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array([list(w) for w in words], pa.list_(pa.string()))], names=["label", "words"])

    return run


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: the words of each host's labels. A label's stretches are priced by a join with all words of the corpus, so that
    no vocabulary is cut short; a label longer than LONGEST_LABEL is no name and stays whole."""
    placed = hosts.select("host", F.explode(F.filter(F.split("host", "[^a-z]+"), lambda x: x != "")).alias("label"))
    labels = placed.select("label").distinct()
    n = F.length("label")
    places = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("label", i, k))))
    stretches = labels.filter(n <= LONGEST_LABEL).select("label", F.explode(F.array_distinct(places)).alias("w"))
    priced = stretches.join(counts, "w").groupBy("label").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    short = labels.filter(n <= LONGEST_LABEL).join(priced, "label", "left").mapInArrow(_split(total), "label string, words array<string>")
    split = durable(short.unionByName(labels.filter(n > LONGEST_LABEL).select("label", F.array("label").alias("words"))))
    return placed.join(split, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, odds (log odds of `block` under the classifier) for each row."""
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumns({"rule": rule, "verdict": verdict})
    sites = durable(rows.groupBy("host", "path", "verdict").agg(F.count(F.lit(1)).alias("times")))
    words = durable(segmented(sites.select("host").distinct(), durable(unigrams(pages, text))))

    # what the rules themselves consist of says nothing about urls that no rule fits
    said = [f"p:{t}" for _, _, p in rules for t in p.split("/") if t] + [f"h:{w}" for _, h, _ in rules for w in h.split(".")]
    part = lambda mark, x: F.concat(F.lit(mark), x)
    paths = F.transform(F.filter(F.split(F.lower("path"), "[^0-9a-z]+"), lambda x: x != ""), lambda x: part("p:", F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))
    hosts = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda x: part("h:", x))
    tokens = F.filter(F.concat(hosts, paths), lambda x: ~x.isin(*said)) if said else F.concat(hosts, paths)
    told = durable(sites.join(words, "host", "left").select("host", "path", "verdict", "times", tokens.alias("tokens")))

    block = (F.col("verdict") == BLOCK).cast("int")
    known = told.filter("verdict is not null").select(F.explode("tokens").alias("token"), (block * F.col("times")).alias("yes"), ((1 - block) * F.col("times")).alias("no"))
    counted = durable(known.groupBy("token").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    docs = {r["verdict"]: r["n"] for r in told.filter("verdict is not null").groupBy("verdict").agg(F.sum("times").alias("n")).collect()}
    prior = math.log((docs.get(BLOCK, 0) + 1) / (docs.get(ALLOW, 0) + 1)) if docs else 0.0
    yes, no, kinds = counted.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0)), F.count(F.lit(1))).first()
    weights = counted.select("token", (F.log((F.col("yes") + 1) / F.lit(float(yes + kinds))) - F.log((F.col("no") + 1) / F.lit(float(no + kinds)))).alias("weight"))
    summed = told.select("host", "path", F.explode("tokens").alias("token")).join(weights, "token").groupBy("host", "path").agg(F.sum("weight").alias("sum"))
    odds = durable(told.select("host", "path").distinct().join(summed, ["host", "path"], "left").select("host", "path", (F.coalesce("sum", F.lit(0.0)) + prior).alias("odds")))

    out = rows.join(odds, ["host", "path"], "left")
    judged = F.coalesce("verdict", F.when(F.col("odds") > 0, BLOCK).otherwise(ALLOW))
    return out.select(F.col("page_id").alias(key), "host", "path", "rule", judged.alias("verdict"), "odds")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
