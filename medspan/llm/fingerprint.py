"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame operations only.

A paragraph (a non-empty line) hashes to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, lane
by lane, modulo powers of two: the order of paragraphs does not matter, and inserting or deleting one adds or subtracts its
vector (`combine`). The vector has two parts. EQUAL_LANES lanes of 32 bits are independent hashes of the whole paragraph:
they decide equality. LIKE_LANES lanes of 16 bits add +1 or -1 for each pair of neighbouring words in the paragraph: sums of
such signs keep angles, so the cosine of two fingerprints estimates how far the texts' word pairs agree. It is computed from
the fingerprints alone.

A very long text is summed paragraph by paragraph, in parts of any size. Null text counts as empty; an empty text's fingerprint is all zeros and is like another empty one only. One-word paragraphs
have the word alone as their pair. Rows are ordered by doc_id descending (nulls last), then by text; repeated rows are
neighbours. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medspan.llm.common import slices, table

EQUAL_LANES, LIKE_LANES = 8, 64
EQUAL_BITS, LIKE_BITS = 32, 16


def _lanes(paragraph: Column, h: Column, at: Column) -> list[Column]:
    """Sums of one row for each word: the equality lanes (once a paragraph), the sign lanes in twos, and the words."""
    once = (at.isNull() | (at == 0)) & (paragraph != "")
    mask = (1 << EQUAL_BITS) - 1
    equal = [F.sum(F.when(once, F.xxhash64(F.lit(j), paragraph).bitwiseAND(F.lit(mask))).otherwise(F.lit(0))).alias(f"e{j}") for j in range(EQUAL_LANES)]
    twos = [F.sum(F.when(at.isNotNull(), F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001))).otherwise(F.lit(0))).alias(f"s{j}") for j in range(LIKE_LANES // 2)]
    return [*equal, *twos, F.count(at).alias("pairs")]


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, equal (array of EQUAL_LANES) and like (array of LIKE_LANES signed sums) for each row; keys tell rows apart."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__p"))
    words = paragraphs.withColumn("__w", F.array_remove(F.split("__p", "[\\x20\\x09-\\x0D]+"), ""))
    two = F.arrays_zip(F.col("__w").alias("a"), F.slice(F.col("__w"), F.lit(2), F.greatest(F.size("__w"), F.lit(1))).alias("b"))
    pairs = words.select(*keys, "__p", F.posexplode_outer(two).alias("__at", "__pair"))
    hashed = pairs.select(*keys, "__p", "__at", F.xxhash64("__pair.a", "__pair.b").alias("__h"))
    sums = hashed.groupBy(*keys).agg(*_lanes(F.col("__p"), F.col("__h"), F.col("__at")))
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    wrap = lambda c: F.pmod(c + (1 << (LIKE_BITS - 1)), F.lit(1 << LIKE_BITS)) - (1 << (LIKE_BITS - 1))
    counts = [f(F.col(f"s{j}")) for f in (low, high) for j in range(LIKE_LANES // 2)]
    return sums.select(
        *keys,
        F.array(*[F.col(f"e{j}").bitwiseAND(F.lit((1 << EQUAL_BITS) - 1)) for j in range(EQUAL_LANES)]).alias("equal"),
        F.array(*[wrap(2 * c - F.col("pairs")) for c in counts]).alias("like"),
    )


def combine(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """The lanes of two texts put together (sign 1), or of one less the other's paragraphs (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits)))


def as_string(equal: Column, like: Column) -> Column:
    hexed = lambda lanes, bits: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1)))), bits // 4, "0")), "")
    return F.concat(hexed(equal, EQUAL_BITS), F.lit(":"), hexed(like, LIKE_BITS))


def likeness(equal_a: Column, like_a: Column, equal_b: Column, like_b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, else the cosine of the sign lanes, at least 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(dot(like_a, like_a) * dot(like_b, like_b))
    return F.when((equal_a == equal_b) & (like_a == like_b), 1.0).when(scale == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(like_a, like_b) / scale)))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, at, ghost, key, text, next: each row with the text of the next one, descending key, the first after the last.

    The order is dealt out by ranges of the key; each range also gets the head of the one after it (a ghost), so no task
    sees more than a range. Rows of one id (or without one) are one range however many there are; ids are taken to repeat
    rarely. Only the ranges' bounds and heads, as many as there are tasks, pass through the driver.
    """
    spark = docs.sparkSession
    n = 2 * slices(spark)
    k = F.col(key)
    cuts = docs.agg(F.percentile_approx(k, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    bucket = F.when(k.isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > k))) if cuts else F.lit(0)
    heads = {r[0]: r[1] for r in docs.select(bucket.alias("b"), k.alias("k")).groupBy("b").agg(F.max("k")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    null_head = before.pop(None, None)
    also = F.lit(None).cast("int")
    if before:
        also = F.try_element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), k.cast("long"))
    if null_head is not None:
        also = F.when(k.isNull(), F.lit(null_head)).otherwise(also)
    to = F.filter(F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("ghost")), F.struct(also.cast("int").alias("bucket"), F.lit(True).alias("ghost"))), lambda x: x["bucket"].isNotNull())
    dealt = docs.select(k.alias("key"), F.col(text).alias("text"), F.explode(to).alias("to")).select("key", "text", "to.bucket", "to.ghost").repartitionByRange(n // 2, "bucket")
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("key"), "text")
    return dealt.select("bucket", F.row_number().over(w).alias("at"), "ghost", "key", "text", F.lead("text").over(w).alias("next"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    rows = with_next(docs, key, text)
    t, nxt = F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    edited = F.concat(F.substring(t, F.lit(1), F.length(t) - half), F.substring(nxt, F.lit(1), half))
    both = rows.select("bucket", "at", "ghost", "key", F.length(t).cast("long").alias("n_chars"), t.alias("text"), F.when(~F.col("ghost"), edited).alias("edited"))
    each = both.withColumn("sha", F.sha2("edited", 256)).select(
        "bucket", "at", "ghost", "key", "n_chars", "sha", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x")
    )
    each = each.select("bucket", "at", "ghost", "key", "n_chars", "sha", "x.kind", "x.t").filter(~F.col("ghost") | (F.col("kind") == 0))
    prints = fingerprints(each, ["bucket", "at", "ghost", "key", "n_chars", "sha", "kind"], "t")
    # kind 1 follows kind 0 of the same row, and the next row's kind 0 is one or two places on
    w = Window.partitionBy("bucket").orderBy("at", "kind")
    lanes = F.struct("equal", "like")
    seen = prints.select("*", F.lead(lanes).over(w).alias("e"), F.lead(lanes, 2).over(w).alias("x")).filter((F.col("kind") == 0) & ~F.col("ghost"))
    near = lambda o: likeness(F.col("equal"), F.col("like"), F.col(f"{o}.equal"), F.col(f"{o}.like"))
    return seen.select(
        F.col("key").alias(key),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_string(F.col("equal"), F.col("like")).alias("fingerprint"),
        as_string(F.col("e.equal"), F.col("e.like")).alias("edited_fingerprint"),
        near("e").alias("near_edited"),
        near("x").alias("near_next"),
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
