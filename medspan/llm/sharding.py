"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard draws a straw for a row: an exponential variate with the shard's weight as its rate, made from the row's key
and the shard's number alone. A rack's straw is the shortest of its shards', a region's the shortest of its racks'; the
shortest of exponentials is again an exponential with the summed rate, so each level is a weighted draw in proportion to
the weight below it. A row descends along the shortest straw. Changing a weight changes the straws on one path only, so
rows move only into or out of that subtree, and a new shard takes rows only into itself.

A very long text is read once, for its size and checksum, and not moved. Nulls: a null key draws like any other value. Null text has 0 bytes. Empty table: empty result. Repeated rows share a
shard and get slots of their own. Columns other than key and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import number_within, table

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 40, 5, 4


def tree(shards: int, weights: dict[int, float] | None = None, per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight), filled in order of the shard's number."""
    leaves = [(s, float((weights or {}).get(s, 1.0))) for s in range(shards)]
    racks = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [racks[i : i + per_region] for i in range(0, len(racks), per_region)]


def _straw(key: Column, shard: Column, weight: Column) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + 1) / F.lit(float(2**53))
    return -F.log(uniform) / weight


def place(key: Column, regions: list[list[list[tuple[int, float]]]]) -> Column:
    """The shard of a key: the descent, one level after the other, in built-in expressions."""
    leaf = lambda s, w: F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight"))
    whole = F.array(*[F.array(*[F.array(*[leaf(s, w) for s, w in rack]) for rack in racks]) for racks in regions])
    of_rack = lambda rack: F.array_min(F.transform(rack, lambda x: _straw(key, x["shard"], x["weight"])))
    of_region = lambda region: F.array_min(F.transform(region, of_rack))

    def best(nodes: Column, straw) -> Column:
        drawn = F.transform(nodes, lambda x, i: F.struct(straw(x).alias("straw"), i.alias("at")))
        return F.get(nodes, F.array_min(drawn)["at"])

    rack = best(best(whole, of_region), of_rack)
    return best(rack, lambda x: _straw(key, x["shard"], x["weight"]))["shard"]


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row."""
    k = F.col(key)
    rows = docs.select(
        k,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(k, tree(shards, weights)).cast("int").alias("shard"),
        place(k, tree(shards + 1, weights)).cast("int").alias("grown_shard"),
    )
    ids = docs.select(k, place(k, tree(shards, weights)).cast("int").alias("shard"))
    out = number_within(rows, ["shard"], F.xxhash64(k, F.lit("slot")), [k, F.col("text_crc32"), F.col("size")], "slot", ids)
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
