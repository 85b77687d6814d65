"""Interval and run operators over long tables: the same algebra as in one row, for groups of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Offsets of a bin: a key's offsets are dealt to bins of this width, so that no key is one task's work.
BIN = 1 << 16


def merge_spans(spans: DataFrame, key: str, start: str, end: str, kind: str, order: str) -> DataFrame:
    """key, start, end, kind: unions of overlapping spans; touching ones stay apart, and the first span names its union."""
    by = Window.partitionBy(key).orderBy(start, F.desc(end), order)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    island = opened.withColumn("__island", F.sum("__new").over(by))
    first = F.struct(F.col(start), -F.col(end), F.col(order))
    return island.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.min_by(kind, first).alias(kind)).drop("__island")


def runs(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """key, kind, first, last: a row opens a run where its kind differs from the row before."""
    by = Window.partitionBy(key).orderBy(order)
    opened = rows.withColumn("__new", F.when(F.lag(kind).over(by).eqNullSafe(F.col(kind)), 0).otherwise(1))
    grouped = opened.withColumn("__run", F.sum("__new").over(by))
    return grouped.groupBy(key, "__run", kind).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("__run")


def line_offsets(docs: DataFrame, key: str, text: str, sign: str = "\n") -> DataFrame:
    """key, line_no, start, length: where each line begins, in code points. sign: a pattern of one character that ends a line."""
    lines = docs.select(key, F.posexplode(F.split(text, sign)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(key, "line_no", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"), F.length("line").cast("long").alias("length"))


def carried(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, width: int = BIN) -> DataFrame:
    """rows with `out`: the value of the last row of the key that has one, up to this row itself, in the given order (a total one).

    Each slice of a key is swept on its own, with the last value of the slices before it carried in: slices are ranges of `width` of
    the first column of the order, so that a key of any size is many tasks' work. Only one row a slice crosses between them."""
    first = order[0]
    sliced = rows.withColumn("__slice", F.floor(F.col(first) / width))
    own = Window.partitionBy(*key, "__slice").orderBy(*order)
    held = F.struct(F.col(value).alias("v"))
    last = F.last(F.when(F.col(value).isNotNull(), held), ignorenulls=True)
    ends = sliced.filter(F.col(value).isNotNull()).groupBy(*key, "__slice").agg(F.max_by(F.col(value), F.struct(*order)).alias("__end"))
    slices = sliced.select(*key, "__slice").distinct().join(ends, [*key, "__slice"], "left")
    upto = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*key, "__slice", F.last("__end", ignorenulls=True).over(upto).alias("__before"))
    swept = sliced.withColumn("__own", last.over(own)["v"]).join(before, [*key, "__slice"], "left")
    return swept.withColumn(out, F.coalesce("__own", "__before")).drop("__slice", "__own", "__before")


def tile_at(positions: DataFrame, tiles: DataFrame, key: str, at: str, start: str, end: str, payload: list[str], width: int = BIN) -> DataFrame:
    """positions with `payload` of the tile [start, end) of the same key that holds `at`; nulls where none does. Tiles of a key do not
    overlap.

    Tiles and positions are dealt to bins of `width` offsets, a tile to each bin that it reaches into, cut there; a sweep over each bin
    in order of offset carries the last tile to the positions behind it. One shuffle by (key, bin); the tiles of one bin are at most as many as
    its offsets, a long tile has one row a bin, and a key of any length is split. A null position, or one before the first tile, has no tile."""
    held = F.struct(*[F.col(c) for c in payload], F.col(end).alias("__end"))
    full = tiles.filter(F.col(start) < F.col(end))
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    opened = full.select(key, F.explode(bins).alias("__bin"), F.col(start).cast("long").alias("__from"), held.alias("__tile"))
    opened = opened.select(key, "__bin", F.greatest("__from", F.col("__bin") * width).alias("__at"), F.lit(0).alias("__kind"), "__tile", F.lit(None).cast(positions.select(F.struct(*positions.columns)).schema[0].dataType).alias("__row"))
    asked = positions.select(key, F.floor(F.col(at) / width).alias("__bin"), F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(opened.schema["__tile"].dataType).alias("__tile"), F.struct(*positions.columns).alias("__row"))
    sweep = Window.partitionBy(key, "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opened.unionByName(asked).withColumn("__last", F.last("__tile", ignorenulls=True).over(sweep)).filter("__kind = 1")
    inside = F.col("__at") < F.col("__last.__end")
    return swept.select("__row.*", *[F.when(inside, F.col("__last")[c]).alias(c) for c in payload])


def left_bounds(matches: DataFrame, separators: DataFrame, key: str, at: str, reach: int, width: int = BIN) -> DataFrame:
    """matches with `left`: the end of the last separator (key, at, end) that begins before the match and within `reach` of it; `reach`
    before the match, or 0, if there is none. An as-of join by union and carried value: a match is joined to one row, however many
    separators its key has."""
    none = F.lit(None).cast("long")
    signs = separators.select(key, F.col("at").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.struct(F.col("at").cast("long").alias("s"), F.col("end").cast("long").alias("e")).alias("__sign"), F.lit(None).cast(matches.select(F.struct(*matches.columns)).schema[0].dataType).alias("__row"))
    asked = matches.select(key, F.col(at).cast("long").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(signs.schema["__sign"].dataType).alias("__sign"), F.struct(*matches.columns).alias("__row"))
    found = carried(signs.unionByName(asked), [key], ["__at", "__kind"], "__sign", "__held", width).filter("__kind = 0")
    least = F.greatest(F.col("__at") - reach, F.lit(0))
    near = F.when(F.col("__held.s") >= least, F.col("__held.e")).otherwise(none)
    return found.select("__row.*", F.coalesce(near, least).alias("left"))
