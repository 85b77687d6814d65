"""What the operators share: reading tables, cutting lineage, and numbering rows without one big task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, whatever letters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose executors are the driver, gets
    a new folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='medspan-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/medspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession, least: int = 8, most: int = 4096) -> int:
    """Into how many slices a hot group is dealt: follows the session's shuffle partitions, within fixed bounds."""
    return max(least, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def number_within(df: DataFrame, group: list[str], slice_by: Column, order: list[Column], name: str, counted: DataFrame | None = None) -> DataFrame:
    """Add `name`: a gapless number from 0 within each group, though no group is gathered into one task.

    Rows of a group are dealt to slices by slice_by; each slice is numbered on its own and shifted by the sizes of the
    slices before it. counted: a cheaper frame with the same groups and slice keys to count on (df itself if None).
    """
    n = slices(df.sparkSession)
    dealt = lambda x: x.withColumn("__slice", F.pmod(slice_by, F.lit(n)).cast("int"))
    sizes = dealt(df if counted is None else counted).groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    rows = dealt(df).withColumn("__rn", F.row_number().over(Window.partitionBy(*group, "__slice").orderBy(*order)))
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] + [F.col("__slice") == F.col("__s")]
    out = rows.join(shifts, on, "left")
    return out.withColumn(name, (F.col("__shift") + F.col("__rn") - 1).cast("long")).drop("__slice", "__s", "__n", "__shift", "__rn", *[f"__g_{g}" for g in group])
