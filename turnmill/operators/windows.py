"""Window forms that the folds of a transcript reduce to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators.lineage import settled


def over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def up_to(keys: list[str], order: list) -> Window:
    """Rows up to and with this one."""
    return over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys: list[str], order: list) -> Window:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def ordinal(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """0-based place of a row within its keys."""
    return df.withColumn(out, (F.row_number().over(over(keys, order)) - 1).cast("long"))


def running(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(up_to(keys, order)))


def carried(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(up_to(keys, order)))


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, out: str) -> DataFrame:
    """Number, from 1, of the island that a row belongs to; an island begins where ``starts`` holds."""
    return running(df, keys, order, F.when(starts, 1).otherwise(0), out)


def rank_key(df: DataFrame, order: list[str]) -> Column:
    """An order as one value: names rise, names behind a minus (numbers and moments) fall; nulls come first where values rise, last where they fall."""
    parts, kinds = [], dict(df.dtypes)
    for name in order:
        own = F.col(name.removeprefix("-"))
        if name.startswith("-"):
            number = F.unix_micros(own.cast("timestamp")) if kinds[name[1:]].startswith("timestamp") else own
            parts += [own.isNull(), -number]
        else:
            parts.append(own)
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by rank_key().  An aggregate: rows of a key meet before the shuffle, so no key is hot."""
    row = F.min_by(F.struct(*df.columns), rank_key(df, order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def top_of(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_n", F.row_number().over(over(keys, order))).where(F.col("_n") <= k).drop("_n")


def placed(df: DataFrame, order: list, out: str) -> DataFrame:
    """0-based place of a row among all rows: ranges of the order, counted, each beginning where the one before it ends.

    The ranges are settled before they are read twice, for the bounds are found by a sample.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # One row per range.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_own", F.row_number().over(over(["_part"], order)))
    return numbered.join(F.broadcast(starts), "_part").withColumn(out, (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_part", "_start", "_own")
