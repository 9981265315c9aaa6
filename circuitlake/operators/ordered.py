"""Ranks and running aggregates of ordered groups of any size.

A group's rows are cut into blocks by an expression that grows with the order and holds a
bounded number of rows; windows run inside blocks, block summaries carry what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_rank(df: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """Adds `_rank` (from 1, by order within key) and `_n` (rows of the key)."""
    rows = df.withColumn("_b", block)
    over = Window.partitionBy(key).orderBy("_b")
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(key, "_b", (F.sum("_c").over(over) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    inner = Window.partitionBy(key, "_b").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inner)).join(counts, [key, "_b"])
    return ranked.withColumn("_rank", F.col("_rn") + F.col("_before")).drop("_b", "_rn", "_before")


def with_running(df: DataFrame, key: str, order: list[str], block: Column, value: str, name: str, kind: str = "sum") -> DataFrame:
    """Adds the running sum or maximum of `value` up to and with each row."""
    agg, join = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, lambda a, b: F.greatest(a, b))}[kind]
    rows = df.withColumn("_b", block)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_b").agg(agg(value).alias("_t"))
    totals = totals.select(key, "_b", agg("_t").over(before).alias("_past"))
    own = agg(value).over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_own", own).join(totals, [key, "_b"])
    total = F.when(F.col("_past").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_past")).otherwise(join(F.col("_past"), F.col("_own")))
    return rows.withColumn(name, total).drop("_b", "_own", "_past")
