"""Running sums over ordered rows without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut, shuffle_width


def running_sum(df: DataFrame, group: str, order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before a row.

    Rows are range-partitioned by group and order, so a group may span many tasks; each task sums its own
    rows and the totals of a group's earlier tasks are added. Order must be total; null values count 0.
    """
    placed = df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(parts or shuffle_width(df.sparkSession), group, *order)
    placed = cut(placed.withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy(group, "_p").agg(F.sum("_v").alias("_t"))
    tasks = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(tasks), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = summed.join(before, (summed[group].eqNullSafe(before["_g"])) & (summed["_p"] == before["_q"]))
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_p", "_g", "_q", "_in", "_before")
