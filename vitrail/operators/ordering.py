"""Places and running totals of ordered rows without any task that sees a whole group.

Rows are range-partitioned and written once, since another run could draw other range limits; then each piece is numbered for itself and shifted by
the sizes of the pieces before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrail.sources.tables import cut


def pieces(df: DataFrame, columns: list) -> DataFrame:
    """``df`` range-partitioned and sorted by the columns, with the number of its partition as ``_part``; written to the checkpoint folder."""
    return cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, groups: list[str], value: str, count: str) -> DataFrame:
    """``df`` with ``_upto``, the sum of ``count`` up to each value of its group, and ``_n``, the sum of the group. Values are unique in a group."""
    cut_up = pieces(df, [*groups, value])
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    sizes = cut_up.groupBy(*groups, "_part").agg(F.sum(count).alias("_s"))  # a row a group and partition
    before = F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_s").over(group).alias("_n"))
    on = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    inside = F.sum(count).over(Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return cut_up.withColumn("_inside", inside).join(shifts, on).select(*df.columns, (F.col("_inside") + F.col("_before")).alias("_upto"), "_n")


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_row``, its place from 0 in the order of unique columns."""
    cut_up = pieces(df, order)
    sizes = cut_up.groupBy("_part").agg(F.count(F.lit(1)).alias("_s"))  # a row a partition
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut_up.withColumn("_inside", inside).join(F.broadcast(shifts), "_part").select(*df.columns, (F.col("_inside") + F.col("_before")).alias("_row"))
