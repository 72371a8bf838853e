"""Running numbers over whole tables without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladescope.storage import shared_dir


def numbered(rows: DataFrame, keys: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with ``name``: their number from ``first`` in the order of ``keys`` (which tell rows apart).

    Rows are dealt by ranges of the keys and numbered within each; a range's start
    is the sum of the ranges before it, of which there are as many as partitions.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that numbers and sums see one and the same dealing
    dealt = rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = dealt.withColumn("_at", within).join(F.broadcast(starts), "_range")
    return out.withColumn(name, (F.col("_before") + F.col("_at") + (first - 1)).cast("long")).drop("_range", "_n", "_before", "_at")
