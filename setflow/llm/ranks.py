"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setflow.llm import common as C


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df (written to the shared folder) with its rows' places from 0 in this order.

    Rows are range-partitioned; a row's place is its place in its range plus the rows of all ranges before. Only
    one number for each range meets in a single task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = C.materialise(df.repartitionByRange(n, *order).withColumn("__sf_range", F.spark_partition_id()))
    before = (
        dealt.groupBy("__sf_range")
        .agg(F.count(F.lit(1)).alias("__sf_n"))
        .withColumn("__sf_before", F.sum("__sf_n").over(Window.orderBy("__sf_range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("__sf_range", F.coalesce("__sf_before", F.lit(0)).alias("__sf_before"))
    )
    place = F.row_number().over(Window.partitionBy("__sf_range").orderBy(*order)) - 1
    ranked = dealt.withColumn("__sf_place", place).join(before, "__sf_range")
    return ranked.withColumn(name, F.col("__sf_place") + F.col("__sf_before")).drop("__sf_range", "__sf_place", "__sf_before")
