"""Places in a sorted order without one task seeing more than its part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """`df` with `_no` (the group's number in ascending order, null first), `_rank` (place in its group by
    ascending `order`, nulls first, from 0) and `_size` (rows of the group).

    Spark sorts ranges of (group, order) and writes them; a row's place is then its place in its part plus
    the rows of its group in earlier parts. So a group of any size is as many tasks as it has parts, and only a
    row for each group of each part is summed by a window. Rows that are equal in group and order are
    placed in any order."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    t = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    per = t.groupBy(part, F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    groups = per.groupBy("_g").agg(F.sum("_n").alias("_size"))
    # a row a group passes this window, never one a row of `df`
    groups = groups.withColumn("_no", (F.row_number().over(Window.orderBy(F.col("_g").asc_nulls_first())) - 1).cast("long"))
    per = per.join(groups.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h", "_n")
    out = t.join(per, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.select(*df.columns, "_no", (F.col("_before") + F.col("_at") - F.col("_first")).alias("_rank"), "_size")
