"""Gapless numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stage

#: Rows that one window partition holds on average at most.
PART_ROWS = 20_000
#: Parts that a small table is dealt to, so that its hot groups are even, too.
LEAST_PARTS = 64


def numbered(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """``df`` with the long column ``name``: 0, 1, 2 ... within each value of ``group``, in no order that means anything.

    A hash of ``key`` deals each group to parts of bounded size; a row's number
    is that in its part plus the sizes of the group's earlier parts. The only
    rows that share a part by force are those that repeat one key.
    """
    total = df.count()
    part = F.pmod(F.xxhash64(key), F.lit(max(LEAST_PARTS, -(-total // PART_ROWS)))).cast("int")
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    inner = Window.partitionBy(group, "_part").orderBy(key)
    ranked = dealt.withColumn("_rank", F.row_number().over(inner) - 1)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return ranked.join(starts, same, "left").withColumn(name, F.col("_start") + F.col("_rank")).drop("_part", "_group", "_of", "_start", "_rank")
