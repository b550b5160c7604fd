"""Ranks within keys that do not put a key into one task.

Rows are dealt out by ranges of key and order, written, and counted by range; what lies before a range is a running sum over
ranges, of which there are as many as partitions, and only what is inside a range is sorted in one task. Rows that tie in the
whole order take their ranks in any order; nulls come first, as they do in a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.operators.graph import materialize


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _r, the row's place (from 1) in its key by the order columns, and _n, how many rows its key has."""
    keys = list(by)
    parts = materialize(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), before.alias("_b"), F.sum("_c").over(W.partitionBy(*keys)).alias("_n"))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = parts.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)))
    return inside.join(sizes, same).select(*df.columns, (F.col("_b") + F.col("_i")).alias("_r"), "_n")
