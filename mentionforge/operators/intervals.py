"""Half-open intervals per key: islands, coverage, containment, overlap, cuts.

Joins are equi-joins on the key with the range as a residual, so Spark shuffles by key and never builds a product of tables.
Keys with very many intervals are cut into buckets of positions (`cell`), which bounds what meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of each key's intervals as maximal intervals; touching ones merge, empty ones do not count."""
    by = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.where(F.col(end) > F.col(start)).select(*keys, start, end, F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)).alias("_new"))
    numbered = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered_size(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Positions of each key that an interval covers."""
    return merge_islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def with_cells(df: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each bucket of `width` positions that the interval touches, in column cell."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / width).cast("int"), F.floor(last / width).cast("int"))))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Column | None = None, width: int = 256) -> DataFrame:
    """Pairs of left and right rows of a key whose intervals share a position. left has id, start, end; right has id2, start2,
    end2. Rows meet in the bucket where the later one starts, so each pair comes once."""
    a = with_cells(left, width)
    b = with_cells(right.withColumnRenamed("start2", "start").withColumnRenamed("end2", "end"), width).withColumnRenamed("start", "start2").withColumnRenamed("end", "end2")
    pairs = a.join(b, [*keys, "cell"]).where((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")))
    pairs = pairs.where(F.col("cell") == F.floor(F.greatest("start", "start2") / width))
    return (pairs if on is None else pairs.where(on)).drop("cell")


def region_state(spans: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with state: eligible inside one region of the islands, boundary_crossing if they only overlap one, else uncovered.
    Repeated rows are looked up once and come out as often as they are there."""
    islands = merge_islands(regions, keys).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = spans.groupBy(*spans.columns).agg(F.count("*").alias("_n")).join(islands, list(keys), "left")
    inside = F.coalesce((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), F.lit(False))
    touch = F.coalesce((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), F.lit(False))
    state = F.when(F.max(inside), F.lit("eligible")).when(F.max(touch), F.lit("boundary_crossing")).otherwise(F.lit("uncovered"))
    judged = hit.groupBy(*spans.columns, "_n").agg(state.alias("state"))
    return judged.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")


def drop_nested(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans (id, start, end) that no longer span of the same keys strictly contains."""
    other = spans.select(*keys, F.col("id").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    inner = overlap_pairs(spans, other, keys, (F.col("start2") <= F.col("start")) & (F.col("end2") >= F.col("end")) & (F.col("end2") - F.col("start2") > F.col("end") - F.col("start")))
    return spans.join(inner.select("id").distinct(), "id", "left_anti")


def cut_at_boundaries(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementary segments (start, end) between neighbouring boundaries of a key, with how many spans cover each."""
    edges = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = edges.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    by = W.partitionBy(*keys).orderBy("start")
    out = points.withColumn("end", F.lead("start").over(by)).withColumn("depth", F.sum("d").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return out.where("end is not null").drop("d")


def tiles(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with whether their parts follow each other without gap or overlap, and the whole's start and end."""
    by = W.partitionBy(*keys).orderBy("start", "end")
    steps = parts.withColumn("_before", F.lag("end").over(by))
    return steps.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.coalesce(F.col("_before") == F.col("start"), F.lit(True))).alias("exact"))


def edge_eligible(edges: DataFrame, regions: DataFrame, ignored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edges (edge_id, start, end, start2, end2) whose ends lie in one island and overlap no ignored span (ignored_start,
    ignored_end)."""
    islands = merge_islands(regions, keys).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.least("start", "start2") >= F.col("_s")) & (F.greatest("end", "end2") <= F.col("_e"))
    ok = edges.join(islands, list(keys)).where(inside).select("edge_id").distinct()
    hit = ((F.col("start") < F.col("ignored_end")) & (F.col("ignored_start") < F.col("end"))) | ((F.col("start2") < F.col("ignored_end")) & (F.col("ignored_start") < F.col("end2")))
    bad = edges.join(ignored, list(keys)).where(hit).select("edge_id").distinct()
    return edges.join(ok, "edge_id", "left_semi").join(bad, "edge_id", "left_anti")
