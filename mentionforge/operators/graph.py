"""Written intermediate tables, and connected components on top of them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionforge.session import map_in_arrow


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that setting is absent, a temporary one for local masters. A cluster without the
    setting is an error: its executors do not share a folder of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "mentionforge-checkpoints"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get()
    return where


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there, so a lost executor
    costs one task and not a recomputation, and the size of the table is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mentionforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that one task contracts in memory.
TASK_EDGES = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to its stars: a row (u, v) for each vertex but the smallest v of its component. A task with more vertices
    than TASK_EDGES edges have gives its stars whenever it holds that many, and begins anew."""
    up, kind = {}, pa.int64()

    def stars():
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["u", "v"])

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 2 * TASK_EDGES:
            yield stars()
            up.clear()
    yield stars()


def connected(edges: DataFrame, task_edges: int | None = None, most_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) of integers or strings: rows (id, root) for every vertex, root the smallest id
    reachable.

    Tasks of at most about `task_edges` edges first contract what they hold to stars; where that took one task, this is the
    answer. Else rounds follow on the stars: each takes every vertex's smallest neighbour and degree, and once only roots have
    more than one neighbour the graph is a forest of stars; before that, neighbours above a vertex move to its smallest
    neighbour, then a vertex and its smaller neighbours do. Minima are aggregated before the shuffle and written, so a hub's
    edges meet them in a plain join that adaptive execution can split. Ids compress so well that the files of a large table look
    small enough to broadcast, hence the hints. Only counts come to the driver."""
    plain = edges.where("a is not null and b is not null and a <> b")
    e = materialize(plain.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    tasks = -(-e.count() // min(task_edges or TASK_EDGES, TASK_EDGES)) or 1
    e = materialize(map_in_arrow(e.coalesce(tasks), _contract, e.schema), "stars")
    if tasks == 1:
        return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    e = materialize(e.distinct(), "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        if low.where("m < u and n > 1").isEmpty():
            return low.select(F.col("u").alias("id"), F.col("m").alias("root"))
        up = both.where("v > u").join(low.select("u", "m").hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        up = materialize(up.distinct(), "edges")
        several = materialize(up.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
        moved = up.join(several.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(up.join(several.hint("merge"), "u", "left_anti").unionByName(moved).where("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")
