"""Approximate nearest neighbours: inverted lists, scanned dimension block by dimension block.

Vectors are rotated by a fixed random orthogonal matrix, so that a partial distance over the first d' of d dimensions,
scaled by d / d', estimates the whole. Inside each probed list a candidate is abandoned once that estimate rejects, under a
hypothesis test with error factor EPSILON, that it is within the current k-th distance: the k-th distance to the sampled
rows of a query's nearest lists, which are candidates themselves, is where the scans of all its lists begin. Survivors get
exact distances on the original vectors in double precision. Equal vectors are one entry that carries its k + 1 smallest ids, which is all that any
result can hold; long lists are cut into blocks, and no task holds more than one block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.llm.common import bounded_sample, saved, table
from mentionforge.session import map_in_arrow

#: Fitting bounds: rows and numbers of the k-means sample, and lists; broadcasts are the sample, 4 * SAMPLE_NUMBERS bytes at the
#: most, and the centroids, at most MOST_LISTS * d doubles, and at most a quarter of the sample's rows.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_LISTS, ROUNDS = 100_000, 8_000_000, 8192, 8
#: LEAST_PROBES lists are probed at least, and as many more as TARGET recall needs on TRIAL sampled queries.
LEAST_PROBES, TARGET, TRIAL = 16, 0.98, 256
BLOCK, DIMENSIONS, EPSILON = 2048, 16, 3.0


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centroids of each row, nearest first; 256 rows at a time."""
    norm, out = (centroids**2).sum(axis=1), []
    for i in range(0, len(x), 256):
        d = norm - 2 * (x[i : i + 256] @ centroids.T)
        if k == 1:
            out.append(d.argmin(axis=1)[:, None])
        else:
            part = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, k), int)


def fit_lists(vectors: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means with seeded start; empty lists keep their centroid."""
    rng = np.random.default_rng(7)
    c = vectors[rng.permutation(len(vectors))[:n_lists]].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(vectors, c)[:, 0]
        order = np.argsort(own, kind="stable")
        where = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
        sums, counts = np.add.reduceat(vectors[order].astype(np.float64), where, axis=0), np.diff(np.r_[where, len(order)])
        c[own[order][where]] = sums / counts[:, None]
    return c


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float = TARGET, trial: int = TRIAL) -> int:
    """Lists to probe so that `target` of the true k nearest sample rows of trial queries lie in them."""
    own = _nearest(sample, centroids)[:, 0]
    asked = np.random.default_rng(11).permutation(len(sample))[:trial]
    norm, ranks = (sample**2).sum(axis=1), []
    for i in range(0, len(asked), 16):
        q = asked[i : i + 16]
        d = norm - 2 * (sample[q] @ sample.T)
        d[np.arange(len(q)), q] = np.inf
        near = np.argpartition(d, min(k, len(sample) - 1), axis=1)[:, :k]
        place = np.argsort(_nearest(sample[q], centroids, len(centroids)), axis=1)
        ranks.append(np.take_along_axis(place, own[near], 1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigner(centroids, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _nearest(_matrix(batch.column(0)).astype(np.float64), centroids.value, probes) if batch.num_rows else np.empty((0, 1), int)
            at = np.arange(0, (len(lists) + 1) * lists.shape[1], lists.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(lists.ravel(), pa.int32()))], [*batch.schema.names, "lists"])

    return run


def _prober(centroids, sample, probes: int, k: int):
    """Queries (v, query) with the lists to probe, nearest first, and `known`, a distance that k sampled rows keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (rows, starts) = centroids.value, sample.value
        for batch in batches:
            q = _matrix(batch.column(0)).astype(np.float64) if batch.num_rows else np.empty((0, c.shape[1]))
            lists, known = _nearest(q, c, probes), []
            for v, own in zip(q, lists.tolist(), strict=True):
                near = np.empty(0)
                for at in own:
                    near = np.r_[near, ((rows[starts[at] : starts[at + 1]].astype(np.float64) - v) ** 2).sum(axis=1)]
                    if len(near) >= k:
                        break
                known.append(float(np.sqrt(np.partition(near, k - 1)[k - 1])) if len(near) >= k else np.inf)
            at = np.arange(0, (len(lists) + 1) * probes, probes, dtype=np.int32)[: len(lists) + 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(lists.ravel(), pa.int32())), pa.array(known, pa.float64())], ["v", "query", "lists", "known"])

    return run


def columns_of(rotated: np.ndarray, step: int) -> list[np.ndarray]:
    """Blocks of `step` columns, each in a piece of memory of its own."""
    return [np.ascontiguousarray(rotated[:, at : at + step]) for at in range(0, rotated.shape[1], step)]


def scan_block(query: np.ndarray, rotated_query: np.ndarray, block: np.ndarray, columns: list[np.ndarray], k: int, epsilon: float, known: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that may be among the k nearest and their exact distances. known: a distance that k rows elsewhere keep."""
    n, d, step = len(block), block.shape[1], columns[0].shape[1]
    first = min(n, max(4 * k, 64))
    seed = sum(((c[:first] - rotated_query[i * step : i * step + c.shape[1]]) ** 2).sum(axis=1) for i, c in enumerate(columns))
    slack = 1e-12 * float(query @ query)  # rotating rounds, by a share of the vectors' own length
    limit = min(known * known, np.partition(seed, k - 1)[k - 1] if first >= k else np.inf) * (1 + 1e-9) + slack
    alive, partial = np.arange(n), np.zeros(n)
    for i, c in enumerate(columns):
        at, seen = i * step, min(i * step + step, d)
        partial = partial + ((c[alive] - rotated_query[at:seen]) ** 2).sum(axis=1)
        bound = limit * (seen / d) * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < d else limit
        stay = partial <= bound
        alive, partial = alive[stay], partial[stay]
    if len(alive) > k:
        kth = np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + slack
        alive = alive[partial <= kth]
    exact = np.sqrt(np.cumsum((block[alive].astype(np.float64) - query) ** 2, axis=1)[:, -1])
    return alive, exact


def _searcher(k: int, epsilon: float, step: int):
    """Rows (cell, side, vector, ids, query, known) sorted by cell and side in: side 0 are entries, side 1 queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ids, block, columns, turns = None, [], [], None, None, {}
        for batch in batches:
            out = ([], [], [])
            for c, side, v, i, q, known in zip(*(batch.column(j) for j in range(6)), strict=True):
                c = c.as_py()
                if c != cell:
                    cell, held, ids, block = c, [], [], None
                v = v.values.to_numpy(zero_copy_only=False)
                if not side.as_py():
                    held.append(v)
                    ids.append(i.as_py())
                    continue
                if not held:
                    continue
                if len(v) not in turns:
                    turns = {len(v): rotation(len(v))}
                turn = turns[len(v)]
                if block is None:
                    block = np.stack(held)
                    columns = columns_of(block.astype(np.float64) @ turn, step)
                v = v.astype(np.float64)
                rows, dist = scan_block(v, v @ turn, block, columns, k, epsilon, known.as_py())
                found = sorted((s, x) for r, s in zip(rows.tolist(), dist.tolist(), strict=True) for x in ids[r])[:k]
                for s, x in found:
                    out[0].append(q.as_py())
                    out[1].append(x)
                    out[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query", "vec_id", "score"])

    return run


def usable(id_col: str = "vec_id", vector_col: str = "embedding"):
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET, epsilon: float = EPSILON, n_lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query but the row of its own id.

    Both frames have (vec_id, embedding). Null, zero or non-finite vectors and rows without id take no part; vectors of another
    length than most are near those of their own length only, and are one list for each length, which is scanned whole; target
    is the recall that probing aims at; ties go to the smaller id; repeated rows of one id count once; other columns are not
    read; an empty table gives no rows. Vectors are compared as they are: floats where both frames hold floats, else doubles."""
    spark = vectors.sparkSession
    kind = "float" if all(dict(df.dtypes)["embedding"] == "array<float>" for df in (vectors, queries)) else "double"
    pick = lambda df: df.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    base, asked = pick(vectors), pick(queries)
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, n = lengths[0]
    usual = F.size("v") == d
    sample = bounded_sample(base.where(usual), "vec_id", max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // (max(1, d) * (1 if kind == "float" else 2))))).select("v").toArrow().column(0).combine_chunks()
    exact = _matrix(sample if isinstance(sample, pa.Array) else sample.chunk(0))
    sample = exact.astype(np.float32)
    n_lists = max(1, min(n_lists or int(np.sqrt(n) / 2), MOST_LISTS, max(1, len(sample) // 4)))
    fitted = fit_lists(sample, n_lists)
    probes = min(n_lists, max(LEAST_PROBES, probes_for(sample, fitted, k, target)))
    centroids, own = spark.sparkContext.broadcast(fitted), _nearest(sample, fitted)[:, 0]
    held_sample = spark.sparkContext.broadcast((exact[np.argsort(own, kind="stable")], np.searchsorted(np.sort(own), np.arange(n_lists + 1))))

    first = W.partitionBy("v").orderBy("vec_id")
    few = base.distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    placed = map_in_arrow(entries.where(usual), _assigner(centroids, 1), f"v array<{kind}>, ids array<bigint>, lists array<int>")
    alone = entries.where(~usual).select("v", "ids", (-F.size("v")).alias("list"))  # a list for each other length
    placed = saved(placed.select("v", "ids", F.element_at("lists", 1).alias("list")).unionByName(alone), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = saved(asked.select("vec_id", "v", F.xxhash64("v").alias("query")), "asked")
    each = wanted.select("v", "query").distinct()
    probed = map_in_arrow(each.where(usual), _prober(centroids, held_sample, probes, k + 1), f"v array<{kind}>, query bigint, lists array<int>, known double")
    probed = probed.unionByName(each.where(~usual).select("v", "query", F.array(-F.size("v")).alias("lists"), F.lit(float("inf")).alias("known")))
    probed = probed.select("v", "query", "known", F.explode("lists").alias("list")).join(sizes, "list").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = F.lit(None)
    held = placed.join(sizes, "list").withColumn("_b", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("blocks")))
    held = held.select(F.concat_ws("/", "list", "_b").alias("cell"), F.lit(0).alias("side"), "v", "ids", none.cast("bigint").alias("query"), F.lit(float("inf")).alias("known"))
    met = probed.select(F.concat_ws("/", "list", "_b").alias("cell"), F.lit(1).alias("side"), "v", none.cast("array<bigint>").alias("ids"), "query", "known")
    cells = held.unionByName(met).repartition("cell").sortWithinPartitions("cell", "side")
    hits = map_in_arrow(cells, _searcher(k + 1, epsilon, DIMENSIONS), "query bigint, vec_id bigint, score double")
    best = W.partitionBy("query").orderBy("score", "vec_id")
    hits = hits.distinct().withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    hits = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    out = wanted.select(F.col("vec_id").alias("query_id"), "query").distinct().join(hits, "query")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (SELECT q.vec_id query_id, c.vec_id, list_distance(q.e, c.e) score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) rank FROM p) WHERE rank <= 10
"""
