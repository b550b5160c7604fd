"""Near-duplicate classes by min-max hashing.

Every permutation yields its minimum and its maximum, so a signature of 2k values costs k hash evaluations; bands of both
kinds find candidates. Candidates are then confirmed on the full shingle sets, never on the signature.

Steps, all on DataFrames: one row per text with its band keys; texts with equal sets collapse to a class; classes that share
a band form candidate groups; a group of up to BLOCK texts is confirmed in one task, with union-find skipping pairs that are
linked already; larger groups are cut into blocks, compared with a few sampled pivots, and then only texts outside a group's
main component meet the rest, block by block. No task ever holds more than two blocks, and no pair is left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import components, free_names, saved, table
from mentionforge.session import map_in_arrow, spread

BANDS, BAND_PERMUTATIONS = 42, 3
BLOCK, PIVOTS, PIVOT_ROUNDS = 256, 16, 2
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEPS = _mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_PERMUTE = ((_mix(np.arange(1000, 1000 + BANDS * BAND_PERMUTATIONS, dtype=_U)) >> _U(32)) | _U(1)).astype(np.uint32)[:, None]
_SHIFT = (_mix(np.arange(5000, 5000 + BANDS * BAND_PERMUTATIONS, dtype=_U)) >> _U(32)).astype(np.uint32)[:, None]
_WEIGHTS = (_mix(np.arange(9000, 9000 + BANDS * BAND_PERMUTATIONS * 2, dtype=_U)) | _U(1)).reshape(BANDS, 2 * BAND_PERMUTATIONS)
_BAND_SALT = _mix(np.arange(20000, 20000 + BANDS, dtype=_U))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    w = min(n, width)
    acc = h[: n - w + 1] * _STEPS[0]
    for k in range(1, w):
        acc = acc + _mix(h[k : n - w + 1 + k] + _STEPS[k])* _STEPS[k]
    return np.unique(_mix(acc + _U(w)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: BAND_PERMUTATIONS permutations give a minimum and a maximum each."""
    x = (shingles >> _U(32)).astype(np.uint32)
    low = high = None
    for i in range(0, len(x), 4096):
        p = _PERMUTE * (x[None, i : i + 4096] ^ _SHIFT)
        a, b = p.min(axis=1), p.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    v = np.stack([low, high], axis=1).astype(_U).reshape(BANDS, 2 * BAND_PERMUTATIONS)
    return _mix((_mix(v + _U(1)) * _WEIGHTS).sum(axis=1, dtype=_U) ^ _BAND_SALT)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 512):
                n, h1, h2, bands = [], [], [], []
                for t in texts.slice(at, 512):
                    s = shingle_set(t.as_py(), width)
                    n.append(len(s))
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    h1.append(int(d[0]))
                    h2.append(int(d[1]))
                    bands.append(band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64))
                offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), hashes.slice(at, 512), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(bands))], ["doc_id", "text_hash", "n", "h1", "h2", "bands"])

    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), width).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["id", "grp", "shingles"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (n + m - inter)


def _confirmer(percent: int):
    """Rows (cell, side, id, label, shingles) sorted by cell and side in, confirmed links (a, b) out. Side 0 is held, side 1
    is compared with what is held, side 2 is compared and then held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, up, out = None, [], {}, ([], [])

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for c, side, i, label, s in zip(*(batch.column(k) for k in range(5)), strict=True):
                c, side, i, label = c.as_py(), side.as_py(), i.as_py(), label.as_py()
                if c != cell:
                    cell, held, up = c, [], {}
                s = np.frombuffer(s.as_py(), _U)
                if side:
                    for j, other, t in held:
                        if i != j and root(label) != root(other) and _linked(s, t, percent):
                            up[root(label)] = root(other)
                            out[0].append(i)
                            out[1].append(j)
                if side != 1:
                    held.append((i, label, s))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
            out = ([], [])

    return run


def _confirm(cells: DataFrame, percent: int) -> DataFrame:
    rows = cells.select("cell", "side", "id", "label", "shingles").repartition("cell").sortWithinPartitions("cell", "side")
    return map_in_arrow(rows, _confirmer(percent), "a bigint, b bigint")


def _confirm_large(large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of groups of more than BLOCK texts (id, grp, shingles, size), given those of the others: the stars of what pivots
    and other groups link, and links from texts outside a group's main component."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1 << 30))
    own = lambda kind, parts: F.concat_ws("/", F.lit(kind), F.col("grp"), *parts)
    for r in range(PIVOT_ROUNDS):
        picked = large.where(F.pmod(F.xxhash64("id", F.lit(1000 + r)), F.col("size")) < PIVOTS)
        held = picked.withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).select(own("p", ["_b"]).alias("cell"), F.lit(0).alias("side"), "id", F.col("id").alias("label"), "shingles")
        met = large.withColumn("_b", F.pmod(salt(7), blocks)).select(own("p", ["_b"]).alias("cell"), F.lit(1).alias("side"), "id", F.col("id").alias("label"), "shingles")
        links = saved(links.unionByName(_confirm(held.unionByName(met), percent)), "links")
    labels = components(links)
    named = large.join(labels, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    by_label = named.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("total"))
    rest = by_label.join(main, "grp").where("label <> main").groupBy("grp").agg(F.sum("n").alias("apart"))
    named = saved(named.join(main.select("grp", "main"), "grp").join(rest, "grp"), "named")  # groups in one piece end here
    apart_blocks = F.ceil(F.col("apart") / BLOCK).cast("int")
    held = named.where("label <> main").withColumn("_i", F.pmod(salt(11), apart_blocks)).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = named.withColumn("_j", F.pmod(salt(13), blocks)).withColumn("_i", F.explode(F.sequence(F.lit(0), apart_blocks - 1)))
    cells = held.withColumn("side", F.lit(0)).unionByName(met.withColumn("side", F.lit(1)))
    return labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(_confirm(cells.withColumn("cell", own("g", ["_i", "_j"])), percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs.

    Texts are linked with 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable. Null or word-less texts have no shingles and are their own component; repeated rows share theirs; a row
    without id has a null component and is kept; other columns are not read; empty tables give empty tables. A link of
    exactly `percent` is found with probability 1 - 3e-6 (42 bands of 3 minima and 3 maxima), surer links more surely."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = saved(map_in_arrow(base.withColumn("text_hash", F.xxhash64("text")), _sketcher(width), "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"), "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = saved(classes, "classes")
    member = classes.select("rep", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    stars = member.join(buckets, "key").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct()
    groups = components(stars)
    # one kind of join at every size: the list of candidates grows with the table and is never broadcast
    texts = base.where("doc_id is not null").join(groups.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id").select("doc_id", F.col("root").alias("grp"), "text")
    sets = saved(map_in_arrow(texts, _set_maker(width), "id bigint, grp bigint, shingles binary"), "sets")
    sizes = sets.groupBy("grp").agg(F.count("*").alias("size"))
    big = saved(sizes.where(F.col("size") > BLOCK), "big")
    small = sets.join(big, "grp", "left_anti").select(F.col("grp").cast("string").alias("cell"), F.lit(2).alias("side"), "id", F.col("id").alias("label"), "shingles")
    links = saved(_confirm(small, percent), "links")
    if not big.isEmpty():
        links = saved(_confirm_large(saved(sets.join(big, "grp"), "large"), links, percent), "links")
    roots = components(links)
    out = sketch.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"), "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=4, percent=80).drop("text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that near_duplicates drops. Repeated rows of one id and text stay or go together; rows that share an
    id but not the text are judged each by its own. Other columns may have any name."""
    i, h = free_names(docs.columns, "_id", "_hash")
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct().hint("merge")  # grows with the table
    return docs.join(gone, (docs["doc_id"] == F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) g FROM w
), n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, m component_id, d.doc_id = m kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) m FROM reach GROUP BY a) ON a = d.doc_id
"""
