"""Ranked lexical search by MaxScore over shards of an inverted index.

A scan task turns its documents into shards: rows that hold the postings of some megabytes of text, sorted by term, so nothing
is shuffled. A block of queries is sent to every task with the corpus-wide weights of its terms. In each shard a query's terms
are ordered by the most that one of them adds to a score there. Terms whose bounds together stay under the k-th best score so
far are non-essential: documents are taken from the essential lists alone, and the others are probed, largest bound first, only
for documents that what is left could still lift to that score. The k-th score is carried from shard to shard of a task."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.llm.common import saved, table
from mentionforge.session import map_in_arrow, spread

#: Text and rows of a shard; terms of a block of queries, which is what a task is sent at once.
SHARD_BYTES, SHARD_DOCS, BLOCK_TERMS = 4 << 20, 50_000, 200_000
#: Fixed values of the score.
K1_MILLI, B_PERCENT, SCALE = 8, 90, 10**9
#: ASCII letters, lower-cased, digits and all bytes of other code points; the rest parts terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SHARDS = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("at", pa.binary()), ("tf", pa.binary())])
_SHARDS_DDL = "shard bigint, n_docs bigint, n_words bigint, docs binary, lengths binary, terms binary, starts binary, at binary, tf binary"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters (lower-cased), digits and code points beyond ASCII."""
    return text.translate(_TABLE).split()


def _least(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold the largest; _wide reads them."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.empty(0, "<u1")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to shards of their postings; documents without a term are in none."""
    number = TaskContext.get().partitionId() << 32

    def clear():
        nonlocal ids, lengths, terms, counts, size, place
        ids, lengths, terms, counts, size, place = [], [], [], [], 0, defaultdict()
        place.default_factory = place.__len__

    def shard():
        nonlocal number
        term, tf = np.concatenate(terms), np.concatenate(counts)
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in terms])
        order = np.argsort(term, kind="stable")  # by term, then by document
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(place)))]
        row = {"shard": number, "n_docs": len(ids), "n_words": int(sum(lengths)), "docs": np.array(ids, "<i8").tobytes(), "lengths": np.array(lengths, "<i8").tobytes(), "terms": b" ".join(place), "starts": starts.astype("<i8").tobytes(), "at": _least(doc[order]), "tf": _least(tf[order])}
        number += 1
        clear()
        return pa.RecordBatch.from_pylist([row], _SHARDS)

    ids = lengths = terms = counts = size = place = None
    clear()
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            words = terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []
            if not words:
                continue
            found = Counter(words)
            ids.append(i.as_py())
            lengths.append(len(words))
            terms.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
            size += len(t.as_buffer())
            if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                yield shard()
    if ids:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the rows of docs, written; each row with a term is a document of its own, repeated ids too. Rows without id and
    null or term-less texts are in no shard; texts are read whole, a very long one makes a longer shard; an empty table gives
    no shards; other columns are not read."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return saved(map_in_arrow(rows, _shards, _SHARDS_DDL), "shards")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i.as_py(), w) for i, t in zip(batch.column(0), batch.column(1), strict=True) if t.is_valid for w in dict.fromkeys(terms_of(t.as_buffer().to_pybytes()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.binary()))], ["item", "term"])


def _counter(wanted):
    """Document frequencies of wanted terms, summed over the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = wanted.value, Counter()
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                for t, n in zip(terms.as_py().split(b" "), np.diff(np.frombuffer(starts.as_py(), "<i8")).tolist(), strict=True):
                    if t in known:
                        df[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_factors(lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """A document's m, exact beyond 64 bits too."""
    if int(lengths.max(initial=0)) * B_PERCENT * n < 1 << 63:
        return 100 - B_PERCENT + B_PERCENT * lengths * n // words
    return np.array([100 - B_PERCENT + B_PERCENT * x * n // words for x in lengths.tolist()], np.int64)


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], least: int, acc: np.ndarray, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard whose score is `least` or more, and their scores. lists: (bound, documents in order, what the term
    adds to each); acc: zeros, one for each document, which are zeros again afterwards. tally counts postings read and probed."""
    lists = sorted(lists, key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in lists]).tolist()
    few = next((k for k, b in enumerate(bounds) if b >= least), len(lists))  # terms under `few` are non-essential
    if few == len(lists):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for _, at, adds in lists[few:]:
        acc[at] += adds
    seen = np.concatenate([x[1] for x in lists[few:]]) if few else None
    left = np.flatnonzero(acc) if seen is None or len(seen) > len(acc) else np.unique(seen)
    touched = left
    for k in range(few - 1, -1, -1):
        left = left[acc[left] + bounds[k] >= least]
        if not len(left):
            break
        _, at, adds = lists[k]
        place = np.minimum(np.searchsorted(at, left), len(at) - 1)
        hit = at[place] == left
        acc[left[hit]] += adds[place[hit]]
        if tally is not None:
            tally["probed"] += len(left)
    left = left[acc[left] >= least]
    scores = acc[left]
    acc[touched] = 0
    if tally is not None:
        tally["read"] += sum(len(x[1]) for x in lists[few:])
    return left.astype(np.int64), scores


def _searcher(shared, k: int):
    """Shards in; for each query the k best documents of the task out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n, words = shared.value
        best = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i in items}  # ids and scores, best first
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                starts = np.frombuffer(row["starts"], "<i8")
                at, tf = _wide(row["at"], int(starts[-1])), _wide(row["tf"], int(starts[-1]))
                m, lists = length_factors(lengths, n, words), {}
                for place, t in enumerate(row["terms"].split(b" ")):
                    if t in weights:
                        d, f = at[starts[place] : starts[place + 1]].astype(np.int64), tf[starts[place] : starts[place + 1]].astype(np.int64)
                        adds = weights[t] * (SCALE * f // (1000 * f + K1_MILLI * m[d]))
                        lists[t] = (int(adds.max()), d, adds)
                acc = np.zeros(len(docs), np.int64)
                for item, terms in items.items():
                    mine = [lists[t] for t in terms if t in lists]
                    if not mine:
                        continue
                    ids, scores = best[item]
                    found, new = max_score(mine, max(1, int(scores[-1])) if len(ids) == k else 1, acc)
                    if len(found):
                        ids, scores = np.r_[ids, docs[found]], np.r_[scores, new]
                        order = np.lexsort((ids, -scores))[:k]
                        best[item] = (ids[order], scores[order])
        rows = [(i, d, s) for i, (ids, scores) in best.items() for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each query, equal scores by smaller id.

    The score is that of the module's contract: integer arithmetic on term counts, lengths and document frequencies. Queries
    go in blocks of about BLOCK_TERMS terms, whatever their number, each block one pass over the shards; a query's terms count
    once each, and rows of one item are one query. Null or term-less queries, rows without item_id, and an empty index or
    query table give no rows."""
    spark = index.sparkSession
    n, words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    asked = queries.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col))
    asked = saved(map_in_arrow(asked, _query_terms, "item bigint, term binary").distinct(), "asked")
    blocks, out = -(-asked.count() // BLOCK_TERMS), None
    for b in range(blocks if n else 0):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        items = defaultdict(list)
        for i, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
            items[i].append(t)
        wanted = spark.sparkContext.broadcast({t for terms in items.values() for t in terms})
        df = map_in_arrow(index.select("terms", "starts"), _counter(wanted), "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = {t: weight(n, x) for t, x in zip(df.column(0).to_pylist(), df.column(1).to_pylist(), strict=True)}
        shared = spark.sparkContext.broadcast((dict(items), weights, n, words))
        hits = map_in_arrow(index, _searcher(shared, k), "item_id bigint, doc_id bigint, score bigint")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(build_index(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} ts FROM documents), a AS (SELECT doc_id, len(ts)::BIGINT n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT nn, sum(n)::BIGINT ll FROM a),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) t FROM benchmark),
p AS (SELECT doc_id, t, count(*)::BIGINT tf FROM (SELECT doc_id, unnest(ts) t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT w FROM p, g GROUP BY t, nn),
m AS (SELECT doc_id, 10 + (90 * n * nn) // ll m FROM a, g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0) WHERE rank <= 10
"""
