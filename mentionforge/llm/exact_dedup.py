"""Exact duplicates, looked up in a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are dealt into buckets. A bucket's hash is a row of bit arrays: a digest sits at the first level
where no other remaining digest of the bucket shares its bit, and the number of bits set before it is its slot, so n digests
fill n slots exactly. A slot holds the full digest and its winner's id. A lookup computes a slot, compares all 32 bytes there,
and thereby tells members, whose repeats go, from texts that the history does not hold, which are grouped among themselves.

Texts leave the plan as digests right after the scan; digests are counted before they are shuffled, so a text that a third of
the rows share is one row of the lookup."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import SPACE, free_names, saved, table
from mentionforge.session import give_back, ship, spread

#: Digests of a bucket, bits a digest at each level, and bytes of a digest.
SLOTS, BITS, WIDTH = 20_000, 2, 32
_U = np.uint64
_INDEX_DDL = "bucket bigint, levels array<binary>, digests binary, winners binary"
_INDEX = pa.schema([("bucket", pa.int64()), ("levels", pa.list_(pa.binary())), ("digests", pa.binary()), ("winners", pa.binary())])
_FOUND = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("winner", pa.int64())])


class Index(NamedTuple):
    """The written buckets of a history, and how many there are."""

    buckets: DataFrame
    count: int


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "), 256))


def _bit_of(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places of digests (rows of four words) on a level; every level takes other bits of the digest or mixes them anew."""
    x = words[:, level % 4] + _U((level // 4 * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return ((x ^ (x >> _U(32))) % _U(size)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Levels of bits of distinct digests, and the slot of each, which together are 0 to n - 1."""
    levels, slot, left, base = [], np.empty(len(words), np.int64), np.arange(len(words)), 0
    while len(left):
        size = -(-max(64, BITS * len(left)) // 8) * 8
        at = _bit_of(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = base + np.cumsum(alone)[at[mine]] - 1
        levels.append(np.packbits(alone).tobytes())
        left, base = left[~mine], base + int(alone.sum())
    return levels, slot


def slots_of(words: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """The slot of each digest; for one that was not hashed any slot, or -1."""
    slot, left, base = np.full(len(words), -1), np.arange(len(words)), 0
    for k, level in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(level, np.uint8))
        at = _bit_of(words[left], k, len(bits))
        hit = bits[at] == 1
        slot[left[hit]] = base + np.cumsum(bits, dtype=np.int64)[at[hit]] - 1
        left, base = left[~hit], base + int(bits.sum())
    return slot


def _digests_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _build(group: pa.Table) -> pa.Table:
    digests = _digests_of(group.column("digest"))
    levels, slot = perfect_hash(digests.view("<u8"))
    by_slot = np.argsort(slot)
    winners = group.column("winner").to_numpy()[by_slot].astype("<i8")
    return pa.Table.from_pylist([{"bucket": group.column("bucket")[0].as_py(), "levels": levels, "digests": digests[by_slot].tobytes(), "winners": winners.tobytes()}], _INDEX)


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    winner, known = np.zeros(asked.num_rows, np.int64), np.zeros(asked.num_rows, bool)
    if asked.num_rows and index.num_rows:
        held = index.to_pylist()[0]
        digests, digest_at = _digests_of(asked.column("digest")), np.frombuffer(held["digests"], np.uint8).reshape(-1, WIDTH)
        slot = slots_of(digests.view("<u8"), held["levels"])
        known = (slot >= 0) & (digest_at[slot] == digests).all(axis=1)
        winner = np.frombuffer(held["winners"], "<i8")[slot]
        give_back()
    return asked.select(["digest", "n", "first"]).append_column("winner", pa.array(winner, pa.int64(), mask=~known)).cast(_FOUND)


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(count))


def build_index(history: DataFrame) -> Index:
    """The index of rows (doc_id, digest): of equal digests the smallest id wins. An empty history gives an index of no bucket
    that knows nothing. There are as many buckets as shuffle partitions at least, and no bucket holds many more than SLOTS."""
    spark = history.sparkSession
    ship(spark)
    distinct = saved(history.groupBy("digest").agg(F.min("doc_id").alias("winner")), "history")
    count = max(-(-distinct.count() // SLOTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Index(saved(distinct.withColumn("bucket", _bucket(count)).groupBy("bucket").applyInArrow(_build, _INDEX_DDL), "perfect"), count)


def look_up(asked: DataFrame, index: Index) -> DataFrame:
    """asked (digest, n, first), one row a digest, with winner: the id that the history holds the digest under, or null. Where
    more digests are asked for than a bucket's share, its row is sent to several groups."""
    ship(asked.sparkSession)
    copies = max(1, -(-asked.count() // (index.count * SLOTS)))
    dealt = asked.withColumn("bucket", _bucket(index.count)).withColumn("copy", F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(copies)))
    held = index.buckets.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    return dealt.groupBy("bucket", "copy").cogroup(held.groupBy("bucket", "copy")).applyInArrow(_look_up, "digest binary, n bigint, first bigint, winner bigint")


def exact_duplicates(docs: DataFrame, seen: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs; `seen` says which rows are the history.

    Texts are equal when they are once each run of white space is one space. The history's smallest id keeps its texts, even
    from smaller ids outside it; texts that it does not hold are kept by their smallest id. Null text counts as empty. A row
    without id is kept, with no keep_id and a group of one, and belongs to no group; a null `seen` is false. Repeated rows of
    one id stay or go together and count each; rows that share an id but not the text are judged by their own. Only id and
    text (and what `seen` reads) are read; an empty table gives no rows."""
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.coalesce(seen, F.lit(False)).alias("seen")), "digests")
    known = rows.where("doc_id is not null")
    index = build_index(known.where("seen").select("doc_id", "digest"))
    asked = saved(known.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(~F.col("seen"), F.col("doc_id"))).alias("first")), "asked")
    judged = look_up(asked, index).select("digest", F.coalesce("winner", "first").alias("keep_id"), F.col("n").alias("group_size"))
    out = known.join(judged.hint("merge"), "digest")  # grows with the table; a hot text is one row on this side
    none = rows.where("doc_id is null").withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(1).cast("long")})
    out = out.select("doc_id", "keep_id", "group_size", "digest").unionByName(none.select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_known(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the index's history holds, or another row of docs with a smaller id: what a batch adds to
    a history that is there as an index alone. Rows without id stay; columns may have any name; an empty batch gives no rows."""
    i, digest, keep = free_names(docs.columns, "_id", "_digest", "_keep")
    asked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("first"), text_digest(F.col(text_col)).alias("digest"))
    asked = saved(asked.groupBy("digest").agg(F.count("*").alias("n"), F.min("first").alias("first")), "asked")
    new = look_up(asked, index).where("winner is null").select(F.col("digest").alias(digest), F.col("first").alias(keep))
    rows = docs.where(F.col(id_col).isNotNull()).withColumn(i, text_digest(F.col(text_col)))
    stay = rows.join(new.hint("merge"), (F.col(i) == F.col(digest)) & (F.col(id_col) == F.col(keep)), "left_semi").drop(i)
    return stay.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op11(spark, sf_dir: str) -> DataFrame:
    """The documents up to the median id are the history of the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    return exact_duplicates(spread(docs), F.col("doc_id") <= F.lit(middle))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h FROM documents),
g AS (SELECT h, min(doc_id) m, count(*) n FROM d GROUP BY h)
SELECT doc_id, m keep_id, n::BIGINT group_size, doc_id = m kept, h text_sha256 FROM d JOIN g USING (h)
"""
