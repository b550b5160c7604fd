"""A prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, its members are the conversations that begin with it, and the smallest member
owns it. Members only get fewer on the way down, so what a conversation owns is the end of its own path, and one number, the
depth from which it owns, says which nodes those are. Windows over each conversation's path mark the owned nodes and sum up
the bytes of the turns from each depth on. A subtree then needs no walk: over the members of a node, the turns below count
once for each occurrence, and less those owned below they count once for each copy beyond the first. One group-by on the node
sums that, along with members, owned children and owned leaves.

Nodes are named by a chain of SHA-256 digests, so prefixes meet by equality. Every aggregation by node is partial before it
is shuffled, so the root and a very common first turn are a few rows of the shuffle; ids that end in one node are joined by
ranges of ids before one task hashes them in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.llm.common import saved, table
from mentionforge.session import map_in_arrow

#: Ids of a range, as a power of two.
RANGE_BITS = 12
_PATHS = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])
_PATHS_DDL = "conv bigint, depth bigint, node binary, parent binary, bytes bigint, last boolean"
_ROOT = hashlib.sha256(b"").digest()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn digest, bytes) in order, each conversation begun by a row without digest, to the nodes of its path."""
    before = None
    for batch in batches:
        out = []
        for conv, digest, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if digest is None:
                row = (conv, 0, _ROOT, None, 0)
            else:
                row = (conv, before[1] + 1, hashlib.sha256(before[2] + digest).digest(), before[2], size)
            if before is not None:
                out.append((*before, digest is None))
            before = row
        yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 6, _PATHS, strict=True)], schema=_PATHS)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], kind.type) for c, kind in zip((*before, True), _PATHS, strict=True)], schema=_PATHS)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv, at, digest, bytes): turns numbered from 0 by turn, null first; rows of one turn go by their digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(both, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.select("conv", (F.row_number().over(W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")) - 1).alias("at"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, part, at, digest, bytes): for every conversation c a row without digest (part -1), the first h turns of c - c % 5
    (part 0), and its own turns after its first h (part 1), where h is the checksum of c modulo 9."""
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
    convs = turns.where("at = 0").select("conv", taken.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    none = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    first = turns.where("at < 8").select(F.col("conv").alias("base"), "at", "digest", "bytes")
    head = convs.where("h > 0").join(first, "base").where("at < h").select("conv", F.lit(0).alias("part"), "at", "digest", "bytes")
    own = turns.where(F.col("at") >= taken).select("conv", F.lit(1).alias("part"), "at", "digest", "bytes")
    return none.unionByName(head).unionByName(own)


def paths(sequences: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, bytes, last) for each node on each conversation's path, the root included."""
    dealt = sequences.repartition("conv").sortWithinPartitions("conv", "part", "at").select("conv", "digest", "bytes")
    return map_in_arrow(dealt, _chain, _PATHS_DDL)


def _hash_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids of a range, joined) in order to a digest for each node over all its ids, joined."""
    node, running = None, None
    for batch in batches:
        out = ([], [])
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    out[0].append(node)
                    out[1].append(running.hexdigest())
                node, running = name, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def ends(path: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes where a conversation ends."""
    ranges = path.where("last").groupBy("node", F.shiftright("conv", RANGE_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    return map_in_arrow(ranges.repartition("node").sortWithinPartitions("node", "range").select("node", "ids"), _hash_joined, "node binary, ends_sha256 string")


def trie(path: DataFrame) -> DataFrame:
    """One row a node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of written paths."""
    nodes = path.groupBy("node").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("last").alias("leaf"))
    owned = nodes.groupBy("conv").agg(F.min("depth").alias("owns_from"), F.max("leaf").alias("has_leaf"))
    marked = path.join(owned.hint("merge"), "conv", "left").withColumn("owns_from", F.coalesce("owns_from", F.lit(1 << 62)))
    here = F.col("depth") >= F.col("owns_from")
    along = W.partitionBy("conv").orderBy(F.desc("depth"))
    copies = F.sum(F.when(here, 0).otherwise(F.col("bytes"))).over(along)  # occurrences at this depth and below, less what is owned
    child = F.coalesce(F.lag(here).over(along), F.lit(False))
    marked = marked.select("node", "parent", "depth", "conv", "owns_from", copies.alias("copies"), child.cast("long").alias("child"), F.coalesce("has_leaf", F.lit(False)).cast("long").alias("leaf"))
    out = marked.groupBy("node").agg(
        F.min(F.struct("conv", "owns_from")).alias("owner"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("copies").alias("saved_tokens"),
    )
    out = saved(out.select("node", F.col("owner.conv").alias("conv_id"), F.col("owner.owns_from").alias("owns_from"), "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
    within = out.where("depth <> owns_from or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    owner = out.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = out.where("depth = owns_from and depth > 0").join(owner.hint("merge"), "parent")  # the first owned node: another's child
    none = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    both = within.select("node", *columns).unionByName(top.select("node", *columns))
    return both.join(ends(path).hint("merge"), "node", "left").select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of rows (conv_id, turn, role, text).

    Null roles and texts are empty; null turns come first; rows of one turn go by the digest of role and text; rows of one
    conv_id and turn are turns of their own, equal ones too. Rows without conv_id take no part; texts count whole, however
    long; other columns are not read. A conversation that is rebuilt without a turn ends in the root. An empty table has no
    conversation and gives no rows, not even a root."""
    return trie(saved(paths(rebuilt(saved(turn_digests(conversations), "turns"))), "paths"))


def op13(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The checksum byte by byte; a node is the list of its turn digests, a subtree all nodes whose list begins with it.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id c, sha256(strlen(r) || ':' || r || x) g, strlen(x)::BIGINT b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) - 1 k
  FROM (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL)
), v AS (
  SELECT c, c - c % 5 base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda a, y: list_reduce([xor(a, y)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda p, z: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 9 h FROM (SELECT DISTINCT c FROM t)
), l AS (
  SELECT v.c, 0 part, k, g, b FROM v JOIN t ON t.c = v.base AND k < h UNION ALL SELECT v.c, 1, k, g, b FROM v JOIN t ON t.c = v.c AND k >= h
), p AS (
  SELECT v.c, coalesce(gs, []) gs, coalesce(bs, []) bs FROM v LEFT JOIN (SELECT c, list(g ORDER BY part, k) gs, list(b ORDER BY part, k) bs FROM l GROUP BY c) USING (c)
), o AS (
  SELECT c, d, array_to_string(gs[1:d], ',') n, array_to_string(gs[1:d - 1], ',') u, CASE WHEN d = 0 THEN 0 ELSE bs[d] END b, d = len(gs) e, gs FROM (SELECT *, unnest(range(len(gs) + 1)) d FROM p)
), q AS (
  SELECT n, min(c) c, d, min(u) u, count(*) m, (count(*) - 1) * min(b) s, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e) z, bool_and(e) leaf, min_by(gs, c)[1:d] gs FROM o GROUP BY n, d
), a AS (
  SELECT array_to_string(gs[1:i], ',') n, i d, count(*) FILTER (leaf) w, sum(s) s FROM (SELECT *, unnest(range(d + 1)) i FROM q) GROUP BY ALL
), k AS (SELECT u n, d - 1 d, count(*) k FROM q WHERE d > 0 GROUP BY ALL)
SELECT q.c conv_id, q.d depth, CASE WHEN q.d > 0 THEN r.c END parent_conv_id, q.m n_convs, coalesce(k.k, 0) n_children, a.w n_leaves, a.s::BIGINT saved_tokens, sha256(coalesce(q.z, '')) ends_sha256
FROM q JOIN a ON a.n = q.n AND a.d = q.d LEFT JOIN k ON k.n = q.n AND k.d = q.d LEFT JOIN q r ON r.n = q.u AND r.d = q.d - 1
"""
