"""Corpus hygiene: near-duplicate pairs, work groups, leakage codes, exposures, split sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators.graph import connected, materialize
from mentionforge.operators.ranks import ranked
from mentionforge.session import map_in_arrow

#: A shingle that more sets than this hold comes last in the order of rarity; one set in SAMPLED is counted to tell, and MOST_COMMON
#: shingles are told at most. The order decides what is joined on, not what is found.
COMMON = 100
SAMPLED = 8
MOST_COMMON = 1 << 18

#: Words of 64 bits of a set's signature, and the shingles that excerpts are looked for by: one in SEEDS.
WORDS = 32
SEEDS = 8


def shingle_classes(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of documents (doc_id, text) by equal sets of shingles: (doc_id, representative), the smallest id of
    them, and (rep, n, h), with a set's size and the sorted 64-bit hashes of its shingles.

    Documents without shingles (null, empty or shorter texts) and rows without id are in neither; repeated rows count once. Sets
    stay where they were made: what is shuffled is their keys, and rows that stand for no class are taken out by id."""
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  binds a value once
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(width)]))
    hashes = let(F.transform(t.words(F.col("text")), lambda x: F.xxhash64(x)), lambda w: F.when(F.size(w) >= width, F.sort_array(F.array_distinct(some(w)))))
    sets = docs.where("doc_id is not null").select("doc_id", hashes.alias("h")).where("h is not null")
    sets = materialize(sets.select("doc_id", F.size("h").alias("n"), F.xxhash64("h").alias("k"), F.xxhash64(F.lit(1), "h").alias("l"), "h"), "sets")
    keyed = materialize(sets.groupBy("doc_id", "n", "k", "l").agg(F.count("*").alias("rows")), "keys")
    same = keyed.groupBy("n", "k", "l").agg(F.min("doc_id").alias("representative"))
    members = materialize(keyed.join(same, ["n", "k", "l"]).select("doc_id", "representative", "n", "k", "l", "rows"), "members")
    key = ["doc_id", "n", "k", "l"]
    others = materialize(members.where("doc_id <> representative or rows > 1").select(*key), "others")
    rows = sets.join(others, key, "left_anti")
    if not (again := members.where("doc_id = representative and rows > 1").select(*key)).isEmpty():
        rows = rows.unionByName(sets.join(again, key, "left_semi").dropDuplicates(key))
    return members.select("doc_id", "representative"), materialize(rows.select(F.col("doc_id").alias("rep"), "n", "h"), "representatives")


def _prefixes(jaccard: float, common: np.ndarray):
    """Sets (rep, n, h) to (rep, n, p, seed, parity): the first n - ceil(jaccard * n) + 1 shingles in the order of rarity; the first that is
    rare and a multiple of SEEDS, else the first; and for each of 64 * WORDS bits whether an odd number of shingles falls on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, heads, seeds, parity = b.column(2), [], [], []
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            often = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values if len(common) else np.zeros(len(values), bool)
            bits = (values.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * WORDS)
            for i, j in pairwise(at):
                h, c = values[i:j], often[i:j]
                rare = h[~c]
                order, marked = np.concatenate([rare, h[c]]), rare[rare % SEEDS == 0]
                heads.append(order[: len(h) - math.ceil(jaccard * len(h) - 1e-9) + 1])
                seeds.append(marked[0] if len(marked) else order[0])
                parity.append(np.packbits((np.bincount(bits[i:j], minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            p = pa.ListArray.from_arrays(ends, np.concatenate(heads)) if heads else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), p, pa.array(seeds, pa.int64()), pa.array(parity, pa.list_(pa.int64()))], ["rep", "n", "p", "seed", "parity"])

    return run


def near_class_pairs(classes: DataFrame, jaccard: float = 0.85, least_excerpt: int = 6) -> DataFrame:
    """(a, b, jaccard, reason) of classes of shingle_classes whose sets nearly agree or contain one another.

    Exact, by prefix filtering: with sets in one order, two of Jaccard j share one of the first n - ceil(j * n) + 1 of each, and
    as many more of these as their sizes ask for. The order is by hash, but for shingles of more than COMMON sets, which come
    last and so are joined on only where a set has little else. A shingle of a contained set, its seed, is among the other's: it
    is one in SEEDS where it can be, so that only these of every set are shuffled; the few other seeds meet all of them. Each
    shingle in which two sets differ changes one bit of their parities, so those that differ in too many bits are dropped
    before sets are moved; the rest are confirmed by the sizes of their intersections, the smaller set brought to the larger.
    Sets that differ make a pair each, so the result grows with the square of a group of unlike near copies."""
    shingle = F.explode("h").alias("g")
    counted = classes.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).select(shingle).groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") * SAMPLED > COMMON)
    common = np.array(sorted(r.g for r in counted.orderBy(F.desc("df"), "g").limit(MOST_COMMON).select("g").collect()), np.int64)
    ranked = materialize(map_in_arrow(classes.select("rep", "n", "h"), _prefixes(jaccard, common), f"rep {dict(classes.dtypes)['rep']}, n int, p array<bigint>, seed bigint, parity array<bigint>"), "prefixes")
    share = lambda n: F.ceil(F.lit(jaccard) * n - 1e-9)
    first = ranked.select("rep", "n", F.explode("p").alias("g"))
    a, b = first.select("g", F.col("rep").alias("a"), F.col("n").alias("na")), first.select("g", F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= share(F.greatest("na", "nb")))).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    both = F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("na") + F.col("nb")) - 1e-9)  # shingles that a near pair shares at least
    near = met.where(F.col("c") > both - share(F.greatest("na", "nb"))).select("a", "b")
    seed = ranked.where(F.col("n") >= least_excerpt).select(F.col("seed").alias("g"), F.col("rep").alias("x"), F.col("n").alias("nx"))
    every = classes.select(shingle, F.col("rep").alias("y"), F.col("n").alias("ny"))
    marked = F.pmod("g", F.lit(SEEDS)) == 0
    hits = every.where(marked).join(seed.where(marked), "g").unionByName(every.join(materialize(seed.where(~marked), "seeds"), "g"))
    inside = hits.where((F.col("x") != F.col("y")) & (F.col("nx") < F.col("ny"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = materialize(near.unionByName(inside).distinct(), "pairs")

    side = lambda c: ranked.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    odd = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.col("na") + F.col("nb") - 2 * both
    excerpt = (F.least("na", "nb") >= least_excerpt) & (F.col("odd") <= F.abs(F.col("na") - F.col("nb")))
    swap = F.col("na") > F.col("nb")
    left = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("odd", odd).where((F.col("odd") <= most) | excerpt)
    left = materialize(left.select("a", "b", "na", "nb", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("l")), "close")
    held = lambda c, h: classes.join(left.select(F.col(c).alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias(c), F.col("h").alias(h))
    found = left.join(held("s", "hs"), "s").join(held("l", "hl"), "l").withColumn("i", F.size(F.array_intersect("hs", "hl"))).withColumn("jaccard", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    found = found.where((F.col("jaccard") >= jaccard) | ((F.least("na", "nb") >= least_excerpt) & (F.col("i") == F.least("na", "nb"))))
    return found.select("a", "b", "jaccard", F.when(F.col("jaccard") >= jaccard, F.lit("near_duplicate")).otherwise(F.lit("excerpt_overlap")).alias("reason"))


def near_duplicate_pairs(docs: DataFrame, jaccard: float = 0.85, least_excerpt: int = 6, width: int = 5) -> DataFrame:
    """near_class_pairs of documents (doc_id, text). Equal sets meet once, by the smallest id that holds them;
    near_duplicate_members says who they stand for. Pairs of one work group are pairs here too."""
    return near_class_pairs(shingle_classes(docs, width)[1], jaccard, least_excerpt)


def near_duplicate_members(docs: DataFrame, jaccard: float = 0.85, least_excerpt: int = 6, width: int = 5) -> DataFrame:
    """(doc_id, representative, n_links) of every document (doc_id, text) with shingles: the smallest id of those with an equal set,
    and how many other documents it is near to: those of its own class and of the classes that near_duplicate_pairs pairs with it."""
    members, classes = shingle_classes(docs, width)
    pairs = near_class_pairs(classes, jaccard, least_excerpt)
    sizes = members.groupBy("representative").agg(F.count("*").alias("size"))
    size = sizes.select(F.col("representative").alias("b"), F.col("size").alias("m"))
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(size, "b").groupBy("a").agg(F.sum("m").alias("m"))
    counts = sizes.join(links.withColumnRenamed("a", "representative"), "representative", "left").select("representative", (F.col("size") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(counts, "representative").select("doc_id", "representative", "n_links")


def work_groups(docs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(doc_id, work_id): documents linked by an identifier (doc_id, key) or by equal text with white space collapsed.

    Each key links its documents to its smallest one, so a key that many documents hold costs as many edges."""
    texts = docs.select("doc_id", F.concat(F.lit("text:"), t.text_digest(F.col("text"))).alias("key"))
    keys = identifiers.select("doc_id", "key").unionByName(texts).distinct()
    low = keys.groupBy("key").agg(F.min("doc_id").alias("b"))
    edges = keys.join(low, "key").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    return docs.select("doc_id").join(connected(edges).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("work_id"))


def leakage_codes(docs: DataFrame, heldout_groups: DataFrame, heldout_texts: DataFrame, heldout_ids: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, code) of training documents (doc_id, work_id, digest, native_split, split, source) that touch held-out ones."""
    hit_id = ids.join(heldout_ids.distinct(), "key", "left_semi").select("doc_id").distinct().withColumn("_i", F.lit(True))
    d = docs.join(heldout_groups.select("work_id").distinct().withColumn("_g", F.lit(True)), "work_id", "left")
    d = d.join(heldout_texts.select("digest").distinct().withColumn("_t", F.lit(True)), "digest", "left").join(hit_id, "doc_id", "left")
    rules = [
        ("HELDOUT_WORK_GROUP", F.col("_g")),
        ("HELDOUT_TEXT", F.col("_t")),
        ("HELDOUT_IDENTIFIER", F.col("_i")),
        ("NATIVE_HELDOUT", F.col("native_split").isin("test", "dev", "devel", "validation", "unknown")),
        ("HELDOUT_DOCUMENT", F.coalesce(F.col("split"), F.lit("train")) != "train"),
        ("SYNTHETIC_NOT_RESEARCH", F.contains(F.lower("source"), F.lit("synthetic"))),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return d.select("doc_id", F.explode(codes).alias("code"))


def exposure_reasons(docs: DataFrame, exposed: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, reason): an identifier in common beats equal text. exposed: (kind, key), kind identifier or text."""
    by_id = ids.join(exposed.where("kind = 'identifier'").select("key").distinct(), "key", "left_semi").select("doc_id", F.lit(0).alias("rank"), F.lit("identifier").alias("reason"))
    texts = docs.select("doc_id", t.text_digest(F.col("text")).alias("key"))
    by_text = texts.join(exposed.where("kind = 'text'").select("key").distinct(), "key", "left_semi").select("doc_id", F.lit(1).alias("rank"), F.lit("text").alias("reason"))
    return by_id.unionByName(by_text).groupBy("doc_id").agg(F.min_by("reason", "rank").alias("reason"))


def seeded_rank(seed: int, *keys: str) -> Column:
    """An order that looks random and is the same in every engine: the digest of seed and keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"), 256)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a task before it shuffles."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def share_per_key(df: DataFrame, by: Sequence[str], order: Sequence, share: float) -> DataFrame:
    """The first ceil(share * size) rows of each key, however large it is."""
    keyed = df.withColumns({f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)})
    r = ranked(keyed, by, [f"_o{k}" for k in range(len(order))])
    return r.where(F.col("_r") <= F.ceil(F.col("_n") * share)).select(*df.columns)


def round_robin(df: DataFrame, stratum: str, order: Sequence, n: int, priority: str | None = None) -> DataFrame:
    """n rows taken in turn from the strata, preferred ones (priority 0) first: the k-th rows of all strata come before any
    k+1-th."""
    first = [F.col(priority)] if priority else []
    turn = F.row_number().over(W.partitionBy(*([priority] if priority else []), stratum).orderBy(*order))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy(*first, "_turn", stratum).limit(n).drop("_turn")


def exclusion_reasons(docs: DataFrame, held: DataFrame, doc_ids: DataFrame, held_ids: DataFrame, jaccard: float = 0.85, least_excerpt: int = 6, width: int = 5) -> DataFrame:
    """(doc_id, held_id, reason) of documents (doc_id, text) that held-out ones (held_id, text) bar: identifier_overlap where they share
    a key (doc_id, key; held_id, key), else text_overlap where their texts are equal with white space collapsed, their sets of
    shingles nearly agree, or one of `least_excerpt` shingles or more lies in the other.

    Shared shingles are counted exactly, for each pair that has one; what is joined is a document's distinct shingle hashes, and
    the join is with those of the held-out texts alone. Null and short texts have no shingles; null ids, keys and texts meet
    nothing; repeated rows count once."""
    grams = lambda df, key: df.where(F.col(key).isNotNull()).select(key, F.array_distinct(F.transform(t.shingles(F.col("text"), width), lambda g: F.xxhash64(g))).alias("g")).dropDuplicates([key]).where(F.size("g") > 0)
    a = materialize(grams(docs, "doc_id").withColumn("na", F.size("g")), "shingles")
    b = materialize(grams(held, "held_id").withColumn("nb", F.size("g")), "shingles")
    shared = a.select("doc_id", "na", F.explode("g").alias("g")).join(b.select("held_id", "nb", F.explode("g").alias("g")), "g").groupBy("doc_id", "held_id", "na", "nb").agg(F.count("*").alias("i"))
    least = F.least("na", "nb")
    near = shared.where((F.col("i") >= F.lit(jaccard) * (F.col("na") + F.col("nb") - F.col("i"))) | ((least >= least_excerpt) & (F.col("i") == least))).select("doc_id", "held_id")
    digest = t.text_digest(F.col("text")).alias("d")
    same = docs.where("text is not null").select("doc_id", digest).join(held.where("text is not null").select("held_id", digest), "d").select("doc_id", "held_id")
    keyed = doc_ids.select("doc_id", "key").distinct().join(held_ids.select("held_id", "key").distinct(), "key").select("doc_id", "held_id")
    both = keyed.withColumn("k", F.lit(True)).unionByName(near.unionByName(same).withColumn("k", F.lit(False))).dropna(subset=["doc_id", "held_id"])
    return both.groupBy("doc_id", "held_id").agg(F.when(F.max("k"), F.lit("identifier_overlap")).otherwise(F.lit("text_overlap")).alias("reason"))


#: Keys that name a record here and no source.
OWN_KEYS = ("document_id:", "work_group_id:")


def exposure_issues(rows: DataFrame) -> DataFrame:
    """(exposure_id, code, keys) of exposures (exposure_id, identity_keys, associations): MISSING_SOURCE_IDENTIFIERS where no key is a
    source's, and MISSING_DOI, with the catalogue ids (openalex:) of those associations, lists of keys that belong together, in
    which no doi: is known. Null lists count as empty; repeated rows give theirs again."""
    none = F.array().cast("array<string>")
    starts = lambda x, *p: F.coalesce(F.greatest(*[F.startswith(x, F.lit(y)).cast("int") for y in (*p, *p)]) == 1, F.lit(False))
    own = F.forall(F.coalesce("identity_keys", none), lambda x: starts(x, *OWN_KEYS))
    lacking = F.filter(F.coalesce("associations", F.array().cast("array<array<string>>")), lambda g: ~F.exists(g, lambda x: starts(x, "doi:")))
    open_ = F.array_sort(F.array_distinct(F.filter(F.flatten(lacking), lambda x: starts(x, "openalex:"))))
    found = F.array(F.when(own, F.struct(F.lit("MISSING_SOURCE_IDENTIFIERS").alias("code"), none.alias("keys"))), F.when(F.size(open_) > 0, F.struct(F.lit("MISSING_DOI").alias("code"), open_.alias("keys"))))
    return rows.select("exposure_id", F.inline(F.array_compact(found)))
