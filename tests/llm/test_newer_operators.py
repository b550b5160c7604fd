"""Exact dedup, lexical search and the prefix trie against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionforge.llm import exact_dedup, lexical_search, prefix_trie

DOCS = "doc_id bigint, text string, digest string, keep_id string, n int, winner int, _id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2, "x") for i, t in rows], DOCS)


# --- exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 500, 5000])
def test_perfect_hash_fills_its_slots_and_tells_members(n):
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(2 * n)), "<u8").reshape(-1, 4)
    levels, slot = exact_dedup.perfect_hash(words[:n])
    assert sorted(slot.tolist()) == list(range(n))
    assert (exact_dedup.slots_of(words[:n], levels) == slot).all()
    other = exact_dedup.slots_of(words[n:], levels)
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert 8 * sum(map(len, levels)) <= 6 * n + 64 * 12  # a few bits a digest


def test_digests_that_share_words_are_told_apart():
    words = np.array([[7, 7, 7, k] for k in range(40)] + [[7, k, 7, 7] for k in range(40)], "<u8")
    words = np.unique(words, axis=0)
    levels, slot = exact_dedup.perfect_hash(words)
    assert sorted(slot.tolist()) == list(range(len(words))) and (exact_dedup.slots_of(words, levels) == slot).all()


def brute_copies(rows, seen):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        if i is not None:
            groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        key = norm(t)
        ids = groups.get(key, [])
        old = [x for x in ids if seen(x)]
        keep = min(old or ids) if i is not None else None
        out.append((i, keep, len(ids) if i is not None else 1, i is None or i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slots", "cut"), [(20_000, 150), (3, 150), (3, -1), (7, 10**9)])
def test_exact_duplicates_match_brute_force(spark, monkeypatch, slots, cut):
    """Few digests a bucket, more of them asked for than a bucket's share, no history, nothing but history."""
    monkeypatch.setattr(exact_dedup, "SLOTS", slots)
    r = random.Random(slots + cut)
    rows = [(i, r.choice(["", " ", "\t\n", None, "a b", "a  b", "a\x0bb", " a b", "a b", "é\0x", "w " * 30_000, f"own {i}", f"own {i % 40}"])) for i in range(300)]
    rows += [(5, rows[5][1]), (5, "another text"), (None, "a b"), (None, None)]
    docs = docs_of(spark, rows)
    got = exact_dedup.exact_duplicates(docs, F.col("doc_id") <= cut).collect()
    assert sorted(map(tuple, got), key=repr) == brute_copies(rows, lambda i: i <= cut)
    assert exact_dedup.exact_duplicates(docs.where("false"), F.lit(True)).count() == 0


def test_a_batch_meets_an_index_alone(spark):
    """The history's winners keep their texts from smaller ids, and only the index of it is at hand."""
    history = docs_of(spark, [(100, "x y"), (90, "x  y"), (101, "z")])
    index = exact_dedup.build_index(history.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest")))
    batch = docs_of(spark, [(1, "x y"), (2, "new"), (3, "new "), (4, "new"), (7, "n e w"), (None, "z"), (5, None), (6, "")])
    got = exact_dedup.drop_known(batch, index)
    assert got.columns == batch.columns and sorted((x.doc_id or 0, x["_id"]) for x in got.collect()) == [(0, "x"), (2, "x"), (3, "x"), (5, "x"), (7, "x")]
    rows = {x.doc_id: x.keep_id for x in exact_dedup.exact_duplicates(history.unionByName(batch), F.col("doc_id") >= 90).collect() if x.doc_id}
    assert rows == {100: 90, 90: 90, 101: 101, 1: 90, 2: 2, 3: 3, 4: 2, 7: 7, 5: 5, 6: 5}
    assert exact_dedup.drop_known(batch.where("false"), index).count() == 0


# --- lexical search


def brute_ranking(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, terms(t)) for i, t in docs if i is not None]
    rows = [(i, ts, Counter(ts)) for i, ts in rows if ts]
    n, total = len(rows), sum(len(ts) for _, ts, _ in rows)
    df = Counter(t for _, _, c in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, words, tf in rows:
            m = 100 - 90 + (90 * len(words) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in ts if tf[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ODD = [None, "", " ,.;", "É é İ ß ﬁ", "ÀB àb a\u0085b 日本語 x", "A1b2 a1B2", "_a_b_", "w1 " * 20_000]


@pytest.mark.parametrize(("size", "block"), [(4 << 20, 200_000), (300, 200_000), (1, 15)])
def test_ranking_matches_brute_force(spark, monkeypatch, size, block):
    """One shard, several, one for each document; one block of queries and many; ties and repeated rows."""
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", size)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    r = random.Random(size)
    words = [f"w{int(r.paretovariate(0.6)) % 60}" for _ in range(6000)] + ["É", "rare", "日本語", "A1b2"]
    docs = list(enumerate([*ODD, *(" ".join(r.choice(words) for _ in range(r.choice([1, 3, 8, 40, 200]))) for _ in range(120))]))
    docs += [(500 + k, docs[20][1]) for k in range(14)] + [(30, docs[30][1]), (30, "w1 w2 rare"), (None, "w1 rare")]
    r.shuffle(docs)
    items = list(enumerate([None, "", "no_such absent", docs[3][1], "w1", "W1 w2 w3 rare rare", *(" ".join(r.choice(words) for _ in range(r.choice([2, 10, 40]))) for _ in range(12))]))
    items += [(4, "w2"), (None, "w1"), (20, dict(docs)[20])]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = lexical_search.search(lexical_search.build_index(docs_of(spark, docs)), frame).collect()
    assert sorted(map(tuple, got)) == brute_ranking(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "a b"), (2, ",")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, items.where("false")).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs.where("doc_id = 2")), items).count() == 0
    assert [tuple(x)[:3] for x in lexical_search.search(index, items).collect()] == [(1, 1, 1)]


def test_documents_that_cannot_qualify_are_not_probed():
    """Of a rare and of very frequent terms, the frequent lists are probed for the rare one's documents and no others."""
    n, tally = 5000, Counter()
    common = [(5, np.arange(n), np.full(n, 5)) for _ in range(10)]
    rare = (1000, np.array([7, 99, 4000]), np.array([1000, 900, 1000]))
    ids, scores = lexical_search.max_score([*common, rare], 1020, np.zeros(n, np.int64), tally)
    assert ids.tolist() == [7, 4000] and scores.tolist() == [1050, 1050]
    assert tally["read"] == 3 and tally["probed"] <= 30
    acc = np.zeros(n, np.int64)
    ids, scores = lexical_search.max_score([*common, rare], 1, acc)
    assert len(ids) == n and scores[99] == 950 and not acc.any()
    assert not len(lexical_search.max_score(common, 51, acc)[0])


def test_length_factors_beyond_64_bits():
    lengths = np.array([1, 10**9, 10**7], np.int64)
    assert lexical_search.length_factors(lengths, 10**11, 10**13).tolist() == [10 + 90 * x * 10**11 // 10**13 for x in lengths.tolist()]


# --- prefix trie


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        full[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = {p: m for p, m in nodes.items() if p[: len(path)] == path}
        children = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        leaves = [p for p in under if not any(len(q) > len(p) and q[: len(p)] == p for q in nodes)]
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in under.items() if p)
        ended = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "bits"), [(0, 12), (1, 1), (2, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", bits)
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3, -(10**12) - 4]:
        if r.random() < 0.85:
            for turn in range(r.choice([1, 2, 4, 12, 14])):
                rows.append((c, turn if r.random() < 0.95 else None, r.choice(["user", "assistant", None, ""]) if r.random() < 0.2 else ["user", "assistant"][turn % 2], r.choice(["hi", "hi", "hi", "é", None, "", "bye", "x" * 5000]) if turn < 3 or r.random() < 0.5 else "same"))
    rows += [(3, 1, "user", "hi")] * 3 + [(None, 0, "user", "lost"), (4, 0, "a", "bc"), (4, 0, "ab", "c")]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, "clash", 9) for x in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    got = sorted(map(tuple, prefix_trie.conversation_trie(frame).collect()), key=repr)
    assert got == brute_trie(rows)
    assert prefix_trie.conversation_trie(frame.where("false")).count() == 0


def test_trie_of_one_common_first_turn(spark):
    """Many members at one node, many children of one node, equal conversations of hundreds."""
    rows = [(c, t, "user", "hello" if t == 0 else f"t{c % 7}" if c % 3 else "all the same") for c in range(400) for t in range(10)]
    got = sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    assert got == brute_trie(rows)
