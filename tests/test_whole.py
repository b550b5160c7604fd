"""Queries and operators do the whole job: no copy, row or part of a text is left out."""

import random
import re

import __spark_entry__ as entry
from mentionforge.operators import hygiene, registry, review, summaries
from mentionforge.plans import linking
from tests.oracle import SMALL


def test_copies_keep_their_links(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join(base).upper(), ", ".join(base), " ".join(base + ["more"]), " ".join(base + ["MORE"]), "six words of some other text", "too short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = hygiene.near_duplicate_members(docs).collect()
    member, n_links = {r.doc_id: r.representative for r in rows}, {r.doc_id: r.n_links for r in rows}
    linked = {(r.a, r.b) for r in hygiene.near_duplicate_pairs(docs).collect()}
    words = [re.findall(r"\w+", x.lower()) for x in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    near = {(a, b) for a in range(7) for b in range(a + 1, 7) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert set(member) == {k for k in range(7) if sets[k]}
    assert {(a, b) for a in member for b in member if a < b and (member[a] == member[b] or tuple(sorted((member[a], member[b]))) in linked)} == near
    assert n_links == {k: sum(k in p for p in near) for k in member}


def test_near_pairs_match_brute_force(spark, monkeypatch):
    """Edited copies, excerpts, texts of common shingles, copies, repeated rows, nulls and short texts, with common shingles and
    without."""
    r = random.Random(7)
    base, other = [f"w{k}" for k in range(120)], [f"v{k}" for k in range(60)]
    texts = [None, "", "a b c d", "a b c d e", "A b, c d e"]
    for k in range(40):
        w = list(r.choice([base, other, base + other]))
        if k % 3 == 0:
            w = w[r.randrange(30) : r.randrange(35, 60)]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    words = [re.findall(r"\w+", (x or "").lower()) for x in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and (len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]) or (min(len(sets[a]), len(sets[b])) >= 6 and (sets[a] <= sets[b] or sets[b] <= sets[a])))}
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, texts[8])], "doc_id long, text string").repartition(3)
    for common in (100, 3):
        monkeypatch.setattr(hygiene, "COMMON", common)
        rows = hygiene.near_duplicate_members(docs).collect()
        member = {x.doc_id: x.representative for x in rows}
        linked = {(x.a, x.b) for x in hygiene.near_duplicate_pairs(docs).collect()}
        assert {(a, b) for a in member for b in member if a < b and (member[a] == member[b] or tuple(sorted((member[a], member[b]))) in linked)} == near
        assert len(rows) == len(member) and {x.doc_id: x.n_links for x in rows} == {k: sum(k in p for p in near) for k in member}


def run(spark, tmp_path, name, **tables):
    """The registered query over a folder of these tables: (rows, columns as DDL)."""
    for table, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(*texts, lang="en"):
    return [(k, x, lang, "s", len(x)) for k, x in enumerate(texts)], DOCS


def test_loose_form_reads_whole_texts(spark, tmp_path):
    x = "A b-" * 200 + "The End"
    assert run(spark, tmp_path, "loose_form", documents=docs_of(x, "-")) == [(0, "ab" * 200 + "theend"), (1, None)]


def test_every_training_order_gives_vocabulary(spark, tmp_path):
    items = [(1, 1, 1.0), (61, 2, 1.0), (5, 1, 30.0), (10, 2, 30.0), (15, 2, 1.0), (20, 3, 30.0)], "l_orderkey long, l_partkey long, l_quantity double"
    parts = [(1, "one"), (2, "Two"), (3, "three")], "p_partkey long, p_name string"
    got = run(spark, tmp_path, "seen_unseen", lineitem=items, part=parts)
    assert sorted(got) == [(False, 1, 1, 1.0), (True, 3, 2, 2 / 3)]


def test_alias_groups_take_every_order(spark, tmp_path):
    rows = [(1, 10), (2, 11), (3, 12), (4, 50), (23, 90)]
    pairs, negatives = [(c, c + 1 + k % 3) for k, c in rows], [(c, c + 2) for _, c in rows]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    bad = {root[a] for a, b in negatives if a in root and b in root and root[a] == root[b]}
    got = run(spark, tmp_path, "alias_groups", orders=(rows, "o_orderkey long, o_custkey long"))
    assert sorted(got) == sorted((x, r, r in bad) for x, r in root.items()) and len(bad) == 2


def test_alias_groups_are_not_broadcast(spark):
    pairs, negatives = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"), spark.createDataFrame([(1, 3), (2, 7)], "a long, b long")
    got = review.alias_groups(pairs, negatives)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 1, True), (2, 1, True), (3, 1, True), (7, 7, False), (8, 7, False)]


def test_population_difference_reads_every_document(spark, tmp_path):
    labels = [(1, 0, 0), (2, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int"
    got = run(spark, tmp_path, "population_difference", documents=docs_of("a", "b", "c", "d"), labels=labels)
    assert sorted(got) == [(0, "documents_only"), (3, "documents_only"), (9, "labels_only")]


def test_every_document_has_an_identifier(spark, tmp_path):
    tables = {"documents": docs_of("a", "b", "c", "d", "d"), "labels": ([(2, 0, 1)], "doc_id long, quality int, toxic int")}
    assert sorted(run(spark, tmp_path, "work_groups", **tables)) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
    rows = run(spark, tmp_path, "leakage_codes", **tables)
    codes = {doc: {c for d, c in rows if d == doc} for doc, _ in rows}
    assert "HELDOUT_IDENTIFIER" in codes[3] and "HELDOUT_IDENTIFIER" not in codes[4] and "HELDOUT_WORK_GROUP" in codes[4]
    assert sorted(run(spark, tmp_path, "exposure_reasons", **tables)) == [(2, "identifier"), (3, "identifier")]


def test_tokens_of_every_language(spark, tmp_path):
    rows = [(k, x, lang, "s", len(x)) for k, (x, lang) in enumerate([("aligners run", "en"), ("run vite", "fr"), ("vite", None), ("nous", "de")])]
    got = dict(run(spark, tmp_path, "context_tokens", documents=(rows, DOCS)))
    assert got == {0: ["align", "run"], 1: ["run", "vite"], 2: ["vite"], 3: ["nous"]}
    assert run(spark, tmp_path, "vocab_overlap", documents=(rows, DOCS)) == [(3, 2, 3, 2)]


def test_containment_recall_follows_its_table(spark, monkeypatch):
    """Names are dealt out by document over tasks whose number follows their table; rows without a document are held by nothing."""
    dealt, plain = [], summaries.dealt
    monkeypatch.setattr(summaries, "dealt", lambda df, *keys: dealt.append(keys) or plain(df, *keys))
    wanted = spark.createDataFrame([(1, "Num Py"), (1, "num-py"), (1, "scipy"), (2, "numpy"), (None, "numpy"), (3, "-")], "doc_id long, name string")
    found = spark.createDataFrame([(1, "Num"), (None, "numpy"), (3, "x")], "doc_id long, name string")
    assert [tuple(r) for r in summaries.containment_recall(wanted, found).collect()] == [(4, 1)] and dealt == [("doc_id",)]


def test_the_catalogue_is_dealt_out_before_its_forms_are_told(spark, monkeypatch):
    monkeypatch.setattr(linking, "ENTITY_BYTES", 1 << 10)
    entities = linking._entities(lambda table: spark.read.parquet(f"{SMALL}/{table}.parquet"))
    assert entities._jdf.queryExecution().toRdd().getNumPartitions() > spark.sparkContext.defaultParallelism
    assert registry.form_claims(entities)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1  # by id, which tells claims apart as well
