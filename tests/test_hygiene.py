import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mentionforge.operators import graph, hygiene, intervals, linkage, registry


@pytest.mark.parametrize("task_edges", [10**6, 40])
def test_components(spark, task_edges):
    r = random.Random(3)
    edges = [(i + 1, i) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    root = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.connected(spark.createDataFrame(edges, "a long, b long").repartition(5), task_edges).collect()
    assert {x.id: x.root for x in got} == root and len(got) == len(root)
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_holds_so_many_vertices_at_once(monkeypatch):
    """Stars of parts have the same components as the edges, however often a task begins anew."""
    monkeypatch.setattr(graph, "TASK_EDGES", 10)
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array([max(e) for e in edges[k : k + 15]]), pa.array([min(e) for e in edges[k : k + 15]])], ["u", "v"]) for k in range(0, 400, 15)]
    out = list(graph._contract(iter(batches)))

    def roots(pairs):
        up = {x: x for x in range(60)}
        for _ in range(60):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    stars = [(u, v) for b in out for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(out) > 3 and roots(stars) == roots(edges)


def test_near_duplicates_and_excerpts(spark):
    base = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base + ["more"])), (3, " ".join(base[10:30])), (4, "quite another text of seven words here"), (5, ""), (6, None)], "doc_id long, text string")
    got = {(r.a, r.b): r.reason for r in hygiene.near_duplicate_pairs(docs).collect()}
    assert got == {(1, 2): "near_duplicate", (1, 3): "excerpt_overlap", (2, 3): "excerpt_overlap"}


def test_overlap_pairs_come_once(spark):
    r = random.Random(5)
    rows = [(1, k, s := r.randrange(900), s + r.randrange(1, 600)) for k in range(60)]
    a = spark.createDataFrame(rows, "doc_id long, id long, start long, end long")
    b = a.select("doc_id", F.col("id").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    got = sorted((x.id, x.id2) for x in intervals.overlap_pairs(a, b, ["doc_id"], F.col("id") < F.col("id2")).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[2] < y[3] and y[2] < x[3])


def test_entity_merge_conflicts(spark):
    rec = [
        ("wikidata:Q1", "wikidata", ["pypi:numpy"], [], ["github.com/n/n"]), ("biotools:numpy", "biotools", ["pypi:numpy"], [], []),
        ("ecosystems:pypi/numpy", "ecosystems", ["pypi:numpy"], [], ["github.com/n/n"]), ("ecosystems:pypi/other", "ecosystems", ["pypi:other"], [], ["github.com/n/n"]),
        ("wikidata:Q9", "wikidata", ["pypi:zeta"], [], ["github.com/z/z"]), ("ecosystems:pypi/eta", "ecosystems", ["pypi:eta"], [], ["github.com/z/z"]), ("wikidata:Q5", "wikidata", [], [], []),
    ]
    df = spark.createDataFrame(rec, "key string, source string, packages array<string>, rrids array<string>, repo_keys array<string>")
    got = {r.key: r for r in registry.merge_records(df).collect()}
    assert {got[k].entity_id for k in ("wikidata:Q1", "biotools:numpy", "ecosystems:pypi/numpy")} == {"wikidata:Q1"}
    assert got["ecosystems:pypi/other"].entity_id == "ecosystems:pypi/other"
    assert got["ecosystems:pypi/eta"].entity_id == "ecosystems:pypi/eta" and got["wikidata:Q5"].entity_id == "wikidata:Q5"
    why = {c.split("|")[-1] for r in got.values() for c in r.conflicts}
    assert why == {"same_source_ecosystems", "distinct_pypi_packages"}


def test_bootstrap_brackets_the_estimate(spark):
    r = random.Random(2)
    rows = [(k, c := r.randrange(5), c + r.randrange(3), c + r.randrange(4)) for k in range(300)]
    got = {x.measure: (x.low, x.high) for x in linkage.bootstrap(spark.createDataFrame(rows, "paper long, correct long, predicted long, gold long"), draws=300).collect()}
    p = sum(x[1] for x in rows) / sum(x[2] for x in rows)
    assert got["precision"][0] < p < got["precision"][1] and got["precision"][1] - got["precision"][0] < 0.2


def test_ranks_over_ranges(spark):
    from mentionforge.operators.ranks import ranked

    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, *range(40)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, v int, id int").repartition(5)
    got = {x.id: (x._r, x._n) for x in ranked(df, ["key"], ["v", "id"]).collect()}
    for key in ("hot", "a", None):
        order = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[2]] for x in order] == [(k + 1, len(order)) for k in range(len(order))]
    assert ranked(df.where("false"), ["key"], ["v"]).count() == 0


def test_exclusion_reasons_match_brute_force(spark):
    r = random.Random(11)
    base = [f"w{k}" for k in range(60)]

    def text():
        w = list(base if r.random() < 0.6 else base[r.randrange(20) : r.randrange(30, 60)])
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        return r.choice([" ", "  "]).join(w)

    docs, held = [(k, text()) for k in range(40)] + [(40, "a b"), (41, None)], [(k, text()) for k in range(15)] + [(15, "a  b"), (16, None)]
    keys, held_keys = [(k, f"k{k % 9}") for k in range(20)] + [(41, None)], [(k, f"k{k % 12}") for k in range(16)] + [(16, None)]
    grams = lambda x: {tuple(w[i : i + 5]) for w in [(x or "").lower().split()] for i in range(len(w) - 4)}
    want = {}
    for a, x in docs:
        for b, y in held:
            s, u = grams(x), grams(y)
            near = s and u and (len(s & u) >= 0.85 * len(s | u) or (min(len(s), len(u)) >= 6 and (s <= u or u <= s)))
            if {k for i, k in keys if i == a and k} & {k for i, k in held_keys if i == b and k}:
                want[a, b] = "identifier_overlap"
            elif near or (x is not None and y is not None and x.split() == y.split()):
                want[a, b] = "text_overlap"
    frame = lambda rows, ddl: spark.createDataFrame([*rows, rows[0]], ddl)
    got = hygiene.exclusion_reasons(frame(docs, "doc_id long, text string"), frame(held, "held_id long, text string"), frame(keys, "doc_id long, key string"), frame(held_keys, "held_id long, key string")).collect()
    assert {(x.doc_id, x.held_id): x.reason for x in got} == want and len(got) == len(want) > 50


def test_exposure_issues(spark):
    rows = [(1, ["document_id:a"], None), (2, ["doi:1", "document_id:a"], [["openalex:w", "document_id:a"], ["openalex:v", "doi:1"], ["openalex:u"]]), (3, None, [["doi:1"]]), (4, ["pmid:1", None], [])]
    got = hygiene.exposure_issues(spark.createDataFrame(rows, "exposure_id long, identity_keys array<string>, associations array<array<string>>")).collect()
    assert sorted((x.exposure_id, x.code, x["keys"]) for x in got) == [(1, "MISSING_SOURCE_IDENTIFIERS", []), (2, "MISSING_DOI", ["openalex:u", "openalex:w"]), (3, "MISSING_SOURCE_IDENTIFIERS", [])]


def test_what_many_entities_claim_makes_no_pairs(spark):
    """Forms that thousands of entities claim: flags look at the form's ends, and lists take the first of each form."""
    n = 6000
    e = spark.range(n).select(F.col("id").alias("entity_id"), F.array(F.when(F.col("id") == n - 1, F.lit("lone name")).otherwise(F.lit("One tool"))).alias("names"), F.array(F.lit("hub kit")).alias("aliases"), F.array().cast("array<string>").alias("packages"), F.array().cast("array<string>").alias("catalogue_names"))
    claims = registry.form_claims(e)
    links = e.select(F.col("entity_id").alias("record"), "entity_id", F.col("names")[0].alias("name"), F.lit("text").alias("description"))
    flagged = registry.catalogue_flags(links, claims)
    assert not re.search("Join.*_o", flagged._jdf.queryExecution().optimizedPlan().toString())  # no row for each other claimant
    assert [r.record for r in flagged.where("size(flags) = 0").collect()] == [n - 1]
    tasks = e.select(F.col("entity_id").alias("task"), F.array(F.lit("HUB KIT"), F.lit("onetool"), F.lit("tool"), F.lit("lone name")).alias("surface_forms"))
    got = linkage.task_candidates(tasks, claims)
    assert got.count() == 12 * n
    one = sorted(map(tuple, got.where("task = 5").collect()))
    assert one == [(5, k, "exact", "HUB KIT") for k in range(12)]
    assert linkage.first_claims(claims).groupBy("key_type", "form").count().agg(F.max("count")).collect()[0][0] == 12
    nested = linkage.task_candidates(tasks.where("task < 3"), registry.surface_forms(e))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, got.where("task < 3").collect()))


def test_entities_of_shared_keys_come_once_and_unshuffled(spark):
    r = random.Random(2)
    some = lambda ids: [(r.choice(ids), [r.choice(["a", "b", "c", "d", None]) for _ in range(r.randrange(4))]) for _ in range(60)]
    a, b = some([*range(20), None]), some([*range(30), None])
    got = linkage.keyed_entities(spark.createDataFrame(a, "task long, keys array<string>"), spark.createDataFrame(b, "entity_id long, keys array<string>"))
    want = {(x, y) for x, k in a for y, m in b if x is not None and y is not None and set(k) & set(m) - {None}}
    of = lambda rows, i: {k for x, ks in rows if x == i for k in ks if k}
    assert want == {(x, y) for x in range(20) for y in range(30) if of(a, x) & of(b, y)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert "Project" in top[0] and "Join" in top[1]  # nothing is done to the pairs once they are joined


def test_groups_of_a_hot_key_are_bounded_and_nothing_is_broadcast(spark, monkeypatch):
    for size, v in (("GROUP_TASKS", 16), ("GROUP_ENTITIES", 32), ("TASK_PAIRS", 4000)):
        monkeypatch.setattr(linkage, size, v, raising=False)
    keys = lambda k: F.array(F.when(F.col("id") % 10 > 0, F.lit("hot")), F.concat(F.lit("k"), F.col("id") % k), F.when(F.col("id") % 3 == 0, F.lit("also")))
    got = linkage.keyed_entities(spark.range(300).select(F.col("id").alias("task"), keys(40).alias("keys")), spark.range(400).select(F.col("id").alias("entity_id"), keys(60).alias("keys")))
    of = lambda n, k: [{x for x in (i % 10 > 0 and "hot", f"k{i % k}", i % 3 == 0 and "also") if x} for i in range(n)]
    want = [(i, j) for i, a in enumerate(of(300, 40)) for j, b in enumerate(of(400, 60)) if a & b]
    assert sorted(map(tuple, got.collect())) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # small as they look, they need not be
    by_task = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(by_task) > 20 and max(by_task) < len(want) / 5


def test_sets_move_only_for_pairs_that_may_be_near(spark, monkeypatch):
    """Texts that share half their words meet by these, and are told apart before their sets are moved."""
    kept, plain = {}, hygiene.materialize
    monkeypatch.setattr(hygiene, "materialize", lambda df, name="part": kept.setdefault(name, plain(df, name)))
    half = [f"w{k}" for k in range(60)]
    texts = [" ".join(half + [f"v{k}x{i}" for i in range(60)]) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, texts[3] + " more")], "doc_id long, text string")
    found = hygiene.near_duplicate_pairs(docs).collect()
    assert [(r.a, r.b) for r in found] == [(3, 40)] and kept["close"].count() == 1
