import random

import pytest
from pyspark.sql import functions as F

from mentionforge.operators import spans, splits
from mentionforge.operators import summaries as sm


def test_splits_take_turns_and_say_what_is_short(spark):
    rows = [("t1", "s", "a", ["test"], None, None), ("t2", "s", "b", None, None, True), ("d1", "s", None, ["devel"], False, None), ("u", "s", "a", ["unknown"], None, None), ("h", "s", "a", [], True, None)]
    rows += [(f"x{k}", "s", "ab"[k % 2], ["train"] if k % 3 else None, False, False) for k in range(10)] + [("lone", None, None, None, None, None)]
    g = spark.createDataFrame(rows, "work_id string, source string, stratum string, natives array<string>, historical boolean, exposed boolean")
    taken, short = splits.assign_splits(g, {"test": 2, "dev": 2, "train": 4}, 5)
    got = {r.work_id: r.split for r in taken.where("source = 's'").collect()}
    assert got["t1"] == "test" and got["d1"] == "dev" and "u" not in got and "h" not in got
    assert sorted(got.values()) == ["dev"] * 2 + ["test"] * 2 + ["train"] * 4 and got.get("t2", "train") == "train"
    assert len(got) == len(taken.where("source = 's'").collect())
    assert all(r.available < r.required for r in short.collect())
    empty, none = splits.assign_splits(g.where("false"), {"test": 1, "dev": 1, "train": 1}, 5)
    assert empty.count() == none.count() == 0


def test_evaluation_pool_gives_one_document_a_paper(spark):
    rows = spark.createDataFrame([(k,) for k in range(12)] + [(3,)], "doc_id long")
    links = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    exposed = spark.createDataFrame([(5,)], "doc_id long")
    got = {r.doc_id: (r.part, r.representative) for r in splits.evaluation_pool(rows, links, exposed, 3, 2, 7).collect()}
    assert {got[4][0], got[5][0]} == {"historical_exposure"} and got[4][1] is None
    assert len({got[k][1] for k in (0, 1, 2)}) == 1 and sorted(got[k][0] == "same_paper_or_duplicate" for k in (0, 1, 2)) == [False, True, True]
    parts = [p for p, _ in got.values()]
    assert (parts.count("evaluation"), parts.count("development"), len(got)) == (3, 2, 12)


def test_names_and_versions_behind_them(spark):
    cases = {
        "We ran R 4.1 here": (["R"], True), "for the rest": ([], False), "NUMPY, version 1.2 ran": (["NumPy"], True), "numpy and 3 others": (["NumPy"], False), "numpy2": ([], False),
        "C++ (v2)": (["C++"], True), "r 4": ([], False), "x.NumPy-": (["NumPy"], False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    hits, version = splits.names_in(F.col("t"), ["R", "NumPy", "C++"])
    assert {r.t: (r.h, r.v) for r in df.select("t", hits.alias("h"), version.alias("v")).collect()} == cases


def test_paired_bootstrap_covers_the_difference(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(6), r.randrange(3), r.randrange(3), r.randrange(5), r.randrange(3), r.randrange(4)) for k in range(400)]
    df = spark.createDataFrame(rows, "paper long, tp long, fp long, fn long, tp2 long, fp2 long, fn2 long")
    got = splits.paired_bootstrap(df, draws=400, low=10, high=389).first()
    f1 = lambda a, b, c: 2 * a / (2 * a + b + c)
    total = [sum(x[k] for x in rows) for k in range(1, 7)]
    assert got.n == 400 and abs(got.difference - 100 * (f1(*total[:3]) - f1(*total[3:]))) < 1e-9 and got.low < got.difference < got.high
    same = df.select("paper", "tp", "fp", "fn", F.col("tp").alias("tp2"), F.col("fp").alias("fp2"), F.col("fn").alias("fn2"))
    one = splits.paired_bootstrap(same, draws=50, low=1, high=48).first()
    assert (one.difference, one.low, one.high) == (0.0, 0.0, 0.0)
    # means and spreads of the draws are those of drawing papers with replacement
    draws = []
    for _ in range(400):
        pick = [rows[r.randrange(400)] for _ in range(400)]
        t = [sum(x[k] for x in pick) for k in range(1, 7)]
        draws.append(100 * (f1(*t[:3]) - f1(*t[3:])))
    draws.sort()
    width = got.high - got.low
    assert abs(draws[10] - got.low) < width / 4 and abs(draws[389] - got.high) < width / 4


def test_errors_are_loud(spark):
    results = spark.createDataFrame([(1, "c"), (2, "c")], "doc_id long, checkpoint string")
    for timings in ([(1, "c", 1.0)], [(1, "c", 1.0), (1, "c", 2.0), (2, "c", 1.0)]):
        with pytest.raises(Exception, match="TIMING_NOT_ONE_TO_ONE"):
            sm.timing_join(results, spark.createDataFrame(timings, "doc_id long, checkpoint string, seconds double")).collect()
    replies = spark.createDataFrame([("```json\n[{\"name\": \"x\"}]",), ("{}",), ("[1] and more",)], "r string")
    for k in range(3):
        with pytest.raises(Exception, match="INCOMPLETE_JSON_ARRAY"):
            replies.where(F.col("r") == replies.collect()[k].r).select(sm.fenced_records(F.col("r"), "array<struct<name:string>>")).collect()
    with pytest.raises(ValueError):
        sm.markdown(spark.range(3), most=2)
    assert sm.markdown(spark.createDataFrame([(1, None, 0.5), (2, "a|b", None)], "x int, y string, z double")) == "| x | y | z |\n|---|---|---|\n| 1 |  | 0.5000 |\n| 2 | a\\|b |  |\n"


def test_surface_hits_are_words_in_their_own_case(spark):
    docs = spark.createDataFrame([(1, "R and R, Ruby.R C++ C++x"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.name, r.start, r.end) for r in sm.surface_hits(docs, ["R", "C++"]).collect())
    assert got == [(1, "C++", 16, 19), (1, "R", 0, 1), (1, "R", 6, 7), (1, "R", 14, 15)]


def test_merge_problems_name_what_differs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (2, "x", "y"), (3, None, None)], "doc_id long, p string, q string")
    b = spark.createDataFrame([(1, "x", "z"), (2, "x", "y"), (4, None, None)], "doc_id long, p string, q string")
    assert sorted((r.doc_id, r.problem) for r in sm.merge_problems(a, b, ["p", "q"]).collect()) == [(1, "differs: q"), (2, "twice"), (3, "only left"), (4, "only right")]


def test_boundary_policies(spark):
    frame = spark.createDataFrame([(1, "use ImageJ® 1.2.3 or Image", 4, 17, "SOFTWARE")], "doc_id long, text string, start long, end long, label string")
    assert [tuple(x) for x in spans.repair_boundaries(frame, "none").collect()] == [(1, "SOFTWARE", 4, 17, [])]
    assert spans.repair_boundaries(frame).first().events == ["absorbed_version", "whitespace_trim"]  # the sign stands before a blank
    rows = [(1, "SOFTWARE", 0, 7), (1, "SOFTWARE", 0, 5), (1, "VERSION", 0, 5), (1, "SOFTWARE", 0, 7), (1, "SOFTWARE", 2, 7), (1, "SOFTWARE", 5, 9), (2, "SOFTWARE", 0, 5)]
    kept = spark.createDataFrame(rows, "doc_id long, label string, start long, end long")
    assert sorted(tuple(x) for x in spans.resolved_spans(kept).collect()) == [(1, "SOFTWARE", 0, 7), (1, "SOFTWARE", 5, 9), (1, "VERSION", 0, 5), (2, "SOFTWARE", 0, 5)]
    assert sorted(tuple(x) for x in spans.resolved_spans(kept, "none").collect()) == sorted(set(rows))
    with pytest.raises(ValueError, match="other"):
        spans.repair_boundaries(frame, "other")


def test_review_states_follow_the_stamps(spark):
    ddl = "task_id int, mention_id int, field string, known boolean, stamp_state string, stamp_hash string, value_hash string, ambiguous boolean, accepted boolean"
    rows = [
        (1, 1, "software", True, "confirmed", "h", "h", None, None), (1, 1, "versions", False, "confirmed", "h", "h", True, None), (1, 1, "used", False, "unresolved", "h", "h", None, None),
        (1, 1, "shared", None, None, None, "h", None, None), (1, 1, "created", True, "confirmed", "old", "h", None, True), (1, 1, "sentiment", True, None, None, None, None, None), (2, 1, "software", True, None, None, None, None, True),
    ]
    s = sm.field_states(spark.createDataFrame(rows, ddl))
    assert {(r.task_id, r.field): r.state for r in s.collect()} == {(1, "software"): "confirmed", (1, "versions"): "unresolved", (1, "used"): "unresolved", (1, "shared"): "missing", (1, "created"): "confirmed", (1, "sentiment"): "proposed", (2, "software"): "confirmed"}
    assert sorted((r.unit, r.code) for r in sm.review_questions(s).collect()) == [("intents", "unresolved"), ("sentiment", "confirm_proposal"), ("versions", "unresolved")]
    tasks = spark.createDataFrame([(1, 0, True, False), (2, None, True, None), (3, 2, True, True), (4, 0, False, None)], "task_id int, n_issues int, approved boolean, touched boolean")
    assert {r.task_id: (r.workflow_status, r.can_approve) for r in sm.review_status(tasks, s).collect()} == {1: ("in_progress", False), 2: ("approved", True), 3: ("source_issue", False), 4: ("pending", True)}


def test_links_of_a_paper_are_put_together_on_its_row(spark, monkeypatch):
    """Papers of few rows need no graph; papers of more take it, with the same result."""
    r = random.Random(8)
    rows = [(p, k % 4, [r.randrange(14) for _ in range(r.randrange(4))]) for p in range(6) for k in range(r.randrange(9))] + [(None, 1, [1, 2]), (2, 5, None), (3, 9, [None, 4]), (4, None, [1, 99])]
    gold = spark.createDataFrame(rows, "paper long, row_id long, entity_ids array<long>")
    predicted = spark.createDataFrame([(r.choice([0, 1, 2, 3, 9, None]), r.choice([*range(16), None])) for _ in range(60)], "paper long, entity_id long")
    sets = {}
    for p, k, es in rows:
        if p is not None and k is not None:
            sets.setdefault(p, {}).setdefault(k, set()).update(e for e in es or [] if e is not None)
    want = set()
    for p, by_row in sets.items():
        groups = []
        for s in by_row.values():
            if s:
                hit = [g for g in groups if g & s]
                groups = [g for g in groups if not g & s] + [s.union(*hit)]
        want |= {(p, f"{p}|{min(g):020d}", e) for g in groups for e in g}
    graph = splits.connected
    monkeypatch.setattr(splits, "connected", None)  # no rounds for these
    assert sorted(map(tuple, splits.merged_gold(gold).collect())) == sorted(want)
    whole = splits.paper_link_metrics(gold, predicted).collect()
    monkeypatch.setattr(splits, "connected", graph)
    monkeypatch.setattr(splits, "MOST_ROWS", 8)
    assert sorted(map(tuple, splits.merged_gold(gold).collect())) == sorted(want)
    assert splits.paper_link_metrics(gold, predicted).collect() == whole
    pairs = {(x.paper, x.entity_id) for x in predicted.collect() if x.entity_id is not None}
    held = {(p, e) for p, _, e in want}
    assert list(whole[0])[:4] == [len(pairs), len(pairs & held), len({w[:2] for w in want}), len({w[:2] for w in want if (w[0], w[2]) in pairs})]
