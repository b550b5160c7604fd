import copy
import json
import os
import random

import pytest

from mentionforge.operators import review_log as rl
from mentionforge.operators.contracts import FIELDS
from mentionforge.sources import files as fs
from mentionforge.streaming import review

TEXT = "We used NumPy 1.2 and SciPy with R here."


def span(word):
    return {"start": TEXT.index(word), "end": TEXT.index(word) + len(word)}


def item(ident="t1", occurrences=(), **more):
    task = {"task_id": ident, "document_id": "d", "text_revision": "r", "policy_version": "2.1", "policy_hash": "h", "offset_base": 0, "annotation_region": {"start": 0, "end": len(TEXT)}, "context_span": {"start": 0, "end": len(TEXT)}, "split": "train", "text": TEXT, "requested_fields": [*FIELDS, "aliases"]}
    region = {"start": 0, "end": len(TEXT), "fields": dict.fromkeys(FIELDS, True)}
    return [ident, json.dumps(task), json.dumps({"occurrences": list(occurrences), "covered_regions": [region], "unresolved_regions": [], **more}), 1, "unreviewed"]


def mention(word, **more):
    known = dict.fromkeys(FIELDS, True)
    return {"name": word, "name_span": span(word), "version_links": [], "version_status": "absent", "intents": ["used"], "sentiment": "not_expressed", "known": known, "evidence": {"intents": [span("used")], "sentiment": []}, **more}


def ident(word):
    return f"d|r|{span(word)['start']}:{span(word)['end']}"


def event(n, base, action, task="t1", **more):
    return {"decision_id": f"d{n}", "task_id": task, "document_id": "d", "text_revision": "r", "reviewer": "me", "reason": "why", "base_annotation_revision": base, "action": action, **more}


def replay(events, start=None):
    task = rl.Task(*(start or item())[1:])
    return task, [task.decide(json.dumps(e)) for e in events]


def alias(a, b, decision="alias", preferred=None):
    return {"member_mention_ids": [ident(a), ident(b)], "relation_type": "short", "decision": decision, "preferred_mention_id": preferred, "evidence_spans": []}


def relation(a, b):
    return rl.relation_id({"document_id": "d", "text_revision": "r"}, [ident(a), ident(b)])


def test_the_twelve_actions():
    link = {"text": "1.2", "span": span("1.2")}
    steps = [
        ("upsert_occurrence", {"value": mention("NumPy")}), ("upsert_occurrence", {"value": mention("SciPy")}), ("link_version", {"target_name_span": span("NumPy"), "value": link}), ("accept_occurrence", {"target_name_span": span("NumPy")}),
        ("upsert_alias", {"value": alias("NumPy", "SciPy", preferred=ident("NumPy"))}), ("accept_alias", {"target_relation_id": relation("NumPy", "SciPy")}), ("unresolve_alias", {"target_relation_id": relation("NumPy", "SciPy")}),
        ("reject_alias", {"target_relation_id": relation("NumPy", "SciPy")}), ("remove_alias", {"target_relation_id": relation("NumPy", "SciPy")}), ("unlink_version", {"target_name_span": span("NumPy"), "value": link}),
        ("mark_field_unresolved", {"target_name_span": span("NumPy"), "field": "intents"}), ("remove_occurrence", {"target_name_span": span("SciPy")}), ("accept_passage", {}),
    ]
    task, states = rl.Task(*item()[1:]), []
    for k, (action, more) in enumerate(steps):
        assert task.decide(json.dumps(event(k, k + 1, action, **more))) == "applied", action
        states.append(copy.deepcopy(task.annotation))
    assert task.revision == task.annotation["annotation_revision"] == 14 and task.status == "reviewed"
    assert states[0]["status"] == "complete" and states[0]["complete_negative_regions"] == []
    assert [o["name"] for o in states[1]["occurrences"]] == ["NumPy", "SciPy"] and states[1]["occurrences"][0]["review"]["decision_id"] == "d0"
    assert states[2]["occurrences"][0]["version_status"] == "explicit" and states[3]["occurrences"][0]["review"]["decision_id"] == "d3"
    decisions = [s["alias_annotations"]["relations"][0]["decision"] for s in states[4:8]]
    assert decisions == ["alias", "alias", "unresolved", "not_alias"] and states[7]["alias_annotations"]["relations"][0]["preferred_mention_id"] is None and states[8]["alias_annotations"]["relations"] == []
    assert states[9]["occurrences"][0]["version_status"] == "absent"
    o = states[10]["occurrences"][0]
    assert o["intents"] is None and not any(o["known"][b] for b in ("created", "used", "shared")) and o["review"]["status"] == "unresolved" and states[10]["status"] == "partial"
    assert len(states[11]["occurrences"]) == 1 and states[12]["human_passage_review"]["decision_id"] == "d12" and states[12]["covered_regions"][0]["human_reviewed_fields"] == ["software"]
    assert set(rl.ACTIONS) >= {a for a, _ in steps} and len(rl.ACTIONS) == 12


@pytest.mark.parametrize(("change", "code"), [
    ({"reason": " "}, "IDENTITY_AND_REASON_REQUIRED"), ({"text_revision": "s"}, "SOURCE_REVISION_MISMATCH"), ({"base_annotation_revision": 1}, "STALE_REVISION"), ({"base_annotation_revision": "3"}, "STALE_REVISION"), ({"action": "other"}, "UNKNOWN_ACTION"),
    ({"actor_kind": "system"}, "ACTOR_FORBIDDEN"), ({"action": "remove_occurrence", "target_name_span": span("R")}, "UNKNOWN_OCCURRENCE"), ({"action": "remove_occurrence", "target_name_span": span("NumPy")}, "ALIAS_MEMBER_IN_USE"),
    ({"action": "upsert_occurrence", "value": mention("NumPy"), "target_name_span": None}, "DUPLICATE_OCCURRENCE"), ({"action": "upsert_occurrence", "value": {**mention("R"), "name": "S"}}, "INVALID_OCCURRENCE"), ({"action": "upsert_occurrence", "value": {**mention("R"), "sentiment": None}}, "INVALID_OCCURRENCE"),
    ({"action": "upsert_occurrence", "value": None}, "INVALID_OCCURRENCE"), ({"action": "upsert_occurrence", "value": mention("R"), "target_name_span": span("NumPy")}, "ALIAS_MEMBER_IN_USE"), ({"action": "unlink_version", "target_name_span": span("NumPy"), "value": {}}, "UNKNOWN_VERSION_LINK"),
    ({"action": "link_version", "target_name_span": span("NumPy"), "value": {"text": "9", "span": span("1.2")}}, "INVALID_OCCURRENCE"), ({"action": "mark_field_unresolved", "target_name_span": span("NumPy"), "field": "software"}, "UNKNOWN_FIELD"), ({"action": "accept_alias", "target_relation_id": "x"}, "UNKNOWN_ALIAS_RELATION"),
    ({"action": "upsert_alias", "value": alias("NumPy", "R")}, "ALIAS_MEMBER_UNKNOWN"), ({"action": "upsert_alias", "value": {}}, "INVALID_ALIAS_RECORD"), ({"action": "upsert_alias", "value": alias("NumPy", "SciPy", "perhaps"), "target_relation_id": relation("NumPy", "SciPy")}, "INVALID_ALIAS_RECORD"),
    ({"decision_id": "d0"}, "DECISION_ID_CONFLICT"),
])
def test_refusals_leave_everything_as_it_was(change, code):
    task, outcomes = replay([event(0, 1, "upsert_occurrence", value=mention("NumPy")), event(1, 2, "upsert_occurrence", value=mention("SciPy")), event(2, 3, "upsert_alias", value=alias("NumPy", "SciPy"))])
    before = copy.deepcopy(task.annotation)
    assert outcomes == ["applied"] * 3
    assert task.decide(json.dumps(event(9, 4, "accept_occurrence", target_name_span=span("NumPy")) | change)) == code
    assert task.annotation == before and task.revision == 4
    assert [task.decide(x) for x in ("[1]", "{", "null")] == ["INVALID_DECISION"] * 3


def test_contradicting_aliases_and_repeated_decisions():
    names = ("NumPy", "SciPy", "R")
    events = [event(k, k + 1, "upsert_occurrence", value=mention(n)) for k, n in enumerate(names)]
    events += [event(3, 4, "upsert_alias", value=alias("NumPy", "SciPy")), event(4, 5, "upsert_alias", value=alias("SciPy", "R")), event(5, 6, "upsert_alias", value=alias("NumPy", "R", "not_alias")), event(4, 5, "upsert_alias", value=alias("SciPy", "R"))]
    assert replay(events)[1] == ["applied"] * 5 + ["ALIAS_CONTRADICTION", "duplicate"]


def batch(n, base, operations, completion="save", revealed=True, actor="human"):
    return event(n, base, "apply_review_batch", actor_kind=actor, value={"schema_version": "1.0", "completion": completion, "proposals_revealed": revealed, "operations": [{"operation_id": f"o{k}", **op} for k, op in enumerate(operations)]})


def test_batches_count_whole_or_not_at_all():
    add = lambda word, **more: {"action": "upsert_occurrence", "value": mention(word, **more), "fields": list(FIELDS)}
    good = batch(0, 1, [add("NumPy"), add("SciPy"), {"action": "record_note"}, {"action": "upsert_alias", "value": alias("NumPy", "SciPy")}])
    task, outcomes = replay([good])
    assert outcomes == ["applied"] and task.status == "in_progress" and [o["review"]["status"] for o in task.annotation["occurrences"]] == ["human_reviewed"] * 2
    kept = copy.deepcopy(task.annotation)
    target = {"target_name_span": span("NumPy")}
    unsure = {**mention("NumPy"), "sentiment": None, "known": {**dict.fromkeys(FIELDS, True), "sentiment": False}}
    for value, code in (
        (batch(1, 2, [{"action": "remove_occurrence", "target_name_span": span("R")}]), "UNKNOWN_OCCURRENCE"), (batch(1, 2, [add("R"), add("R")]), "DUPLICATE_OCCURRENCE"), (batch(1, 2, [{"action": "upsert_occurrence", "value": unsure, **target, "fields": ["software"]}]), "BATCH_OUT_OF_SCOPE"),
        (batch(1, 2, [{"action": "upsert_occurrence", "value": mention("R"), "fields": ["software"]}]), "BATCH_OUT_OF_SCOPE"), (batch(1, 2, [{"action": "link_version", **target}]), "UNKNOWN_ACTION"), (batch(1, 2, [], "approve", False), "BATCH_REVEAL_REQUIRED"), (batch(1, 2, [], "approve", actor="system"), "BATCH_ACTOR_FORBIDDEN"),
        (batch(1, 2, [add("R")], actor="system"), "BATCH_ACTOR_FORBIDDEN"), (batch(1, 2, [{"action": "record_note"}] * 201), "BATCH_OPERATIONS_INVALID"), (batch(1, 2, [], "perhaps"), "BATCH_ENVELOPE_INVALID"), (batch(1, 2, [{"action": "record_source_issue"}]), "WORKFLOW_SOURCE_ISSUE_INVALID"),
        (batch(1, 2, [{"action": "record_note", "operation_id": "o"}, {"action": "record_note", "operation_id": "o"}]), "BATCH_DUPLICATE_OPERATION_ID"), (batch(1, 2, [{"action": "upsert_occurrence", "value": unsure, **target, "fields": ["sentiment"]}], "approve"), "BATCH_APPROVAL_NOT_READY"),
    ):
        assert task.decide(json.dumps(value)) == code and task.annotation == kept, code
    assert task.decide(json.dumps(batch(2, 2, [{"action": "upsert_occurrence", "value": unsure, **target, "fields": ["sentiment"]}]))) == "applied"
    assert task.decide(json.dumps(batch(3, 3, [{"action": "accept_fields", **target, "fields": ["sentiment"]}]))) == "BATCH_CANNOT_CONFIRM_UNKNOWN"
    assert task.decide(json.dumps(batch(4, 3, [{"action": "upsert_occurrence", "value": mention("NumPy"), **target, "fields": ["sentiment"]}], "approve"))) == "applied"
    assert task.status == "reviewed" and task.annotation["review_workflow"]["approval"]["decision_id"] == "d4" and set(task.annotation["review_workflow"]["field_reviews"]) == {ident("NumPy"), ident("SciPy")}
    assert task.decide(json.dumps(batch(5, 4, [{"action": "record_source_issue", "value": {"kind": "scan"}}], actor="system"))) == "applied" and task.annotation["review_workflow"]["approval"] is None
    assert task.decide(json.dumps(event(6, 5, "accept_passage"))) == "SOURCE_ISSUE_BLOCKS_APPROVAL"


def random_log(seed, tasks=12, n=200):
    """Decisions on tasks, most of them on the revision that the task then has, told with gaps, repeats and other faults."""
    r, live, log = random.Random(seed), {f"t{k}": rl.Task(*item(f"t{k}")[1:]) for k in range(tasks)}, []
    for k in range(n):
        t = r.choice([*live, "t0", "t0", "t0"])
        base = live[t].revision if r.random() < 0.85 else r.randrange(1, 5)
        word = r.choice(["NumPy", "SciPy", "R"])
        action, more = r.choice([("upsert_occurrence", {"value": mention(word)}), ("remove_occurrence", {"target_name_span": span(word)}), ("accept_passage", {}), ("upsert_alias", {"value": alias("NumPy", "SciPy")}), ("nothing", {})])
        e = r.choice(log) if log and r.random() < 0.1 else event(k, base, action, t, **more)
        live[e["task_id"]].decide(json.dumps(e))
        log.append(e)
    return log, live


LOG = "decision_id string, task_id string, seq long, payload string"


def rows_of_log(log):
    return [(e["decision_id"], e["task_id"], k, json.dumps(e)) for k, e in enumerate(log)]


@pytest.mark.parametrize("parts", [1, 7])
def test_fold_equals_a_sequential_replay(spark, parts):
    log, live = random_log(parts)
    rows = [*rows_of_log(log), ("x", "gone", 0, json.dumps(event("x", 1, "accept_passage", "gone"))), ("y", "t1", 10**6, None), ("d0", "t99", 10**6, "{}"), (None, "t1", 10**6 + 1, "7")]
    random.Random(1).shuffle(rows)
    items = spark.createDataFrame([*[item(f"t{k}") for k in range(12)], item("t99")], rl.ITEM_DDL)
    state, ledger = rl.fold_log(items, spark.createDataFrame(rows, LOG).repartition(parts))
    got = {x.task_id: x for x in state.collect()}
    assert len(got) == 13 and got["t99"].revision == 1
    for k, t in live.items():
        assert (json.loads(got[k].annotation), got[k].revision, got[k].status) == (t.annotation, t.revision, t.status)
    told = {(x.decision_id, x.seq): x for x in ledger.collect()}
    assert len(told) == len(rows)
    assert [told[k].outcome for k in (("x", 0), ("y", 10**6), ("d0", 10**6), (None, 10**6 + 1))] == ["UNKNOWN_TASK", "INVALID_DECISION", "DECISION_ID_CONFLICT", "INVALID_DECISION"]
    assert sum(x.outcome == "applied" for x in told.values()) == sum(t.revision - 1 for t in live.values()) > 20
    empty, none = rl.fold_log(items.where("false"), spark.createDataFrame([], LOG))
    assert empty.count() == none.count() == 0


def test_a_decision_copies_what_it_changes_and_digests_wait(monkeypatch):
    copies, digests = [], []
    monkeypatch.setattr(rl, "copied", lambda v, f=rl.copied: (copies.append(v), f(v))[1])
    monkeypatch.setattr(rl, "digest", lambda v, f=rl.digest: (digests.append(v), f(v))[1])
    words = ("NumPy", "SciPy", "R")
    events = [event(k, k + 1, "upsert_occurrence", value=mention(w)) for k, w in enumerate(words)] + [event(3, 4, "accept_occurrence", target_name_span=span("SciPy")), event(4, 5, "accept_passage")]
    task, outcomes = replay(events)
    assert outcomes == ["applied"] * 5 and not digests
    assert sum(isinstance(v, dict) and "name_span" in v for v in copies) == 4  # one for each that a decision brings or changes
    assert task.decide(json.dumps(events[0], indent=1)) == "duplicate" and task.decide(json.dumps(events[0] | {"reason": "other"})) == "DECISION_ID_CONFLICT"
    assert task.mark("d0") == rl.digest(events[0]) and task.mark("d9") is None
    monkeypatch.setattr(rl.Task, "FRESH", 2)
    few, outcomes = replay([*events, events[0], events[4], events[1] | {"reason": "other"}])
    assert outcomes[5:] == ["duplicate", "duplicate", "DECISION_ID_CONFLICT"] and len(few.fresh) < 2 and few.annotation == task.annotation


def test_payloads_of_a_log_without_repeats_are_sent_once(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(rl, "materialize", lambda df, name, f=rl.materialize: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), f(df, name))[1])
    items = spark.createDataFrame([item(), item("t2")], rl.ITEM_DDL)
    log = spark.createDataFrame(rows_of_log([event(k, k + 1, "accept_passage") for k in range(5)]), LOG)
    _, ledger = rl.fold_log(items, log)
    assert plans["folded"].count("hashpartitioning") == 1 and {x.outcome for x in ledger.collect()} == {"applied"}
    _, ledger = rl.fold_log(items, log.unionByName(log.select("decision_id", rl.F.lit("t2").alias("task_id"), (rl.F.col("seq") + 9).alias("seq"), "payload")))
    assert sorted((x.task_id, x.outcome) for x in ledger.collect()) == [("t1", "applied")] * 5 + [("t2", "DECISION_ID_CONFLICT")] * 5


def snapshot(spark, seed=3):
    log, live = random_log(seed)
    items = spark.createDataFrame([item(f"t{k}") for k in range(12)], rl.ITEM_DDL)
    decisions = spark.createDataFrame(rows_of_log(log), LOG)
    state, ledger = rl.fold_log(items, decisions)
    applied = decisions.join(ledger.where("outcome = 'applied'").select("decision_id", "seq"), ["decision_id", "seq"], "left_semi").select("decision_id", "task_id", "seq", "payload")
    return log, live, items, state, applied


def test_snapshots_are_checked_and_restored(spark, tmp_path):
    log, live, items, state, applied = snapshot(spark)
    assert rl.snapshot_problems(state, applied, "train").count() == 0
    path = str(tmp_path / "snap")
    digests = review.write_snapshot(items, state, applied, path, "train")
    original, again, decisions = review.read_snapshot(spark, path, "train", digests)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect())) and decisions.count() == applied.count() and original.count() == 12
    tables = rl.reference_tables(state)
    assert tables["occurrences"].count() == sum(len(t.annotation["occurrences"]) for t in live.values())
    pairs = sum(bool(t.annotation.get("alias_annotations", {}).get("relations")) for t in live.values())
    assert tables["aliases"].count() == tables["alias_groups"].count() == pairs > 0
    assert all(x.members == sorted([ident("NumPy"), ident("SciPy")]) and x.group_id == x.members[0] for x in tables["alias_groups"].collect())
    with pytest.raises(fs.Refused, match="MISSING_OR_CHANGED"):
        review.read_snapshot(spark, path, "train", digests | {"coverage": "0"})
    for args, code in (((items, state, applied, "test"), "SPLIT_NOT_PERMITTED"), ((items, state, applied, "dev"), "SPLIT_CONFLICT"), ((items, state, applied.limit(3), "train"), "SNAPSHOT_REVISION")):
        with pytest.raises(fs.Refused, match=code):
            review.write_snapshot(*args[:3], str(tmp_path / "no"), args[3])
    wrong = state.withColumn("status", review.F.lit("in_progress"))
    digests = review.write_snapshot(items, wrong, applied, str(tmp_path / "wrong"), "train")
    with pytest.raises(fs.Refused, match="SNAPSHOT_HISTORY_MISMATCH"):
        review.read_snapshot(spark, str(tmp_path / "wrong"), "train", digests)


def test_each_problem_of_a_snapshot_is_named(spark):
    *_, state, applied = snapshot(spark, 5)
    found = lambda s, d: {x.code for x in rl.snapshot_problems(s, d, "train").collect()}
    lit, col = review.F.lit, review.F.col
    first = applied.orderBy("seq").limit(1)
    moved = applied.withColumn("payload", review.F.regexp_replace("payload", '"base_annotation_revision": 1,', '"base_annotation_revision": 7,'))
    assert found(state.unionByName(state.limit(1)), applied) >= {"SNAPSHOT_DUPLICATE_TASK"}
    assert found(state.withColumn("status", lit("odd")), applied) == {"SNAPSHOT_ITEM_INVALID"}
    assert found(state.withColumn("task", review.F.regexp_replace("task", '"offset_base":0', '"offset_base":1')), applied) == {"SNAPSHOT_ITEM_IDENTITY_MISMATCH"}
    assert found(state, applied.unionByName(first)) >= {"SNAPSHOT_DUPLICATE_DECISION", "SNAPSHOT_REVISION_MISMATCH"}
    assert found(state, applied.unionByName(first.withColumns({"task_id": lit("gone"), "decision_id": lit("new")}))) == {"SNAPSHOT_DECISION_REFERENCE"}
    assert found(state, moved) == {"SNAPSHOT_REVISION_CHAIN"}
    assert found(state, applied.withColumn("payload", review.F.replace(col("payload"), lit('"why"'), lit('" "')))) == {"SNAPSHOT_DECISION_IDENTITY_MISMATCH"}


def stream_of(spark, folder, items, checkpoint, applied=None):
    out = []
    told = review.review_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(folder), items, applied)
    q = told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.awaitTermination(240)
    return spark.createDataFrame(out, review.OUT_DDL)


def test_a_restored_stream_ends_where_one_without_a_stop_does(spark, tmp_path):
    log, live = random_log(8, tasks=4, n=60)
    items = spark.createDataFrame([item(f"t{k}") for k in range(4)], rl.ITEM_DDL)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [dict(zip(("decision_id", "task_id", "seq", "payload"), x, strict=True)) for x in rows_of_log(log)]
    for name, part in (("all", rows), ("first", rows[:30]), ("rest", rows[30:])):
        (tmp_path / name).mkdir()
        for k in range(0, len(part), 15):
            file = tmp_path / name / f"{k:03}.json"
            file.write_text("\n".join(map(json.dumps, part[k : k + 15])) + "\n")
            os.utime(file, (10**9 + k, 10**9 + k))  # a stream takes files in order of time
    want = {k: (t.annotation, t.revision, t.status) for k, t in live.items()}
    state = lambda told, base: {x.task_id: (json.loads(x.annotation), x.revision, x.status) for x in review.latest_items(told, base).collect()}
    assert state(stream_of(spark, str(tmp_path / "all"), items, str(tmp_path / "ck1")), items) == want
    half = stream_of(spark, str(tmp_path / "first"), items, str(tmp_path / "ck2"))
    stopped = review.latest_items(half, items)
    applied = spark.createDataFrame(rows_of_log(log)[:30], LOG).join(half.where("outcome = 'applied'").select("decision_id", "seq"), ["decision_id", "seq"], "left_semi")
    rest = stream_of(spark, str(tmp_path / "rest"), stopped, str(tmp_path / "ck3"), applied)
    assert state(rest, stopped) == want
