import copy
import hashlib

import pytest

from mentionforge.operators import consistency as cs
from mentionforge.operators import contracts as ct

TEXT = "We used NumPy 1.2 with SciPy and R."
REV = "sha256:" + hashlib.sha256(TEXT.encode()).hexdigest()


def at(word):
    return {"start": TEXT.index(word), "end": TEXT.index(word) + len(word)}


def ident(word):
    return f"doc|{REV}|{at(word)['start']}:{at(word)['end']}"


def field(value, scores, **more):
    return {"status": "success", "value": value, "scores": scores, "reasons": [], "context_span": None, "context_text": None, "evidence_method": None, **more}


def entry(word, versions):
    low = dict.fromkeys(ct.SENTIMENTS, 0.1)
    context = {"context_span": {"start": 0, "end": len(TEXT)}, "context_text": TEXT, "evidence_method": "model_input_context"}
    return {
        "mention_id": ident(word), "name": word, "name_span": at(word), "software": field([word], {"software": 0.9}), "versions": field(versions, {"1": 0.8} if versions else {}),
        "intents": field(["used"], {"created": 0.1, "used": 0.7, "shared": 0.2}, **context), "sentiment": field(["positive"], low | {"positive": 0.6}),
    }


def pair(k, a, b, label, second=None):
    return {"pair_id": f"p{k}", "first_id": ident(a), "second_id": second or ident(b), "first_span": at(a), "second_span": at(b), "status": "success", "label": label, "scores": {"yes": 0.9}, "reasons": [], "context_span": {"start": 0, "end": len(TEXT)}, "context_text": TEXT, "evidence_method": "model_input_context"}


def good():
    stage = {"status": "success", "candidate_count": 3, "completed_count": 3, "occurrence_count": 3, "reasons": []}
    names = ("NumPy", "SciPy", "R")
    fields = [entry("NumPy", ["14:17"]), entry("SciPy", []), entry("R", [])]
    alias = [pair(1, "NumPy", "SciPy", "alias"), pair(2, "SciPy", "R", "alias"), pair(3, "NumPy", "R", "not_alias")]
    return {
        "document_id": "doc", "text_revision": REV, "text": TEXT, "schema_version": cs.SCHEMA, "offset_unit": ct.OFFSET_UNIT, "stages": {s: dict(stage) for s in cs.STAGES}, "pipeline_complete": True, "public_contract_complete": True, "status": "success",
        "detector": {"status": "success", "spans": [{"label": "SOFTWARE", **at(n), "text": n, "score": 0.9} for n in names] + [{"label": "VERSION", **at("1.2"), "text": "1.2", "score": 0.8}], "chunks": [{"status": "success"}]},
        "fields": fields, "links": [pair(0, "NumPy", "1.2", "linked", "version:" + ident("1.2"))], "alias_pairs": [{**p, "relation_type": None, "preferred_mention_id": None} for p in alias],
        "alias_groups": [{"members": sorted(map(ident, names)), "edges": ["p1", "p2"], "chords": ["p3"]}], "exclusions": [],
        "occurrences": [{"mention_id": f["mention_id"], "name": f["name"], "versions": f["versions"]["value"], "intents": ["used"], "sentiment": "positive"} for f in fields],
    }


def put(value, *path):
    def change(p):
        for k in path[:-1]:
            p = p[k]
        p[path[-1]] = value

    return change


def both(*changes):
    return lambda p: [c(p) for c in changes]


def failing(p):
    """A detector that failed, told as it should be."""
    p.update(fields=[], occurrences=[], links=[], alias_pairs=[], alias_groups=[], detector=None, pipeline_complete=False, public_contract_complete=False, status="failure")
    for s in cs.STAGES:
        p["stages"][s].update(status="failed" if s == "detector" else "blocked", reasons=["x"])


#: A change of a prediction that is right, and the rules that it breaks.
FAULTS = [
    (put("x", "schema_version"), {"identity"}), (put("sha256:0", "text_revision"), {"identity", "fields", "links", "alias_pairs", "detector_coverage"}), (lambda p: p["stages"].pop("alias"), {"stages", "pipeline_complete", "status"}),
    (put(9, "stages", "alias", "completed_count"), {"stage_counts"}), (both(put("partial", "stages", "alias", "status"), put(False, "pipeline_complete"), put("partial", "status")), {"stage_reasons"}), (put(False, "pipeline_complete"), {"pipeline_complete"}),
    (put("Numpy", "detector", "spans", 0, "text"), {"detector_spans"}), (put(float("nan"), "detector", "spans", 0, "score"), {"detector_spans"}), (put("OTHER", "detector", "spans", 3, "label"), {"detector_spans", "links"}), (put("numpy", "fields", 0, "name"), {"fields", "occurrences"}),
    (put(ident("R"), "fields", 0, "mention_id"), {"fields", "occurrences", "detector_coverage"}), (put(["x"], "fields", 0, "intents", "value"), {"intent_labels", "occurrences"}), (put({"used": 0.7}, "fields", 0, "intents", "scores"), {"intent_labels"}),
    (put(1.5, "fields", 0, "intents", "scores", "used"), {"field_states"}), (put(["negative"], "fields", 1, "sentiment", "value"), {"sentiment_label", "occurrences"}), (put("odd", "fields", 1, "sentiment", "context_text"), set()),
    (put("odd", "fields", 1, "intents", "context_text"), {"field_context"}), (lambda p: p["occurrences"].pop(), {"occurrences"}), (put("negative", "occurrences", 0, "sentiment"), {"occurrences"}), (put("failed", "detector", "chunks", 0, "status"), {"detector_coverage"}),
    (lambda p: p["detector"]["spans"].pop(2), {"detector_coverage", "alias_pairs"}), (put(False, "public_contract_complete"), {"public_contract_complete"}), (put("partial", "status"), {"status"}), (failing, set()), (both(failing, put("success", "stages", "linker", "status")), {"blocked"}),
    (put(None, "links", 0, "label"), {"links"}), (put(at("R"), "links", 0, "second_span"), {"links"}), (put("failed", "links", 0, "status"), {"links"}), (put("short", "alias_pairs", 0, "relation_type"), {"alias_pairs"}), (put({"start": 0, "end": 10}, "links", 0, "context_span"), {"pair_context"}),
    (both(put({"start": 8, "end": 17}, "links", 0, "context_span"), put("NumPy 1.2", "links", 0, "context_text")), set()), (put(sorted(map(ident, ("NumPy", "SciPy"))), "alias_groups", 0, "members"), {"alias_groups", "group_edges"}), (put("not_alias", "alias_pairs", 1, "label"), {"alias_groups", "group_edges"}),
    (put([], "alias_groups"), {"alias_groups"}), (put([], "alias_groups", 0, "chords"), {"group_edges"}), (lambda p: p["alias_groups"].append(copy.deepcopy(p["alias_groups"][0])), {"alias_groups"}),
    (both(put("failed", "stages", "linker", "status"), put(["x"], "stages", "linker", "reasons"), put(False, "pipeline_complete"), put("partial", "status")), {"field_stages"}),
]


def test_each_fault_is_named_and_right_predictions_pass(spark):
    rows = []
    for change, _ in FAULTS:
        p = good()
        change(p)
        rows.append(p)
    mixed = [good() for _ in range(3)]
    for p, faults in zip(mixed, ((5, 12), (22, 25, 34), (3, 21, 28)), strict=True):
        for k in faults:
            FAULTS[k][0](p)
    df = spark.createDataFrame([good(), *rows, *mixed], cs.PREDICTION_DDL).repartition(1)
    got = [set(x.problems) for x in cs.prediction_problems(df).collect()]
    assert got[0] == set()
    for k, ((_, want), found) in enumerate(zip(FAULTS, got[1:], strict=False)):
        assert found == want, k
    assert got[-3:] == [{"pipeline_complete", "intent_labels"}, {"status", "links", "group_edges"}, {"stage_counts", "public_contract_complete", "alias_pairs"}]
    assert {r for x in got for r in x} == {name for name, _ in cs._rules()}


@pytest.mark.parametrize("reason", ["candidate_context", "other"])
def test_an_absent_version_excuses_a_failed_linker(spark, reason):
    p = good()
    p["stages"]["linker"].update(status="failed", reasons=["x"])
    p.update(pipeline_complete=False, status="partial", links=[], exclusions=[{"stage": "linker", "first_id": ident(n), "second_id": "version:" + ident("1.2"), "reason": reason} for n in ("NumPy", "SciPy", "R")])
    for f, o in zip(p["fields"], p["occurrences"], strict=True):
        f["versions"].update(value=[], scores={}, reasons=["predicted_absence"])
        o["versions"] = []
    assert cs.prediction_problems(spark.createDataFrame([p], cs.PREDICTION_DDL)).first().problems == ([] if reason == "candidate_context" else ["field_stages"])


def test_odd_predictions(spark):
    empty = good() | {"fields": [], "occurrences": [], "links": [], "alias_pairs": [], "alias_groups": [], "status": "no_mentions"}
    empty["detector"]["spans"] = []
    nothing = dict.fromkeys(good())
    got = cs.prediction_problems(spark.createDataFrame([empty, nothing], cs.PREDICTION_DDL).repartition(1)).collect()
    assert got[0].problems == [] and len(got[1].problems) > 15
    assert cs.prediction_problems(spark.createDataFrame([], cs.PREDICTION_DDL)).count() == 0
