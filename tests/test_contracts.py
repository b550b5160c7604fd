import hashlib
import json

from pyspark.sql import functions as F

from mentionforge.operators import contracts as ct

TEXT = "We ran Toolkit 2.1 here."
REV = "sha256:" + hashlib.sha256(TEXT.encode()).hexdigest()
SPAN = "struct<start:bigint,end:bigint>"
DDL = f"""case string, text string, schema_version string, document_id string, text_revision string, mention_id string, name string, name_span {SPAN}, context_sentence string,
context_span {SPAN}, context_kind string, known struct<software:boolean,versions:boolean,created:boolean,used:boolean,shared:boolean,sentiment:boolean>,
version_links array<struct<text:string,span:{SPAN},status:string>>, version_status string, intents array<string>, sentiment string,
evidence struct<intents:array<{SPAN}>,sentiment:array<{SPAN}>>, run_id string, calibration string, needs_review boolean, review_reasons array<string>,
checkpoint_hashes map<string,string>, scores struct<software:double,version_links:array<double>,intents:struct<created:double,used:double,shared:double>,
sentiment:struct<positive:double,negative:double,mixed:double,not_expressed:double>>"""
GOOD = {
    "text": TEXT, "schema_version": "2.0", "document_id": "d", "text_revision": REV, "mention_id": f"d|{REV}|7:14", "name": "Toolkit", "name_span": (7, 14), "context_sentence": TEXT,
    "context_span": (0, len(TEXT)), "context_kind": "sentence", "known": (True,) * 6, "version_links": [("2.1", (15, 18), "explicit_local")], "version_status": "explicit", "intents": ["used"],
    "sentiment": "not_expressed", "evidence": ([(0, 6)], []), "run_id": None, "calibration": None, "needs_review": None, "review_reasons": None, "checkpoint_hashes": None, "scores": None,
}
PREDICTED = {"known": None, "run_id": "r", "calibration": "uncalibrated", "needs_review": False, "review_reasons": [], "checkpoint_hashes": {"m": REV}, "scores": (0.9, [0.5], (0.1, 0.8, 0.0), (0.0, 0.0, 0.1, 0.9))}
CASES = {
    "good": ({}, []), "predicted": (PREDICTED, []), "neither": ({"known": None}, ["run_id", "calibration", "review_reasons", "checkpoint_hashes", "scores"]),
    "half a mask": ({"known": (True, True, None, True, True, True)}, ["known"]), "no text": ({"text": None}, []),
    "other text": ({"text": TEXT + "!"}, ["text_revision"]), "link twice": ({"version_links": GOOD["version_links"] * 2}, ["version_links"]),
    "no version": ({"version_links": [("N/A", (15, 18), "explicit_local")]}, ["version_links"]), "unknown bit": ({"known": (True, True, True, False, True, True)}, ["intents"]),
    "no links": ({"version_links": None}, ["version_links", "version_links", "version_status"]), "opinion": ({"sentiment": "mixed"}, ["evidence.sentiment"]),
    "unsure": (PREDICTED | {"scores": (1.5, [0.5], (0.1, 0.8, 0.0), (0.0, 0.0, 0.1, 0.9))}, ["scores"]), "nan": (PREDICTED | {"scores": (0.9, [float("nan")], (0.1, 0.8, 0.0), (0.0, 0.0, 0.1, 0.9))}, ["scores"]),
    "too few": (PREDICTED | {"scores": (0.9, [], (0.1, 0.8, 0.0), (0.0, 0.0, 0.1, 0.9))}, ["scores"]), "reason unsaid": (PREDICTED | {"needs_review": True}, ["review_reasons"]),
    "ambiguous": (PREDICTED | {"version_status": "ambiguous", "version_links": [], "scores": (0.9, [], (0.1, 0.8, 0.0), (0.0, 0.0, 0.1, 0.9))}, ["needs_review"]), "no hash": (PREDICTED | {"checkpoint_hashes": {}}, ["checkpoint_hashes"]),
    "reversed": ({"name_span": (14, 7)}, ["name_span", "mention_id", "context_span", "text_revision"]),
}


def test_occurrences_break_what_they_break(spark):
    names = [f.name for f in spark.createDataFrame([], DDL).schema.fields][1:]
    rows = [(case, *[(GOOD | change)[n] for n in names]) for case, (change, _) in CASES.items()]
    df = spark.createDataFrame(rows + rows[:1], DDL)
    got = [(r.case, r.problems) for r in ct.occurrence_problems(df).collect()]
    assert sorted(got) == sorted([(c, want) for c, (_, want) in CASES.items()] + [("good", [])])
    assert ct.occurrence_problems(df.where("false")).count() == 0
    kept = ct.demand(ct.occurrence_problems(df.where("case in ('good', 'predicted')")))
    assert kept.count() == 3 and kept.columns == df.columns
    try:
        ct.demand(ct.occurrence_problems(df)).collect()
    except Exception as e:
        assert "INVALID_CONTRACT: d" in str(e)
    else:
        raise AssertionError


def test_everything_null_breaks_every_rule(spark):
    df = spark.createDataFrame([("x",) + (None,) * 22], DDL)
    fields = ct.occurrence_problems(df).first().problems
    assert {"schema_version", "document_id", "text_revision", "name", "name_span", "mention_id", "context_span", "version_links", "version_status", "evidence"} <= set(fields)
    docs = spark.createDataFrame([(None, None), ("d", " "), ("d", "x")], "document_id string, text string")
    assert [r.problems for r in ct.document_problems(docs).collect()] == [["document_id", "text"], ["text"], []]


def test_ids_equal_canonical_json(spark):
    identity = ["d1", REV, "2.1", "h", 3, 9]
    form = lambda v: hashlib.sha256((json.dumps(v, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()).hexdigest()
    d, rev = F.lit("d1"), F.lit(REV)
    row = spark.range(1).select(ct.task_id(d, rev, F.lit("2.1"), F.lit("h"), F.lit(3), F.lit(9)).alias("t"), ct.member_id("alias:", d, rev, F.array(F.lit("b"), F.lit("a"))).alias("m")).first()
    assert row.t == "task:" + form(identity)[:32] and row.m == "alias:" + form(["d1", REV, ["a", "b"]])


def test_refused_rows_and_subsets(spark):
    df = spark.createDataFrame([(1, None, (None, "train")), (2, True, (False, None)), (3, False, (True, None)), (4, None, (False, "heldout"))], "id int, private boolean, metadata struct<private:boolean,split:string>")
    assert [r.id for r in df.where(~ct.refused(df)).collect()] == [1]
    one = spark.range(1).select(ct.subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("a"), ct.subset(F.array(F.lit(3)), F.array(F.lit(1))).alias("b")).first()
    assert (one.a, one.b) == (True, False)
