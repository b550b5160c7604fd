"""Consistency of whole predictions: what a document's stages, fields, pairs, groups and occurrences say about each other.

A prediction is one row of nested columns, and each rule an expression over them, so that a document is judged where it lies,
without a shuffle. Groups are held against the edges by growing each from its first member along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.operators import contracts as ct

#: Stages in order, their states, and the stage that each field comes from.
STAGES = ("detector", "linker", "intent", "sentiment", "alias")
STATES = ("success", "partial", "not_applicable", "unavailable", "failed", "blocked")
ENDED, UNFINISHED = ("success", "not_applicable"), ("partial", "unavailable", "failed", "blocked")
FIELD_STAGES = {"software": "detector", "versions": "linker", "intents": "intent", "sentiment": "sentiment"}
NO_CANDIDATE = ("candidate_context", "repeated_name", "overlapping_endpoint")
SCHEMA = "full-label-prediction-1"
_S = "struct<start:bigint,end:bigint>"
_FIELD = "struct<status:string,value:array<string>,scores:map<string,double>,reasons:array<string>,context_span:{0},context_text:string,evidence_method:string>".format(_S)
_PAIR = f"pair_id:string,first_id:string,second_id:string,first_span:{_S},second_span:{_S},status:string,label:string,scores:map<string,double>,reasons:array<string>,context_span:{_S},context_text:string,evidence_method:string"
#: A prediction: value holds one entry where a field has one value, and a version's span as start:end.
PREDICTION_DDL = (
    f"document_id string, text_revision string, text string, schema_version string, offset_unit string, stages map<string,struct<status:string,candidate_count:bigint,completed_count:bigint,occurrence_count:bigint,reasons:array<string>>>, "
    f"pipeline_complete boolean, public_contract_complete boolean, status string, detector struct<status:string,spans:array<struct<label:string,start:bigint,end:bigint,text:string,score:double>>,chunks:array<struct<status:string>>>, "
    f"fields array<struct<mention_id:string,name:string,name_span:{_S},software:{_FIELD},versions:{_FIELD},intents:{_FIELD},sentiment:{_FIELD}>>, links array<struct<{_PAIR}>>, alias_pairs array<struct<{_PAIR},relation_type:string,preferred_mention_id:string>>, "
    f"alias_groups array<struct<members:array<string>,edges:array<string>,chords:array<string>>>, exclusions array<struct<stage:string,first_id:string,second_id:string,reason:string>>, occurrences array<struct<mention_id:string,name:string,versions:array<string>,intents:array<string>,sentiment:string>>"
)


def _all(rows: Column, holds) -> Column:
    """What holds of every entry; one for which it cannot be said does not."""
    return F.coalesce(F.forall(rows, lambda x: F.coalesce(holds(x), F.lit(False))), F.lit(False))


def _likely(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _alias_components(edges: Column, members: Column) -> Column:
    """Members that edges (arrays of two) lead to from the first of them: as many steps as there are members reach them all."""
    touch = lambda reached: F.flatten(F.filter(edges, lambda e: F.arrays_overlap(e, reached)))
    return F.aggregate(members, F.slice(members, 1, 1), lambda reached, _: F.array_union(reached, touch(reached)))


def _rules() -> list[ct.Rule]:
    doc, rev, text, n = F.col("document_id"), F.col("text_revision"), F.col("text"), F.length("text")
    stages, fields, status = F.col("stages"), F.col("fields"), lambda name: F.col("stages")[name]["status"]
    spans = F.coalesce("detector.spans", F.array().cast("array<struct<label:string,start:bigint,end:bigint,text:string,score:double>>"))
    ident = lambda s: ct.occurrence_id(doc, rev, s["start"], s["end"])
    key = lambda s: F.concat_ws(":", s["start"], s["end"])
    at = lambda s: F.concat(ident(s), F.lit("@"), key(s))
    of = lambda label: F.filter(spans, lambda s: s["label"] == label)
    names, versions = F.transform(of("SOFTWARE"), at), F.transform(of("VERSION"), lambda s: F.concat(F.lit("version:"), at(s)))
    name_ids = F.transform(of("SOFTWARE"), ident)
    version_ids = F.transform(of("VERSION"), lambda s: F.concat(F.lit("version:"), ident(s)))
    done = lambda row: F.array_min(F.array(*[(row[f]["status"] == "success").cast("int") for f in FIELD_STAGES])) == 1
    complete_ids = F.transform(F.filter(fields, done), lambda r: r["mention_id"])
    all_ended = F.array_min(F.array(*[F.coalesce(status(s).isin(*ENDED), F.lit(False)).cast("int") for s in STAGES])) == 1
    detected = F.coalesce(status("detector") == "success", F.lit(False))

    def absent(row):
        """No version stood near enough to be one of the mention's."""
        mine = F.filter("exclusions", lambda x: (x["stage"] == "linker") & (x["first_id"] == row["mention_id"]))
        return ~F.exists("links", lambda p: p["first_id"] == row["mention_id"]) & _all(mine, lambda x: x["reason"].isin(*NO_CANDIDATE)) & (F.size(F.array_except(version_ids, F.transform(mine, lambda x: x["second_id"]))) == 0)

    def states(row, f):
        p = row[f]
        told = p["value"].isNotNull() & _all(F.map_values(p["scores"]), _likely)
        return F.coalesce(p["status"].isin(*STATES), F.lit(False)) & F.when(p["status"] == "success", told).otherwise(p["value"].isNull() & p["scores"].isNull() & (F.size(p["reasons"]) > 0))

    def backed(row, f):
        p = row[f]
        excuse = F.lit(False)
        if f == "versions":
            excuse = (F.size(p["value"]) == 0) & F.array_contains(p["reasons"], "predicted_absence") & absent(row)
        return (p["status"] != "success") | status(FIELD_STAGES[f]).isin("success", "partial", "not_applicable") | excuse

    def context(p):
        c = p["context_span"]
        return c.isNull() | (ct.good_span(c, n) & (p["context_text"] == ct.cut(text, c)) & (p["evidence_method"] == "model_input_context"))

    over = lambda scores: F.filter(F.array(*map(F.lit, ct.INTENT_BITS)), lambda b: scores[b] >= 0.5)
    intents = lambda p: F.when(F.size(over(p["scores"])) > 0, over(p["scores"])).otherwise(F.array(F.lit("mentioned")))
    best = lambda p: F.get(F.filter(F.array(*map(F.lit, ct.SENTIMENTS)), lambda x: p["scores"][x] == F.array_max(F.map_values(p["scores"]))), F.lit(0))
    keyed = lambda p, wanted: _same_set(F.map_keys(p["scores"]), F.array(*map(F.lit, wanted)))

    def pair(ends):
        def holds(p):
            told = p["scores"].isNotNull() & p["label"].isNotNull() & _all(F.map_values(p["scores"]), _likely)
            return F.when(p["status"] == "success", told).otherwise(p["scores"].isNull() & p["label"].isNull() & (F.size(p["reasons"]) > 0)) & F.array_contains(names, F.concat_ws("@", p["first_id"], key(p["first_span"]))) & F.array_contains(ends, F.concat_ws("@", p["second_id"], key(p["second_span"])))

        return holds

    def pair_context(p):
        c = p["context_span"]
        inside = lambda s: (c["start"] <= s["start"]) & (s["end"] <= c["end"])
        read = F.coalesce(p["evidence_method"] != "model_input_context", F.lit(True)) | (c.isNotNull() & (p["context_text"] == ct.cut(text, c)))
        return F.when(c.isNull(), read).otherwise(ct.good_span(c, n) & inside(p["first_span"]) & inside(p["second_span"]) & read)

    ends = lambda p: F.array(p["first_id"], p["second_id"])
    positive = F.filter("alias_pairs", lambda p: p["label"] == "alias")
    edges, within = F.transform(positive, ends), lambda p, g: F.size(F.array_except(ends(p), g["members"])) == 0
    listed = lambda pairs, g: F.array_sort(F.transform(F.filter(pairs, lambda p: within(p, g)), lambda p: p["pair_id"]))
    members = F.flatten(F.transform("alias_groups", lambda g: g["members"]))
    same = lambda o, r: (o["name"] == r["name"]) & o["versions"].eqNullSafe(r["versions"]["value"]) & o["intents"].eqNullSafe(r["intents"]["value"]) & o["sentiment"].eqNullSafe(F.get(r["sentiment"]["value"], F.lit(0)))
    each = lambda f, holds: _all(fields, lambda r: (r[f]["status"] != "success") | holds(r[f]))
    wanted_status = F.when(~detected, "failure").when(~all_ended, "partial").when(F.size(fields) > 0, "success").otherwise("no_mentions")
    blocked = F.array_min(F.array(*[F.coalesce(status(s) == "blocked", F.lit(False)).cast("int") for s in STAGES[1:]])) == 1
    return [
        ("identity", (F.col("schema_version") == SCHEMA) & (F.col("offset_unit") == ct.OFFSET_UNIT) & (rev == ct.revision(text))),
        ("stages", _same_set(F.map_keys(stages), F.array(*map(F.lit, STAGES))) & _all(F.map_values(stages), lambda s: s["status"].isin(*STATES))),
        ("stage_counts", _all(F.map_values(stages), lambda s: (s["candidate_count"] >= s["completed_count"]) & (s["completed_count"] >= 0) & (s["occurrence_count"] >= 0))),
        ("stage_reasons", _all(F.map_values(stages), lambda s: ~s["status"].isin(*UNFINISHED) | (F.size(s["reasons"]) > 0))),
        ("pipeline_complete", F.col("pipeline_complete") == all_ended),
        ("detector_spans", _all(spans, lambda s: s["label"].isin("SOFTWARE", "VERSION") & ct.good_span(s, n) & (s["text"] == ct.cut(text, s)) & _likely(s["score"]))),
        ("fields", (F.size(F.array_distinct(F.transform(fields, lambda r: r["mention_id"]))) == F.size(fields)) & _all(fields, lambda r: ct.good_span(r["name_span"], n) & (r["name"] == ct.cut(text, r["name_span"])) & (r["mention_id"] == ident(r["name_span"])))),
        ("field_states", _all(fields, lambda r: F.array_min(F.array(*[F.coalesce(states(r, f), F.lit(False)).cast("int") for f in FIELD_STAGES])) == 1)),
        ("field_stages", _all(fields, lambda r: F.array_min(F.array(*[F.coalesce(backed(r, f), F.lit(False)).cast("int") for f in FIELD_STAGES])) == 1)),
        ("intent_labels", each("intents", lambda p: keyed(p, ct.INTENT_BITS) & (p["value"] == intents(p)))),
        ("sentiment_label", each("sentiment", lambda p: keyed(p, ct.SENTIMENTS) & (F.size(p["value"]) == 1) & (F.get(p["value"], F.lit(0)) == best(p)))),
        ("field_context", _all(fields, lambda r: F.array_min(F.array(*[F.coalesce(context(r[f]), F.lit(False)).cast("int") for f in FIELD_STAGES])) == 1)),
        ("occurrences", (F.size("occurrences") == F.size(complete_ids)) & _same_set(F.transform("occurrences", lambda o: o["mention_id"]), complete_ids) & _all(F.col("occurrences"), lambda o: F.exists(fields, lambda r: (r["mention_id"] == o["mention_id"]) & F.coalesce(same(o, r), F.lit(False))))),
        ("detector_coverage", ~detected | (F.col("detector.status").isin("success", "no_mentions") & _all(F.col("detector.chunks"), lambda c: c["status"] == "success") & _same_set(F.transform(fields, lambda r: r["mention_id"]), name_ids))),
        ("public_contract_complete", F.col("public_contract_complete") == (detected & (F.size(complete_ids) == F.size(fields)))),
        ("blocked", detected | ((F.size(fields) == 0) & (F.size("occurrences") == 0) & blocked)),
        ("status", F.col("status") == wanted_status),
        ("links", _all(F.col("links"), pair(versions))),
        ("alias_pairs", _all(F.col("alias_pairs"), pair(names)) & _all(F.col("alias_pairs"), lambda p: (p["first_id"] != p["second_id"]) & p["relation_type"].isNull() & p["preferred_mention_id"].isNull())),
        ("pair_context", _all(F.col("links"), pair_context) & _all(F.col("alias_pairs"), pair_context)),
        ("alias_groups", (F.size(F.array_distinct(members)) == F.size(members)) & _same_set(members, F.array_distinct(F.flatten(edges))) & _all(F.col("alias_groups"), lambda g: _same_set(_alias_components(edges, g["members"]), g["members"]))),
        ("group_edges", _all(F.col("alias_groups"), lambda g: (F.array_sort(g["edges"]) == listed(positive, g)) & (F.array_sort(g["chords"]) == listed(F.filter("alias_pairs", lambda p: p["label"] == "not_alias"), g)))),
    ]


def prediction_problems(predictions: DataFrame) -> DataFrame:
    """predictions (PREDICTION_DDL, and other columns) with `problems`, the names of the rules that a row breaks.

    A rule that cannot be decided, because something that it needs is null, is broken, so a null text or null lists break most;
    empty lists are all right. Rows are never dropped; repeated ones are judged each. A negative chord (a pair that is no alias,
    within a group) must be listed by its group: whoever reads the groups learns of the conflict."""
    return predictions.withColumn("problems", ct.broken(_rules()))
