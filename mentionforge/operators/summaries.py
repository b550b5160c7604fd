"""Counts and comparisons over runs, reviews and references.

Aggregates are partial before they are shuffled; nulls in keys form a group of their own unless stated; repeated rows count as
often as they are there unless an operator says that it counts distinct ones; empty tables give empty groups, or one row of
zeros where a result is one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators.contracts import FIELDS, INTENT_BITS
from mentionforge.operators.evaluation import outcome, sums
from mentionforge.operators.graph import materialize
from mentionforge.operators.intervals import edge_eligible, merge_islands, overlap_pairs
from mentionforge.session import dealt

COMPLETED = ("success", "no_mentions", "completed")


def value_edges(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn and ratios of version values at a name: rows (doc_id, start, end, versions), each value of a span once."""
    flat = lambda df: df.select("doc_id", "start", "end", F.explode("versions").alias("value"))
    return sums(outcome(flat(gold), flat(predicted), ["doc_id", "start", "end", "value"]))


def failure_counters(docs: DataFrame, states: DataFrame) -> DataFrame:
    """One row over docs (doc_id) and their states (doc_id, status, chunks_expected, chunks_succeeded, chunks_failed): a document without
    state is missing; chunks that are neither done nor failed are unaccounted for, and make a document that claims to be
    complete incomplete."""
    j = docs.select("doc_id").join(states, "doc_id", "left")
    status, failed = F.coalesce("status", F.lit("missing")), F.coalesce("chunks_failed", F.lit(0))
    loose = F.coalesce(F.col("chunks_expected") - F.col("chunks_succeeded") - failed, F.lit(0))
    bad = ~status.isin(*COMPLETED) | (failed > 0) | (loose != 0)
    return j.agg(F.count_if(bad).alias("failed_documents"), F.coalesce(F.sum(failed), F.lit(0)).alias("failed_chunks"), F.coalesce(F.sum(loose), F.lit(0)).alias("unaccounted_chunks"), F.count_if(status == "missing").alias("missing_status_documents"))


def zero_mention_counters(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row over fully covered documents (doc_id) without gold spans: how many there are, and how many of them have a prediction."""
    none = docs.select("doc_id").distinct().join(gold, "doc_id", "left_anti")
    hit = predicted.select("doc_id").distinct().withColumn("_p", F.lit(1))
    return none.join(hit, "doc_id", "left").agg(F.count("*").alias("eligible"), F.count("_p").alias("false_positive"))


def registry_statistics(members: DataFrame, forms: DataFrame, links: DataFrame) -> DataFrame:
    """One row from members (entity_id, source, key), forms (key_type, form, entities) and links (trust)."""
    e = members.groupBy("entity_id").agg(F.count_distinct("key").alias("n"), F.count_distinct("source").alias("s"))
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))  # noqa: E731  rows that are joined by a constant
    a = one(e, F.count("*").alias("entities"), F.count_if(F.col("s") > 1).alias("multi_source_entities"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_entity_members"))
    x = forms.where("key_type = 'exact'")
    b = one(x, F.count("*").alias("exact_forms"), F.count_if(F.size("entities") > 1).alias("ambiguous_exact_forms"))
    c = one(links, F.count("*").alias("links"), F.count_if(F.col("trust") == "low_trust").alias("low_trust"), F.count_if(F.col("trust") == "unaudited").alias("unaudited"))
    return a.join(b, "_k").join(c, "_k").drop("_k")


def readiness(spans: DataFrame, required_spans: int, required_papers: int) -> DataFrame:
    """Distinct spans (paper, arm, label, start, end, kind) in all, by paper, by arm and by label, those that a human reviewed, and for
    the total how many spans and papers are short. A span reviewed once is reviewed; level names the grouping."""
    one = spans.groupBy("paper", "arm", "label", "start", "end").agg(F.max(F.col("kind") == "human_reviewed").alias("_h"))
    g = one.groupingSets([[], ["paper"], ["arm"], ["label"]], "paper", "arm", "label").agg(
        F.grouping_id("paper", "arm", "label").alias("_g"), F.count("*").alias("spans"), F.count_if("_h").alias("human_reviewed"), F.count_distinct("paper").alias("papers")
    )
    level = F.when(F.col("_g") == 7, F.lit("total")).when(F.col("_g") == 3, F.lit("paper")).when(F.col("_g") == 5, F.lit("arm")).otherwise(F.lit("label"))
    short = lambda need, have: F.when(F.col("_g") == 7, F.greatest(F.lit(0), need - F.col(have)))
    name = F.coalesce(F.col("paper").cast("string"), F.col("arm").cast("string"), F.col("label"))
    return g.select(level.alias("level"), name.alias("name"), "spans", "human_reviewed", "papers", short(required_spans, "spans").alias("span_shortfall"), short(required_papers, "papers").alias("paper_shortfall"))


def run_statistics(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """By run: events and failures, token sums with how many events told them, seconds, predictions and documents that have some.
    events: (run, status, input_tokens, output_tokens, seconds); predictions: (run, doc_id, name)."""
    e = events.groupBy("run").agg(F.count("*").alias("events"), F.count_if(F.col("status") != "success").alias("not_success"), F.sum("input_tokens").alias("input_tokens"), F.count("input_tokens").alias("with_input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("seconds"), 3).alias("seconds"))
    p = predictions.groupBy("run").agg(F.count("*").alias("predictions"), F.count_distinct("doc_id").alias("documents"))
    return e.join(p, "run", "full_outer").select("run", *[c for c in e.columns if c != "run"], F.coalesce("predictions", F.lit(0)).alias("predictions"), F.coalesce("documents", F.lit(0)).alias("documents"))


def top_values(rows: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group, ties by value, with their counts; nulls do not count."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("count"))
    return c.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("count"), value))).where(F.col("_r") <= n).drop("_r")


def query_hits(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """(query, state) of queries (query, doc_id): Y if a name predicted (doc_id, name) for one of its documents matches it, partial if
    there are only other names, - if there is none."""
    j = queries.join(predictions.select("doc_id", "name").distinct(), "doc_id", "left")
    hit = F.coalesce(t.seed_match(F.col("query"), F.col("name")), F.lit(False))
    return j.groupBy("query").agg(F.when(F.max(hit), F.lit("Y")).when(F.count("name") > 0, F.lit("partial")).otherwise(F.lit("-")).alias("state"))


def comparison_table(runs: DataFrame, metrics: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """runs (run, ...) with a rounded column for each of `names` from metrics (run, metric, value); null where a run lacks one."""
    wide = metrics.groupBy("run").agg(*[F.round(F.max(F.when(F.col("metric") == n, F.col("value"))), digits).alias(n) for n in names])
    return runs.join(wide, "run", "left")


def distinct_names(rows: DataFrame) -> DataFrame:
    """(doc_id, names): the sorted distinct names of each document, wherever they stand."""
    return rows.where("name is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def mask_versions(rows: DataFrame, masked: DataFrame) -> DataFrame:
    """rows (doc_id, versions_known, version_status) whose versions are unknown and ambiguous if their document is in masked (doc_id)."""
    j = rows.join(masked.select("doc_id").distinct().withColumn("_m", F.lit(True)), "doc_id", "left")
    out = j.withColumn("versions_known", F.when(F.col("_m"), F.lit(False)).otherwise(F.col("versions_known"))).withColumn("version_status", F.when(F.col("_m"), F.lit("ambiguous")).otherwise(F.col("version_status")))
    return out.drop("_m")


def best_arms(scores: DataFrame) -> DataFrame:
    """By field the arms of the highest F1, all that tie, of scores (field, arm, tp, fn, f1). A field without any positive reference has
    no ranking: its arms are an empty list and its F1 null."""
    supported = F.sum(F.coalesce(F.col("tp") + F.col("fn"), F.lit(0))) > 0
    top = scores.groupBy("field").agg(F.when(supported, F.max("f1")).alias("best_f1"))
    j = top.join(scores.select("field", "arm", "f1"), "field", "left")
    return j.groupBy("field", "best_f1").agg(F.array_sort(F.collect_set(F.when(F.col("f1") == F.col("best_f1"), F.col("arm")))).alias("arms"))


def timing_join(results: DataFrame, timings: DataFrame) -> DataFrame:
    """results (doc_id, checkpoint, ...) with seconds of their one timing (doc_id, checkpoint, seconds); none, or a second one, is an
    error that names the document."""
    one = timings.groupBy("doc_id", "checkpoint").agg(F.count("*").alias("_n"), F.first("seconds").alias("seconds"))
    j = results.join(one, ["doc_id", "checkpoint"], "left")
    bad = F.raise_error(F.concat(F.lit("TIMING_NOT_ONE_TO_ONE: "), F.col("doc_id").cast("string"))).cast("double")
    return j.withColumn("seconds", F.when(F.col("_n") == 1, F.col("seconds").cast("double")).otherwise(bad)).drop("_n")


def attached_attributes(spans: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(doc_id, id, kind, value) of spans (doc_id, id, type, text, corresp): spans of `kinds` point at others by a list of ids, each with or
    without a hash in front. A value comes once for each span and kind; pointers into nothing are left out."""
    to = spans.where(F.col("type").isin(*kinds)).select("doc_id", F.col("type").alias("kind"), F.btrim("text").alias("value"), F.explode(F.filter(F.split("corresp", r"\s+"), lambda x: x != "")).alias("_to"))
    to = to.select("doc_id", "kind", "value", F.regexp_replace("_to", "^#+", "").alias("id"))
    return to.join(spans.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select("doc_id", "id", "kind", "value").distinct()


def containment_recall(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """One row: distinct wanted (doc_id, name) folds, and how many hold or are held by a fold found (doc_id, name) in their document."""
    fold = lambda df, side: df.select("doc_id", t.alnum_fold(F.col("name")).alias("f"), F.lit(side).alias("side")).where("f <> ''")
    folds = materialize(fold(wanted, "w").unionByName(fold(found.where("doc_id is not null"), "g")), "folds")
    held = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("f"))).alias(side)
    docs = dealt(folds, "doc_id").groupBy("doc_id").agg(held("w"), held("g"))  # as many tasks as the folds ask for
    hits = F.filter("w", lambda w: F.exists("g", lambda g: F.contains(w, g) | F.contains(g, w)))
    total = lambda c: F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0).cast("long"))
    return docs.agg(total("w").alias("wanted"), total(hits).alias("found"))


def merge_problems(left: DataFrame, right: DataFrame, equal: Sequence[str]) -> DataFrame:
    """(doc_id, problem) that keep two runs over one population (doc_id, columns) from being merged: a document of one side only, twice on
    a side, or other values. No rows: they may be."""
    side = lambda df, p: df.groupBy("doc_id").agg(F.count("*").alias(f"{p}n"), *[F.first(c).alias(p + c) for c in equal])
    j = side(left, "l_").join(side(right, "r_"), "doc_id", "full_outer")
    unlike = [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(f"differs: {c}")) for c in equal]
    only = F.when(F.col("l_n").isNull(), F.lit("only right")).when(F.col("r_n").isNull(), F.lit("only left"))
    twice = F.when((F.col("l_n") > 1) | (F.col("r_n") > 1), F.lit("twice"))
    found = F.when(only.isNotNull(), F.array(only)).otherwise(F.array_compact(F.array(twice, *unlike)))
    return j.select("doc_id", F.explode(found).alias("problem"))


def surface_hits(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(doc_id, name, start, end) of every place where a name stands in docs (doc_id, text) as a word, in its own case.

    A text is split at the name; where the pieces end is where it stands."""
    out = None
    for n in names:
        quoted = "".join(f"\\{c}" if not (c.isalnum() or c.isspace() or ord(c) > 127) else c for c in n)
        parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?U)(?<!\\w){quoted}(?!\\w)")).alias("k", "part"), F.lit(n).alias("name"))
        before = F.sum(F.length("part") + len(n)).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)) - len(n)
        hits = parts.withColumn("start", before.cast("long")).withColumn("_last", F.max("k").over(W.partitionBy("doc_id"))).where("k < _last").select("doc_id", "name", "start", (F.col("start") + len(n)).alias("end"))
        out = hits if out is None else out.unionByName(hits)
    return out


def label_audit(docs: DataFrame, spans: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, hits, covered): places of names in docs, and how many lie within a labelled span (doc_id, start, end)."""
    hits = surface_hits(docs, names).withColumn("id", F.concat_ws(":", "doc_id", "name", "start"))
    right = spans.select("doc_id", F.col("start").alias("start2"), F.col("end").alias("end2")).withColumn("id2", F.lit(0))
    inside = overlap_pairs(hits.select("doc_id", "id", "start", "end"), right, ["doc_id"], (F.col("start2") <= F.col("start")) & (F.col("end") <= F.col("end2"))).select("id").distinct().withColumn("_c", F.lit(1))
    return hits.join(inside, "id", "left").groupBy("name").agg(F.count("*").alias("hits"), F.count("_c").alias("covered"))


def arms_that_differ(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pairs `by` (such as arm and document) whose sets of keys `on` are not the same on both sides, with how many keys each lacks."""
    keys = [*by, *[c for c in on if c not in by]]
    flags = outcome(left, right, keys)
    return flags.groupBy(*by).agg(F.sum("fn").alias("only_left"), F.sum("fp").alias("only_right")).where("only_left + only_right > 0")


def reviewed_reference(spans: DataFrame, coverage: DataFrame, kind: str) -> DataFrame:
    """spans (doc_id, id, label, start, end) that one region (doc_id, label, start, end, review_kind) of their label and of this kind of review
    holds; each once."""
    r = coverage.where(F.col("review_kind") == kind).select("doc_id", "label", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = spans.join(r, ["doc_id", "label"]).where("start >= _s and end <= _e and end > start").select("doc_id", "id").distinct()
    return spans.join(held, ["doc_id", "id"], "left_semi")


def reviewed_edges(edges: DataFrame, coverage: DataFrame, ignored: DataFrame, kind: str) -> DataFrame:
    """edges (doc_id, edge_id, start, end, start2, end2) within regions of this kind of review, away from ignored spans."""
    return edge_eligible(edges, coverage.where(F.col("review_kind") == kind).select("doc_id", "start", "end"), ignored, ["doc_id"])


def alias_candidates(names: DataFrame) -> DataFrame:
    """(doc_id, a, b): pairs of names (doc_id, id, text, start, end) of a document, the earlier first, that do not overlap and are written
    differently. Names are paired within a sentence range column `block`, if there is one, else within the document."""
    keys = ["doc_id", *(["block"] if "block" in names.columns else [])]
    a = names.select(*keys, F.col("id").alias("a"), F.col("text").alias("_ta"), F.col("start").alias("_sa"), F.col("end").alias("_ea"))
    b = names.select(*keys, F.col("id").alias("b"), F.col("text").alias("_tb"), F.col("start").alias("_sb"), F.col("end").alias("_eb"))
    return a.join(b, keys).where("_ea <= _sb and _ta <> _tb").select("doc_id", "a", "b").distinct()


def link_scores(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """By arm and document, and by arm in all (doc_id null): tp, fp, fn and ratios of edges (arm, doc_id, edge); gold (doc_id, edge) holds for
    every arm of docs (arm, doc_id)."""
    g = docs.select("arm", "doc_id").distinct().join(gold, "doc_id").select("arm", "doc_id", "edge")
    flags = materialize(outcome(g, predicted.join(docs.select("arm", "doc_id").distinct(), ["arm", "doc_id"], "left_semi"), ["arm", "doc_id", "edge"]), "flags")
    return sums(flags, ["arm", "doc_id"]).unionByName(sums(flags, ["arm"]).withColumn("doc_id", F.lit(None).cast(dict(docs.dtypes)["doc_id"])))


def snippet_reservations(rows: DataFrame) -> DataFrame:
    """(openalex, doi, associations): the works that rows (text, status, openalex, doi, association) come from, accepted or not, with the
    sorted associations of each; works without one of the ids are told apart by the other."""
    return rows.groupBy("openalex", "doi").agg(F.array_sort(F.collect_list("association")).alias("associations"))


def fenced_records(reply: Column, schema: str) -> Column:
    """Records of a model's reply: a JSON array, alone or within one closed code fence; anything else is an error."""
    body = F.btrim(F.regexp_replace(reply, r"^\s+|\s+$", ""))
    open_fence = F.startswith(body, F.lit("```"))
    inner = F.when(open_fence, F.regexp_extract(body, r"(?s)^```(?:json)?\s*\n(.*?)\n```$", 1)).otherwise(body)
    whole = F.startswith(F.btrim(inner), F.lit("[")) & F.endswith(F.regexp_replace(inner, r"\s+$", ""), F.lit("]"))
    parsed = F.from_json(inner, schema)
    return F.when(whole & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("INCOMPLETE_JSON_ARRAY")).cast(schema))


# --- reviews


def coverage_status(regions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """regions (doc_id, id, start, end, fields_known) with status, complete if all its fields are known and every occurrence (doc_id, start,
    end, known) that touches it is, and negative, if it is complete and none does."""
    pairs = overlap_pairs(regions.select("doc_id", "id", "start", "end"), occurrences.select("doc_id", F.col("start").alias("start2"), F.col("end").alias("end2"), "known").withColumn("id2", F.monotonically_increasing_id()), ["doc_id"])
    hit = pairs.groupBy("doc_id", "id").agg(F.min("known").alias("_all"), F.count("*").alias("_n"))
    j = regions.join(hit, ["doc_id", "id"], "left")
    done = F.coalesce("fields_known", F.lit(False)) & F.coalesce("_all", F.lit(True))
    return j.select(*regions.columns, F.when(done, F.lit("complete")).otherwise(F.lit("partial")).alias("status"), (done & F.col("_n").isNull()).alias("negative"))


def annotation_status(checked: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(doc_id, status) of coverage_status rows: complete if every region is and nothing (doc_id) is unresolved."""
    open_ = unresolved.select("doc_id").distinct().withColumn("_u", F.lit(True))
    a = checked.groupBy("doc_id").agg(F.min(F.col("status") == "complete").alias("_c")).join(open_, "doc_id", "left")
    return a.select("doc_id", F.when(F.col("_c") & F.col("_u").isNull(), F.lit("complete")).otherwise(F.lit("partial")).alias("status"))


def field_states(rows: DataFrame) -> DataFrame:
    """rows (task_id, mention_id, field, known, stamp_state, stamp_hash, value_hash, ambiguous, accepted) with state.

    A stamp counts while the value it was put on is there: its state holds if it says unresolved or the field is known. Else an
    unknown field is unresolved if its version is ambiguous, or missing; a known one is confirmed if it was accepted, or proposed."""
    fresh = F.coalesce(F.col("stamp_hash") == F.col("value_hash"), F.lit(False))
    known = F.coalesce("known", F.lit(False))
    state = (
        F.when(fresh & ((F.col("stamp_state") == "unresolved") | known), F.col("stamp_state"))
        .when(~known & F.coalesce("ambiguous", F.lit(False)), F.lit("unresolved"))
        .when(~known, F.lit("missing"))
        .when(F.coalesce("accepted", F.lit(False)), F.lit("confirmed"))
        .otherwise(F.lit("proposed"))
    )
    return rows.withColumn("state", state)


def review_questions(states: DataFrame) -> DataFrame:
    """(task_id, mention_id, unit, code): one question for a name, its versions, its three intent bits together, and its sentiment, by
    the worst state among them: unresolved, missing, confirm_proposal."""
    unit = F.when(F.col("field").isin(*INTENT_BITS), F.lit("intents")).otherwise(F.col("field"))
    rank = F.when(F.col("state") == "unresolved", 3).when(F.col("state") == "missing", 2).when(F.col("state") == "proposed", 1).otherwise(0)
    worst = states.where(F.col("field").isin(*FIELDS)).groupBy("task_id", "mention_id", unit.alias("unit")).agg(F.max(rank).alias("_w")).where("_w > 0")
    return worst.select("task_id", "mention_id", "unit", F.element_at(F.array(F.lit("confirm_proposal"), F.lit("missing"), F.lit("unresolved")), F.col("_w")).alias("code"))


def review_status(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """tasks (task_id, n_issues, approved, touched) with needs_decisions, proposals_to_confirm, can_approve and workflow_status: source_issue
    if there are issues, approved if it was and nothing blocks, in_progress if it was touched or a field is confirmed, else pending."""
    q = review_questions(states).groupBy("task_id").agg(F.count_if(F.col("code") != "confirm_proposal").alias("_d"), F.count_if(F.col("code") == "confirm_proposal").alias("_p"))
    c = states.groupBy("task_id").agg(F.max(F.col("state") == "confirmed").alias("_c"))
    j = tasks.join(q, "task_id", "left").join(c, "task_id", "left")
    decisions, issues = F.coalesce("_d", F.lit(0)), F.coalesce("n_issues", F.lit(0))
    blocked = (decisions > 0) | (issues > 0)
    status = F.when(issues > 0, F.lit("source_issue")).when(F.coalesce("approved", F.lit(False)) & ~blocked, F.lit("approved")).when(F.coalesce("touched", F.lit(False)) | F.coalesce("_c", F.lit(False)) | F.coalesce("approved", F.lit(False)), F.lit("in_progress")).otherwise(F.lit("pending"))
    return j.select(*tasks.columns, decisions.alias("needs_decisions"), F.coalesce("_p", F.lit(0)).alias("proposals_to_confirm"), (~blocked).alias("can_approve"), status.alias("workflow_status"))


def review_queue(items: DataFrame, **filters: str) -> DataFrame:
    """items (task_id, reasons, ...) whose columns equal the filters, but for 'all' and none, by task; reason means one of the reasons."""
    out = items
    for name, value in filters.items():
        if value not in (None, "all"):
            out = out.where(F.array_contains("reasons", value) if name == "reason" else F.col(name).cast("string") == value)
    return out.orderBy("task_id")


def review_progress(items: DataFrame) -> DataFrame:
    """One row: how many items there are, and of each workflow status."""
    states = ("pending", "in_progress", "approved", "source_issue")
    return items.agg(F.count("*").alias("total"), *[F.count_if(F.col("workflow_status") == s).alias(s) for s in states])


def union_length(regions: DataFrame) -> DataFrame:
    """Positions that the regions (doc_id, start, end) of all documents cover together."""
    return merge_islands(regions, ["doc_id"]).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of at most `most` rows as Markdown, for reports; more rows are an error, as a report is no place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]
    return "\n".join(lines) + "\n"
