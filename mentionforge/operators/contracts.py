"""Row contracts as tables of checks: a rule names a field and what must hold, and a row's problems are an array of fields.

A rule that cannot be decided, because something it needs is null, is broken. Problems keep the order of the rules, a field
comes once for each rule that it breaks, and rows are never dropped; repeated rows are judged each. Columns that a rule needs
and a table lacks count as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.operators.annotation import SENTIMENTS

#: Names and states of the annotation contract.
INTENTS = ("created", "used", "shared", "mentioned")
INTENT_BITS = ("created", "used", "shared")
FIELDS = ("software", "versions", "created", "used", "shared", "sentiment")
CONTEXT_KINDS = ("sentence", "paragraph", "table", "reference")
VERSION_STATES = ("explicit", "absent", "ambiguous", "unannotated")
EDGE_STATES = ("explicit_local", "explicit_remote")
NO_VERSION = ("null", "na", "n/a", "none")
CALIBRATIONS = ("uncalibrated", "development_calibrated")
COMPARISON_SCHEMA, OFFSET_UNIT = "span-comparison-1", "unicode_codepoint_half_open"
RESULT_STATES = ("success", "no_mentions", "failure", "unavailable", "unsupported")
COMPLETED_STATES = ("success", "no_mentions")
CAPABILITIES = ("software_spans", "version_spans", "version_linking", "aliases", "intent", "sentiment", "full_contract")
LABEL_CAPABILITIES = {"SOFTWARE": "software_spans", "VERSION": "version_spans"}
REVIEW_KINDS = ("human_reviewed", "agent_provisional")
REFUSED_ROLES = ("test", "private", "heldout")
DIGEST = "^sha256:[0-9a-f]{64}$"

Rule = tuple[str, Column]


def broken(rules: Sequence[Rule]) -> Column:
    """Fields of the rules that do not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def filled(c: Column) -> Column:
    """A string with something in it but white space."""
    return c.rlike("(?U)\\S")


def revision(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def occurrence_id(doc: Column, rev: Column, start: Column, end: Column) -> Column:
    """Identity of a span in a revision of a document."""
    return F.concat(doc.cast("string"), F.lit("|"), rev, F.lit("|"), start.cast("string"), F.lit(":"), end.cast("string"))


def identity_digest(kind: str, *parts: Column) -> Column:
    """kind and the digest of a list of strings and numbers in canonical JSON: an item a line, two blanks in front, as sorted
    and indented JSON writers put it. Strings are taken as they are, so they must not need escapes."""
    line = lambda c: F.concat(F.lit("  "), c)
    return F.concat(F.lit(kind), F.sha2(F.concat(F.lit("[\n"), F.concat_ws(",\n", *map(line, parts)), F.lit("\n]\n")).cast("binary"), 256))


def json_string(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def json_list(items: Column) -> Column:
    """An array of strings, sorted, as the inner list of identity_digest."""
    inner = F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(F.lit("    "), json_string(x))), ",\n")
    return F.concat(F.lit("[\n"), inner, F.lit("\n  ]"))


def task_id(doc: Column, rev: Column, policy: Column, policy_hash: Column, start: Column, end: Column) -> Column:
    return F.substring(identity_digest("task:", json_string(doc), json_string(rev), json_string(policy), json_string(policy_hash), start.cast("string"), end.cast("string")), 1, 37)


def member_id(kind: str, doc: Column, rev: Column, members: Column) -> Column:
    """Id of an alias relation or a group by its document, revision and sorted members."""
    return identity_digest(kind, json_string(doc), json_string(rev), json_list(members))


def good_span(s: Column, length: Column | None = None) -> Column:
    ok = (s["start"] >= 0) & (s["end"] > s["start"])
    return ok if length is None else ok & F.coalesce(s["end"] <= length, F.lit(True))


def _spans(c: Column, length: Column | None = None) -> Column:
    return F.forall(c, lambda s: F.coalesce(good_span(s, length), F.lit(False)))


def cut(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))


def _get(df: DataFrame):
    return lambda name: F.col(name) if name in df.columns else F.lit(None)


def document_problems(docs: DataFrame) -> DataFrame:
    """docs (document_id, text, and optionally text_revision, sections and page_spans) with `problems`: identity and text are there,
    the revision is the text's, and spans lie in it."""
    get = _get(docs)
    n = F.length("text")
    rules = [("document_id", filled(get("document_id").cast("string"))), ("text", filled(F.col("text"))), ("text_revision", get("text_revision").isNull() | (get("text_revision") == revision(F.col("text"))))]
    rules += [(name, F.col(name).isNull() | _spans(F.col(name), n)) for name in ("sections", "page_spans") if name in docs.columns]
    return docs.withColumn("problems", broken(rules))


def _prediction_rules(get) -> list[Rule]:
    """Where a record has no masks it is a prediction, and must say where it comes from and how sure it is."""
    share = lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))  # noqa: E731  NaN is over 1
    scores, links = get("scores"), get("version_links")
    values = [scores["software"], *[scores["intents"][b] for b in INTENT_BITS], *[scores["sentiment"][s] for s in SENTIMENTS]]
    sure = F.forall(F.array(*values), share) & F.forall(scores["version_links"], share) & (F.size(scores["version_links"]) == F.size(links))
    return [
        ("run_id", filled(get("run_id"))),
        ("calibration", get("calibration").isin(*CALIBRATIONS)),
        ("review_reasons", F.forall(get("review_reasons"), lambda r: F.coalesce(filled(r), F.lit(False))) & (get("needs_review") == (F.size(get("review_reasons")) > 0))),
        ("checkpoint_hashes", (F.size(F.map_keys(get("checkpoint_hashes"))) > 0) & F.forall(F.map_entries(get("checkpoint_hashes")), lambda e: F.coalesce(filled(e["key"]) & e["value"].rlike(DIGEST), F.lit(False)))),
        ("scores", sure),
        ("needs_review", (get("version_status") != "ambiguous") | get("needs_review")),
    ]


def occurrence_problems(occurrences: DataFrame) -> DataFrame:
    """occurrences with `problems`.

    Columns: schema_version, document_id, text_revision, mention_id, name, name_span, context_sentence, context_span, context_kind, known
    (struct of FIELDS, or null), version_links (array of text, span, status), version_status, intents, sentiment, evidence (struct of
    span arrays intents and sentiment); text, the document's, where spans are to be checked against it; and, if there are
    predictions, run_id, calibration, needs_review, review_reasons, checkpoint_hashes and scores."""
    get = _get(occurrences)
    has_text = "text" in occurrences.columns
    text = F.col("text") if has_text else F.lit(None).cast("string")
    n = F.length(text)
    name, span, ctx, known, links = F.col("name"), F.col("name_span"), F.col("context_span"), F.col("known"), F.col("version_links")
    masked, status, intents, sentiment, evidence = known.isNotNull(), F.col("version_status"), F.col("intents"), F.col("sentiment"), F.col("evidence")
    bit = lambda f: ~masked | F.coalesce(known[f], F.lit(False))  # noqa: E731  a prediction knows every field
    all_bits = bit("created") & bit("used") & bit("shared")
    within = (ctx["start"] <= span["start"]) & (span["end"] <= ctx["end"]) & (F.length("context_sentence") == ctx["end"] - ctx["start"])
    in_context = F.substring(F.col("context_sentence"), (span["start"] - ctx["start"]).cast("int") + 1, (span["end"] - span["start"]).cast("int")) == name
    in_text = text.isNull() | ((revision(text) == F.col("text_revision")) & (cut(text, span) == name) & (cut(text, ctx) == F.col("context_sentence")))
    link = lambda e: F.coalesce(filled(e["text"]) & good_span(e["span"], n) & ~F.lower(F.btrim(e["text"])).isin(*NO_VERSION) & (F.length(e["text"]) == e["span"]["end"] - e["span"]["start"]) & (text.isNull() | (cut(text, e["span"]) == e["text"])) & e["status"].isin(*EDGE_STATES), F.lit(False))
    keys = F.transform(links, lambda e: F.struct(e["span"]["start"], e["span"]["end"], e["text"]))
    held = lambda label: F.coalesce(F.array_contains(intents, label), F.lit(False))
    order = F.filter(F.array(*map(F.lit, INTENTS)), lambda x: F.array_contains(intents, x))
    some = F.size(F.coalesce(intents, F.array().cast("array<string>"))) > 0
    rules: list[Rule] = [
        ("schema_version", F.col("schema_version") == "2.0"),
        ("document_id", filled(F.col("document_id").cast("string"))),
        ("text_revision", F.col("text_revision").rlike(DIGEST)),
        ("name", filled(name)),
        ("name_span", good_span(span, n)),
        ("mention_id", F.col("mention_id") == occurrence_id(F.col("document_id"), F.col("text_revision"), span["start"], span["end"])),
        ("context_sentence", filled(F.col("context_sentence"))),
        ("context_span", good_span(ctx, n) & within & in_context),
        ("context_kind", F.col("context_kind").isin(*CONTEXT_KINDS)),
        ("text_revision", in_text),
        ("known", ~masked | F.forall(F.array(*[known[f] for f in FIELDS]), lambda x: x.isNotNull())),
        ("known.software", ~masked | known["software"]),
        ("version_links", F.forall(links, link)),
        ("version_links", F.size(F.array_distinct(keys)) == F.size(links)),
        ("version_status", status.isin(*VERSION_STATES)),
        ("version_status", F.when(status == "explicit", F.size(links) > 0).when(status.isin("absent", "unannotated"), F.size(links) == 0).otherwise(F.lit(True))),
        ("known.versions", ~masked | (known["versions"] == status.isin("explicit", "absent"))),
        ("intents", F.when(intents.isNull(), ~(bit("created") | bit("used") | bit("shared"))).otherwise(intents == order)),
        ("intents", ~held("mentioned") | ((F.size(intents) == 1) & all_bits)),
        ("intents", F.forall(F.array(*[~held(b) | bit(b) for b in INTENT_BITS]), lambda x: x)),
        ("intents", ~all_bits | some),
        ("sentiment", F.when(bit("sentiment"), sentiment.isin(*SENTIMENTS)).otherwise(sentiment.isNull())),
        ("evidence", _spans(evidence["intents"], n) & _spans(evidence["sentiment"], n)),
        ("evidence.intents", ~(held("created") | held("used") | held("shared")) | (F.size(evidence["intents"]) > 0)),
        ("evidence.sentiment", ~F.coalesce(sentiment.isin("positive", "negative", "mixed"), F.lit(False)) | (F.size(evidence["sentiment"]) > 0)),
    ]
    if "run_id" in occurrences.columns:
        rules[10:10] = [(field, masked | F.coalesce(ok, F.lit(False))) for field, ok in _prediction_rules(get)]
    else:
        rules.insert(10, ("known", masked))
    return occurrences.withColumn("problems", broken(rules))


def gold_problems(rows: DataFrame) -> DataFrame:
    """Gold rows (document_id, name_span, intents, sentiment) with `problems`."""
    intents = F.col("intents")
    rules = [
        ("document_id", F.coalesce(F.col("document_id").cast("string"), F.lit("")) != ""),
        ("name_span", F.col("name_span")["start"].isNotNull() & F.col("name_span")["end"].isNotNull()),
        ("intents", (F.size(intents) > 0) & (F.size(F.array_except(intents, F.array(*map(F.lit, INTENTS)))) == 0)),
        ("sentiment", F.col("sentiment").isin(*SENTIMENTS)),
    ]
    return rows.withColumn("problems", broken(rules))


def result_problems(results: DataFrame) -> DataFrame:
    """One arm's results for a document, with `problems`.

    Columns: schema_version, arm_id, document_id, text_revision, text (the document's), status, reason, offset_unit, capabilities (struct of
    CAPABILITIES), scores_calibrated, spans (array of label, start, end, text, score, score_kind), n_unresolved, chunk_states, raw_artifact."""
    spans, status, cap, n, raw = F.col("spans"), F.col("status"), F.col("capabilities"), F.length("text"), F.col("raw_artifact")
    done, finds = status.isin(*COMPLETED_STATES), cap["software_spans"] | cap["version_spans"]
    able = lambda label: F.when(label == "SOFTWARE", cap["software_spans"]).when(label == "VERSION", cap["version_spans"])
    span = lambda s: F.coalesce(good_span(s, n) & s["label"].isin(*LABEL_CAPABILITIES) & (cut(F.col("text"), s) == s["text"]), F.lit(False))
    sure = lambda s: F.when(s["score"].isNull(), s["score_kind"].isNull()).otherwise(~F.isnan(s["score"]) & (F.abs(s["score"]) < float("inf")) & F.coalesce(filled(s["score_kind"]), F.lit(False)))
    inside = filled(raw) & ~raw.rlike("^/|[\\\\:\\x00]") & ~F.array_contains(F.split(raw, "/"), "..")
    rules = [
        ("schema_version", (F.col("schema_version") == COMPARISON_SCHEMA) & (F.col("offset_unit") == OFFSET_UNIT)),
        ("arm_id", filled(F.col("arm_id"))),
        ("text_revision", F.col("text_revision") == revision(F.col("text"))),
        ("status", status.isin(*RESULT_STATES)),
        ("capabilities", F.forall(F.array(*[cap[c] for c in CAPABILITIES]), lambda x: x.isNotNull())),
        ("scores_calibrated", F.col("scores_calibrated").isNotNull()),
        ("spans", F.forall(spans, span) & (F.size(F.array_distinct(F.transform(spans, lambda s: F.struct(s["label"], s["start"], s["end"])))) == F.size(spans))),
        ("spans.score", F.forall(spans, sure)),
        ("capabilities", F.forall(spans, lambda s: F.coalesce(able(s["label"]), F.lit(False)))),
        ("chunks.status", F.forall("chunk_states", lambda c: F.coalesce(c.isin(*RESULT_STATES), F.lit(False)))),
        ("status", ~done | ((status == "success") == (F.size(spans) > 0))),
        ("status", ~done | ((F.col("n_unresolved") == 0) & F.forall("chunk_states", lambda c: c.isin(*COMPLETED_STATES)))),
        ("capabilities", ~done | finds),
        ("reason", done | filled(F.col("reason"))),
        ("spans", done | (F.size(spans) == 0)),
        ("capabilities", (status != "unsupported") | ~finds),
        ("raw_artifact", F.when(raw.isNull(), ~done).otherwise(inside)),
    ]
    return results.withColumn("problems", broken(rules))


def reference_problems(references: DataFrame) -> DataFrame:
    """References (text_revision, text, spans, coverage: array of label, start, end, complete, review_kind) with `problems`."""
    n = F.length("text")
    span = lambda s: F.coalesce(good_span(s, n) & s["label"].isin(*LABEL_CAPABILITIES) & (cut(F.col("text"), s) == s["text"]), F.lit(False))
    each = lambda ok: F.forall("coverage", lambda r: F.coalesce(ok(r), F.lit(False)))
    rules = [
        ("text_revision", F.col("text_revision") == revision(F.col("text"))),
        ("spans", F.forall("spans", span)),
        ("coverage", each(lambda r: good_span(r, n))),
        ("coverage.label", each(lambda r: r["label"].isin(*LABEL_CAPABILITIES))),
        ("coverage.complete", each(lambda r: r["complete"])),
        ("coverage.review_kind", each(lambda r: r["review_kind"].isin(*REVIEW_KINDS))),
    ]
    return references.withColumn("problems", broken(rules))


def demand(checked: DataFrame, code: str = "INVALID_CONTRACT") -> DataFrame:
    """Rows without problems as they are; reading one that has some fails with the code, its identity and its fields."""
    bad = F.size("problems") > 0
    what = F.concat(F.lit(f"{code}: "), F.coalesce(F.col("document_id").cast("string"), F.lit("?")), F.lit(" "), F.array_join("problems", ","))
    return checked.withColumn("problems", F.when(bad, F.raise_error(what).cast("array<string>")).otherwise(F.col("problems"))).where(F.size("problems") == 0).drop("problems")


def refused(rows: DataFrame) -> Column:
    """Whether a record is private or held out by its own flags, or by those of its provenance or metadata structs."""
    parts = [None, *(c for c in ("provenance", "metadata") if c in rows.columns)]
    tests = []
    for part in parts:
        names = rows.columns if part is None else rows.schema[part].dataType.names
        at = lambda n, part=part: F.col(n) if part is None else F.col(part)[n]
        tests += [at("private") if n == "private" else ~at("public") if n == "public" else at(n).isin(*REFUSED_ROLES) for n in names if n in ("private", "public", "role", "split")]
    out = F.lit(False)
    for x in tests:
        out = out | F.coalesce(x, F.lit(False))
    return out


def fingerprint(value: Column) -> Column:
    """A digest of a struct that does not depend on the order of lists that it holds sorted (see sorted_lists)."""
    return F.sha2(F.to_json(value).cast("binary"), 256)


def sorted_lists(df: DataFrame, columns: Sequence[str], left_out: Sequence[str] = ("review", "reviewed_at", "reviewer")) -> Column:
    """A struct of columns, by name, without review stamps, and with their arrays sorted: what a content fingerprint covers."""
    kinds = dict(df.dtypes)
    return F.struct(*[(F.array_sort(F.col(c)) if kinds[c].startswith("array") else F.col(c)).alias(c) for c in sorted(columns) if c not in left_out])


def subset(a: Column, b: Column) -> Column:
    """Whether every entry of array a is in b; null if one of them is."""
    return F.size(F.array_except(a, b)) == 0
