"""Source annotations and catalogue rows to the engine's own records."""

from __future__ import annotations

from collections.abc import Mapping as Map
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators import contracts as ct
from mentionforge.operators.graph import materialize
from mentionforge.operators.intervals import overlap_pairs


@dataclass(frozen=True)
class Policy:
    """How a source's types are read: software types with the intent bits that they imply, version types, the relations that link a
    version to its software, and types that mean nothing here."""

    software: Map[str, Map[str, bool]]
    versions: Sequence[str] = ()
    relations: Sequence[str] = ()
    ignored: Sequence[str] = ()
    fields: Sequence[str] = field(default=ct.FIELDS)


def project(text: Column, start: Column, end: Column) -> Column:
    """Span of the normal form that a source span becomes; null if one of its ends cuts what is written as one, such as a run of
    blanks or a line end of two characters. Three parts of a text read on their own give the whole text's normal form only if
    no such run is cut, so that is what is compared where an end lies between two blank characters; elsewhere it cuts none."""
    s, e = start.cast("int"), end.cast("int")
    between = lambda at: (at > 0) & F.substring(text, at, 2).rlike("[ \\t\\r\\n\u00a0]{2}")
    head, body, tail = (t.normalize_v2(x) for x in (F.substring(text, F.lit(1), s), F.substring(text, s + 1, e - s), F.substring(text, e + 1, F.length(text))))
    begin = F.length(head).cast("long")
    whole = F.when(between(s) | between(e), F.concat(head, body, tail) == t.normalize_v2(text)).otherwise(F.lit(True)) & (s >= 0) & (e > s) & (e <= F.length(text)) & (F.length(body) > 0)
    return F.when(whole, F.struct(begin.alias("start"), (begin + F.length(body)).alias("end")))


def _among(names: Sequence[str]) -> Column:
    return F.col("type").isin(*names) if names else F.lit(False)


def map_annotations(docs: DataFrame, spans: DataFrame, relations: DataFrame, coverage: DataFrame, policy: Policy) -> dict[str, DataFrame]:
    """documents (doc_id, text, text_revision) in normal form, occurrences (columns of contracts.occurrence_problems, and doc_id and
    id), coverage (doc_id, start, end, fields, status) without what is left out, and exclusions (doc_id, id, code).

    docs: (doc_id, text); spans: (doc_id, id, type, segments, aligned), ids distinct within a document; relations: (doc_id, id, kind,
    source, target); coverage: (doc_id, start, end, fields), fields a struct of booleans by contracts.FIELDS, in source offsets.

    A span is left out if it cannot be placed, has an unknown type, several segments, lies outside coverage, or overlaps another
    entity; where it stands nothing is covered, and if it cannot be placed at all, its document's coverage knows no field. A
    version without software, or a relation without its ends, leaves versions unknown in the document. Coverage that cannot
    be placed fails the job. Documents with null text count as empty ones."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    whole = texts.select("doc_id", t.normalize_v2(F.col("source")).alias("text")).withColumn("text_revision", ct.revision(F.col("text")))
    lost = F.raise_error(F.concat(F.lit("ALIGNMENT_UNRESOLVED: coverage of "), F.col("doc_id").cast("string"))).cast("struct<start:bigint,end:bigint>")
    placed = coverage.join(texts, "doc_id").select("doc_id", F.coalesce(project(F.col("source"), F.col("start"), F.col("end")), lost).alias("p"), "fields")
    regions = materialize(placed.select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "fields").withColumn("region", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end"))), "regions")

    ends = spans.select("doc_id", "id", "type", "segments", "aligned", F.element_at("segments", 1)["start"].alias("start"), F.element_at("segments", -1)["end"].alias("end"))
    ends = ends.join(texts, "doc_id").withColumn("p", project(F.col("source"), F.col("start"), F.col("end"))).withColumn("blank", ~ct.filled(F.expr("substring(source, cast(start as int) + 1, cast(end - start as int))"))).drop("source")
    inside = ends.where("p is not null").join(regions.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "doc_id").where("p.start >= _s and p.end <= _e").select("doc_id", "id").distinct().withColumn("_in", F.lit(True))
    entity = _among([*policy.software, *policy.versions])
    ents = ends.where(entity).select("doc_id", "id", "start", "end")
    pairs = overlap_pairs(ents, ents.select("doc_id", F.col("id").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2")), ["doc_id"], F.col("id") != F.col("id2"))
    overlapped = pairs.select("doc_id", "id").distinct().withColumn("_over", F.lit(True))
    code = (
        F.when(_among(policy.ignored), None)
        .when(~F.coalesce("aligned", F.lit(True)) | F.col("p").isNull() | F.col("blank"), F.lit("ALIGNMENT_UNRESOLVED"))
        .when(~entity, F.lit("UNMAPPED_TYPE"))
        .when(F.size("segments") != 1, F.lit("DISCONTINUOUS_SPAN"))
        .when(F.col("_in").isNull(), F.lit("OUTSIDE_COVERAGE"))
    )
    judged = ends.join(inside, ["doc_id", "id"], "left").join(overlapped, ["doc_id", "id"], "left")
    judged = materialize(judged.withColumn("code", F.coalesce(code, F.when(F.col("_over"), F.lit("OVERLAPPING_ENTITY")))).select("doc_id", "id", "type", "p", "code"), "judged")

    good = judged.where("code is null")
    source = good.where(_among(policy.versions)).select("doc_id", F.col("id").alias("source"), F.col("p").alias("vp"))
    target = good.where(_among(list(policy.software))).select("doc_id", F.col("id").alias("target"), F.lit(True).alias("_t"))
    told = relations.where(F.col("kind").isin(*policy.relations) if policy.relations else F.lit(False)).select("doc_id", "id", "source", "target")
    told = materialize(told.join(source, ["doc_id", "source"], "left").join(target, ["doc_id", "target"], "left").withColumn("ok", F.col("vp").isNotNull() & F.col("_t").isNotNull()), "told")
    linked = told.where("ok").select("doc_id", F.col("source").alias("id")).distinct()
    unlinked = judged.where(_among(policy.versions)).select("doc_id", "id").join(linked, ["doc_id", "id"], "left_anti")
    exclusions = judged.where("code is not null").select("doc_id", "id", "code").unionByName(told.where("not ok").select("doc_id", "id", F.lit("UNRESOLVED_VERSION_RELATION").alias("code"))).unionByName(unlinked.withColumn("code", F.lit("UNLINKED_VERSION")))
    unsure = told.where("not ok").select("doc_id").unionByName(unlinked.select("doc_id")).distinct().withColumn("_unsure", F.lit(True))

    bad = judged.where("code is not null").select("doc_id", F.col("p.start").alias("a"), F.col("p.end").alias("b"))
    hit = regions.join(bad, "doc_id").select("doc_id", "region", F.when(F.col("a").isNull(), F.col("start")).otherwise(F.greatest("a", "start")).alias("lo"), F.when(F.col("a").isNull(), F.col("end")).otherwise(F.least("b", "end")).alias("hi")).where("lo < hi")
    points = regions.select("doc_id", "region", F.explode(F.array("start", "end")).alias("at")).unionByName(hit.select("doc_id", "region", F.explode(F.array("lo", "hi")).alias("at"))).distinct()
    pieces = points.withColumn("to", F.lead("at").over(W.partitionBy("doc_id", "region").orderBy("at"))).where("to is not null")
    masked = pieces.join(hit, ["doc_id", "region"], "left").groupBy("doc_id", "region", "at", "to").agg(F.coalesce(F.max((F.col("lo") < F.col("to")) & (F.col("at") < F.col("hi"))), F.lit(False)).alias("out"))
    masked = masked.join(regions.select("doc_id", "region", "fields"), ["doc_id", "region"]).join(unsure, "doc_id", "left")
    known = F.struct(*[(F.coalesce(F.col("fields")[f], F.lit(False)) & ~F.col("out") & (F.col("_unsure").isNull() if f == "versions" else F.lit(True))).alias(f) for f in policy.fields])
    covered = materialize(masked.select("doc_id", F.col("at").alias("start"), F.col("to").alias("end"), known.alias("fields"), F.when(F.col("out"), F.lit("partial")).otherwise(F.lit("complete")).alias("status")), "covered")

    links = told.where("ok").join(whole.select("doc_id", "text"), "doc_id").select("doc_id", F.col("target").alias("id"), F.struct(F.col("vp.start").alias("_at"), ct.cut(F.col("text"), F.col("vp")).alias("text"), F.col("vp").alias("span"), F.lit("explicit_local").alias("status")).alias("e"))
    links = links.groupBy("doc_id", "id").agg(F.transform(F.array_sort(F.collect_set("e")), lambda e: F.struct(e["text"].alias("text"), e["span"].alias("span"), e["status"].alias("status"))).alias("version_links"))
    names = good.where(_among(list(policy.software))).select("doc_id", "id", "type", F.col("p").alias("name_span"))
    first = names.join(covered.select("doc_id", "start", "end", F.col("fields.versions").alias("_v")), "doc_id").where("name_span.start >= start and name_span.end <= end").groupBy("doc_id", "id").agg(F.min_by("_v", "start").alias("_v"))
    rows = names.join(first, ["doc_id", "id"], "left").join(links, ["doc_id", "id"], "left").join(unsure, "doc_id", "left").join(whole, "doc_id")
    bit = lambda b, of: F.coalesce(*[F.when(F.col("type") == k, F.lit(of(v.get(b)))) for k, v in policy.software.items()], F.lit(False))
    told_bits = {b: bit(b, lambda v: v is not None) for b in ct.INTENT_BITS}
    true_bits = F.array_compact(F.array(*[F.when(bit(b, lambda v: v is True), F.lit(b)) for b in ct.INTENT_BITS]))
    any_bit, all_bits = told_bits["created"] | told_bits["used"] | told_bits["shared"], told_bits["created"] & told_bits["used"] & told_bits["shared"]
    sure = F.coalesce("_v", F.lit(False))
    none = F.array().cast("array<struct<text:string,span:struct<start:bigint,end:bigint>,status:string>>")
    links_of = F.coalesce("version_links", none)
    status = F.when(sure, F.when(F.size(links_of) > 0, F.lit("explicit")).otherwise(F.lit("absent"))).when((F.size(links_of) > 0) | F.col("_unsure").isNotNull(), F.lit("ambiguous")).otherwise(F.lit("unannotated"))
    before, after = F.expr("substring(text, 1, cast(name_span.start as int))"), F.expr("locate('\n', text, cast(name_span.end as int) + 1)")
    ctx = F.struct((F.col("name_span.start") - F.length(F.substring_index(before, "\n", -1))).alias("start"), F.when(after > 0, after - 1).otherwise(F.length("text")).cast("long").alias("end"))
    rows = rows.withColumn("context_span", ctx).withColumn("intents", F.when(any_bit, F.when(all_bits & (F.size(true_bits) == 0), F.array(F.lit("mentioned"))).otherwise(true_bits)))
    proof = F.when(F.coalesce((F.size("intents") > 0) & ~F.array_contains("intents", "mentioned"), F.lit(False)), F.array("context_span")).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    occurrences = rows.select(
        "doc_id", "id", "text", F.lit("2.0").alias("schema_version"), F.col("doc_id").alias("document_id"), "text_revision",
        ct.occurrence_id(F.col("doc_id"), F.col("text_revision"), F.col("name_span.start"), F.col("name_span.end")).alias("mention_id"), ct.cut(F.col("text"), F.col("name_span")).alias("name"), "name_span",
        ct.cut(F.col("text"), F.col("context_span")).alias("context_sentence"), "context_span", F.lit("paragraph").alias("context_kind"), links_of.alias("version_links"), status.alias("version_status"), "intents",
        F.lit(None).cast("string").alias("sentiment"), F.struct(F.lit(True).alias("software"), sure.alias("versions"), *[told_bits[b].alias(b) for b in ct.INTENT_BITS], F.lit(False).alias("sentiment")).alias("known"),
        F.struct(proof.alias("intents"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("sentiment")).alias("evidence"),
    )
    return {"documents": whole, "occurrences": occurrences, "coverage": covered, "exclusions": exclusions}


def convert_legacy(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each occurrence that old rows (document_id, ordinal, name, name_span, version, intents, sentiment, mention_id) tell
    of: mention_id, document_id, aligned, name, name_span, versions, intents, sentiment, invalid_fields and ordinals.

    A span is aligned if the document (document_id, text) reads the name there, whatever its case, and the text's case counts.
    Unaligned rows go by the id that they report, or by their number. Intents or sentiments that differ between rows of one
    occurrence become null and are listed; versions are distinct, in order of the rows; rows of unknown documents fail the job."""
    span, name = F.col("name_span"), F.col("name")
    j = rows.join(docs.select("document_id", "text"), "document_id", "left")
    j = j.withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("UNKNOWN_DOCUMENT: "), F.col("document_id").cast("string"))).cast("string")))
    read, rev = ct.cut(F.col("text"), span), ct.revision(F.col("text"))
    aligned = F.coalesce(ct.good_span(span, F.length("text")) & (F.lower(read) == F.lower(name)), F.lit(False))
    doc = F.col("document_id").cast("string")
    reported = F.when(ct.filled(F.col("mention_id")), F.concat(doc, F.lit("|"), rev, F.lit("|reported:"), F.col("mention_id"))).otherwise(F.concat(doc, F.lit("|unaligned:"), F.col("ordinal").cast("string")))
    ident = F.when(aligned, ct.occurrence_id(F.col("document_id"), rev, span["start"], span["end"])).otherwise(reported)
    j = j.select("document_id", "ordinal", aligned.alias("aligned"), ident.alias("mention_id"), F.when(aligned, read).otherwise(name).alias("name"), F.when(aligned, span).alias("name_span"), F.when(ct.filled(F.col("version")), F.col("version")).alias("version"), F.array_sort("intents").alias("intents"), "sentiment")
    one = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) == 1, F.first(c))
    unlike = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) > 1, F.lit(c))
    ordered = F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("ordinal", "version"))))
    return j.groupBy("mention_id", "document_id", "aligned").agg(
        F.min_by("name", "ordinal").alias("name"), F.min_by("name_span", "ordinal").alias("name_span"), F.array_distinct(F.transform(ordered, lambda x: x["version"])).alias("versions"),
        one("intents").alias("intents"), one("sentiment").alias("sentiment"), F.array_compact(F.array(unlike("intents"), unlike("sentiment"))).alias("invalid_fields"), F.array_sort(F.collect_list("ordinal")).alias("ordinals"),
    )


def successful_fields(predictions: DataFrame, fields: Sequence[str] = ("versions", "intents", "sentiment")) -> DataFrame:
    """predictions whose fields, structs of status and value, are their value where the status is success, else null, and the names
    of the others in invalid_fields."""
    ok = lambda f: F.coalesce(F.col(f)["status"] == "success", F.lit(False))
    invalid = F.array_compact(F.array(*[F.when(~ok(f), F.lit(f)) for f in fields]))
    return predictions.select(*[F.when(ok(c), F.col(c)["value"]).alias(c) if c in fields else F.col(c) for c in predictions.columns], invalid.alias("invalid_fields"))


def native_role(ids: DataFrame, partitions: DataFrame) -> DataFrame:
    """(id, role, code) of ids by partitions (id, role): one role each, or why there is none. The names of the middle part of a
    split are one; repeated rows of a partition count once."""
    role = F.when(F.col("role").isin("devel", "validation"), F.lit("dev")).otherwise(F.col("role"))
    held = partitions.select("id", "role").distinct().groupBy("id").agg(F.count("*").alias("n"), F.first(role).alias("role"))
    j = ids.join(held, "id", "left")
    code = F.when(F.col("n").isNull(), F.lit("NATIVE_SPLIT_MISSING")).when(F.col("n") > 1, F.lit("NATIVE_SPLIT_CONFLICT")).when(~F.coalesce(F.col("role").isin("train", "dev", "test"), F.lit(False)), F.lit("NATIVE_SPLIT_UNKNOWN"))
    return j.select("id", F.when(code.isNull(), F.col("role")).alias("role"), code.alias("code"))


def access_overlay(docs: DataFrame, decisions: DataFrame, allowed: Sequence[str] = ("public", "language", "text_license", "access_basis", "supplied_text_scope")) -> DataFrame:
    """docs (document_id, text_revision, allowed columns) with a decision's values in place of theirs where it has some, and
    `access_code` where it may not be applied: it is for another revision, or calls an excerpt a full text."""
    d = decisions.select("document_id", F.col("text_revision").alias("_rev"), *[F.col(c).alias(f"_{c}") for c in allowed])
    j = docs.join(d, "document_id", "left")
    excerpt = F.col("supplied_text_scope").isin("methods", "sentence") & (F.col("_supplied_text_scope") == "fulltext")
    code = F.when(F.col("_rev").isNotNull() & (F.col("_rev") != F.col("text_revision")), F.lit("REVISION_MISMATCH")).when(excerpt, F.lit("EXCERPT_REQUIRES_NEW_TEXT"))
    j = j.withColumn("access_code", code)
    return j.select(*[F.when(F.col("access_code").isNull(), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in docs.columns], "access_code")


def listed_names(lines: DataFrame) -> DataFrame:
    """(name, at) of lines (at, value) that are a name or a JSON object with one: distinct, at the first line that has it."""
    v = F.btrim(F.regexp_replace("value", r"^[\s]+|[\s]+$", ""))
    name = F.when(F.startswith(v, F.lit("{")), F.get_json_object(v, "$.name")).otherwise(v)
    return lines.select("at", name.alias("name")).where("name <> ''").groupBy("name").agg(F.min("at").alias("at"))


def dictionary(sources: Sequence[DataFrame]) -> DataFrame:
    """(fold, name) of lists of names (name, at): the last list, and in it the last line, that has a fold says how it is written."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select(F.lit(k).alias("k"), "at", "name", t.alnum_fold(F.col("name")).alias("fold")).where("fold <> ''")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("fold").agg(F.max_by("name", F.struct("k", "at", "name")).alias("name"))


RECORD = ("source", "source_id", "key", "name", "aliases", "description", "homepages", "repo_urls", "repo_keys", "packages", "rrids", "dois", "topics")


def _kept(values: Column) -> Column:
    """Distinct entries in their order, without nulls and empty ones."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def catalogue_records(rows: DataFrame) -> DataFrame:
    """Records (RECORD) of rows (source, source_id, name, aliases, description, homepages, repo_urls, packages, rrids, dois, topics) of
    any catalogue: repository keys and packages are also read off the urls, ids are in normal form, lists hold a value once.
    packages are ecosystem:name."""
    urls = F.concat(_kept(F.col("repo_urls")), _kept(F.col("homepages")))
    found = F.transform(urls, lambda u: F.concat_ws(":", t.url_package(u)["ecosystem"], t.url_package(u)["package"]))
    flat = F.filter(found, lambda x: F.contains(x, F.lit(":")))
    out = rows.select(
        "source", "source_id", F.concat_ws(":", "source", "source_id").alias("key"), F.nullif("name", F.lit("")).alias("name"),
        F.filter(_kept(F.col("aliases")), lambda a: ~F.coalesce(a == F.col("name"), F.lit(False))).alias("aliases"), F.nullif(F.btrim(F.col("description")), F.lit("")).alias("description"),
        _kept(F.col("homepages")).alias("homepages"), _kept(F.col("repo_urls")).alias("repo_urls"), _kept(F.transform(urls, t.repo_key)).alias("repo_keys"),
        F.array_sort(_kept(F.concat(F.coalesce("packages", F.array().cast("array<string>")), flat))).alias("packages"),
        _kept(F.transform("rrids", lambda r: F.regexp_replace(F.upper(F.btrim(r)), "^RRID:", ""))).alias("rrids"), _kept(F.transform("dois", lambda d: F.lower(F.btrim(d)))).alias("dois"), _kept(F.col("topics")).alias("topics"),
    )
    return out.select(*RECORD)


def parse_packages(rows: DataFrame) -> DataFrame:
    """Records of package indexes: rows (ecosystem, name, payload), payload JSON with name, description, homepage, repository_url and
    keywords_array."""
    p = F.from_json("payload", "name string, description string, homepage string, repository_url string, keywords_array array<string>")
    x = rows.withColumn("p", p).withColumn("_n", F.coalesce("p.name", "name"))
    none = F.array().cast("array<string>")
    return catalogue_records(x.select(
        F.lit("ecosystems").alias("source"), F.concat_ws("/", "ecosystem", "name").alias("source_id"), F.col("_n").alias("name"), none.alias("aliases"), "p.description", F.array("p.homepage").alias("homepages"), F.array("p.repository_url").alias("repo_urls"),
        F.array(F.concat_ws(":", "ecosystem", t.package_id(F.col("ecosystem"), F.col("_n")))).alias("packages"), none.alias("rrids"), none.alias("dois"), F.col("p.keywords_array").alias("topics"),
    ))


def parse_tools(rows: DataFrame) -> DataFrame:
    """Records of a tool registry: rows (payload), payload JSON with biotoolsID, name, description, homepage, link, download, otherID,
    publication and topic."""
    p = F.from_json("payload", "biotoolsID string, name string, description string, homepage string, link array<struct<url:string,type:array<string>>>, download array<struct<url:string,type:string>>, otherID array<struct<value:string,type:string>>, publication array<struct<doi:string>>, topic array<struct<term:string>>")
    x = rows.select(p.alias("p")).select("p.*")
    held = lambda c, ok, get: F.transform(F.filter(F.coalesce(c, F.array().cast(x.schema[c].dataType)), ok), get)
    none = F.array().cast("array<string>")
    repos = F.concat(held("link", lambda k: F.coalesce(F.array_contains(k["type"], "Repository"), F.lit(False)), lambda k: k["url"]), held("download", lambda k: k["type"] == "Source code", lambda k: k["url"]))
    return catalogue_records(x.select(
        F.lit("biotools").alias("source"), F.col("biotoolsID").alias("source_id"), "name", none.alias("aliases"), "description", F.array("homepage").alias("homepages"), repos.alias("repo_urls"), none.alias("packages"),
        held("otherID", lambda k: F.lower(k["type"]) == "rrid", lambda k: k["value"]).alias("rrids"), held("publication", lambda k: F.lit(True), lambda k: k["doi"]).alias("dois"), held("topic", lambda k: F.lit(True), lambda k: k["term"]).alias("topics"),
    ))
