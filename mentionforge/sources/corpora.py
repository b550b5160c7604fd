"""Corpora from archives and folders of annotated files: members, parsers, mapping, roles, and a ledger of what became of each file.

A file is read in one task: it is opened, its members are paired and parsed, and what comes out is rows. Whatever cannot be read
is a row of the ledger with a code, so that one bad file ends no job, and every file and every member that came in is
accounted for once."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.operators import contracts as ct
from mentionforge.operators import mapping as mp
from mentionforge.operators.graph import materialize
from mentionforge.session import map_in_arrow
from mentionforge.sources import files as fs

#: How the two formats' types are read.
_KINDS = ("Application", "PlugIn", "ProgrammingEnvironment", "OperatingSystem")
_USES = ("Usage", "Creation", "Deposition", "Mention")
POLICIES = {
    "tei": mp.Policy({"software": {}}, ("version",), ("version_of",), ("bibr", "publisher", "url", "language")),
    "brat": mp.Policy({f"{k}_{u}": {} for k in _KINDS for u in _USES}, ("Version",), ("Version_of",), ("Developer", "URL", "License", "Citation", "Abbreviation", "AlternativeName", "Release")),
}
#: Folders of members that say how much of an article their text is.
SCOPES = (("Pubmed_fulltext/", "fulltext"), ("PLoS_methods/", "methods"), ("_sentences/", "sentence"))
TABLES = ("documents", "occurrences", "coverage", "native", "issues", "ledger")
_SPAN = pa.struct([("id", pa.string()), ("type", pa.string()), ("segments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("aligned", pa.bool_())])
_RELATION = pa.struct([(n, pa.string()) for n in ("id", "kind", "source", "target")])
_READ = pa.schema([("path", pa.string()), ("member", pa.string()), ("format", pa.string()), ("outcome", pa.string()), ("code", pa.string()), ("sha256", pa.string()), ("text", pa.string()), ("spans", pa.list_(_SPAN)), ("relations", pa.list_(_RELATION)), ("unmapped", pa.list_(pa.string())), *((n, pa.string()) for n in ("source", "pmcid", "scope"))])
_READ_DDL = "path string, member string, format string, outcome string, code string, sha256 string, text string, spans array<struct<id:string,type:string,segments:array<struct<start:bigint,end:bigint>>,aligned:boolean>>, relations array<struct<id:string,kind:string,source:string,target:string>>, unmapped array<string>, source string, pmcid string, scope string"


class Corpus(NamedTuple):
    """documents, their occurrences and coverage, native annotations, issues (document_id, id, code), and the ledger (path, member,
    outcome, code, document_id): outcome is document, annotations (of the document beside it), ignored or failed."""

    documents: DataFrame
    occurrences: DataFrame
    coverage: DataFrame
    native: DataFrame
    issues: DataFrame
    ledger: DataFrame


def _parsed(kind: str, data: bytes, annotations: bytes | None) -> dict:
    """text, spans, relations and unmapped ids of a document in one of the formats, or Refused."""
    try:
        if kind == "tei":
            d = fs.parse_tei(data)
            spans = [{"id": s["id"], "type": s["type"], "segments": [{"start": s["start"], "end": s["end"]}], "aligned": True} for s in d["spans"]]
            relations = [{"id": f"{r['source']}>{r['target']}", "kind": "version_of", "source": r["source"], "target": r["target"]} for r in d["relations"]]
            out = {"text": d["text"], "spans": spans, "relations": relations, "unmapped": []}
        elif kind == "brat":
            text = data.decode("utf-8")
            d = fs.parse_brat(text, annotations.decode("utf-8"))
            spans = [{"id": s["id"], "type": s["type"], "segments": [{"start": a, "end": b} for a, b in s["segments"]], "aligned": s["aligned"]} for s in d["spans"]]
            out = {"text": text, "spans": spans, "relations": [{k: r[k] for k in ("id", "kind", "source", "target")} for r in d["relations"]], "unmapped": d["unmapped"]}
        else:
            out = {"text": data.decode("utf-8"), "spans": [], "relations": [], "unmapped": []}
    except UnicodeDecodeError as e:
        raise fs.Refused("NOT_UTF8") from e
    if not out["text"].strip():
        raise fs.Refused("EMPTY_SOURCE_TEXT")
    return out


def _read_file(path: str, role: str, kind: str, record: str, content: bytes | None, fault: str | None) -> Iterator[dict]:
    """Rows of one input file: one for the file itself if it is no archive or cannot be opened, else one for each member."""
    row = lambda member, outcome, code=None, **more: {"path": path, "member": member, "outcome": outcome, "code": code, **more}

    def document(member, form, data, annotations=None):
        try:
            return row(member, "document", format=form, sha256=hashlib.sha256(data).hexdigest(), **_parsed(form, data, annotations))
        except fs.Refused as e:
            return row(member, "failed", str(e).split(":")[0], format=form, sha256=hashlib.sha256(data).hexdigest())

    if fault:
        yield row(None, "failed", fault)
    elif role == "paper_text":
        yield document(record or path, "tei" if kind == "tei" else "text", content)
    elif role != "native_archive":
        yield row(None, "ignored")
    else:
        try:
            members = fs.zip_members(content)
        except fs.Refused as e:
            yield row(None, "failed", str(e).split(":")[0])
            return
        for name, data in members.items():
            beside = members.get(f"{name[:-4]}.ann")
            if name.endswith(".tei.xml"):
                yield document(name, "tei", data)
            elif name.endswith(".txt") and beside is not None:
                yield document(name, "brat", data, beside)
            else:
                yield row(name, "annotations" if name.endswith(".ann") and f"{name[:-4]}.txt" in members else "ignored")
        if not members:
            yield row(None, "ignored")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():  # an archive at a time, so that no more than one is open
            about = {c: r.get(c) for c in ("source", "pmcid", "scope")}
            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in _READ.names} | about for x in _read_file(r["path"], r["role"], r["format"], r["record"], r["content"], r["fault"])], _READ)


def _mapped(read: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Normal documents, occurrences, coverage and issues of parsed rows (document_id, format, text, spans, relations, unmapped), by the
    policy of their format. What is annotated is there, what is not is unknown: coverage knows no field."""
    known = F.struct(*[F.lit(False).alias(f) for f in ct.FIELDS])
    parts = []
    for form, policy in POLICIES.items():
        rows = read.where(F.col("format").isin(form, "text") if form == "tei" else F.col("format") == form).withColumnRenamed("document_id", "doc_id")
        spans = rows.select("doc_id", F.inline("spans")).select("doc_id", "id", "type", "segments", "aligned")
        relations = rows.select("doc_id", F.inline("relations"))
        whole = rows.select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), known.alias("fields"))
        out = mp.map_annotations(rows.select("doc_id", "text"), spans, relations, whole, policy)
        odd = rows.select("doc_id", F.explode("unmapped").alias("id"), F.lit("UNMAPPED_RECORD").alias("code"))
        parts.append((out["documents"], out["occurrences"].drop("doc_id", "text"), out["coverage"].withColumn("status", F.lit("partial")), out["exclusions"].unionByName(odd)))
    normal, occurrences, coverage, issues = (a.unionByName(b) for a, b in zip(*parts, strict=True))
    normal = normal.withColumnRenamed("doc_id", "document_id").join(documents, "document_id")
    return normal, occurrences, coverage.withColumnRenamed("doc_id", "document_id"), issues.withColumnRenamed("doc_id", "document_id")


def _corpus(read: DataFrame, named: DataFrame) -> Corpus:
    """read: rows of _read with document_id, identifier and code, null where there is no document; named: what documents keep besides."""
    twice = F.count("document_id").over(W.partitionBy("document_id")) > 1
    made = read.where("document_id is not null").withColumn("code", F.coalesce("code", F.when(twice, F.lit("DUPLICATE_SOURCE_ID"))))
    judged = materialize(made.unionByName(read.where("document_id is null")), "read")  # rows without an id meet nowhere
    good = judged.where("document_id is not null and code is null")
    normal, occurrences, coverage, issues = _mapped(good, named)
    outcome = F.when(F.col("document_id").isNotNull() & F.col("code").isNotNull(), F.lit("failed")).otherwise(F.col("outcome"))
    ledger = judged.select("path", "member", outcome.alias("outcome"), "code", F.when(outcome == "document", F.col("document_id")).alias("document_id"))
    native = good.select("document_id", ct.revision(F.col("text")).alias("original_text_revision"), "spans", "relations")
    return Corpus(normal, occurrences, coverage, native, issues, ledger)


def build_corpus(files: DataFrame, partitions: DataFrame | None = None) -> Corpus:
    """A corpus of files (path, source, role, format, record, pmcid, scope, content, fault), such as checked_files gives them.

    Of a native_archive every *.tei.xml is a document, and every *.txt with an *.ann beside it; a paper_text is one document, as TEI
    where its format says so. A document's id is its source and member. partitions (source, id, role): documents of these sources
    get the one role of their PMC id, or of their name; where there is none or several their role is unknown and an issue says
    why. Failed: files with a fault, archives that are refused, members that cannot be parsed, are empty or not UTF-8, documents
    whose name holds another PMC id than their row, and all documents of one id. Ignored: other members and roles. A null
    format, record, pmcid or scope is one that is not known."""
    rows = map_in_arrow(files.select("path", "role", "format", "record", "content", "fault", "source", "pmcid", "scope"), _read, _READ_DDL)
    made = F.col("outcome") == "document"
    base = F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"(\.training\.tei\.xml|\.txt)$", "")
    found = F.nullif(F.regexp_extract(base, r"PMC\d+", 0), F.lit(""))
    rows = rows.withColumns({"document_id": F.when(made, F.concat_ws(":", "source", "member")), "identifier": base, "_pmc": found})
    rows = rows.withColumn("code", F.coalesce("code", F.when(made & (F.col("_pmc") != F.upper("pmcid")), F.lit("SOURCE_ID_CONFLICT"))))
    scope = F.coalesce(*[F.when(F.contains("member", F.lit(part)), F.lit(name)) for part, name in SCOPES], F.col("scope"), F.lit("unverified"))
    rows = rows.withColumns({"scope": scope, "pmcid": F.coalesce("pmcid", "_pmc")})
    rows = materialize(rows, "members")
    named = rows.where(made).select("document_id", "source", F.col("identifier").alias("source_record_id"), "pmcid", F.col("scope").alias("supplied_text_scope"), F.col("format").alias("source_format"), "path", "member", "sha256").dropDuplicates(["document_id"])
    missing = None
    if partitions is not None:
        ask = F.concat_ws("/", "source", F.coalesce("pmcid", "source_record_id"))
        of = named.join(partitions.select("source").distinct(), "source", "left_semi").select("document_id", ask.alias("id"))
        told = mp.native_role(of.select("id").distinct(), partitions.select(F.concat_ws("/", "source", "id").alias("id"), "role"))
        told = materialize(of.join(told, "id").drop("id"), "roles")
        named = named.join(told.select("document_id", F.coalesce("role", F.lit("unknown")).alias("native_split")), "document_id", "left")
        missing = told.where("code is not null").select("document_id", F.lit(None).cast("string").alias("id"), "code")
    else:
        named = named.withColumn("native_split", F.lit(None).cast("string"))
    out = _corpus(rows, named)
    if missing is None:
        return out
    return out._replace(issues=out.issues.unionByName(missing.join(out.documents.select("document_id"), "document_id", "left_semi")))


def import_files(files: DataFrame, form: str) -> Corpus:
    """A corpus of single files (path, content) in one format, tei or brat: a document's id is the format and the file's name without
    its ending. Of brat, a *.txt and the *.ann of the same folder and name are one document; either alone fails, as do files
    that cannot be parsed and all documents of one id; other endings are ignored."""
    if form not in POLICIES:
        raise ValueError(f"unknown native format: {form}")
    ending = F.regexp_extract(F.lower("path"), r"\.(?:tei\.xml|[^./]*)$", 0)
    stem = F.expr("substring(path, 1, length(path) - length(ending))")
    rows = files.withColumn("ending", ending).withColumn("stem", stem)
    if form == "tei":
        one = rows.select("path", F.when(F.col("ending").isin(".xml", ".tei.xml", ".tei"), F.lit("paper_text")).otherwise(F.lit("other")).alias("role"), F.lit("tei").alias("format"), F.col("path").alias("record"), "content", F.lit(None).cast("string").alias("fault"))
        read = map_in_arrow(one, _read, _READ_DDL)
    else:
        pairs = rows.where(F.col("ending").isin(".txt", ".ann")).groupBy("stem").agg(*[F.max(F.when(F.col("ending") == e, F.col(c))).alias(f"{c}_{e[1:]}") for e in (".txt", ".ann") for c in ("path", "content")], F.count("*").alias("n"))
        read = map_in_arrow(pairs.select("path_txt", "path_ann", "content_txt", "content_ann", "n"), _read_pairs, _READ_DDL)
        rest = rows.where(~F.col("ending").isin(".txt", ".ann")).select("path", F.lit("ignored").alias("outcome"))
        read = read.unionByName(rest, allowMissingColumns=True)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.(tei\.xml|[^./]*)$", "")
    read = materialize(read.withColumn("document_id", F.when(F.col("outcome") == "document", F.concat_ws(":", F.lit(form), name))), "members")
    named = read.where("outcome = 'document'").select("document_id", "path", "sha256", F.lit("unverified").alias("supplied_text_scope"), F.lit(None).cast("string").alias("native_split")).dropDuplicates(["document_id"])
    return _corpus(read, named)


def _read_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            text, notes = r["path_txt"], r["path_ann"]
            if text is None or notes is None:
                rows = [{"path": text or notes, "outcome": "failed", "code": "MISSING_ANNOTATIONS" if notes is None else "MISSING_TEXT"}]
            else:
                role = {"path": text, "member": posixpath.basename(text), "format": "brat", "sha256": hashlib.sha256(r["content_txt"]).hexdigest()}
                try:
                    rows = [role | {"outcome": "document", **_parsed("brat", r["content_txt"], r["content_ann"])}]
                except fs.Refused as e:
                    rows = [role | {"outcome": "failed", "code": str(e).split(":")[0]}]
                rows.append({"path": notes, "outcome": "annotations"})
            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in _READ.names} for x in rows], _READ)


def write_corpus(corpus: Corpus, path: str) -> dict[str, str]:
    """Writes the tables as JSON lines, once each, and returns their digests; a folder that holds other rows is a conflict, and a
    corpus without a document is refused."""
    if corpus.documents.isEmpty():
        raise fs.Refused("NO_SOURCE_TEXT")
    for name in TABLES:
        fs.write_once(getattr(corpus, name), f"{path}/{name}")
    return {name: fs.content_digest(getattr(corpus, name)) for name in TABLES}


def load_corpus(spark: SparkSession, path: str, like: Corpus, digests: dict[str, str]) -> Corpus:
    """The tables of a written corpus, in the schemas of `like`, if they are those that were written."""
    tables = [spark.read.schema(getattr(like, name).schema).json(f"{path}/{name}") for name in TABLES]
    for name, df in zip(TABLES, tables, strict=True):
        if fs.content_digest(df) != digests[name]:
            raise fs.Refused(f"MISSING_OR_CHANGED: {name}")
    return Corpus(*tables)
