"""Queries of contracts. Records are made of documents: the first word of four letters is the name, and what a record breaks
follows from its id, so that every rule is broken by some."""

from pyspark.sql import functions as F

from mentionforge.operators import contracts as ct
from mentionforge.plans.catalog import query

_LIST = "list_filter([{0}], lambda x: x IS NOT NULL)"


def _broken(cases: dict[int, tuple[str, ...]], modulus: int, key: str = "doc_id") -> str:
    whens = " ".join(f"WHEN {k} THEN [{', '.join(repr(f) for f in fields)}]" for k, fields in cases.items() if fields)
    return f"CASE {key} % {modulus} {whens} ELSE []::VARCHAR[] END"


@query("document_problems", f"""
SELECT doc_id, {_LIST.format("CASE WHEN NOT regexp_matches(coalesce(t, ''), '[^ \\t\\n\\v\\f\\r]') THEN 'text' END, CASE WHEN doc_id % 7 = 0 THEN 'text_revision' END, CASE WHEN doc_id % 5 = 0 OR length(t) = 0 THEN 'sections' END")} AS problems
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END t FROM documents) WHERE t IS NOT NULL
""")
def document_problems(load):
    d = load("documents").select("doc_id", F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text")).where("text is not null")
    n = F.length("text")
    end = F.when(F.col("doc_id") % 5 == 0, n + 1).otherwise(n)
    d = d.withColumn("text_revision", F.when(F.col("doc_id") % 7 == 0, F.lit("sha256:0")).otherwise(ct.revision(F.col("text"))))
    return ct.document_problems(d.withColumn("sections", F.array(F.struct(F.lit(0).alias("start"), end.alias("end"))))).select("doc_id", "problems")


_NAMED = "SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') w FROM documents WHERE regexp_matches(text, '[A-Za-z]{4,}')"
_OCCURRENCE = {1: ("mention_id",), 2: ("context_span", "text_revision"), 3: ("context_kind",), 4: ("known.software",), 5: ("intents",), 6: ("intents",), 7: ("sentiment",), 8: ("version_status",), 9: ("evidence.intents",), 10: ("evidence",), 11: ("intents",), 12: ("schema_version",), 13: ("version_links",), 14: ("known.versions",)}


def _named(load):
    d = load("documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w")).where("w <> ''")
    start = F.expr("locate(w, text)").cast("long") - 1
    return d.withColumn("name_span", F.struct(start.alias("start"), (start + F.length("w")).alias("end")))


def _occurrences(load):
    """Occurrences of which one in fifteen is right and the others break one rule each."""
    d, k = _named(load), F.pmod("doc_id", F.lit(15))
    word, rev = F.col("w"), ct.revision(F.col("text"))
    s, e = F.col("name_span")["start"], F.col("name_span")["end"]
    ctx = F.struct(F.lit(0).cast("long").alias("start"), F.least(F.length("text").cast("long"), e + 20).alias("end"))
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    link = F.struct(word.alias("text"), F.struct(s.alias("start"), (e + F.when(k == 13, 1).otherwise(0)).alias("end")).alias("span"), F.lit("explicit_local").alias("status"))
    none = F.array().cast("array<struct<text:string,span:struct<start:bigint,end:bigint>,status:string>>")
    evidence = F.array(F.struct(s.alias("start"), F.when(k == 10, F.length("text") + 1).otherwise(e).cast("long").alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    d = d.withColumn("context_span", ctx)
    return d.select(
        "doc_id", "text", "name_span", "context_span",
        F.when(k == 12, F.lit("1.0")).otherwise(F.lit("2.0")).alias("schema_version"), F.col("doc_id").alias("document_id"), rev.alias("text_revision"),
        F.concat(ct.occurrence_id(F.col("doc_id"), rev, s, e), F.when(k == 1, F.lit("x")).otherwise(F.lit(""))).alias("mention_id"),
        F.when(k == 2, F.concat(F.reverse(word), F.lit("!"))).otherwise(word).alias("name"), F.expr("substring(text, 1, cast(context_span.end as int))").alias("context_sentence"),
        F.when(k == 3, F.lit("heading")).otherwise(F.lit("sentence")).alias("context_kind"),
        F.struct(*[(~((k == 4) & F.lit(f == "software")) & ~((k == 14) & F.lit(f == "versions"))).alias(f) for f in ct.FIELDS]).alias("known"),
        F.when(k == 13, F.array(link)).otherwise(none).alias("version_links"), F.when(k.isin(8, 13), F.lit("explicit")).otherwise(F.lit("absent")).alias("version_status"),
        F.when(k == 5, strings("used", "created")).when(k == 6, strings()).when(k == 11, strings("used", "mentioned")).otherwise(strings("used")).alias("intents"),
        F.when(k != 7, F.lit("not_expressed")).alias("sentiment"),
        F.struct(F.when(k == 9, empty).otherwise(evidence).alias("intents"), empty.alias("sentiment")).alias("evidence"),
    )


@query("occurrence_problems", f"SELECT doc_id, {_broken(_OCCURRENCE, 15)} AS problems FROM ({_NAMED})")
def occurrence_problems(load):
    return ct.occurrence_problems(_occurrences(load)).select("doc_id", "problems")


@query("gold_problems", f"SELECT doc_id, {_broken({0: ('document_id',), 1: ('name_span',), 2: ('intents',), 3: ('intents',), 4: ('sentiment',)}, 6)} AS problems FROM documents")
def gold_problems(load):
    k = F.pmod("doc_id", F.lit(6))
    rows = load("documents").select(
        "doc_id", F.when(k != 0, F.col("doc_id").cast("string")).alias("document_id"), F.struct(F.lit(0).alias("start"), F.when(k != 1, F.lit(3)).alias("end")).alias("name_span"),
        F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("used"), F.lit("bought"))).otherwise(F.array(F.lit("used"))).alias("intents"),
        F.when(k == 4, F.lit("glad")).otherwise(F.lit("mixed")).alias("sentiment"),
    )
    return ct.gold_problems(rows).select("doc_id", "problems")


_RESULT = {1: ("status",), 2: ("capabilities",), 3: ("spans",), 4: ("spans.score",), 5: ("reason", "spans", "raw_artifact"), 6: ("status",), 7: ("raw_artifact",), 8: ("schema_version",), 9: ("status",)}


@query("result_problems", f"SELECT doc_id, {_broken(_RESULT, 11)} AS problems FROM ({_NAMED})")
def result_problems(load):
    d, k = _named(load), F.pmod("doc_id", F.lit(11))
    s, e = F.col("name_span")["start"], F.col("name_span")["end"]
    score = F.when(k == 4, F.lit(float("nan"))).otherwise(F.lit(0.5))
    span = F.struct(F.lit("SOFTWARE").alias("label"), s.alias("start"), (e + F.when(k == 3, 1).otherwise(0)).alias("end"), F.col("w").alias("text"), score.alias("score"), F.lit("p").alias("score_kind"))
    none = F.array().cast("array<struct<label:string,start:bigint,end:bigint,text:string,score:double,score_kind:string>>")
    rows = d.select(
        "doc_id", "text", F.when(k == 8, F.lit("0")).otherwise(F.lit(ct.COMPARISON_SCHEMA)).alias("schema_version"), F.lit("arm").alias("arm_id"), F.col("doc_id").alias("document_id"), ct.revision(F.col("text")).alias("text_revision"),
        F.when(k == 1, F.lit("no_mentions")).when(k == 5, F.lit("failure")).otherwise(F.lit("success")).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(ct.OFFSET_UNIT).alias("offset_unit"),
        F.struct(*[F.lit(True).alias(c) if c != "aliases" else F.when(k != 2, F.lit(False)).alias(c) for c in ct.CAPABILITIES]).alias("capabilities"), F.lit(False).alias("scores_calibrated"),
        F.when(k == 6, none).otherwise(F.array(span)).alias("spans"), F.when(k == 9, 1).otherwise(0).alias("n_unresolved"), F.array(F.lit("success")).alias("chunk_states"),
        F.when(k == 5, F.lit("../x")).when(k != 7, F.lit("raw/x.json")).alias("raw_artifact"),
    )
    return ct.result_problems(rows).select("doc_id", "problems")


@query("reference_problems", f"SELECT doc_id, {_broken({1: ('text_revision',), 2: ('spans',), 3: ('coverage',), 4: ('coverage.label',), 5: ('coverage.complete',), 6: ('coverage.review_kind',)}, 8)} AS problems FROM ({_NAMED})")
def reference_problems(load):
    d, k = _named(load), F.pmod("doc_id", F.lit(8))
    s, e = F.col("name_span")["start"], F.col("name_span")["end"]
    span = F.struct(F.lit("VERSION").alias("label"), s.alias("start"), e.alias("end"), F.when(k == 2, F.lit("?")).otherwise(F.col("w")).alias("text"))
    region = F.struct(F.when(k == 4, F.lit("NAME")).otherwise(F.lit("SOFTWARE")).alias("label"), F.lit(0).cast("long").alias("start"), (F.length("text") + F.when(k == 3, 1).otherwise(0)).cast("long").alias("end"), (k != 5).alias("complete"), F.when(k == 6, F.lit("machine")).otherwise(F.lit("human_reviewed")).alias("review_kind"))
    rows = d.select("doc_id", "text", F.when(k == 1, F.lit("sha256:0")).otherwise(ct.revision(F.col("text"))).alias("text_revision"), F.array(span).alias("spans"), F.array(region).alias("coverage"))
    return ct.reference_problems(rows).select("doc_id", "problems")


@query("identity_ids", """
WITH d AS (SELECT doc_id, 'sha256:' || sha256(text) rev FROM documents WHERE text IS NOT NULL)
SELECT doc_id, doc_id || '|' || rev || '|3:9' AS mention_id,
  'task:' || substr(sha256('[' || chr(10) || '  "' || doc_id || '",' || chr(10) || '  "' || rev || '",' || chr(10) || '  "2.1",' || chr(10) || '  "h",' || chr(10) || '  3,' || chr(10) || '  9' || chr(10) || ']' || chr(10)), 1, 32) AS task_id,
  'alias:' || sha256('[' || chr(10) || '  "' || doc_id || '",' || chr(10) || '  "' || rev || '",' || chr(10) || '  [' || chr(10) || '    "a",' || chr(10) || '    "b' || doc_id || '"' || chr(10) || '  ]' || chr(10) || ']' || chr(10)) AS relation_id
FROM d
""")
def identity_ids(load):
    d = load("documents").where("text is not null")
    doc, rev, at = F.col("doc_id").cast("string"), ct.revision(F.col("text")), (F.lit(3), F.lit(9))
    return d.select("doc_id", ct.occurrence_id(doc, rev, *at).alias("mention_id"), ct.task_id(doc, rev, F.lit("2.1"), F.lit("h"), *at).alias("task_id"), ct.member_id("alias:", doc, rev, F.array(F.concat(F.lit("b"), doc), F.lit("a"))).alias("relation_id"))


@query("permitted_rows", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 4 <> 0 AND coalesce(toxic, 0) = 0 AND coalesce(lang, '') <> 'de'")
def permitted_rows(load):
    rows = load("documents").join(load("labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", (F.col("toxic") == 0).alias("public"), F.when(F.col("doc_id") % 4 == 0, F.lit("test")).alias("split"), F.struct((F.col("lang") == "de").alias("private")).alias("metadata"))
    return rows.where(~ct.refused(rows)).select("doc_id")


@query("content_fingerprints", "SELECT conv_id, sha256('{\"roles\":[' || string_agg('\"' || role || '\"', ',' ORDER BY role) || '],\"turns\":' || count(*) || '}') AS fingerprint FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def content_fingerprints(load):
    c = load("conversations").where("role is not null").groupBy("conv_id").agg(F.collect_list("role").alias("roles"), F.count("*").alias("turns"), F.max("turn").alias("reviewer"))
    return c.select("conv_id", ct.fingerprint(ct.sorted_lists(c, ["turns", "roles", "reviewer"])).alias("fingerprint"))
