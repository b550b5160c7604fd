"""Queries of corpus building. Forty documents are an archive; by its id a document is a text with standoff annotations, a TEI file, or a
text without annotations, and every seventh is empty."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from mentionforge.plans.catalog import query
from mentionforge.sources import corpora


def _zip(group: pa.Table) -> pa.Table:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in sorted(zip(group.column("name").to_pylist(), group.column("content").to_pylist(), strict=True)):
            z.writestr(name, content)
    return pa.table({"path": [f"{group.column('archive')[0].as_py()}.zip"], "content": pa.array([data.getvalue()], pa.binary())})


def _archives(load):
    """Files (path, content) that hold every document."""
    d = load("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumns({"w": F.regexp_extract("t", "[A-Za-z]{4,}", 0), "v": F.regexp_extract("t", "[0-9]+", 0), "a": F.floor(F.col("doc_id") / 40)})
    place = lambda c: F.concat((F.expr(f"locate({c}, t)") - 1).cast("string"), F.lit(" "), (F.expr(f"locate({c}, t)") - 1 + F.length(c)).cast("string"), F.lit("\t"), F.col(c), F.lit("\n"))
    lines = F.concat(
        F.when(F.col("w") != "", F.concat(F.lit("T1\tApplication_Usage "), place("w"))).otherwise(F.lit("")), F.when(F.col("v") != "", F.concat(F.lit("T2\tVersion "), place("v"))).otherwise(F.lit("")),
        F.when((F.col("w") != "") & (F.col("v") != "") & (F.col("doc_id") % 4 != 0), F.lit("R1\tVersion_of Arg1:T2 Arg2:T1\n")).otherwise(F.lit("")),
    )
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    at = F.expr("locate(w, t)")
    marked = F.when(F.col("w") == "", esc(F.col("t"))).otherwise(F.concat(esc(F.expr("substring(t, 1, locate(w, t) - 1)")), F.lit('<rs type="software">'), "w", F.lit("</rs>"), esc(F.substring(F.col("t"), at + F.length("w"), F.length("t")))))
    kind, name = F.pmod("doc_id", F.lit(3)), F.concat(F.lit("m/d"), F.col("doc_id").cast("string"))
    file = lambda ending, content: F.struct(F.concat(name, F.lit(ending)).alias("name"), F.encode(content, "utf-8").alias("content"))
    members = F.when(kind == 0, F.array(file(".txt", F.col("t")), file(".ann", lines))).when(kind == 1, F.array(file(".tei.xml", F.concat(F.lit("<TEI><text><p>"), marked, F.lit("</p></text></TEI>"))))).otherwise(F.array(file(".txt", F.col("t"))))
    rows = d.select(F.col("a").cast("long").alias("archive"), F.inline(members))
    return rows.groupBy("archive").applyInArrow(_zip, "path string, content binary")


@query("corpus_build", r"""
WITH d AS (SELECT doc_id, doc_id % 3 k, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE coalesce(text, '') END t FROM documents),
m AS (SELECT *, regexp_extract(t, '[A-Za-z]{4,}') w, regexp_extract(t, '[0-9]+') v, (doc_id // 40) || '.zip' path, 'm/d' || doc_id n FROM d),
c AS (SELECT *, CASE WHEN k < 2 THEN CASE WHEN k = 1 AND regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'MALFORMED_XML' WHEN NOT regexp_matches(t, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]') THEN 'EMPTY_SOURCE_TEXT' END END code FROM m),
o AS (SELECT *, CASE WHEN k = 2 THEN 'ignored' WHEN code IS NULL THEN 'document' ELSE 'failed' END outcome FROM c)
SELECT path, n || CASE k WHEN 1 THEN '.tei.xml' ELSE '.txt' END AS member, outcome, code, CASE WHEN outcome = 'document' THEN CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' ELSE 'unknown' END END AS native_split,
  CASE WHEN outcome = 'document' THEN (w <> '')::BIGINT END AS n_occurrences,
  CASE WHEN outcome = 'document' THEN (doc_id % 5 > 2)::BIGINT + (k = 0 AND v <> '' AND (w = '' OR doc_id % 4 = 0))::BIGINT END AS n_issues FROM o
UNION ALL SELECT path, n || '.ann', 'annotations', NULL, NULL, NULL, NULL FROM o WHERE k = 0
""")
def corpus_build(load):
    """The ledger of the archives, with what each document came to."""
    none = F.lit(None).cast("string")
    files = _archives(load).select("path", F.lit("docs").alias("source"), F.lit("native_archive").alias("role"), none.alias("format"), none.alias("record"), none.alias("pmcid"), none.alias("scope"), "content", none.alias("fault"))
    fifth = F.pmod("doc_id", F.lit(5))
    roles = F.when(fifth == 0, F.array(F.lit("train"))).when(fifth == 1, F.array(F.lit("devel"))).when(fifth == 2, F.array(F.lit("test"))).when(fifth == 3, F.array(F.lit("train"), F.lit("test")))
    base = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 1, F.lit(".tei.xml")).otherwise(F.lit("")))
    c = corpora.build_corpus(files, load("documents").select(F.lit("docs").alias("source"), base.alias("id"), F.explode(roles).alias("role")))
    n = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    counts = n(c.occurrences, "o").unionByName(n(c.issues, "i"), allowMissingColumns=True).groupBy("document_id").agg(F.max("o").alias("n_occurrences"), F.max("i").alias("n_issues"))
    made = c.ledger.where("document_id is not null").join(c.documents.select("document_id", "native_split"), "document_id").join(counts, "document_id", "left").fillna(0, ["n_occurrences", "n_issues"])
    columns = ["path", "member", "outcome", "code"]
    return made.select(*columns, "native_split", "n_occurrences", "n_issues").unionByName(c.ledger.where("document_id is null").select(*columns), allowMissingColumns=True)
