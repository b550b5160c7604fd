"""Queries of corpus hygiene over documents, benchmark and labels."""

from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators import hygiene as hy
from mentionforge.plans.catalog import query

_WORDS = r"regexp_extract_all(lower(text), '[\pL\pM\p{Nd}\p{Pc}]+')"
_SETS = f"w AS (SELECT doc_id, {_WORDS} ws FROM documents), s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) g FROM w)"
#: Every pair of documents, and the smallest id of each equal set.
_PAIRS = f"""{_SETS}, n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT a, b, i / (x.n + y.n - i) jaccard, i, x.n na, y.n nb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
near AS (SELECT a, b, jaccard, CASE WHEN jaccard >= 0.85 THEN 'near_duplicate' ELSE 'excerpt_overlap' END AS reason FROM j WHERE jaccard >= 0.85 OR (least(na, nb) >= 6 AND i = least(na, nb))),
r AS (SELECT n.doc_id, least(n.doc_id, coalesce(min(e.a), n.doc_id)) r FROM n LEFT JOIN j e ON e.b = n.doc_id AND jaccard = 1 GROUP BY n.doc_id)"""


@query("near_dup_pairs", f"WITH {_PAIRS} SELECT DISTINCT least(x.r, y.r) AS a, greatest(x.r, y.r) AS b, jaccard, reason FROM near JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE x.r <> y.r")
def near_dup_pairs(load):
    return hy.near_duplicate_pairs(load("documents").select("doc_id", "text"))


@query("near_dup_members", f"WITH {_PAIRS}, k AS (SELECT doc_id, count(*) k FROM (SELECT a doc_id FROM near UNION ALL SELECT b FROM near) GROUP BY doc_id) SELECT doc_id, r AS representative, coalesce(k, 0)::BIGINT AS n_links FROM r LEFT JOIN k USING (doc_id)")
def near_dup_members(load):
    return hy.near_duplicate_members(load("documents").select("doc_id", "text"))


_KEYS = "SELECT doc_id, 'key:' || (doc_id // 2) * 7 % 400 AS k FROM documents"
_GROUPS = rf"""k AS (SELECT doc_id, k FROM ({_KEYS}) UNION SELECT doc_id, 'text:' || sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM documents),
e AS (SELECT DISTINCT x.doc_id a, y.doc_id b FROM k x JOIN (SELECT k, min(doc_id) doc_id FROM k GROUP BY k) y USING (k) WHERE x.doc_id <> y.doc_id),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
w AS (SELECT a AS doc_id, min(b) AS work_id FROM reach GROUP BY a)"""


def _identifiers(load):
    return load("documents").select("doc_id", F.concat(F.lit("key:"), F.pmod(F.floor(F.col("doc_id") / 2) * 7, F.lit(400))).alias("key"))


@query("work_groups", f"WITH RECURSIVE {_GROUPS} SELECT doc_id, work_id FROM w")
def work_groups(load):
    return hy.work_groups(load("documents").select("doc_id", "text"), _identifiers(load))


@query("leakage_codes", rf"""
WITH RECURSIVE {_GROUPS}, h AS (SELECT doc_id FROM labels WHERE quality = 0),
d AS (SELECT documents.*, work_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) g FROM documents JOIN w USING (doc_id)),
hd AS (SELECT * FROM d SEMI JOIN h USING (doc_id)), i AS ({_KEYS}),
c AS (SELECT doc_id, unnest([CASE WHEN work_id IN (SELECT work_id FROM hd) THEN 'HELDOUT_WORK_GROUP' END, CASE WHEN g IN (SELECT g FROM hd) THEN 'HELDOUT_TEXT' END,
  CASE WHEN doc_id IN (SELECT doc_id FROM i WHERE k IN (SELECT k FROM i SEMI JOIN h USING (doc_id))) THEN 'HELDOUT_IDENTIFIER' END,
  CASE WHEN doc_id % 11 = 0 THEN 'NATIVE_HELDOUT' END, CASE WHEN doc_id % 13 = 0 THEN 'HELDOUT_DOCUMENT' END, CASE WHEN source = 'src3' THEN 'SYNTHETIC_NOT_RESEARCH' END]) code FROM d)
SELECT doc_id, code FROM c WHERE code IS NOT NULL
""")
def leakage_codes(load):
    docs = load("documents").select("doc_id", "text", "source")
    ids = _identifiers(load)
    d = hy.work_groups(docs, ids).join(docs, "doc_id").select(
        "doc_id", "work_id", t.text_digest(F.col("text")).alias("digest"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("test")).alias("native_split"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("dev")).otherwise(F.lit("train")).alias("split"),
        F.when(F.col("source") == "src3", F.lit("Synthetic set")).otherwise(F.col("source")).alias("source"),
    )
    held = load("labels").where("quality = 0").select("doc_id").distinct()
    h = d.join(held, "doc_id", "left_semi")
    return hy.leakage_codes(d, h.select("work_id"), h.select("digest"), ids.join(held, "doc_id", "left_semi").select("key"), ids)


@query("exposure_reasons", rf"""
WITH i AS ({_KEYS}), d AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) g FROM documents), h AS (SELECT doc_id FROM labels WHERE toxic = 1),
a AS (SELECT doc_id, 0 r, 'identifier' reason FROM i WHERE k IN (SELECT k FROM i SEMI JOIN h USING (doc_id)) UNION ALL SELECT doc_id, 1, 'text' FROM d WHERE g IN (SELECT g FROM d SEMI JOIN h USING (doc_id)))
SELECT doc_id, min_by(reason, r) AS reason FROM a GROUP BY doc_id
""")
def exposure_reasons(load):
    docs, ids = load("documents").select("doc_id", "text"), _identifiers(load)
    held = load("labels").where("toxic = 1").select("doc_id").distinct()
    by_id = ids.join(held, "doc_id", "left_semi").select(F.lit("identifier").alias("kind"), "key")
    by_text = docs.join(held, "doc_id", "left_semi").select(F.lit("text").alias("kind"), t.text_digest(F.col("text")).alias("key"))
    return hy.exposure_reasons(docs, by_id.unionByName(by_text), ids)


@query("benchmark_overlap", f"""
WITH {_SETS}, b AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) g FROM (SELECT item_id, {_WORDS} ws FROM benchmark))
SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM s JOIN b USING (g) GROUP BY ALL
""")
def benchmark_overlap(load):
    d = load("documents").select("doc_id", F.explode(t.shingles(F.col("text"))).alias("g"))
    b = load("benchmark").select("item_id", F.explode(t.shingles(F.col("text"))).alias("g"))
    return d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("per_key_first_n", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3")
def per_key_first_n(load):
    return hy.first_per_key(load("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("per_group_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || doc_id)) <= 5")
def per_group_cap(load):
    return hy.first_per_key(load("documents").select("source", "doc_id"), ["source"], [hy.seeded_rank(7, "doc_id")], 5)


@query("audit_share", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('3|' || doc_id)) r, count(*) OVER (PARTITION BY lang, source) n FROM documents) WHERE r <= ceil(n * 0.1::DOUBLE)")
def audit_share(load):
    return hy.share_per_key(load("documents").select("lang", "source", "doc_id"), ["lang", "source"], [hy.seeded_rank(3, "doc_id")], 0.1)


@query("round_robin", """
SELECT doc_id, source FROM (SELECT doc_id, source, (lang <> 'en')::INTEGER p, row_number() OVER (PARTITION BY (lang <> 'en'), source ORDER BY sha256('5|' || doc_id)) k FROM documents) ORDER BY p, k, source LIMIT 137
""")
def round_robin(load):
    d = load("documents").select("doc_id", "source", (F.col("lang") != "en").cast("int").alias("p"))
    return hy.round_robin(d, "source", [hy.seeded_rank(5, "doc_id")], 137, "p").select("doc_id", "source")


@query("population_difference", "SELECT doc_id, 'labels_only' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'documents_only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def population_difference(load):
    a, b = load("labels").select("doc_id"), load("documents").select("doc_id")
    return a.subtract(b).withColumn("side", F.lit("labels_only")).unionByName(b.subtract(a).withColumn("side", F.lit("documents_only")))


@query("vocab_overlap", r"""
WITH t AS (SELECT DISTINCT doc_id % 2 h, unnest(regexp_extract_all(lower(text), '[a-z]+')) w, doc_id FROM documents), c AS (SELECT w, count(*) FILTER (h = 0) a, count(*) FILTER (h = 1) b FROM t GROUP BY w)
SELECT count(*) FILTER (b > 0)::BIGINT AS holdout_types, count(*) FILTER (a > 0 AND b > 0)::BIGINT AS shared_types, sum(b)::BIGINT AS holdout_uses, sum(CASE WHEN a > 0 THEN b ELSE 0 END)::BIGINT AS shared_uses FROM c
""")
def vocab_overlap(load):
    w = load("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("w"))
    c = w.groupBy("w").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    return c.agg(F.count_if(F.col("b") > 0).alias("holdout_types"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared_types"), F.sum("b").alias("holdout_uses"), F.sum(F.when(F.col("a") > 0, F.col("b")).otherwise(F.lit(0))).alias("shared_uses"))


@query("inventory", "SELECT source, count(*)::BIGINT AS n_documents, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, min(sha256(text)) AS first_digest FROM documents GROUP BY source")
def inventory(load):
    return load("documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"), F.min(F.sha2(F.col("text").cast("binary"), 256)).alias("first_digest"))


@query("exclusion_reasons", f"""
WITH {_SETS}, b AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) g FROM (SELECT item_id, {_WORDS} ws FROM benchmark)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY ALL), m AS (SELECT item_id, count(*) m FROM b GROUP BY ALL), i AS (SELECT doc_id, item_id, count(*) i FROM s JOIN b USING (g) GROUP BY ALL),
x AS (SELECT doc_id, item_id, FALSE k FROM i JOIN n USING (doc_id) JOIN m USING (item_id) WHERE i >= 0.85 * (n + m - i) OR (least(n, m) >= 6 AND i = least(n, m))
  UNION ALL SELECT doc_id, item_id, TRUE FROM documents JOIN benchmark ON doc_id % 1000 = item_id * 3)
SELECT doc_id, item_id AS held_id, CASE WHEN bool_or(k) THEN 'identifier_overlap' ELSE 'text_overlap' END AS reason FROM x GROUP BY ALL
""")
def exclusion_reasons(load):
    """Documents that the items of the benchmark bar; a thousand documents share its identifiers in turn."""
    d, b = load("documents").select("doc_id", "text"), load("benchmark").select(F.col("item_id").alias("held_id"), "text")
    return hy.exclusion_reasons(d, b, d.select("doc_id", (F.col("doc_id") % 1000).alias("key")), b.select("held_id", (F.col("held_id") * 3).alias("key")))


@query("exposure_issues", """
SELECT o_orderkey AS exposure_id, unnest(CASE WHEN o_custkey % 3 = 0 THEN [{code: 'MISSING_SOURCE_IDENTIFIERS', keys: []::VARCHAR[]}] ELSE [] END
  || CASE WHEN o_custkey % 5 < 3 THEN [{code: 'MISSING_DOI', keys: ['openalex:' || o_orderkey]}] ELSE [] END, recursive := TRUE) FROM orders
""")
def exposure_issues(load):
    o = load("orders").select(F.col("o_orderkey").alias("exposure_id"), "o_custkey", F.col("o_orderkey").cast("string").alias("k"))
    own, open_, doi = F.concat(F.lit("document_id:"), "k"), F.concat(F.lit("openalex:"), "k"), F.concat(F.lit("doi:10.1/"), "k")
    keys = F.when(F.col("o_custkey") % 3 == 0, F.array(own)).otherwise(F.array(own, doi))
    groups = F.when(F.col("o_custkey") % 5 < 3, F.array(F.array(open_, own), F.array(open_))).otherwise(F.array(F.array(open_, doi), F.array(own)))
    return hy.exposure_issues(o.select("exposure_id", keys.alias("identity_keys"), groups.alias("associations")))
