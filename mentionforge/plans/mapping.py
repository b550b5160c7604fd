"""Queries of annotation mapping and catalogue parsing. In documents the first word of four letters is a tool (or, in a third of
them, of a type that nobody knows), the first number a version; a fifth of the documents has no coverage."""

from pyspark.sql import functions as F

from mentionforge.operators import contracts as ct
from mentionforge.operators import mapping as mp
from mentionforge.plans.catalog import query
from mentionforge.plans.texts import _CRS, _V

_POLICY = mp.Policy(software={"tool": {"used": True}, "own": {"created": True, "used": False, "shared": False}}, versions=["ver"], relations=["version_of"])
_NORM = _V.format(_CRS)


def _norm(x: str) -> str:
    return _NORM.replace("(text,", f"({x},")


_MARKED = """m AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') w, regexp_extract(text, '[0-9]+') v FROM documents WHERE regexp_matches(text, '[A-Za-z]{4,}')),
k AS (SELECT *, instr(text, w) - 1 ws, CASE WHEN v <> '' THEN instr(text, v) - 1 END vs, doc_id % 3 < 2 mapped, doc_id % 5 <> 0 cov FROM m),
o AS (SELECT *, mapped AND cov tool, v <> '' AND doc_id % 4 <> 0 rel, v <> '' AND doc_id % 4 <> 0 AND mapped AND cov linked FROM k)"""


def _parts(load):
    d = load("documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w"), F.regexp_extract("text", "[0-9]+", 0).alias("v")).where("w <> ''")
    at = lambda c: (F.expr(f"locate({c}, text)") - 1).cast("long")
    span = lambda c, ident, kind: F.struct(F.lit(ident).alias("id"), kind.alias("type"), F.array(F.struct(at(c).alias("start"), (at(c) + F.length(c)).alias("end"))).alias("segments"), F.lit(True).alias("aligned"))
    word = F.when(F.col("doc_id") % 3 == 0, F.lit("tool")).when(F.col("doc_id") % 3 == 1, F.lit("own")).otherwise(F.lit("thing"))
    spans = d.select("doc_id", F.inline(F.array(span("w", "T1", word)))).unionByName(d.where("v <> ''").select("doc_id", F.inline(F.array(span("v", "T2", F.lit("ver"))))))
    relations = d.where("v <> '' and doc_id % 4 <> 0").select("doc_id", F.lit("R1").alias("id"), F.lit("version_of").alias("kind"), F.lit("T2").alias("source"), F.lit("T1").alias("target"))
    fields = F.struct(*[F.lit(f != "sentiment").alias(f) for f in ct.FIELDS])
    coverage = d.where("doc_id % 5 <> 0").select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), fields.alias("fields"))
    return mp.map_annotations(d.select("doc_id", "text"), spans, relations, coverage, _POLICY)


@query("mapped_occurrences", f"""
WITH {_MARKED} SELECT doc_id, length({_norm("substr(text, 1, ws)")})::BIGINT AS "start", w AS name, linked::INTEGER::BIGINT AS n_links, CASE WHEN linked THEN v END AS version,
  CASE WHEN linked THEN 'explicit' WHEN v = '' THEN 'absent' ELSE 'ambiguous' END AS version_status, (linked OR v = '') AS versions_known,
  CASE WHEN doc_id % 3 = 0 THEN ['used'] ELSE ['created'] END AS intents, 0::BIGINT AS n_problems
FROM o WHERE tool
""")
def mapped_occurrences(load):
    o = ct.occurrence_problems(_parts(load)["occurrences"])
    return o.select("doc_id", F.col("name_span.start").alias("start"), "name", F.size("version_links").cast("long").alias("n_links"), F.get("version_links", F.lit(0))["text"].alias("version"), "version_status", F.col("known.versions").alias("versions_known"), "intents", F.size("problems").cast("long").alias("n_problems"))


@query("mapped_exclusions", f"""
WITH {_MARKED} SELECT doc_id, 'T1' AS id, CASE WHEN mapped THEN 'OUTSIDE_COVERAGE' ELSE 'UNMAPPED_TYPE' END AS code FROM o WHERE NOT tool
UNION ALL SELECT doc_id, 'T2', 'OUTSIDE_COVERAGE' FROM o WHERE v <> '' AND NOT cov UNION ALL SELECT doc_id, 'R1', 'UNRESOLVED_VERSION_RELATION' FROM o WHERE rel AND NOT linked
UNION ALL SELECT doc_id, 'T2', 'UNLINKED_VERSION' FROM o WHERE v <> '' AND NOT linked
""")
def mapped_exclusions(load):
    return _parts(load)["exclusions"]


@query("mapped_coverage", f"""
WITH {_MARKED}, p AS (SELECT *, length({_norm("substr(text, 1, ws)")}) a, length({_norm("text")}) n FROM o WHERE cov),
e AS (SELECT doc_id, unnest(CASE WHEN mapped THEN [0] ELSE list_distinct([0, a, a + length(w)]) END) s, n, mapped, a, w, v, linked FROM p),
r AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) nx FROM e WHERE s < n)
SELECT doc_id, s::BIGINT AS "start", coalesce(nx, n)::BIGINT AS "end", CASE WHEN NOT mapped AND s = a THEN 'partial' ELSE 'complete' END AS status,
  NOT (NOT mapped AND s = a) AND (v = '' OR linked) AS versions, NOT (NOT mapped AND s = a) AS software FROM r
""")
def mapped_coverage(load):
    return _parts(load)["coverage"].select("doc_id", "start", "end", "status", F.col("fields.versions").alias("versions"), F.col("fields.software").alias("software"))


@query("legacy_occurrences", """
WITH m AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') w FROM documents WHERE regexp_matches(text, '[A-Za-z]{4,}'))
SELECT doc_id AS document_id, CASE WHEN doc_id % 6 = 5 THEN doc_id || '|unaligned:0' ELSE doc_id || '|sha256:' || sha256(text) || '|' || (instr(text, w) - 1) || ':' || (instr(text, w) - 1 + length(w)) END AS mention_id,
  CASE WHEN doc_id % 6 = 5 THEN 'zz' ELSE w END AS name, CASE WHEN doc_id % 6 = 5 THEN ['1'] WHEN doc_id % 2 = 0 THEN ['1'] ELSE ['1', '2'] END AS versions,
  CASE WHEN doc_id % 6 = 5 OR doc_id % 4 <> 0 THEN ['used'] END AS intents, CASE WHEN doc_id % 6 = 5 THEN ['sentiment'][1:0] WHEN doc_id % 4 = 0 THEN ['intents'] ELSE []::VARCHAR[] END AS invalid_fields,
  CASE WHEN doc_id % 6 = 5 THEN [0] ELSE [0, 1] END AS ordinals
FROM m UNION ALL SELECT doc_id, doc_id || '|unaligned:1', 'zz', CASE WHEN doc_id % 2 = 0 THEN ['1'] ELSE ['2'] END, CASE WHEN doc_id % 4 = 0 THEN ['shared'] ELSE ['used'] END, []::VARCHAR[], [1] FROM m WHERE doc_id % 6 = 5
""")
def legacy_occurrences(load):
    d = load("documents").select(F.col("doc_id").alias("document_id"), "text", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w")).where("w <> ''")
    at = (F.expr("locate(w, text)") - 1).cast("long")
    rows = d.withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "document_id", "ordinal", F.when(F.col("document_id") % 6 == 5, F.lit("zz")).when(F.col("ordinal") == 1, F.upper("w")).otherwise(F.col("w")).alias("name"), F.struct(at.alias("start"), (at + F.length("w")).alias("end")).alias("name_span"),
        F.when((F.col("ordinal") == 1) & (F.col("document_id") % 2 == 1), F.lit("2")).otherwise(F.lit("1")).alias("version"),
        F.array(F.when((F.col("ordinal") == 1) & (F.col("document_id") % 4 == 0), F.lit("shared")).otherwise(F.lit("used"))).alias("intents"), F.lit("mixed").alias("sentiment"), F.lit(None).cast("string").alias("mention_id"),
    )
    out = mp.convert_legacy(rows, d.select("document_id", "text"))
    return out.select("document_id", "mention_id", "name", "versions", "intents", "invalid_fields", "ordinals")


@query("successful_fields", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS versions, CASE WHEN l_linestatus = 'O' THEN l_shipmode END AS sentiment, list_filter([CASE WHEN l_returnflag = 'R' THEN 'versions' END, CASE WHEN l_linestatus <> 'O' THEN 'sentiment' END], lambda x: x IS NOT NULL) AS invalid_fields FROM (SELECT *, 'm' || l_suppkey % 7 AS l_shipmode FROM lineitem)")
def successful_fields(load):
    state = lambda ok: F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status")
    mode = F.concat(F.lit("m"), F.col("l_suppkey") % 7)
    rows = load("lineitem").select("l_orderkey", "l_linenumber", F.struct(state(F.col("l_returnflag") != "R"), F.col("l_quantity").alias("value")).alias("versions"), F.struct(state(F.col("l_linestatus") == "O"), mode.alias("value")).alias("sentiment"))
    return mp.successful_fields(rows, ("versions", "sentiment"))


_ROLES = "SELECT c_custkey id, ['train', 'devel', 'test', 'other'][c_custkey % 5 + 1] AS role FROM customer WHERE c_custkey % 5 < 4 UNION ALL SELECT c_custkey, 'test' FROM customer WHERE c_custkey % 7 = 0"


@query("native_roles", f"""
WITH p AS (SELECT DISTINCT * FROM ({_ROLES})), g AS (SELECT id, count(*) n, any_value(role) r FROM p GROUP BY id)
SELECT c_custkey AS id, CASE WHEN n = 1 AND r <> 'other' THEN CASE r WHEN 'devel' THEN 'dev' ELSE r END END AS role,
  CASE WHEN n IS NULL THEN 'NATIVE_SPLIT_MISSING' WHEN n > 1 THEN 'NATIVE_SPLIT_CONFLICT' WHEN r = 'other' THEN 'NATIVE_SPLIT_UNKNOWN' END AS code FROM customer LEFT JOIN g ON id = c_custkey
""")
def native_roles(load):
    ids = load("customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id") % 5
    role = F.when(k == 0, F.lit("train")).when(k == 1, F.lit("devel")).when(k == 2, F.lit("test")).otherwise(F.lit("other"))
    return mp.native_role(ids, ids.where(k < 4).select("id", role.alias("role")).unionByName(ids.where("id % 7 = 0").select("id", F.lit("test").alias("role"))))


@query("access_overlay", """
SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 1 THEN 'CC-BY-4.0' ELSE 'none' END AS text_license,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 1 THEN 'fulltext' WHEN doc_id % 4 = 1 THEN 'methods' ELSE 'abstract' END AS supplied_text_scope, lang AS language,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'REVISION_MISMATCH' WHEN doc_id % 3 = 0 AND doc_id % 4 = 1 THEN 'EXCERPT_REQUIRES_NEW_TEXT' END AS access_code FROM documents
""")
def access_overlay(load):
    none = F.lit(None).cast("string")
    d = load("documents").select(F.col("doc_id").alias("document_id"), F.lit("r1").alias("text_revision"), F.lit(False).alias("public"), F.col("lang").alias("language"), F.lit("none").alias("text_license"), none.alias("access_basis"), F.when(F.col("doc_id") % 4 == 1, F.lit("methods")).otherwise(F.lit("abstract")).alias("supplied_text_scope"))
    decisions = d.where("document_id % 3 = 0").select("document_id", F.when(F.col("document_id") % 5 == 0, F.lit("r0")).otherwise(F.lit("r1")).alias("text_revision"), F.lit(True).alias("public"), none.alias("language"), F.lit("CC-BY-4.0").alias("text_license"), F.lit("x").alias("access_basis"), F.lit("fulltext").alias("supplied_text_scope"))
    return mp.access_overlay(d, decisions).select("document_id", "text_license", "supplied_text_scope", "language", "access_code")


@query("listed_names", "SELECT p_name AS name, min(p_partkey) AS \"at\" FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_name")
def listed_names(load):
    value = F.when(F.col("p_partkey") % 9 == 0, F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.lit('{"id": 1}'))).when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("name")))).otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t")))
    return mp.listed_names(load("part").select(F.col("p_partkey").alias("at"), value.alias("value")))


@query("dictionary_names", """
WITH a AS (SELECT 0 k, p_partkey p, p_name n FROM part UNION ALL SELECT 1, p_partkey, upper(p_name) FROM part WHERE p_size > 25 UNION ALL SELECT 2, p_partkey, p_brand FROM part)
SELECT regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS fold, max_by(n, (k, p, n)) AS name FROM a GROUP BY 1
""")
def dictionary_names(load):
    part = load("part").withColumnRenamed("p_partkey", "at")
    return mp.dictionary([part.select("at", F.col("p_name").alias("name")), part.where("p_size > 25").select("at", F.upper("p_name").alias("name")), part.select("at", F.col("p_brand").alias("name"))])


@query("catalogue_packages", """
WITH x AS (SELECT p_partkey k, CASE WHEN p_size % 2 = 0 THEN 'pypi' ELSE 'cran' END eco, replace(p_name, ' ', '_') n, p_type FROM part)
SELECT 'ecosystems:' || eco || '/' || n || k AS key, n || k AS name, p_type AS description, ['github.com/o/r' || k] AS repo_keys,
  list_sort(list_distinct([eco || ':' || CASE WHEN eco = 'pypi' THEN regexp_replace(lower(n || k), '[-_.]+', '-', 'g') ELSE lower(n || k) END, 'pypi:home-' || k])) AS packages, ['a', 'b'] AS topics FROM x
""")
def catalogue_packages(load):
    p = load("part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey"))
    body = F.to_json(F.struct(name.alias("name"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("description"), F.concat(F.lit("https://pypi.org/project/Home_"), "p_partkey", F.lit("/")).alias("homepage"), F.concat(F.lit("https://GitHub.com/O/R"), "p_partkey", F.lit(".git")).alias("repository_url"), F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("")).alias("keywords_array")))
    rows = p.select(F.when(F.col("p_size") % 2 == 0, F.lit("pypi")).otherwise(F.lit("cran")).alias("ecosystem"), name.alias("name"), body.alias("payload"))
    return mp.parse_packages(rows).select("key", "name", "description", "repo_keys", "packages", "topics")


@query("catalogue_tools", """
SELECT 'biotools:s' || s_suppkey AS key, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN ['github.com/b/t' || s_suppkey, 'gitlab.com/g/t'] ELSE ['gitlab.com/g/t'] END AS repo_keys, ['SCR_' || s_suppkey] AS rrids, ['10.1/x' || s_suppkey] AS dois, ['t'] AS topics FROM supplier
""")
def catalogue_tools(load):
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("s_") else F.col(x).cast("string") for x in xs])
    link = F.struct(text("https://github.com/B/T", "s_suppkey").alias("url"), F.array(F.when(F.col("s_suppkey") % 2 == 0, F.lit("Repository")).otherwise(F.lit("Mirror"))).alias("type"))
    files = F.array(F.struct(F.lit("https://gitlab.com/g/t/-/archive").alias("url"), F.lit("Source code").alias("type")), F.struct(F.lit("https://gitlab.com/g/bin").alias("url"), F.lit("Binaries").alias("type")))
    ids = F.array(F.struct(text(" rrid:scr_", "s_suppkey").alias("value"), F.lit("RRID").alias("type")), F.struct(F.lit("x").alias("value"), F.lit("doi").alias("type")))
    body = F.struct(text("s", "s_suppkey").alias("biotoolsID"), F.col("s_name").alias("name"), F.array(link).alias("link"), files.alias("download"), ids.alias("otherID"), F.array(F.struct(text("10.1/X", "s_suppkey").alias("doi"))).alias("publication"), F.array(F.struct(F.lit("t").alias("term")), F.struct(F.lit(None).cast("string").alias("term"))).alias("topic"))
    return mp.parse_tools(load("supplier").select(F.to_json(body).alias("payload"))).select("key", "name", "repo_keys", "rrids", "dois", "topics")
