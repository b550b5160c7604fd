"""Queries of eligibility, review routing, stage decisions, snippets and windows."""

from pyspark.sql import functions as F

from mentionforge.operators import annotation as an
from mentionforge.plans.catalog import query

_LICENCES = "['CC-BY-4.0', 'CC-BY-NC-4.0', 'CC0-1.0', 'public-domain']"


@query("fulltext_eligible", f"""
SELECT doc_id, (doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND lang = 'en' AND source <> 'src0' AND {_LICENCES}[doc_id % 4 + 1] <> 'CC-BY-NC-4.0') AS eligible FROM documents
""")
def fulltext_eligible(load):
    licence = F.element_at(F.array(*map(F.lit, ("CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "public-domain"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    d = load("documents").select("doc_id", (F.col("doc_id") % 7 != 0).alias("public"), F.when(F.col("doc_id") % 3 == 0, F.lit("abstract")).otherwise(F.lit("fulltext")).alias("scope"), F.col("lang").alias("language"), F.when(F.col("source") == "src0", F.lit("")).otherwise(F.lit("open")).alias("access_basis"), licence.alias("licence"))
    return d.select("doc_id", an.fulltext_eligible().alias("eligible"))


@query("publication_types", """
SELECT p_partkey, NOT (p_size % 5 = 0 OR p_size % 7 = 0) AND CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 ELSE p_size % 3 = 0 END AS permitted FROM part
""")
def publication_types(load):
    own = F.when(F.col("p_size") % 7 == 0, F.lit("Editorial note")).when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 4 == 0, F.lit(" Research-Article ")).otherwise(F.lit("poster")))
    core = F.array(F.when(F.col("p_size") % 5 == 0, F.lit("Letter to us")).otherwise(F.lit("x")), F.when(F.col("p_size") % 3 == 0, F.lit("Journal Article")).otherwise(F.lit("y")))
    return load("part").select("p_partkey", an.permitted_type(own, core).alias("permitted"))


@query("review_reasons", """
SELECT l_orderkey, l_linenumber, l_partkey, list_sort(list_filter([CASE WHEN l_tax > 0.07 THEN 'evidence_disagreement' END, CASE WHEN l_returnflag <> 'N' THEN 'expressed_sentiment' END, CASE WHEN l_linestatus = 'F' THEN 'created_or_shared' END,
  CASE WHEN l_quantity > 40 THEN 'multiple_versions' END, CASE WHEN l_suppkey % 3 = 0 THEN 'ambiguous_version' END, CASE WHEN l_suppkey % 5 = 0 THEN 'table_or_reference' END, CASE WHEN l_discount = 0 THEN 'cross_sentence' END, CASE WHEN l_partkey % 2 = 0 THEN 'unresolved_field' END], lambda x: x IS NOT NULL)) AS reasons FROM lineitem
""")
def review_reasons(load):
    d = load("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") > 0.07).alias("disagreement"), F.when(F.col("l_returnflag") == "N", F.lit("not_expressed")).otherwise(F.lit("mixed")).alias("sentiment"),
        F.when(F.col("l_linestatus") == "F", F.array(F.lit("created"))).otherwise(F.array(F.lit("used"))).alias("intents"), F.when(F.col("l_quantity") > 40, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1"))).alias("versions"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("ambiguous")).alias("version_status"), F.when(F.col("l_suppkey") % 5 == 0, F.lit("table")).alias("context_kind"), (F.col("l_discount") == 0).alias("cross_sentence"), F.create_map(F.lit("name"), F.col("l_partkey") % 2 != 0).alias("known"),
    )
    return d.select("l_orderkey", "l_linenumber", "l_partkey", an.review_reasons().alias("reasons"))


@query("stage_labels", """
WITH p AS (SELECT event_id, [event_id % 7 / 7, event_id % 11 / 11, event_id % 13 / 13, event_id % 3 / 3] v FROM events)
SELECT event_id, CASE WHEN list_max(v[1:3]) < 0.5 THEN ['mentioned'] ELSE list_filter([CASE WHEN v[1] >= 0.5 THEN 'used' END, CASE WHEN v[2] >= 0.5 THEN 'created' END, CASE WHEN v[3] >= 0.5 THEN 'shared' END], lambda x: x IS NOT NULL) END AS intents,
  ['positive', 'negative', 'mixed', 'not_expressed'][list_position(v, list_max(v))] AS sentiment FROM p
""")
def stage_labels(load):
    v = F.array(*[F.pmod("event_id", F.lit(k)) / k for k in (7, 11, 13, 3)])
    e = load("events").select("event_id", v.alias("v"))
    return e.select("event_id", an.intent_labels(F.col("v"), ("used", "created", "shared")).alias("intents"), an.best_label(F.col("v"), an.SENTIMENTS).alias("sentiment"))


@query("sentiment_metrics", """
WITH c AS (SELECT ['positive', 'negative', 'mixed', 'not_expressed'][l_partkey % 4 + 1] g, ['positive', 'negative', 'mixed', 'not_expressed', 'other'][(l_partkey + l_suppkey % 2) % 5 + 1] p, count(*) n FROM lineitem GROUP BY ALL), k AS (SELECT * FROM c WHERE p <> 'other'),
t AS (SELECT l, sum(CASE WHEN g = l AND p = l THEN n ELSE 0 END) tp, sum(CASE WHEN p = l AND g <> l THEN n ELSE 0 END) fp, sum(CASE WHEN g = l AND p <> l THEN n ELSE 0 END) fn FROM k, (SELECT unnest(['positive', 'negative', 'mixed', 'not_expressed']) l) GROUP BY l),
f AS (SELECT 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / nullif(tp / (tp + fp) + tp / (tp + fn), 0) f1 FROM t)
SELECT (SELECT avg(f1) FROM f) AS macro_f1, sum(CASE WHEN g = 'not_expressed' AND p IN ('positive', 'negative', 'mixed') THEN n ELSE 0 END) / sum(CASE WHEN g = 'not_expressed' THEN n ELSE 0 END) AS false_opinion_rate, sum(CASE WHEN p <> 'other' THEN n ELSE 0 END)::BIGINT AS matched FROM c
""")
def sentiment_metrics(load):
    names = F.array(*map(F.lit, (*an.SENTIMENTS, "other")))
    g = F.element_at(names, (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    p = F.element_at(names, (F.pmod(F.col("l_partkey") + F.pmod("l_suppkey", F.lit(2)), F.lit(5)) + 1).cast("int"))
    return an.sentiment_metrics(load("lineitem").groupBy(g.alias("gold"), p.alias("predicted")).agg(F.count("*").alias("n")))


@query("snippets", """
WITH s AS (SELECT o_orderkey, unnest(range(7)) w FROM orders), t AS (SELECT o_orderkey, w, unnest(range(3)) k FROM s WHERE w < 5)
SELECT 'q' || o_orderkey AS query, 'W' || w AS work_id, w::INTEGER AS work_rank, k::INTEGER AS snippet_rank, CASE WHEN (w + k) % 4 = 3 THEN '' ELSE 'hit ' || k || ' & more' END AS text, CASE WHEN (w + k) % 4 = 3 THEN 'rejected' ELSE 'accepted' END AS status FROM t WHERE k < 2
""")
def snippets(load):
    snippet = lambda w, k: F.when((w + k) % 4 == 3, F.lit(" ")).otherwise(F.concat(F.lit("<em>hit</em>  "), k.cast("string"), F.lit(" &amp; more")))
    work = lambda w: F.struct(F.concat(F.lit("W"), w.cast("string")).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: snippet(w, k)).alias("snippets"))
    r = load("orders").select(F.concat(F.lit("q"), "o_orderkey").alias("query"), F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(6)), work).alias("results"))).alias("payload"))
    return an.snippets(r)


@query("event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(load):
    return load("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("frozen_windows")
def frozen_windows(load):
    return an.frozen_windows(load("documents").select("doc_id", "text"))
