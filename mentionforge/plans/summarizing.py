"""Queries of run, review and reference summaries. Orders are documents or tasks, their lines spans, events or fields."""

from pyspark.sql import functions as F

from mentionforge.operators import summaries as sm
from mentionforge.plans.catalog import query
from mentionforge.plans.evaluation import _PRED, _REGIONS, _SPANS, _gold, _predicted, _regions
from mentionforge.plans.linking import _FORMS, _entities

_RATIOS = 'tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1'


def _values(df):
    return df.select("doc_id", "start", "end", F.array(F.col("label"), F.concat("label", F.col("end") % 2)).alias("versions"))


def _vals(rows: str) -> str:
    return f"SELECT DISTINCT doc_id, \"start\" s, \"end\" e, unnest([label, label || \"end\" % 2]) v FROM ({rows})"


@query("value_edges", f"""
WITH g AS ({_vals(_SPANS)}), p AS ({_vals(_PRED)}), c AS (SELECT (SELECT count(*) FROM g SEMI JOIN p USING (doc_id, s, e, v))::BIGINT tp, (SELECT count(*) FROM p ANTI JOIN g USING (doc_id, s, e, v))::BIGINT fp, (SELECT count(*) FROM g ANTI JOIN p USING (doc_id, s, e, v))::BIGINT fn)
SELECT tp, fp, fn, {_RATIOS} FROM c
""")
def value_edges(load):
    return sm.value_edges(_values(_gold(load)), _values(_predicted(load)))


_STATES = "SELECT o_orderkey doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'success' END status, o_orderkey % 4 + 1 e, o_orderkey % 4 + 1 - (o_orderkey % 6 = 0)::INTEGER - (o_orderkey % 10 = 0)::INTEGER s, (o_orderkey % 10 = 0)::INTEGER f FROM orders WHERE o_orderkey % 7 <> 0"


@query("failure_counters", f"""
WITH s AS ({_STATES}), j AS (SELECT o_orderkey, coalesce(status, 'missing') status, coalesce(f, 0) f, coalesce(e - s - f, 0) u FROM orders LEFT JOIN s ON doc_id = o_orderkey)
SELECT count(*) FILTER (status <> 'success' OR f > 0 OR u <> 0)::BIGINT AS failed_documents, sum(f)::BIGINT AS failed_chunks, sum(u)::BIGINT AS unaccounted_chunks, count(*) FILTER (status = 'missing')::BIGINT AS missing_status_documents FROM j
""")
def failure_counters(load):
    k = F.col("o_orderkey")
    docs = load("orders").select(k.alias("doc_id"))
    n = (k % 4 + 1).cast("int")
    s = load("orders").where(k % 7 != 0).select(k.alias("doc_id"), F.when(k % 9 == 0, F.lit("failed")).otherwise(F.lit("success")).alias("status"), n.alias("chunks_expected"), (n - (k % 6 == 0).cast("int") - (k % 10 == 0).cast("int")).alias("chunks_succeeded"), (k % 10 == 0).cast("int").alias("chunks_failed"))
    return sm.failure_counters(docs, s)


@query("zero_mention_counters", f"WITH g AS ({_SPANS}), p AS ({_PRED}), z AS (SELECT o_orderkey d FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM g WHERE label = 'A')) SELECT count(*)::BIGINT AS eligible, count(*) FILTER (d IN (SELECT doc_id FROM p))::BIGINT AS false_positive FROM z")
def zero_mention_counters(load):
    return sm.zero_mention_counters(load("orders").select(F.col("o_orderkey").alias("doc_id")), _gold(load).where("label = 'A'"), _predicted(load))


@query("registry_statistics", f"""
WITH {_FORMS}, m AS (SELECT p_name e, p_size % 3 s, p_partkey k FROM part), g AS (SELECT e, count(DISTINCT k) n, count(DISTINCT s) ns FROM m GROUP BY e), x AS (SELECT form, count(*) n FROM p WHERE key_type = 'exact' GROUP BY form)
SELECT (SELECT count(*) FROM g)::BIGINT AS entities, (SELECT count(*) FROM g WHERE ns > 1)::BIGINT AS multi_source_entities, (SELECT max(n) FROM g)::BIGINT AS largest_entity_members, (SELECT count(*) FROM x)::BIGINT AS exact_forms,
  (SELECT count(*) FROM x WHERE n > 1)::BIGINT AS ambiguous_exact_forms, (SELECT count(*) FROM supplier)::BIGINT AS links, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0)::BIGINT AS low_trust, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 > 0)::BIGINT AS unaudited
""")
def registry_statistics(load):
    from mentionforge.operators import registry as rg

    members = load("part").select(F.col("p_name").alias("entity_id"), (F.col("p_size") % 3).alias("source"), F.col("p_partkey").alias("key"))
    links = load("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.lit("low_trust")).otherwise(F.lit("unaudited")).alias("trust"))
    return sm.registry_statistics(members, rg.surface_forms(_entities(load)), links)


@query("readiness", """
WITH s AS (SELECT l_orderkey % 40 paper, 'a' || l_suppkey % 3 arm, l_returnflag label, l_partkey % 50 s, bool_or(l_linestatus = 'O') h FROM lineitem GROUP BY ALL), t AS (SELECT paper, arm, label, s, bool_or(h) h FROM s GROUP BY ALL)
SELECT 'total' AS level, NULL AS name, count(*)::BIGINT AS spans, count(*) FILTER (h)::BIGINT AS human_reviewed, count(DISTINCT paper)::BIGINT AS papers, greatest(0, 100000 - count(*))::BIGINT AS span_shortfall, greatest(0, 60 - count(DISTINCT paper))::BIGINT AS paper_shortfall FROM t
UNION ALL SELECT 'paper', paper::VARCHAR, count(*), count(*) FILTER (h), 1, NULL, NULL FROM t GROUP BY paper UNION ALL SELECT 'arm', arm, count(*), count(*) FILTER (h), count(DISTINCT paper), NULL, NULL FROM t GROUP BY arm UNION ALL SELECT 'label', label, count(*), count(*) FILTER (h), count(DISTINCT paper), NULL, NULL FROM t GROUP BY label
""")
def readiness(load):
    k = F.col("l_partkey") % 50
    s = load("lineitem").select((F.col("l_orderkey") % 40).alias("paper"), F.concat(F.lit("a"), F.col("l_suppkey") % 3).alias("arm"), F.col("l_returnflag").alias("label"), k.alias("start"), (k + 1).alias("end"), F.when(F.col("l_linestatus") == "O", F.lit("human_reviewed")).otherwise(F.lit("agent_provisional")).alias("kind"))
    return sm.readiness(s, 100_000, 60)


@query("run_statistics", """
WITH e AS (SELECT event_type run, count(*) events, count(*) FILTER (user_id % 5 = 0) bad, sum(CASE WHEN user_id % 3 > 0 THEN user_id END) i, count(*) FILTER (user_id % 3 > 0) ni, sum(event_id % 7) o, round(sum((event_id % 11)::DOUBLE / 4), 3) s FROM events GROUP BY event_type),
p AS (SELECT event_type run, count(*) n, count(DISTINCT user_id) d FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY event_type)
SELECT run, events::BIGINT AS events, bad::BIGINT AS not_success, i::BIGINT AS input_tokens, ni::BIGINT AS with_input_tokens, o::BIGINT AS output_tokens, s AS seconds, coalesce(n, 0)::BIGINT AS predictions, coalesce(d, 0)::BIGINT AS documents FROM e LEFT JOIN p USING (run)
""")
def run_statistics(load):
    e, u = load("events"), F.col("user_id")
    rows = e.select(F.col("event_type").alias("run"), F.when(u % 5 == 0, F.lit("failed")).otherwise(F.lit("success")).alias("status"), F.when(u % 3 > 0, u).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), ((F.col("event_id") % 11).cast("double") / 4).alias("seconds"))
    p = e.where("event_id % 2 = 0 and event_type <> 'view'").select(F.col("event_type").alias("run"), u.alias("doc_id"), F.lit("x").alias("name"))
    return sm.run_statistics(rows, p)


@query("top_values", "SELECT l_returnflag AS run, l_suppkey AS name, count(*)::BIGINT AS count FROM lineitem GROUP BY l_returnflag, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) <= 5")
def top_values(load):
    return sm.top_values(load("lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("name")), ["run"], "name", 5)


@query("majority_value", "SELECT o_custkey, max_by(s, (n, -k)) AS sentiment FROM (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' END s, count(*) n, min(o_orderkey) k FROM orders GROUP BY ALL) WHERE s IS NOT NULL GROUP BY o_custkey")
def majority_value(load):
    from mentionforge.operators import review as rv

    k = F.col("o_orderkey") % 4
    rows = load("orders").select("o_custkey", "o_orderkey", F.when(k == 0, F.lit("mixed")).when(k == 1, F.lit("positive")).when(k == 2, F.lit("negative")).alias("sentiment")).where("sentiment is not null")
    return rv.most_common(rows, ["o_custkey"], "sentiment", "o_orderkey")


_FOLD = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query("query_hits", f"""
WITH q AS (SELECT DISTINCT p_brand query, l_orderkey d FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1), n AS (SELECT DISTINCT l_orderkey d, p_name nm FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 1 UNION SELECT l_orderkey, p_brand || '!' FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 50 = 0),
j AS (SELECT query, nm, {_FOLD.format('query')} a, {_FOLD.format('nm')} b FROM q LEFT JOIN n USING (d))
SELECT query, CASE WHEN bool_or(nm IS NOT NULL AND (a = b OR (least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a))))) THEN 'Y' WHEN count(nm) > 0 THEN 'partial' ELSE '-' END AS state FROM j GROUP BY query
""")
def query_hits(load):
    j = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey"))
    q = j.where("l_linenumber = 1").select(F.col("p_brand").alias("query"), F.col("l_orderkey").alias("doc_id")).distinct()
    n = j.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("name")).unionByName(j.where("l_suppkey % 50 = 0").select(F.col("l_orderkey").alias("doc_id"), F.concat("p_brand", F.lit("!")).alias("name")))
    return sm.query_hits(q, n)


@query("comparison_table", "SELECT n_nationkey AS run, n_name AS model, round(max(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 7 END), 3) AS f1, round(max(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey / 7 END), 3) AS recall FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def comparison_table(load):
    m = load("supplier").select(F.col("s_nationkey").alias("run"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("f1")).otherwise(F.lit("recall")).alias("metric"), (F.col("s_suppkey") / 7).alias("value"))
    return sm.comparison_table(load("nation").select(F.col("n_nationkey").alias("run"), F.col("n_name").alias("model")), m, ["f1", "recall"], 3)


@query("distinct_names", "SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def distinct_names(load):
    return sm.distinct_names(load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("name")))


@query("masked_versions", "SELECT l_orderkey AS doc_id, l_partkey AS id, (o_custkey % 6 <> 0 AND l_linestatus = 'O') AS versions_known, CASE WHEN o_custkey % 6 = 0 THEN 'ambiguous' ELSE 'absent' END AS version_status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def masked_versions(load):
    o = load("orders")
    rows = load("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("id"), (F.col("l_linestatus") == "O").alias("versions_known"), F.lit("absent").alias("version_status"))
    return sm.mask_versions(rows, o.where("o_custkey % 6 = 0").select(F.col("o_orderkey").alias("doc_id")))


@query("best_arms", """
WITH s AS (SELECT n_regionkey field, n_name arm, CASE WHEN n_regionkey = 2 THEN 0 ELSE n_nationkey % 3 END tp, 0 fn, CASE WHEN n_nationkey % 4 > 0 THEN round(n_nationkey % 3 / 4, 2) END f1 FROM nation), t AS (SELECT field, CASE WHEN sum(tp + fn) > 0 THEN max(f1) END b FROM s GROUP BY field)
SELECT field, b AS best_f1, list_sort(coalesce(list(DISTINCT arm) FILTER (f1 = b), [])) AS arms FROM s JOIN t USING (field) GROUP BY field, b
""")
def best_arms(load):
    k = F.col("n_nationkey")
    s = load("nation").select(F.col("n_regionkey").alias("field"), F.col("n_name").alias("arm"), F.when(F.col("n_regionkey") == 2, 0).otherwise(k % 3).alias("tp"), F.lit(0).alias("fn"), F.when(k % 4 > 0, F.round(k % 3 / 4, 2)).alias("f1"))
    return sm.best_arms(s)


@query("timed_results", "SELECT o_orderkey AS doc_id, 'c' || o_custkey % 3 AS checkpoint, (o_orderkey % 13) / 8 AS seconds FROM orders")
def timed_results(load):
    o = load("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("checkpoint"))
    return sm.timing_join(o, o.withColumn("seconds", F.col("doc_id") % 13 / 8))


@query("attached_attributes", """
WITH s AS (SELECT l_orderkey d, l_linenumber n, min(l_partkey) p, min(l_suppkey) u FROM lineitem GROUP BY ALL), a AS (SELECT d, CASE WHEN n % 3 = 1 THEN 'version' ELSE 'url' END kind, 'v' || u % 5 v, unnest([n - 1, n + 1, 99]) t FROM s WHERE n % 3 > 0)
SELECT DISTINCT a.d AS doc_id, 's' || t AS id, kind, v AS value FROM a JOIN s ON s.d = a.d AND s.n = t
""")
def attached_attributes(load):
    s = load("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("u"))
    n = F.col("l_linenumber")
    spans = s.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), n).alias("id"), F.when(n % 3 == 1, F.lit("version")).when(n % 3 == 2, F.lit("url")).otherwise(F.lit("software")).alias("type"), F.concat(F.lit(" v"), F.col("u") % 5).alias("text"), F.concat(F.lit("#s"), n - 1, F.lit("  #s"), n + 1, F.lit(" s99")).alias("corresp"))
    return sm.attached_attributes(spans, ["version", "url"])


@query("containment_recall", f"""
WITH w AS (SELECT DISTINCT l_orderkey d, {_FOLD.format('p_name')} f FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT DISTINCT l_orderkey d, {_FOLD.format("split_part(p_name, ' ', 1)")} f FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 1)
SELECT count(*)::BIGINT AS wanted, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.d = w.d AND (contains(w.f, g.f) OR contains(g.f, w.f))))::BIGINT AS found FROM w
""")
def containment_recall(load):
    j = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey"))
    return sm.containment_recall(j.select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("name")), j.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc_id"), F.substring_index("p_name", " ", 1).alias("name")))


@query("merge_problems", """
WITH a AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END t2, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END l2 FROM documents WHERE doc_id % 11 > 0)
SELECT doc_id, unnest(list_filter(CASE WHEN a.doc_id IS NULL THEN ['only right'] WHEN b.doc_id IS NULL THEN ['only left'] ELSE [CASE WHEN text IS DISTINCT FROM t2 THEN 'differs: text' END, CASE WHEN lang IS DISTINCT FROM l2 THEN 'differs: lang' END] END, lambda x: x IS NOT NULL)) AS problem FROM a FULL JOIN b USING (doc_id)
""")
def merge_problems(load):
    d, k = load("documents").select("doc_id", "text", "lang"), F.col("doc_id")
    b = d.where(k % 11 > 0).select("doc_id", F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("text")).alias("text"), F.when(k % 5 != 0, F.col("lang")).alias("lang"))
    return sm.merge_problems(d.where(k % 10 > 0), b, ["text", "lang"])


_WORDS = ("the", "est", "der")
_NW = "[^\\pL\\pM\\p{Nd}\\p{Pc}]"


@query("label_audit", "WITH " + ", ".join(f"""p{k} AS (SELECT doc_id, unnest(x) part, generate_subscripts(x, 1) i, len(x) n FROM (SELECT doc_id, string_split(' ' || regexp_replace(text, '([^\\pL\\pM\\p{{Nd}}\\p{{Pc}}])', '\\1\\1', 'g') || ' ', '{w}') x FROM documents WHERE text IS NOT NULL))""" for k, w in enumerate(_WORDS)) + ", " + ", ".join(f"""h{k} AS (SELECT doc_id, count(*) n FROM (SELECT doc_id, i, n, regexp_matches(part, '{_NW}$') e, regexp_matches(lead(part) OVER (PARTITION BY doc_id ORDER BY i), '^{_NW}') b FROM p{k}) WHERE i < n AND e AND b GROUP BY doc_id)""" for k in range(len(_WORDS))) + " " + " UNION ALL ".join(f"SELECT '{w}' AS name, sum(n)::BIGINT AS hits, sum(CASE WHEN doc_id % 2 = 0 THEN n ELSE 0 END)::BIGINT AS covered FROM h{k}" for k, w in enumerate(_WORDS)))
def label_audit(load):
    d = load("documents").select("doc_id", "text")
    return sm.label_audit(d, d.where("doc_id % 2 = 0").select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")), _WORDS)


@query("arms_that_differ", f"""
WITH g AS (SELECT DISTINCT label arm, doc_id, "start" s, "end" e FROM ({_SPANS})), p AS (SELECT DISTINCT label arm, doc_id, "start" s, "end" e FROM ({_PRED})), j AS (SELECT arm, doc_id, g.s IS NULL r, p.s IS NULL l FROM (SELECT *, 1 k FROM g) g FULL JOIN (SELECT *, 1 k FROM p) p USING (arm, doc_id, s, e)),
x AS (SELECT arm, doc_id, 1 a, 0 b FROM (SELECT * FROM g EXCEPT SELECT * FROM p) UNION ALL SELECT arm, doc_id, 0, 1 FROM (SELECT * FROM p EXCEPT SELECT * FROM g))
SELECT arm, doc_id, sum(a)::BIGINT AS only_left, sum(b)::BIGINT AS only_right FROM x GROUP BY ALL
""")
def arms_that_differ(load):
    arm = lambda df: df.withColumnRenamed("label", "arm")
    return sm.arms_that_differ(arm(_gold(load)), arm(_predicted(load)), ["start", "end"], ["arm", "doc_id"])


_KIND = "CASE WHEN \"start\" = 60 THEN 'human_reviewed' ELSE 'agent_provisional' END"


@query("reviewed_reference", f"""
WITH r AS (SELECT doc_id, "start" s, "end" e, {_KIND} k, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'N' END label FROM ({_REGIONS})) SELECT DISTINCT x.doc_id, x.id, x.label FROM ({_SPANS}) x JOIN r ON r.doc_id = x.doc_id AND r.label = x.label AND k = 'agent_provisional' AND x."start" >= s AND x."end" <= e
""")
def reviewed_reference(load):
    kind = F.when(F.col("start") == 60, F.lit("human_reviewed")).otherwise(F.lit("agent_provisional"))
    r = _regions(load).select("doc_id", "start", "end", kind.alias("review_kind"), F.when(F.col("doc_id") % 2 == 0, F.lit("A")).otherwise(F.lit("N")).alias("label"))
    return sm.reviewed_reference(_gold(load), r, "agent_provisional").select("doc_id", "id", "label")


@query("alias_candidates", f'WITH s AS ({_SPANS}) SELECT DISTINCT x.doc_id, x.id AS a, y.id AS b FROM s x JOIN s y ON x.doc_id = y.doc_id AND x."end" <= y."start" AND x.label <> y.label')
def alias_candidates(load):
    return sm.alias_candidates(_gold(load).withColumnRenamed("label", "text"))


@query("arm_link_scores", f"""
WITH d AS (SELECT 'a' || k arm, o_orderkey doc_id FROM orders, (SELECT unnest([0, 1]) k) WHERE o_orderkey % 3 <> k), g AS (SELECT DISTINCT arm, doc_id, id FROM d JOIN ({_SPANS}) USING (doc_id)), p AS (SELECT DISTINCT arm, doc_id, id + (id % 4 = 0)::BIGINT id FROM d JOIN ({_PRED}) USING (doc_id)),
x AS (SELECT arm, doc_id, (g.h = 1 AND p.h = 1)::INTEGER t, (g.h IS NULL)::INTEGER f, (p.h IS NULL)::INTEGER m FROM (SELECT *, 1 h FROM g) g FULL JOIN (SELECT *, 1 h FROM p) p USING (arm, doc_id, id)),
s AS (SELECT arm, doc_id, coalesce(sum(t), 0)::BIGINT tp, sum(f)::BIGINT fp, sum(m)::BIGINT fn FROM x GROUP BY arm, doc_id UNION ALL SELECT arm, NULL, coalesce(sum(t), 0)::BIGINT, sum(f)::BIGINT, sum(m)::BIGINT FROM x GROUP BY arm)
SELECT arm, doc_id, tp, fp, fn, {_RATIOS} FROM s
""")
def arm_link_scores(load):
    o = load("orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("doc_id % 3 <> k").select(F.concat(F.lit("a"), "k").alias("arm"), "doc_id")
    edge = (F.col("id") + (F.col("id") % 4 == 0).cast("long")).alias("edge")
    return sm.link_scores(_gold(load).select("doc_id", F.col("id").alias("edge")), _predicted(load).select("doc_id", edge).join(o, "doc_id"), o)


@query("snippet_reservations", "SELECT 'w' || doc_id % 90 AS openalex, CASE WHEN doc_id % 90 % 4 > 0 THEN '10.1/' || doc_id % 90 END AS doi, list_sort(list(source || doc_id)) AS associations FROM documents GROUP BY ALL")
def snippet_reservations(load):
    k = F.col("doc_id") % 90
    return sm.snippet_reservations(load("documents").select("text", F.concat(F.lit("w"), k).alias("openalex"), F.when(k % 4 > 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.concat("source", "doc_id").alias("association")))


@query("fenced_records", "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS version FROM part")
def fenced_records(load):
    body = F.concat(F.lit('[{"name": "'), "p_name", F.lit('"'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', "version": "'), "p_size", F.lit('"'))).otherwise(F.lit("")), F.lit("}]"))
    reply = F.when(F.col("p_partkey") % 3 == 0, body).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(F.concat(F.lit("\n```\n "), body, F.lit(" \n```")))
    return load("part").select("p_partkey", F.inline(sm.fenced_records(reply, "array<struct<name:string,version:string>>")))


@query("coverage_status", f"""
WITH r AS (SELECT doc_id, "start" s, "end" e, doc_id * 1000 + "start" id, (doc_id + "start") % 5 > 0 k FROM ({_REGIONS}) WHERE "end" > "start"), o AS (SELECT doc_id, "start" a, "end" b, label <> 'R' known FROM ({_SPANS})),
j AS (SELECT r.doc_id, r.id, k, bool_and(known) al, count(a) n FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND a < e AND s < b GROUP BY ALL)
SELECT doc_id, id, CASE WHEN k AND coalesce(al, true) THEN 'complete' ELSE 'partial' END AS status, (k AND n = 0) AS negative FROM j
""")
def coverage_status(load):
    r = _regions(load).where("end > start").select("doc_id", (F.col("doc_id") * 1000 + F.col("start")).alias("id"), "start", "end", ((F.col("doc_id") + F.col("start")) % 5 > 0).alias("fields_known"))
    return sm.coverage_status(r, _gold(load).select("doc_id", "start", "end", (F.col("label") != "R").alias("known"))).select("doc_id", "id", "status", "negative")


_FIELD = "['software', 'versions', 'created', 'used', 'shared', 'sentiment'][l_partkey % 6 + 1]"
_STATE = f"""SELECT DISTINCT l_orderkey t, l_suppkey % 4 m, {_FIELD} f, CASE WHEN l_partkey % 7 = 0 AND (l_suppkey % 2 = 0 OR l_partkey % 3 > 0) THEN CASE WHEN l_suppkey % 2 = 0 THEN 'unresolved' ELSE 'confirmed' END
  WHEN l_partkey % 3 = 0 AND l_partkey % 4 = 0 THEN 'unresolved' WHEN l_partkey % 3 = 0 THEN 'missing' WHEN l_partkey % 5 = 0 THEN 'confirmed' ELSE 'proposed' END s, l_partkey p FROM lineitem"""


def _states(load):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    names = F.array(*map(F.lit, ("software", "versions", "created", "used", "shared", "sentiment")))
    rows = load("lineitem").select(
        F.col("l_orderkey").alias("task_id"), (s % 4).alias("mention_id"), F.element_at(names, (p % 6 + 1).cast("int")).alias("field"), (p % 3 > 0).alias("known"), F.when(s % 2 == 0, F.lit("unresolved")).otherwise(F.lit("confirmed")).alias("stamp_state"),
        F.lit("h").alias("value_hash"), F.when(p % 7 == 0, F.lit("h")).alias("stamp_hash"), (p % 4 == 0).alias("ambiguous"), (p % 5 == 0).alias("accepted"), p.alias("p"),
    )
    return sm.field_states(rows.distinct())


@query("field_states", f"SELECT t AS task_id, m AS mention_id, f AS field, s AS state, p FROM ({_STATE})")
def field_states(load):
    return _states(load).select("task_id", "mention_id", "field", "state", "p")


_QUESTIONS = f"SELECT t, m, CASE WHEN f IN ('created', 'used', 'shared') THEN 'intents' ELSE f END u, max(CASE s WHEN 'unresolved' THEN 3 WHEN 'missing' THEN 2 WHEN 'proposed' THEN 1 ELSE 0 END) w FROM ({_STATE}) GROUP BY ALL HAVING w > 0"


@query("review_questions", f"SELECT t AS task_id, m AS mention_id, u AS unit, ['confirm_proposal', 'missing', 'unresolved'][w] AS code FROM ({_QUESTIONS})")
def review_questions(load):
    return sm.review_questions(_states(load))


def _reviewed(load):
    k = F.col("task_id")
    tasks = load("orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0).alias("n_issues"), (F.col("o_orderkey") % 2 == 0).alias("approved"), (F.col("o_orderkey") % 5 == 0).alias("touched"))
    return sm.review_status(tasks, _states(load)).withColumn("reasons", F.array(F.concat(F.lit("r"), k % 3)))


_REVIEWED = f"""q AS (SELECT t, count(*) FILTER (w > 1) d, count(*) FILTER (w = 1) p FROM ({_QUESTIONS}) GROUP BY t), c AS (SELECT t, bool_or(s = 'confirmed') c FROM ({_STATE}) GROUP BY t),
v AS (SELECT o_orderkey task_id, coalesce(d, 0)::BIGINT needs_decisions, coalesce(p, 0)::BIGINT proposals_to_confirm, NOT (coalesce(d, 0) > 0 OR o_orderkey % 11 = 0) can_approve,
  CASE WHEN o_orderkey % 11 = 0 THEN 'source_issue' WHEN o_orderkey % 2 = 0 AND coalesce(d, 0) = 0 THEN 'approved' WHEN o_orderkey % 5 = 0 OR coalesce(c, false) OR o_orderkey % 2 = 0 THEN 'in_progress' ELSE 'pending' END workflow_status FROM orders LEFT JOIN q ON q.t = o_orderkey LEFT JOIN c ON c.t = o_orderkey)"""


@query("review_status", f"WITH {_REVIEWED} SELECT * FROM v")
def review_status(load):
    return _reviewed(load).select("task_id", "needs_decisions", "proposals_to_confirm", "can_approve", "workflow_status")


@query("review_queue", f"WITH {_REVIEWED} SELECT task_id, workflow_status FROM v WHERE workflow_status = 'in_progress' AND task_id % 3 = 1")
def review_queue(load):
    return sm.review_queue(_reviewed(load), workflow_status="in_progress", reason="r1", status=None).select("task_id", "workflow_status")


@query("review_progress", f"WITH {_REVIEWED} SELECT count(*)::BIGINT AS total, " + ", ".join(f"count(*) FILTER (workflow_status = '{s}')::BIGINT AS {s}" for s in ("pending", "in_progress", "approved", "source_issue")) + " FROM v")
def review_progress(load):
    return sm.review_progress(_reviewed(load))
