"""Queries of interval and scoring operators. Spans come from lineitem: an order is a document, a line a span."""

from pyspark.sql import functions as F

from mentionforge.functions import scores
from mentionforge.operators import evaluation as ev
from mentionforge.operators import intervals as iv
from mentionforge.plans.catalog import query
from mentionforge.session import dealt

#: Lines of an order that share a number count as one.
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey, max(l_quantity) l_quantity, min(l_returnflag) l_returnflag, min(l_linestatus) l_linestatus FROM lineitem GROUP BY ALL)"
_SPANS = f"SELECT l_orderkey doc_id, l_orderkey * 10 + l_linenumber id, l_partkey % 200 AS \"start\", l_partkey % 200 + 1 + l_quantity::BIGINT AS \"end\", l_returnflag AS label FROM {_LINES}"
_PRED = f"SELECT l_orderkey doc_id, l_orderkey * 10 + l_linenumber id, l_partkey % 200 + (l_suppkey % 3 = 0)::BIGINT AS \"start\", l_partkey % 200 + 1 + l_quantity::BIGINT AS \"end\", CASE WHEN l_suppkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS label FROM {_LINES} WHERE l_suppkey % 5 <> 0"
_REGIONS = "SELECT o_orderkey doc_id, unnest([0, 60, 130]) AS \"start\", unnest([60, 100, 130 + o_custkey % 90]) AS \"end\" FROM orders"
_ISLANDS = f"""r AS ({_REGIONS}), b AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM r WHERE "end" > "start"),
g AS (SELECT *, sum(CASE WHEN reach >= "start" THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) k FROM b),
i AS (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY doc_id, k)"""


def _lines(load):
    """Lines by order and number. Least and largest strings are taken of sorted rows, so rows are dealt out by order before that: a
    task of the scan sorts nothing, and what follows by order needs no other shuffle."""
    one = dealt(load("lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber")
    return one.agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))


def _gold(load):
    start = F.pmod("l_partkey", F.lit(200))
    return _lines(load).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + 1 + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("label"))


def _predicted(load):
    start = F.pmod("l_partkey", F.lit(200))
    rows = _lines(load).where("l_suppkey % 5 <> 0")
    label = F.when(F.col("l_suppkey") % 4 == 0, F.lit("N")).otherwise(F.col("l_returnflag"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (start + (F.col("l_suppkey") % 3 == 0).cast("long")).alias("start"), (start + 1 + F.col("l_quantity").cast("long")).alias("end"), label.alias("label"))


def _regions(load):
    pairs = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(60).cast("long").alias("end")), F.struct(F.lit(60).cast("long").alias("start"), F.lit(100).cast("long").alias("end")), F.struct(F.lit(130).cast("long").alias("start"), (F.pmod("o_custkey", F.lit(90)) + 130).alias("end")))
    return load("orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(pairs))


@query("union_regions", f'WITH {_ISLANDS} SELECT doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end" FROM i')
def union_regions(load):
    return iv.merge_islands(_regions(load), ["doc_id"])


@query("covered_size", f'WITH {_ISLANDS} SELECT doc_id, sum("end" - "start")::BIGINT AS covered FROM i GROUP BY doc_id')
def covered_size(load):
    return iv.covered_size(_regions(load), ["doc_id"])


@query("region_state", f"""
WITH {_ISLANDS}, s AS ({_SPANS})
SELECT s.doc_id, s.id, s."start", s."end", s.label, CASE WHEN bool_or(coalesce(s."start" >= i."start" AND s."end" <= i."end", false)) THEN 'eligible'
  WHEN bool_or(coalesce(s."start" < i."end" AND i."start" < s."end", false)) THEN 'boundary_crossing' ELSE 'uncovered' END AS state
FROM s LEFT JOIN i USING (doc_id) GROUP BY ALL
""")
def region_state(load):
    return iv.region_state(_gold(load), _regions(load), ["doc_id"])


@query("coverage_mask", f"""
WITH {_ISLANDS}, s AS ({_SPANS})
SELECT s.id, EXISTS (SELECT 1 FROM i WHERE i.doc_id = s.doc_id AND s."start" >= i."start" AND s."end" <= i."end") AS covered FROM s
""")
def coverage_mask(load):
    return iv.region_state(_gold(load), _regions(load), ["doc_id"]).select("id", (F.col("state") == "eligible").alias("covered"))


@query("nested_spans", f"""
WITH s AS ({_SPANS})
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.label = s.label AND o."start" <= s."start" AND o."end" >= s."end" AND o."end" - o."start" > s."end" - s."start")
""")
def nested_spans(load):
    return iv.drop_nested(_gold(load), ["doc_id", "label"])


@query("overlapping_spans", f"""
WITH s AS ({_SPANS}) SELECT a.id, b.id AS id2 FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.id < b.id AND a."start" < b."end" AND b."start" < a."end"
""")
def overlapping_spans(load):
    s = _gold(load).select("doc_id", "id", "start", "end")
    other = s.select("doc_id", F.col("id").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    return iv.overlap_pairs(s, other, ["doc_id"], F.col("id") < F.col("id2")).select("id", "id2")


@query("boundary_segments", f"""
WITH s AS ({_SPANS}), e AS (SELECT doc_id, "start" p, 1 d FROM s UNION ALL SELECT doc_id, "end", -1 FROM s), k AS (SELECT doc_id, p, sum(d) d FROM e GROUP BY ALL),
r AS (SELECT doc_id, p AS "start", lead(p) OVER w AS "end", sum(d) OVER w depth FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT doc_id, "start", "end", depth::BIGINT AS depth FROM r WHERE "end" IS NOT NULL
""")
def boundary_segments(load):
    return iv.cut_at_boundaries(_gold(load), ["doc_id"])


@query("tiled_regions", f"""
WITH r AS ({_REGIONS}), l AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end") b FROM r)
SELECT doc_id, min("start")::BIGINT AS "start", max("end")::BIGINT AS "end", bool_and(coalesce(b = "start", true)) AS exact FROM l GROUP BY doc_id
""")
def tiled_regions(load):
    return iv.tiles(_regions(load), ["doc_id"])


_EDGES = f"""e AS (SELECT a.doc_id, a.id AS edge_id, a."start", a."end", b."start" AS start2, b."end" AS end2 FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.doc_id = b.doc_id AND b.id = a.id + 1),
x AS (SELECT o_orderkey doc_id, 40 + o_custkey % 40 s, 45 + o_custkey % 40 t FROM orders)"""
_EDGE_OK = 'EXISTS (SELECT 1 FROM i WHERE i.doc_id = e.doc_id AND least(e."start", start2) >= i."start" AND greatest(e."end", end2) <= i."end") AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = e.doc_id AND ((e."start" < t AND s < e."end") OR (start2 < t AND s < end2)))'


def _edges(load):
    a = _gold(load).select("doc_id", F.col("id").alias("edge_id"), "start", "end")
    b = _gold(load).select("doc_id", (F.col("id") - 1).alias("edge_id"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    ignored = load("orders").select(F.col("o_orderkey").alias("doc_id"), (F.pmod("o_custkey", F.lit(40)) + 40).alias("ignored_start"), (F.pmod("o_custkey", F.lit(40)) + 45).alias("ignored_end"))
    return a.join(b, ["doc_id", "edge_id"]), ignored


@query("edge_eligible", f"WITH {_ISLANDS}, {_EDGES} SELECT edge_id FROM e WHERE {_EDGE_OK}")
def edge_eligible(load):
    edges, ignored = _edges(load)
    return iv.edge_eligible(edges, _regions(load), ignored, ["doc_id"]).select("edge_id")


@query("conditional_links", f"""
WITH {_ISLANDS}, {_EDGES}, p AS ({_PRED}), k AS (SELECT e.* FROM e WHERE {_EDGE_OK}),
c AS (SELECT k.*, EXISTS (SELECT 1 FROM p WHERE p.doc_id = k.doc_id AND p."start" = k."start" AND p."end" = k."end") AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = k.doc_id AND p."start" = k.start2 AND p."end" = k.end2) hit FROM k)
SELECT count(*)::BIGINT AS eligible, count(*) FILTER (hit)::BIGINT AS conditional FROM c
""")
def conditional_links(load):
    edges, ignored = _edges(load)
    ok = iv.edge_eligible(edges, _regions(load), ignored, ["doc_id"])
    p = _predicted(load).select("doc_id", "start", "end").distinct()
    j = ok.join(p.withColumn("_a", F.lit(1)), ["doc_id", "start", "end"], "left")
    j = j.join(p.select("doc_id", F.col("start").alias("start2"), F.col("end").alias("end2"), F.lit(1).alias("_b")), ["doc_id", "start2", "end2"], "left")
    return j.agg(F.count("*").alias("eligible"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("conditional"))


_RATIOS = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


@query("match_full_outer", f"""
WITH g AS (SELECT DISTINCT doc_id, "start", "end", 1 a FROM ({_SPANS})), p AS (SELECT DISTINCT doc_id, "start", "end", 1 b FROM ({_PRED}))
SELECT doc_id, "start", "end", (a IS NOT NULL AND b IS NOT NULL)::INTEGER AS tp, (a IS NULL)::INTEGER AS fp, (b IS NULL)::INTEGER AS fn FROM g FULL JOIN p USING (doc_id, "start", "end")
""")
def match_full_outer(load):
    return ev.outcome(_gold(load), _predicted(load), ["doc_id", "start", "end"])


_F = f"""g AS (SELECT DISTINCT doc_id, "start", "end", 1 a FROM ({_SPANS})), p AS (SELECT DISTINCT doc_id, "start", "end", 1 b FROM ({_PRED})),
f AS (SELECT doc_id, (a IS NOT NULL AND b IS NOT NULL)::INTEGER tp, (a IS NULL)::INTEGER fp, (b IS NULL)::INTEGER fn FROM g FULL JOIN p USING (doc_id, "start", "end"))"""


@query("prf_v2", f"WITH {_F}, t AS (SELECT doc_id, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM f GROUP BY doc_id) SELECT doc_id, {_RATIOS} FROM t")
def prf_v2(load):
    return ev.sums(match_full_outer(load), ["doc_id"])


@query("prf_pooled", f"WITH {_F}, t AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn FROM f) SELECT {_RATIOS} FROM t")
def prf_pooled(load):
    return ev.sums(match_full_outer(load))


_CONVENTION = f"WITH {_F}, t AS (SELECT doc_id, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM f GROUP BY doc_id), r AS (SELECT doc_id, tp / nullif(tp + fp, 0) p, tp / nullif(tp + fn, 0) r FROM t)"


@query("prf_legacy", f"{_CONVENTION} SELECT doc_id, 2 * p * r / nullif(p + r, 0) AS f1 FROM r")
def prf_legacy(load):
    return prf_v2(load).select("doc_id", scores.f1_legacy(F.col("precision"), F.col("recall")).alias("f1"))


@query("prf_linkage", f"{_CONVENTION} SELECT doc_id, CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM r")
def prf_linkage(load):
    return prf_v2(load).select("doc_id", scores.f1_linkage(F.col("precision"), F.col("recall")).alias("f1"))


_LABELS = f"""g AS (SELECT DISTINCT doc_id, "start", "end", label, 1 a FROM ({_SPANS})), p AS (SELECT DISTINCT doc_id, "start", "end", label, 1 b FROM ({_PRED})),
t AS (SELECT label, sum((a IS NOT NULL AND b IS NOT NULL)::INTEGER) tp, sum((a IS NULL)::INTEGER) fp, sum((b IS NULL)::INTEGER) fn FROM g FULL JOIN p USING (doc_id, "start", "end", label) GROUP BY label)"""


@query("class_metrics", f"WITH {_LABELS} SELECT label, {_RATIOS} FROM t")
def class_metrics(load):
    return ev.sums(ev.outcome(_gold(load), _predicted(load), ["doc_id", "start", "end", "label"]), ["label"])


@query("class_macro", f"WITH {_LABELS}, k AS (SELECT label, {_RATIOS} FROM t) SELECT CASE WHEN min(tp + fn) > 0 THEN avg(f1) END AS macro_f1, avg(f1) AS observed_macro_f1, count(*)::BIGINT AS n_classes FROM k")
def class_macro(load):
    return ev.class_macro(class_metrics(load))


@query("confusion", f"""
WITH g AS ({_SPANS}), p AS ({_PRED}) SELECT coalesce(g.label, '@spurious') AS gold_label, coalesce(p.label, '@missed') AS predicted_label, count(*)::BIGINT AS n FROM g FULL JOIN p USING (id) GROUP BY ALL
""")
def confusion(load):
    return ev.confusion(_gold(load), _predicted(load), ["id"], "label")


_OCC = "SELECT l_orderkey doc_id, l_orderkey * 10 + l_linenumber occurrence_id, l_returnflag AS name, list_transform(range(l_quantity::BIGINT % 3), lambda i: 'v' || (l_suppkey + i) % 7) versions, l_linestatus intent FROM lineitem"


def _occurrences(load):
    n = F.pmod(F.col("l_quantity").cast("long"), F.lit(3)).cast("int")
    versions = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("v"), F.pmod(F.col("l_suppkey") + i, F.lit(7)))))
    return load("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occurrence_id"), F.col("l_returnflag").alias("name"), versions.alias("versions"), F.col("l_linestatus").alias("intent"))


@query("export_public", f"""
WITH o AS ({_OCC}) SELECT occurrence_id, name, i::INTEGER - 1 AS ordinal, version FROM (SELECT occurrence_id, name, unnest(versions) version, generate_subscripts(versions, 1) i FROM o WHERE len(versions) > 0)
UNION ALL SELECT occurrence_id, name, 0, NULL FROM o WHERE len(versions) = 0
""")
def export_public(load):
    return ev.export_public(_occurrences(load))


@query("agg_occurrences", f"""
WITH o AS ({_OCC}) SELECT intent, count(*)::BIGINT AS n_mentions, sum(greatest(1, len(versions)))::BIGINT AS n_rows, count(*) FILTER (len(versions) = 0)::BIGINT AS n_without FROM o GROUP BY intent
""")
def agg_occurrences(load):
    return _occurrences(load).groupBy("intent").agg(F.count("*").alias("n_mentions"), F.sum(F.greatest(F.lit(1), F.size("versions"))).alias("n_rows"), F.count_if(F.size("versions") == 0).alias("n_without"))


@query("agg_documents", f"""
WITH o AS ({_OCC}), r AS (SELECT doc_id, occurrence_id, unnest(versions) v FROM o UNION ALL SELECT doc_id, occurrence_id, '@null' FROM o WHERE len(versions) = 0)
SELECT doc_id, v AS version, count(DISTINCT occurrence_id)::BIGINT AS n_mentions, count(*)::BIGINT AS n_rows FROM r GROUP BY ALL
""")
def agg_documents(load):
    return ev.aggregate_documents(_occurrences(load))


@query("public_record_problems", f"""
WITH o AS ({_OCC}) SELECT occurrence_id, list_filter([CASE WHEN name = 'N' THEN 'NAME_NOT_ALLOWED' END, CASE WHEN len(versions) > len(list_distinct(versions)) THEN 'DUPLICATE_VERSION' END, CASE WHEN intent NOT IN ('F') THEN 'UNKNOWN_INTENT' END], lambda x: x IS NOT NULL) AS problems FROM o
""")
def public_record_problems(load):
    rules = [("NAME_NOT_ALLOWED", F.col("name") == "N"), ("DUPLICATE_VERSION", F.size("versions") > F.size(F.array_distinct("versions"))), ("UNKNOWN_INTENT", ~F.col("intent").isin("F"))]
    return _occurrences(load).select("occurrence_id", ev.problems(rules).alias("problems"))


@query("unique_occurrences", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority")
def unique_occurrences(load):
    kept = ev.dedupe_predictions(load("orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return kept.select("o_custkey", "o_orderkey")


_ARMS = "SELECT CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END arm, l_orderkey doc_id, l_partkey % 3 s FROM lineitem"


def _arm_spans(load):
    arm = F.when(F.col("l_suppkey") % 3 == 0, F.lit("a")).when(F.col("l_suppkey") % 3 == 1, F.lit("b")).otherwise(F.lit("c"))
    return dealt(load("lineitem"), "l_orderkey").select(arm.alias("arm"), F.col("l_orderkey").alias("doc_id"), F.pmod("l_partkey", F.lit(3)).alias("start"), (F.pmod("l_partkey", F.lit(3)) + 5).alias("end"))


@query("agreement_jaccard", f"""
WITH x AS (SELECT DISTINCT * FROM ({_ARMS})), v AS (SELECT DISTINCT arm, doc_id FROM x), j AS (SELECT a.arm arm_a, b.arm arm_b, doc_id FROM v a JOIN v b USING (doc_id) WHERE a.arm < b.arm),
k AS (SELECT arm_a, arm_b, doc_id, s, 1 l, 0 r FROM j JOIN x USING (doc_id) WHERE x.arm = arm_a UNION ALL SELECT arm_a, arm_b, doc_id, s, 0, 1 FROM j JOIN x USING (doc_id) WHERE x.arm = arm_b),
h AS (SELECT arm_a, arm_b, doc_id, s, max(l) l, max(r) r FROM k GROUP BY ALL)
SELECT arm_a, arm_b, sum(l * r)::BIGINT AS shared, count(*)::BIGINT AS either, sum(l * r) / count(*) AS jaccard FROM h GROUP BY ALL
""")
def agreement_jaccard(load):
    spans = _arm_spans(load)
    return ev.agreement(spans, spans.select("arm", "doc_id").distinct())


@query("arm_operations", f"""
WITH x AS (SELECT DISTINCT arm, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'completed' END st FROM ({_ARMS})), w AS (SELECT o_orderkey doc_id, unnest(['a', 'b', 'c']) arm FROM orders)
SELECT arm, count(*)::BIGINT AS expected, count(*) FILTER (st = 'completed')::BIGINT AS completed, count(*) FILTER (st = 'failed')::BIGINT AS failed, count(*) FILTER (st IS NULL)::BIGINT AS missing FROM w LEFT JOIN x USING (arm, doc_id) GROUP BY arm
""")
def arm_operations(load):
    results = _arm_spans(load).select("arm", "doc_id").distinct().withColumn("status", F.when(F.col("doc_id") % 7 == 0, F.lit("failed")).otherwise(F.lit("completed")))
    arms = load("region").sparkSession.createDataFrame([("a",), ("b",), ("c",)], "arm string")
    return ev.arm_operations(arms, load("orders").select(F.col("o_orderkey").alias("doc_id")), results)


@query("alias_pairs", """
WITH a AS (SELECT DISTINCT least(l_partkey, l_suppkey) x, greatest(l_partkey, l_suppkey) y, 1 g FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey),
b AS (SELECT DISTINCT least(l_partkey, l_suppkey) x, greatest(l_partkey, l_suppkey) y, 1 p FROM lineitem WHERE l_quantity > 20 AND l_partkey <> l_suppkey)
SELECT x AS a, y AS b, (g IS NOT NULL AND p IS NOT NULL)::INTEGER AS tp, (g IS NULL)::INTEGER AS fp, (p IS NULL)::INTEGER AS fn FROM a FULL JOIN b USING (x, y)
""")
def alias_pairs(load):
    pairs = load("lineitem").where("l_partkey <> l_suppkey").select("l_linenumber", "l_quantity", F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    return ev.outcome(pairs.where("l_linenumber = 1"), pairs.where("l_quantity > 20"), ["a", "b"])


@query("latency_summary", "SELECT event_type, count(value)::BIGINT AS n, median(value) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_summary(load):
    return ev.latency(load("events"), ["event_type"], "value")


@query("legacy_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) k, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, value AS p90 FROM r WHERE k = least(n - 1, 90 * n // 100) + 1
""")
def legacy_percentiles(load):
    return ev.index_percentile(load("events"), ["event_type"], "value", 90)


@query("throughput", "SELECT lang, sum(length(text))::BIGINT AS n_chars, min(length(text) / 1000.0) AS best, median(length(text) / 1000.0) AS median FROM documents GROUP BY lang")
def throughput(load):
    k = F.length("text") / 1000.0
    return load("documents").groupBy("lang").agg(F.sum(F.length("text")).alias("n_chars"), F.min(k).alias("best"), F.median(k).alias("median"))


@query("wilson", """
WITH k AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') k, count(*) n FROM orders GROUP BY ALL), p AS (SELECT *, k / n p, 1.96 * 1.96 zz FROM k)
SELECT o_orderpriority, greatest(0.0::DOUBLE, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)) AS low, least(1.0::DOUBLE, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)) AS high FROM p
""")
def wilson(load):
    k = load("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return k.select("o_orderpriority", low.alias("low"), high.alias("high"))


@query("audit_summary", """
SELECT coalesce(l_returnflag, '@all') AS stratum, coalesce(l_linestatus, '@all') AS flag, count(*)::BIGINT AS n, avg((l_discount > 0.05)::INTEGER) AS wrong_rate, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS weighted_rate
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))
""")
def audit_summary(load):
    rows = load("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_discount") > 0.05).alias("wrong"))
    g = rows.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg(F.col("wrong").cast("int")).alias("wrong_rate"), (F.sum(F.when(F.col("wrong"), F.col("l_quantity")).otherwise(F.lit(0.0))) / F.sum("l_quantity")).alias("weighted_rate"))
    return g.select(F.coalesce("l_returnflag", F.lit("@all")).alias("stratum"), F.coalesce("l_linestatus", F.lit("@all")).alias("flag"), "n", "wrong_rate", "weighted_rate")


@query("support_grouping_sets", """
SELECT coalesce(lang, '@all') AS lang, coalesce(source, '@all') AS source, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS n_works, greatest(0, 100 - count(*))::BIGINT AS shortfall FROM documents GROUP BY GROUPING SETS ((), (lang), (source))
""")
def support_grouping_sets(load):
    d = load("documents").select("lang", "source", "text")
    g = d.groupingSets([[], [F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_works"))
    return g.select(F.coalesce("lang", F.lit("@all")).alias("lang"), F.coalesce("source", F.lit("@all")).alias("source"), "n", "n_works", F.greatest(F.lit(0), 100 - F.col("n")).cast("long").alias("shortfall"))


@query("revision_chain", """
WITH l AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) b FROM conversations) SELECT conv_id, count(*)::BIGINT AS n_revisions, bool_and(coalesce(turn = b + 1, true)) AS unbroken FROM l GROUP BY conv_id
""")
def revision_chain(load):
    return ev.revision_chain(load("conversations"), "conv_id", "turn")


@query("latest_revision", "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_revision(load):
    return ev.latest(load("conversations"), "conv_id", "turn", "text")


_TOK = "SELECT user_id doc_id, event_id k, CASE event_id % 5 WHEN 0 THEN 'B-SW' WHEN 1 THEN 'I-SW' WHEN 2 THEN 'I-VER' ELSE 'O' END lab, (1 + event_id % 9) / 10 p FROM events"


@query("bio_runs", f"""
WITH t AS (SELECT *, lab[1:1] kd, lab[3:] nm FROM ({_TOK})), o AS (SELECT *, CASE WHEN kd = 'B' OR (kd = 'I' AND NOT coalesce(lag(kd) OVER w <> 'O' AND lag(nm) OVER w = nm, false)) THEN 1 ELSE 0 END nw FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) run FROM o)
SELECT doc_id, first(nm ORDER BY k) AS label, min(k) AS first, max(k) AS last, exp(avg(ln(greatest(p, 1e-30)))) AS score FROM r WHERE kd <> 'O' GROUP BY doc_id, run
""")
def bio_runs(load):
    k = F.col("event_id") % 5
    label = F.when(k == 0, F.lit("B-SW")).when(k == 1, F.lit("I-SW")).when(k == 2, F.lit("I-VER")).otherwise(F.lit("O"))
    return ev.bio_spans(load("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("k"), label.alias("label"), ((1 + F.col("event_id") % 9) / 10).alias("p")))
