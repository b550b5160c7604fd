"""Queries of the review log. An order is a task whose text is its number eight times over; its lines, one of each number, are decisions: each adds the
mention of its own place, takes away that of the line before, or accepts the passage, and every fifth is made on a stale revision."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.operators import review_log as rl
from mentionforge.operators.contracts import FIELDS
from mentionforge.plans.catalog import query
from mentionforge.session import dealt

_LOG = """
WITH l AS (SELECT l_orderkey o, l_linenumber n, min(l_suppkey) % 5 = 0 stale, min(l_partkey) % 4 kind FROM lineitem WHERE l_linenumber <= 8 GROUP BY ALL),
g AS (SELECT *, lag(NOT stale AND kind > 1) OVER w prev, lag(n) OVER w pn FROM l WINDOW w AS (PARTITION BY o ORDER BY n)),
k AS (SELECT *, CASE WHEN stale THEN 'STALE_REVISION' WHEN kind = 0 AND NOT coalesce(prev AND pn = n - 1, FALSE) THEN 'UNKNOWN_OCCURRENCE' ELSE 'applied' END outcome FROM g),
r AS (SELECT *, 1 + sum((outcome = 'applied')::INTEGER) OVER (PARTITION BY o ORDER BY n) rev FROM k)
"""


def _json(**fields):
    return F.to_json(F.struct(*[F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()]))


def _span(start, end):
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def _folded(load):
    key = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    whole = _span(F.lit(0), F.lit(103))
    text = F.array_join(F.array_repeat(key("o_orderkey"), 8), " ")
    task = _json(document_id=key("o_orderkey"), text_revision=F.lit("r"), text=text, offset_base=F.lit(0), annotation_region=whole, context_span=whole, requested_fields=F.array(*map(F.lit, FIELDS)))
    fields = F.struct(*[F.lit(True).alias(f) for f in FIELDS])
    annotation = _json(occurrences=F.array(), covered_regions=F.array(F.struct(F.lit(0).alias("start"), F.lit(103).alias("end"), fields.alias("fields"))))
    items = load("orders").select(F.col("o_orderkey").cast("string").alias("task_id"), task.alias("task"), annotation.alias("annotation"), F.lit(1).cast("long").alias("revision"), F.lit("unreviewed").alias("status"))
    lines = dealt(load("lineitem").where("l_linenumber <= 8").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("n"))  # a text has eight places
    d = lines.agg((F.min("l_suppkey") % 5 == 0).alias("stale"), (F.min("l_partkey") % 4).alias("kind"))
    by = W.partitionBy("l_orderkey").orderBy("n")
    held = F.coalesce(F.lag((~F.col("stale")) & (F.col("kind") > 1)).over(by) & (F.lag("n").over(by) == F.col("n") - 1), F.lit(False))
    d = d.withColumn("ok", ~F.col("stale") & ((F.col("kind") != 0) | held))
    before = F.sum(F.col("ok").cast("long")).over(by) - F.col("ok").cast("long")
    at = (F.col("n") - 1) * 13
    place = lambda a: _span(a, a + 12)
    known = F.struct(*[F.lit(f in ("software", "versions")).alias(f) for f in FIELDS])
    value = F.struct(key("l_orderkey").alias("name"), place(at).alias("name_span"), F.array().alias("version_links"), F.lit("absent").alias("version_status"), F.lit(None).cast("string").alias("intents"), F.lit(None).cast("string").alias("sentiment"), known.alias("known"), F.struct(F.array().alias("intents"), F.array().alias("sentiment")).alias("evidence"))
    action = F.when(F.col("kind") == 0, "remove_occurrence").when(F.col("kind") == 1, "accept_passage").otherwise("upsert_occurrence")
    ident = F.concat_ws("-", "l_orderkey", "n")
    shown = F.to_json(F.struct(ident.alias("decision_id"), F.col("l_orderkey").cast("string").alias("task_id"), F.lit("r").alias("text_revision"), key("l_orderkey").alias("document_id"), F.lit("x").alias("reviewer"), F.lit("y").alias("reason"),
        F.when(F.col("stale"), F.lit(0).cast("long")).otherwise(before + 1).alias("base_annotation_revision"), action.alias("action"), F.when(F.col("kind") == 0, place(at - 13)).alias("target_name_span"), F.when(F.col("kind") > 1, value).alias("value")), {"ignoreNullFields": "false"})
    return rl.fold_log(items, d.select(ident.alias("decision_id"), F.col("l_orderkey").cast("string").alias("task_id"), F.col("n").cast("long").alias("seq"), shown.alias("payload")))


@query("review_ledger", _LOG + "SELECT o::VARCHAR AS task_id, n::BIGINT AS seq, outcome, rev::BIGINT AS revision FROM r")
def review_ledger(load):
    return _folded(load)[1].select("task_id", "seq", "outcome", "revision")


@query("review_items", _LOG + """, p AS (SELECT *, lead(outcome = 'applied' AND kind = 0) OVER (PARTITION BY o ORDER BY n) gone, lead(n) OVER (PARTITION BY o ORDER BY n) nn FROM r)
SELECT o_orderkey::VARCHAR AS task_id, coalesce(max(rev), 1)::BIGINT AS revision, CASE arg_max(kind, n) FILTER (outcome = 'applied') WHEN 1 THEN 'reviewed' WHEN NULL THEN NULL ELSE CASE WHEN bool_or(outcome = 'applied') THEN 'in_progress' ELSE 'unreviewed' END END AS status,
  count(*) FILTER (outcome = 'applied' AND kind > 1 AND NOT coalesce(gone AND nn = n + 1, FALSE)) AS n_occurrences FROM orders LEFT JOIN p ON o = o_orderkey GROUP BY o_orderkey
""")
def review_items(load):
    held = F.from_json("annotation", "occurrences array<struct<name:string>>")["occurrences"]
    return _folded(load)[0].select("task_id", "revision", "status", F.size(held).cast("long").alias("n_occurrences"))
