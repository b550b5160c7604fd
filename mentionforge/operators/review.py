"""Review, annotation and collection operators: relation checks, candidates, windows, statuses, queues, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators.graph import connected


def check_relations(relations: DataFrame, spans: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """relations (relation_id, source, target) with the reason they are left out, or null: an end that is no span, or one of
    another type than asked for. spans: (id, type)."""
    s = spans.select(F.col("id").alias("source"), F.col("type").alias("_s"))
    d = spans.select(F.col("id").alias("target"), F.col("type").alias("_t"))
    j = relations.join(s, "source", "left").join(d, "target", "left")
    reason = F.when(F.col("_s").isNull() | F.col("_t").isNull(), F.lit("DANGLING")).when((F.col("_s") != source_type) | (F.col("_t") != target_type), F.lit("WRONG_TYPE"))
    return j.select("relation_id", reason.alias("reason"))


def containing(spans: DataFrame, blocks: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(id, name) of the first block of a key that holds a span whole; blocks: (keys, name, b_start, b_end)."""
    j = spans.join(blocks, list(keys)).where((F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end")))
    return j.groupBy("id").agg(F.min_by(name, "b_start").alias(name))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], distance: int = 1) -> DataFrame:
    """Pairs (id, id2) of rows of a key whose sentence numbers differ by `distance` at most. right rows are spread over the
    numbers they may meet, so the join is on equal keys and numbers."""
    spread = right.withColumn("sentence", F.explode(F.sequence(F.col("sentence") - distance, F.col("sentence") + distance)))
    return left.join(spread.select(*keys, "sentence", F.col("id").alias("id2")), [*keys, "sentence"]).select("id", "id2")


def reduce_windows(results: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, windows) from window results (doc_id, window, status, label, start, end): a span that
    several windows report is one, and a document with a failed window has none."""
    bad = results.groupBy("doc_id").agg(F.bool_or(F.col("status") != "completed").alias("_bad"))
    spans = results.groupBy("doc_id", "label", "start", "end").agg(F.array_sort(F.collect_set("window")).alias("windows"))
    return spans.join(bad.where("not _bad"), "doc_id").drop("_bad")


def widest_margin(results: DataFrame) -> DataFrame:
    """Of the reports of a span by several windows, the one farthest from its window's edge; ties to the lower window."""
    margin = F.least(F.col("start") - F.col("w_start"), F.col("w_end") - F.col("end"))
    return results.groupBy("doc_id", "start", "end").agg(F.max_by("window", F.struct(margin, -F.col("window"))).alias("window"))


def boundary_misses(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions without an equal gold span that overlap a gold span without an equal prediction. (doc_id, start, end)"""
    on = ["doc_id", "start", "end"]
    fp = predicted.select(*on).distinct().join(gold.select(*on), on, "left_anti")
    fn = gold.select(*on).distinct().join(predicted.select(*on), on, "left_anti").select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = fp.join(fn, "doc_id").where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    return hit.select(*on).distinct()


def label_scores(gold: DataFrame, predicted: DataFrame, status: DataFrame) -> DataFrame:
    """tp, fp, fn over all documents, failed ones keeping their gold, and fn over completed ones alone. status: (doc_id, status)"""
    on = ["doc_id", "start", "end"]
    done = status.where("status = 'completed'").select("doc_id").withColumn("_d", F.lit(True))
    g, p = gold.select(*on).distinct().withColumn("_g", F.lit(1)), predicted.select(*on).distinct().withColumn("_p", F.lit(1)).join(done.select("doc_id"), "doc_id", "left_semi")
    j = g.join(p, on, "full_outer").join(done, "doc_id", "left")
    miss = F.col("_p").isNull()
    return j.agg(F.count_if(F.col("_g").isNotNull() & ~miss).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(miss).alias("fn"), F.count_if(miss & F.col("_d").isNotNull()).alias("fn_completed"))


def alias_groups(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """(id, root, contradicted) of components over alias pairs (a, b): contradicted if a negative pair lies within one."""
    groups = connected(pairs)
    of = lambda end, root: groups.select(F.col("id").alias(end), F.col("root").alias(root)).hint("merge")  # noqa: E731  its files look smaller than it is
    n = negatives.join(of("a", "_x"), "a").join(of("b", "_y"), "b")
    bad = n.where("_x = _y").select(F.col("_x").alias("root")).distinct().withColumn("contradicted", F.lit(True))
    return groups.join(bad.hint("merge"), "root", "left").select("id", "root", F.coalesce("contradicted", F.lit(False)).alias("contradicted"))


def role_conflicts(rows: DataFrame, key: str, role: str) -> DataFrame:
    """Keys that hold more than one role, with the sorted roles."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)


def dedupe_texts(rows: DataFrame, order: str) -> DataFrame:
    """One row for each text digest: the first row's id, and the sorted ids of all that share it."""
    g = rows.select(order, t.text_digest(F.col("text")).alias("digest"))
    return g.groupBy("digest").agg(F.min(order).alias("first"), F.array_sort(F.collect_set(order)).alias("members"))


def most_common(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    return c.groupBy(*by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_o"))).alias(value))


def neighbours_in_order(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows with the value before and after theirs in a group, null at its ends."""
    w = W.partitionBy(*by).orderBy(order)
    return rows.select(*by, order, F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"))


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order while what was spent before them is below the budget."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("_spent") < budget).drop("_spent")


def shortages(rows: DataFrame, by: str, eligible: Column, required: int) -> DataFrame:
    """Counts by group, how many are eligible, and how many more are required."""
    e = F.count_if(eligible)
    return rows.groupBy(by).agg(F.count("*").alias("n"), e.alias("eligible"), F.greatest(F.lit(0), required - e).cast("long").alias("shortage"))


def document_status(fields: DataFrame) -> DataFrame:
    """failed if every field of a document failed, partial if some did, else completed. fields: (doc_id, status)"""
    bad = F.count_if(F.col("status") == "failed")
    return fields.groupBy("doc_id").agg(F.when(bad == F.count("*"), F.lit("failed")).when(bad > 0, F.lit("partial")).otherwise(F.lit("completed")).alias("status"))


def head_and_sample(rows: DataFrame, weight: str, key: str, head: int, sample: int, rank: Column) -> DataFrame:
    """The `head` heaviest rows and `sample` of the others by rank, marked as head or tail."""
    first = rows.orderBy(F.desc(weight), key).limit(head).withColumn("part", F.lit("head"))
    rest = rows.join(first.select(key), key, "left_anti").orderBy(rank).limit(sample).withColumn("part", F.lit("tail"))
    return first.unionByName(rest)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def code_point_offset(text: Column, units: Column) -> Column:
    """The code point at a UTF-16 offset; null inside a surrogate pair or beyond the text."""
    sizes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.octet_length(c) == 4, F.lit(2)).otherwise(F.lit(1)))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), (acc["k"] + 1).alias("k"), F.when(acc["at"] == units, acc["k"]).otherwise(acc["hit"]).alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("hit"))
    return F.aggregate(sizes, begin, step, lambda acc: F.when(acc["at"] == units, acc["k"]).otherwise(acc["hit"]))


def clean_snippet(raw: Column) -> Column:
    """Emphasis marks off, the five named entities decoded once, white space collapsed."""
    x = F.regexp_replace(raw, "</?em>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return t.collapse(x)


def snap(text: str, raw: str, start: str) -> Column:
    """Where raw begins in text: at start, else its first hit within its length of start, else null. Names of columns."""
    low = f"greatest(0, {start} - length({raw}))"
    found = f"locate({raw}, {text}, {low} + 1) - 1"
    return F.expr(f"CASE WHEN substring({text}, {start} + 1, length({raw})) = {raw} THEN {start} WHEN {found} >= 0 AND {found} <= {start} + length({raw}) THEN {found} END")
