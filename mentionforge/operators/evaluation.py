"""Scoring of predicted spans, fields and links against references, with coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import scores
from mentionforge.operators.ranks import ranked


MOST_ARMS = 1000


def outcome(gold: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of either side with tp, fp and fn flags: one full outer join."""
    g = gold.select(*on).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*on).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, list(on), "full_outer")
    hit = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    return both.select(*on, hit.cast("int").alias("tp"), (F.col("_g").isNull()).cast("int").alias("fp"), (F.col("_p").isNull()).cast("int").alias("fn"))


def sums(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn and their ratios for each group: partial sums, then one row a group."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    out = flags.groupBy(*by).agg(*total)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": scores.precision(tp, fp), "recall": scores.recall(tp, fn), "f1": scores.f1_counts(tp, fp, fn)})


def class_macro(per_class: DataFrame) -> DataFrame:
    """Macro F1, null if a class has no support; observed macro F1 over classes that have an F1."""
    none = F.min((F.col("tp") + F.col("fn") > 0).cast("int")) == 0
    return per_class.agg(F.when(~none, F.avg("f1")).alias("macro_f1"), F.avg("f1").alias("observed_macro_f1"), F.count("*").alias("n_classes"))


def confusion(gold: DataFrame, predicted: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """Counts by gold and predicted label; @spurious for keys without gold, @missed for keys without a prediction."""
    g = gold.select(*on, F.col(label).alias("gold_label"))
    p = predicted.select(*on, F.col(label).alias("predicted_label"))
    j = g.join(p, list(on), "full_outer")
    return j.groupBy(F.coalesce("gold_label", F.lit("@spurious")).alias("gold_label"), F.coalesce("predicted_label", F.lit("@missed")).alias("predicted_label")).agg(F.count("*").alias("n"))


def export_public(occurrences: DataFrame) -> DataFrame:
    """One row for each version of an occurrence (occurrence_id, name, versions), one with null where there is none."""
    rows = occurrences.select("occurrence_id", "name", F.posexplode_outer(F.when(F.size("versions") > 0, F.col("versions"))).alias("ordinal", "version"))
    return rows.withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))


def problems(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, as an array: a contract check is this column and a filter on its size."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def aggregate_documents(occurrences: DataFrame) -> DataFrame:
    """By document and version: distinct mentions and rows; documents without version count under @null."""
    rows = occurrences.select("doc_id", "occurrence_id", F.explode_outer("versions").alias("version"))
    return rows.groupBy("doc_id", F.coalesce("version", F.lit("@null")).alias("version")).agg(F.count_distinct("occurrence_id").alias("n_mentions"), F.count("*").alias("n_rows"))


def dedupe_predictions(predicted: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row in the given order of each set of fields."""
    w = W.partitionBy(*on).orderBy(*order)
    return predicted.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def arm_operations(arms: DataFrame, documents: DataFrame, results: DataFrame) -> DataFrame:
    """Counts by arm of documents completed, failed and missing; every arm is expected to have every document. arms is a
    short list (MOST_ARMS at most, else an error), so the expected side is documents times that list and no product of tables."""
    names = [r[0] for r in arms.select("arm").distinct().orderBy("arm").limit(MOST_ARMS + 1).collect()]
    if len(names) > MOST_ARMS:
        raise ValueError(f"more than {MOST_ARMS} arms")
    wanted = documents.select("doc_id").withColumn("arm", F.explode(F.array(*map(F.lit, names))))
    j = wanted.join(results.select("arm", "doc_id", "status"), ["arm", "doc_id"], "left")
    count = lambda c: F.count_if(c)
    return j.groupBy("arm").agg(F.count("*").alias("expected"), count(F.col("status") == "completed").alias("completed"), count(F.col("status") == "failed").alias("failed"), count(F.col("status").isNull()).alias("missing"))


def agreement(spans: DataFrame, valid: DataFrame) -> DataFrame:
    """For each pair of arms: Jaccard of their spans over documents valid for both. spans: (arm, doc_id, start, end)."""
    a = valid.select(F.col("arm").alias("arm_a"), "doc_id")
    b = valid.select(F.col("arm").alias("arm_b"), "doc_id")
    joint = a.join(b, "doc_id").where("arm_a < arm_b")
    left = joint.join(spans.withColumnRenamed("arm", "arm_a"), ["arm_a", "doc_id"]).select("arm_a", "arm_b", "doc_id", "start", "end", F.lit(1).alias("x"), F.lit(0).alias("y"))
    right = joint.join(spans.withColumnRenamed("arm", "arm_b"), ["arm_b", "doc_id"]).select("arm_a", "arm_b", "doc_id", "start", "end", F.lit(0).alias("x"), F.lit(1).alias("y"))
    keys = ["arm_a", "arm_b", "doc_id", "start", "end"]
    held = left.unionByName(right).groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = F.sum(F.col("x") * F.col("y"))
    return held.groupBy("arm_a", "arm_b").agg(both.alias("shared"), F.count("*").alias("either"), (both / F.count("*")).alias("jaccard"))


def latency(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, median and nearest-rank 95th percentile of the values that are there; a key without any has a count of zero and nulls."""
    r = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    middle = F.col("_r").isin(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    found = r.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(middle, F.col(value))).alias("median"), F.max(F.when(F.col("_r") == F.floor((95 * F.col("_n") + 99) / 100), F.col(value))).alias("p95"))
    none = rows.groupBy(*by).agg(F.count(value).alias("n")).where("n = 0").select(*by, "n", F.lit(None).cast("double").alias("median"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("p95"))
    return found.unionByName(none)


def index_percentile(rows: DataFrame, by: Sequence[str], value: str, percent: int) -> DataFrame:
    """The value at index min(n - 1, percent * n / 100) of the sorted values, nulls first."""
    r = ranked(rows.select(*by, value), by, [value])
    return r.where(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.lit(percent) * F.col("_n") / 100)) + 1).select(*by, F.col(value).alias(f"p{percent}"))


def revision_chain(decisions: DataFrame, key: str, revision: str) -> DataFrame:
    """Keys with the number of revisions and whether each follows the one before by one."""
    w = W.partitionBy(key).orderBy(revision)
    steps = decisions.withColumn("_b", F.lag(revision).over(w))
    return steps.groupBy(key).agg(F.count("*").alias("n_revisions"), F.min(F.coalesce(F.col(revision) == F.col("_b") + 1, F.lit(True))).alias("unbroken"))


def latest(decisions: DataFrame, key: str, revision: str, value: str) -> DataFrame:
    return decisions.groupBy(key).agg(F.max(revision).alias(revision), F.max_by(value, revision).alias(value))


def bio_spans(tokens: DataFrame) -> DataFrame:
    """Spans (doc_id, label, first, last, score) of B-/I- labels: I- continues a run of its own label, else it opens one."""
    w = W.partitionBy("doc_id").orderBy("k")
    kind, name = F.substring("label", 1, 1), F.expr("substring(label, 3)")
    t = tokens.withColumns({"_kind": kind, "_name": name})
    before = F.lag("_name").over(w)
    opens = (F.col("_kind") == "B") | ((F.col("_kind") == "I") & ~F.coalesce((F.lag("_kind").over(w) != "O") & (before == F.col("_name")), F.lit(False)))
    t = t.withColumn("_new", opens.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_kind <> 'O'")
    return t.groupBy("doc_id", "_run").agg(F.first("_name").alias("label"), F.min("k").alias("first"), F.max("k").alias("last"), scores.geometric_mean(F.col("p")).alias("score")).drop("_run")
