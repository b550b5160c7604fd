"""Mentions to entities: candidates, the name-matching baseline, the context-aware resolver, and how both are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.functions import scores
from mentionforge.functions import text as t
from mentionforge.operators.graph import materialize
from mentionforge.operators.registry import claims_of
from mentionforge.session import map_in_arrow

MOST_CANDIDATES = 12
#: Weights of the resolver's features, by kind of match and by name.
MATCH_WEIGHTS = {"name": 2.0, "alias": 1.8, "package": 1.6, "loose": 1.4, "czi": 1.0, "token": 0.5, "url": 0.0}
SIMILARITY, URL, WIKIDATA, SOURCE, SITELINK, SITELINK_MOST, CUE, WRAPPED, EMPTY, THRESHOLD = 4.0, 3.0, 0.3, 0.2, 0.35, 1.5, 0.6, -0.8, -1.0, 2.2
#: Words of a context that point to an ecosystem, and of a description that is about another tool.
CUES = {
    "cran": r"(?i)\bR package|\bCRAN\b|\bin R\b|\bR \(|\bR software|\bRStudio\b|Bioconductor",
    "bioconductor": r"(?i)Bioconductor",
    "pypi": r"(?i)\bPython\b|\bpip\b|\bPyPI\b|\bconda\b",
}
WRAPPER = r"(?i)\b(wrapper|bindings?|interface (?:to|for)|port of|client for|emulat\w*)\b"
PLACEHOLDER = r"(?i)\b(reserved|placeholder|security holding package|dummy package)\b"


def first_claims(forms: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(key_type, form, entity_id) of the first `most` entities, by id, of each form; forms: form_claims, or surface_forms. An entity
    behind them in a form has `most` before it for every name that finds the form, so no list of candidates takes it."""
    by = W.partitionBy("key_type", "form").orderBy("entity_id")
    return claims_of(forms).select("key_type", "form", "entity_id").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).drop("_r")


def _flat(claims: DataFrame, kind: str, name: str) -> DataFrame:
    return claims.where(F.col("key_type") == kind).select(F.col("form").alias(name), "entity_id")


def exact_candidates(names: DataFrame, forms: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(name, entity_id) of the exact matches that `candidates` keeps: the first `most` ids of the name's exact form."""
    q = names.select("name").distinct().select("name", t.exact_form(F.col("name")).alias("e"))
    return q.join(_flat(first_claims(forms.where("key_type = 'exact'"), most), "exact", "e"), "e").select("name", "entity_id")


def _matches(names: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """(name, entity_id, m, form) of the matches of the first `most` entities of each form, m being 0 (exact), 1 (loose) or 2 (token).

    A form that holds all tokens of a name holds its rarest one: names are joined with forms on that alone, and the others are
    looked up on the row. A token that every form holds is joined on only for names that have no other."""
    claims = first_claims(forms, most)
    q = names.select("name").distinct().select("name", t.exact_form(F.col("name")).alias("e"), t.loose_form(F.col("name")).alias("l"), F.array_distinct(t.index_tokens(F.col("name"))).alias("tk"))
    exact = _flat(claims, "exact", "e")
    by_exact = q.join(exact, "e").select("name", "entity_id", F.lit(0).alias("m"), F.col("name").alias("form"))
    by_loose = q.join(_flat(claims, "loose", "l"), "l").select("name", "entity_id", F.lit(1).alias("m"), F.col("name").alias("form"))
    long = q.where(F.exists("tk", lambda x: F.length(x) >= 3)).select("name", "e", "tk", F.explode("tk").alias("token"))
    held = exact.select(F.col("e").alias("f")).distinct().select("f", F.array_distinct(t.index_tokens(F.col("f"))).alias("ftk")).withColumn("token", F.explode("ftk"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    rarest = long.join(df, "token", "left").groupBy("name", "e", "tk").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "token"))["token"].alias("token"))
    whole = rarest.join(held, "token").where((F.col("f") != F.col("e")) & (F.size(F.array_except("tk", "ftk")) == 0))
    by_token = whole.select("name", F.col("f").alias("e")).join(exact, "e").select("name", "entity_id", F.lit(2).alias("m"), F.col("e").alias("form"))
    return by_exact.unionByName(by_loose).unionByName(by_token)


def _kind(m: Column) -> Column:
    return F.element_at(F.array(F.lit("exact"), F.lit("loose"), F.lit("token")), m + 1)


def _best_matches(names: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """(name, entity_id, b), b being the best match's (m, form): the first `most` entities of each name by m and id."""
    best = _matches(names, forms, most).groupBy("name", "entity_id").agg(F.min(F.struct("m", "form")).alias("b"))
    return best.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("b.m", "entity_id"))).where(F.col("_r") <= most).drop("_r")


def candidates(names: DataFrame, forms: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(name, entity_id, match) of up to `most` entities for each name: exact form, else loose form, else a form that holds
    all its tokens; the best match of an entity counts, matches are taken in that order and then by id."""
    return _best_matches(names, forms, most).select("name", "entity_id", _kind(F.col("b.m")).alias("match"))


def task_candidates(tasks: DataFrame, forms: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(task, entity_id, match, matched_form) from tasks (task, surface_forms): as candidates, over all forms of a task in their
    order. Exact matches of any form come before loose ones, and those before token ones; the form that matched is the first
    that finds the entity that way, for tokens the catalogue's. Tasks without forms have no rows; repeated tasks count once.

    What comes before an entity in one form's list comes before it in the task's, so a task meets the first `most` of each form."""
    each = tasks.select("task", F.posexplode("surface_forms").alias("k", "name")).where("name is not null")
    lists = _best_matches(each.select("name"), forms, most).groupBy("name").agg(F.collect_list(F.struct("entity_id", "b")).alias("found"))
    hits = each.join(lists, "name").select("task", "k", "found").repartition("task").select("task", "k", F.inline("found"))
    best = hits.groupBy("task", "entity_id").agg(F.min(F.struct(F.col("b.m").alias("m"), "k", F.col("b.form").alias("form"))).alias("b"))
    ranked = best.withColumn("_r", F.row_number().over(W.partitionBy("task").orderBy("b.m", "entity_id"))).where(F.col("_r") <= most)
    return ranked.select("task", "entity_id", _kind(F.col("b.m")).alias("match"), F.col("b.form").alias("matched_form"))


#: Tasks and entities of one key that meet as one group of rows, and pairs that a task of Spark makes, about.
GROUP_TASKS, GROUP_ENTITIES, TASK_PAIRS = 2048, 4096, 64_000_000


def keyed_entities(tasks: DataFrame, entities: DataFrame) -> DataFrame:
    """(task, entity_id) of tasks (task, keys) and entities (entity_id, keys) that share a key, each pair once; rows of one id are taken
    together, null keys meet nothing.

    A pair is made at the smallest of the keys that it shares, so none is made twice, and the pairs, of which a key makes as many
    as its tasks times its entities, are never shuffled or sorted. A key's tasks are dealt into chunks, its entities into blocks, and a
    copy of each row goes to every group of a chunk and a block that it is part of: no group is large, however much a key holds; the
    groups are dealt out over tasks whose number follows the pairs, and neither side is broadcast."""

    def each(df, name):
        # outer, or Spark first asks whether the array holds anything, and makes the keys twice for it
        return df.where(F.col(name).isNotNull()).select(name, F.explode_outer("keys").alias("key")).where("key is not null")

    held = materialize(each(entities, "entity_id").distinct(), "keys")
    known = each(tasks, "task").join(held.select("key").hint("merge"), "key", "left_semi").groupBy("task").agg(F.collect_set("key").alias("tk"))
    known = materialize(known.select("task", F.explode("tk").alias("key"), F.when(F.size("tk") > 1, F.col("tk")).alias("tk")), "keys")
    n_tasks = known.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("tk").isNotNull()).alias("several"))
    met = n_tasks.join(held.groupBy("key").agg(F.count("*").alias("m")).hint("merge"), "key")
    parts = [F.ceil(F.col(c) / most).cast("int").alias(p) for c, most, p in (("n", GROUP_TASKS, "chunks"), ("m", GROUP_ENTITIES, "blocks"))]
    sizes = materialize(met.select("key", "several", (F.col("n") * F.col("m")).alias("pairs"), *parts), "sizes")

    def place(name, parts):
        return F.pmod(F.xxhash64(name), F.col(parts)).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    spark, group = tasks.sparkSession, ("key", "chunk", "block")
    pairs = sizes.agg(F.sum("pairs")).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    left = known.join(sizes.hint("merge"), "key").select("task", "key", "tk", place("task", "chunks").alias("chunk"), every("blocks").alias("block"))
    shared = held.join(sizes.hint("merge"), "key")
    few = shared.where("several").groupBy("entity_id").agg(F.collect_list("key").alias("ek"))
    right = shared.join(few.hint("merge"), "entity_id", "left").select("entity_id", "key", F.when(F.col("several"), F.col("ek")).alias("ek"), place("entity_id", "blocks").alias("block"), every("chunks").alias("chunk"))
    left, right = (df.repartition(n, *group) for df in (left, right))  # few bytes, much work: not to be coalesced
    first = F.col("tk").isNull() | (F.array_min(F.array_intersect("tk", "ek")) == F.col("key"))
    return left.join(right.hint("merge"), [*group]).where(first).select("task", "entity_id")


def fast_match(found: DataFrame, popularity: DataFrame) -> DataFrame:
    """(name, entity_id, popularity, n_candidates): among exact candidates the most mentioned entity, then the one of most
    sources, then the largest id. found: (name, entity_id) of exact_candidates; popularity: (entity_id, mentions, n_sources)."""
    exact = found.join(popularity, "entity_id")
    return exact.groupBy("name").agg(F.max_by("entity_id", F.struct("mentions", "n_sources", "entity_id")).alias("entity_id"), F.max("mentions").alias("popularity"), F.count("*").alias("n_candidates"))


def inverse_frequency(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, idf) with ln((1 + N) / (1 + df)) + 1 over the texts' token sets."""
    total = texts.count()
    df = texts.select(id_col, F.explode(F.array_distinct(t.context_tokens(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.select("token", (F.log(F.lit(1 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(rows: DataFrame, keys: list[str], text_col: str, drop_col: str, idf: DataFrame, unknown: Column) -> DataFrame:
    """(keys, token, weight): tf-idf weights of norm 1, without the tokens of drop_col."""
    tokens = F.filter(t.context_tokens(F.col(text_col)), lambda x: ~F.array_contains(t.context_tokens(F.col(drop_col)), x))
    counts = rows.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("c"))
    weighted = counts.join(idf, "token", "left").withColumn("w", F.col("c") * F.coalesce("idf", unknown))
    norm = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return weighted.join(norm, keys).select(*keys, "token", (F.col("w") / F.col("_norm")).alias("weight"))


def similarity(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Cosines of vectors of norm 1 that share a key and a token."""
    return left.withColumnRenamed("weight", "_a").join(right.withColumnRenamed("weight", "_b"), [*keys, "token"]).groupBy(*keys, left_id, right_id).agg(F.sum(F.col("_a") * F.col("_b")).alias("similarity"))


def cue_set(context: Column) -> Column:
    return F.array_compact(F.array(*[F.when(context.rlike(p), F.lit(e)) for e, p in CUES.items()]))


def context_score() -> Column:
    """Score of a row (match, similarity, by_url, wikidata, n_sources, sitelinks, cues, ecosystems, description), rounded to
    four places as it is sorted and compared."""
    weight = None
    for kind, w in MATCH_WEIGHTS.items():
        weight = F.when(F.col("match") == kind, F.lit(w)) if weight is None else weight.when(F.col("match") == kind, F.lit(w))
    text = F.coalesce(F.col("description"), F.lit(""))
    hint = F.when((F.size("cues") > 0) & (F.size("ecosystems") > 0), F.when(F.arrays_overlap("cues", "ecosystems"), F.lit(CUE)).otherwise(F.lit(-CUE))).otherwise(F.lit(0.0))
    total = weight + SIMILARITY * F.coalesce("similarity", F.lit(0.0)) + F.when(F.col("by_url"), F.lit(URL)).otherwise(F.lit(0.0))
    total = total + F.when(F.col("wikidata"), F.lit(WIKIDATA)).otherwise(F.lit(0.0)) + SOURCE * (F.col("n_sources") - 1)
    total = total + F.least(F.lit(SITELINK_MOST), SITELINK * F.log1p("sitelinks")) + hint
    total = total + F.when(text.rlike(WRAPPER), F.lit(WRAPPED)).otherwise(F.lit(0.0)) + F.when((text == "") | text.rlike(PLACEHOLDER), F.lit(EMPTY)).otherwise(F.lit(0.0))
    return F.round(total, 4)


def best_candidate(scored: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Per key the candidate of highest score, ties to the smaller id, or none under the threshold, and the highest score."""
    one = scored.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "entity_id"))).where("_r = 1")
    return one.select(*keys, F.when(F.col("score") >= threshold, F.col("entity_id")).alias("entity_id"), "score")


def link_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of counts and ratios from gold (task, entity_ids) and predicted (task, entity_id); a gold task without a
    prediction row is an error."""
    j = gold.join(predicted.withColumn("_p", F.lit(True)), "task", "left")
    j = j.withColumn("_p", F.coalesce("_p", F.raise_error(F.lit("MISSING_PREDICTIONS")).cast("boolean")))
    linked, guess = F.size("entity_ids") > 0, F.col("entity_id").isNotNull() & F.col("_p")
    right = F.coalesce(F.array_contains("entity_ids", F.col("entity_id")), F.lit(False))
    c = j.agg(F.count_if(guess).alias("predicted_links"), F.count_if(linked & right).alias("correct_links"), F.count_if(linked).alias("gold_links"), F.count_if(linked & guess & ~right).alias("wrong_entity"), F.count_if(~linked & guess).alias("linked_nil"), F.count_if(linked & ~guess).alias("missed"))
    p, r = F.try_divide("correct_links", "predicted_links"), F.try_divide("correct_links", "gold_links")
    return c.withColumns({"precision": p, "recall": r, "f1": scores.f1_linkage(p, r)})


def paper_links(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts over distinct (paper, entity) pairs: predicted, correct, gold and recalled."""
    g, p = gold.select("paper", "entity_id").distinct().withColumn("_g", F.lit(1)), predicted.where("entity_id is not null").select("paper", "entity_id").distinct().withColumn("_p", F.lit(1))
    j = g.join(p, ["paper", "entity_id"], "full_outer")
    return j.agg(F.count("_p").alias("predicted"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("correct"), F.count("_g").alias("gold"))


def _resample(draws: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, 3))
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            stats = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=1).astype(float)
            for d in range(draws):
                x = (keys ^ np.uint64((d + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float) / (1 << 53)
                times = np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), u)  # Poisson(1)
                total[d] += times @ stats
        yield pa.RecordBatch.from_arrays([pa.array(range(draws), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], ["draw", "correct", "predicted", "gold"])

    return run


def bootstrap(papers: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(measure, low, high) over resamples of papers (paper, correct, predicted, gold).

    Every paper enters a draw a Poisson(1) number of times, set by a hash of paper, draw and seed: tasks add up their own
    papers for all draws, and one row a task and draw is what is shuffled. Bounds are at index int(q * (n - 1))."""
    rows = papers.select(F.xxhash64("paper"), "correct", "predicted", "gold")
    d = map_in_arrow(rows, _resample(draws, seed), "draw int, correct double, predicted double, gold double").groupBy("draw").agg(F.sum("correct").alias("c"), F.sum("predicted").alias("p"), F.sum("gold").alias("g"))
    p, r = F.try_divide("c", "p"), F.try_divide("c", "g")
    m = d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("v")) for n, v in (("precision", p), ("recall", r), ("f1", scores.f1_linkage(p, r)))])).alias("x")).select("x.*").where("v is not null")
    s = m.groupBy("measure").agg(F.array_sort(F.collect_list("v")).alias("v"))  # one value a draw
    at = lambda q: F.element_at("v", (F.floor(F.lit(q) * (F.size("v") - 1)) + 1).cast("int"))
    return s.select("measure", at(0.025).alias("low"), at(0.975).alias("high"))
