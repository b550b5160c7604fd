"""Why a group of aliases contradicts itself: for each relation that denies what others say, the shortest chain of those others.

Chains grow level by level from one end of every contradiction at once. A level is a written table, and each node of a search is
reached once, by the relation of smallest id among those that reach it first, so what leads back from the other end is a
shortest chain, and the same one in every run. Levels are merged with what they meet and never broadcast: their files look
smaller than they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.operators.graph import connected, materialize


def alias_layer(relations: DataFrame, most_levels: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (member, group_id, preferred, conflict), contradictions (relation_id, a, b, steps) and their witnesses (relation_id, step,
    via, from, to) of relations (relation_id, a, b, decision, preferred).

    Members that relations with decision alias join, in chains of any length, are a group, by its smallest member; its preferred
    member is the one that such relations name, null where they name none or, with a conflict, several. A relation not_alias
    between two members of a group is a contradiction: its witness is a shortest chain of alias relations from a to b, step by
    step from 1. Other decisions, and relations without an end, say nothing; a not_alias of a member and itself is a
    contradiction of no steps; of relations between the same two the smallest id is taken, and repeated rows count once. A chain
    of more than most_levels steps fails the job."""
    whole = relations.where("a is not null and b is not null").dropDuplicates(["relation_id", "a", "b", "decision", "preferred"])
    said = materialize(whole.where("decision = 'alias'").select("relation_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "preferred"), "said")
    roots = materialize(connected(said.select("a", "b")), "roots")
    wishes = said.where("preferred is not null").join(roots.withColumnRenamed("id", "a").hint("merge"), "a").groupBy("root").agg(F.count_distinct("preferred").alias("_n"), F.min("preferred").alias("_p"))
    groups = roots.join(wishes.hint("merge"), "root", "left").select(F.col("id").alias("member"), F.col("root").alias("group_id"), F.when(F.col("_n") == 1, F.col("_p")).alias("preferred"), (F.coalesce("_n", F.lit(0)) > 1).alias("conflict"))

    denied = whole.where("decision = 'not_alias'").select("relation_id", "a", "b").distinct()
    of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")).hint("merge")
    inside = denied.join(of("a"), "a").join(of("b"), "b").where("_a = _b").select("relation_id", "a", "b")
    bad = materialize(inside.unionByName(denied.where("a = b").select("relation_id", "a", "b")).distinct(), "denied")

    way = said.where("a <> b").groupBy("a", "b").agg(F.min("relation_id").alias("via"))
    way = materialize(way.select(F.col("a").alias("from"), F.col("b").alias("to"), "via").unionByName(way.select(F.col("b").alias("from"), F.col("a").alias("to"), "via")), "ways")
    nothing = F.lit(None).cast(dict(way.dtypes)["from"])
    reached = [materialize(bad.select("relation_id", F.col("a").alias("to"), nothing.alias("from"), F.lit(None).cast(dict(way.dtypes)["via"]).alias("via"), F.lit(0).alias("level")), "level")]
    open_ = bad.where("a <> b")
    while not open_.isEmpty():
        if len(reached) > most_levels:
            raise RuntimeError("chains did not end")
        last, seen = reached[-1].select("relation_id", F.col("to").alias("from")), reduce(DataFrame.unionByName, reached).select("relation_id", "to")
        step = last.join(open_.select("relation_id").hint("merge"), "relation_id", "left_semi").join(way.hint("merge"), "from").join(seen.hint("merge"), ["relation_id", "to"], "left_anti")
        step = step.groupBy("relation_id", "to").agg(F.min(F.struct("via", "from")).alias("m")).select("relation_id", "to", "m.from", "m.via", F.lit(len(reached)).alias("level"))
        reached.append(materialize(step, "level"))
        open_ = materialize(open_.join(reached[-1].select("relation_id", F.col("to").alias("b")).hint("merge"), ["relation_id", "b"], "left_anti"), "open")
    every = reduce(DataFrame.unionByName, reached)
    ended = materialize(bad.join(every.select("relation_id", F.col("to").alias("b"), F.col("level").alias("steps")).hint("merge"), ["relation_id", "b"]).select("relation_id", "a", "b", "steps"), "ended")
    at, chain = ended.select("relation_id", F.col("b").alias("to"), F.col("steps").alias("level")), []
    for level in range(len(reached) - 1, 0, -1):  # from b back to a: a chain is as long as its level says
        here = materialize(at.where(F.col("level") == level).select("relation_id", "to").join(reached[level].hint("merge"), ["relation_id", "to"]).select("relation_id", F.col("level").alias("step"), "via", "from", "to"), "back")
        chain.append(here)
        at = at.where(F.col("level") < level).unionByName(here.select("relation_id", F.col("from").alias("to"), (F.col("step") - 1).alias("level")))
    none = reached[0].where("false").select("relation_id", F.col("level").alias("step"), "via", "from", "to")
    return groups, ended, reduce(DataFrame.unionByName, chain, none)
