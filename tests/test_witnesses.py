import random
from collections import deque

import pytest

from mentionforge.operators.witnesses import alias_layer

DDL = "relation_id string, a string, b string, decision string, preferred string"


@pytest.mark.parametrize("seed", [0, 1])
def test_witnesses_are_shortest_chains_of_recorded_relations(spark, seed):
    r = random.Random(seed)
    rows, names = [], [f"m{k:02}" for k in range(40)]
    for k in range(75):
        a, b = r.choice(names), r.choice(names)
        decision = r.choice(["alias", "alias", "alias", "not_alias", "unresolved"])
        rows.append((f"r{k:02}", a, b, decision, r.choice([None, None, a, b]) if decision == "alias" else None))
    rows += [(f"c{k}", f"x{k}", f"x{k + 1}", "alias", "x0") for k in range(8)] + [("far", "x8", "x0", "not_alias", None), ("none", "x0", "lost", "not_alias", None), ("half", None, "x1", "alias", None), rows[3]]
    groups, bad, chains = alias_layer(spark.createDataFrame(rows, DDL))
    edges = {}
    for i, a, b, decision, _ in rows:
        if decision == "alias" and a and b:
            edges.setdefault(a, []).append((b, i))
            edges.setdefault(b, []).append((a, i))

    def distances(start):
        found, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y, _ in edges.get(x, ()):
                if y not in found:
                    found[y] = found[x] + 1
                    queue.append(y)
        return found

    want = {i: (a, b, d[b]) for i, a, b, decision, _ in rows if decision == "not_alias" and b in (d := distances(a))}
    assert {x.relation_id: (x.a, x.b, x.steps) for x in bad.collect()} == want and want["far"][2] == 8 and bad.count() == len(want)
    told = {}
    for x in chains.collect():
        told.setdefault(x.relation_id, []).append((x.step, x["from"], x.to, x.via))
    assert set(told) == {i for i, (a, b, n) in want.items() if n}
    for i, steps in told.items():
        a, b, n = want[i]
        steps.sort()
        assert [s[0] for s in steps] == list(range(1, n + 1)) and steps[0][1] == a and steps[-1][2] == b
        assert all(x[2] == y[1] for x, y in zip(steps, steps[1:])) and all((to, via) in edges[x] for _, x, to, via in steps)
    got = {x.member: x for x in groups.collect()}
    for m in edges:
        if any(y != m for y, _ in edges[m]):
            inside = set(distances(m))
            wishes = {p for _, a, _, d, p in rows if d == "alias" and a in inside and p}
            assert (got[m].group_id, got[m].preferred, got[m].conflict) == (min(inside), next(iter(wishes)) if len(wishes) == 1 else None, len(wishes) > 1)


def test_layers_without_contradictions(spark):
    groups, bad, chains = alias_layer(spark.createDataFrame([("r", "a", "b", "alias", None), ("s", "b", "c", "not_alias", None)], DDL))
    assert sorted(x.member for x in groups.collect()) == ["a", "b"] and bad.count() == chains.count() == 0
    assert [x.count() for x in alias_layer(spark.createDataFrame([], DDL))] == [0, 0, 0]


def test_chains_are_not_broadcast(spark):
    rows = spark.createDataFrame([("p", 1, 2, "alias", None), ("q", 2, 3, "alias", 2), ("r", 1, 3, "not_alias", None)], "relation_id string, a long, b long, decision string, preferred long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    groups, ended, _ = alias_layer(rows)
    assert [tuple(r) for r in ended.collect()] == [("r", 1, 3, 2)] and "BroadcastHashJoin" not in plan(groups)
