"""Queries of splits and supervision. Customers are work groups, orders papers and tasks, lines of documents passages."""

from pyspark.sql import functions as F

from mentionforge.operators import splits as sp
from mentionforge.plans.catalog import query
from mentionforge.plans.evaluation import _SPANS, _gold


@query("exposure_flags", "SELECT doc_id, coalesce(quality = 0 OR toxic = 1, false) AS development_exposed, coalesce(toxic = 1, false) AS historical FROM documents LEFT JOIN labels USING (doc_id)")
def exposure_flags(load):
    l = load("labels")  # noqa: E741
    reasons = l.where("quality = 0").select("doc_id", F.lit("text").alias("reason"), F.lit("train_reserved").alias("role")).unionByName(l.where("toxic = 1").select("doc_id", F.lit("identifier").alias("reason"), F.lit("historical").alias("role")))
    return sp.exposure_flags(load("documents").select("doc_id"), reasons)


@query("seen_before", """
WITH d AS (SELECT doc_id, doc_id // 3 k, sha256(text) g FROM documents), h AS (SELECT * FROM d WHERE doc_id % 17 = 0)
SELECT doc_id, doc_id IN (SELECT doc_id FROM h) OR (k % 2 = 0 AND k IN (SELECT k FROM h)) OR coalesce(g IN (SELECT g FROM h WHERE g IS NOT NULL), false) AS historical FROM d
""")
def seen_before(load):
    k = F.floor(F.col("doc_id") / 3)
    d = load("documents").select("doc_id", F.concat(F.lit("Rec"), "doc_id").alias("record"), F.array(F.when(k % 2 == 0, F.concat(F.lit("k"), k))).alias("keys"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    h = d.where("doc_id % 17 = 0").select(F.upper("record").alias("record"), "keys", "digest")
    return sp.seen_before(d, h).select("doc_id", "historical")


@query("key_closure", """
WITH c AS (SELECT c_custkey c, c_custkey // 8 g FROM customer), k AS (SELECT g, 'a' || c // 2 AS key FROM c UNION SELECT g, 'b' || g FROM c UNION SELECT g, 'c' || c FROM c)
SELECT c AS row_id, key FROM c JOIN k USING (g)
""")
def key_closure(load):
    c = F.col("c_custkey")
    keys = F.array(F.concat(F.lit("a"), F.floor(c / 2)), F.concat(F.lit("b"), F.floor(c / 8)), F.concat(F.lit("c"), c))
    return sp.key_closure(load("customer").select(c.alias("row_id"), c.alias("record"), F.explode(keys).alias("key")))


_QUOTAS = {"test": 30, "dev": 20, "train": 10**6}
_SEED = 11
_NATIVES = "CASE c_custkey % 11 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'unknown' WHEN 3 THEN 'train' END"
_STEPS = {"test": ("NOT x", "NOT t"), "dev": ("NOT x AND NOT t", "NOT d"), "train": ("NOT t AND NOT d", "false")}


def _assigned() -> str:
    out = f"g AS (SELECT 'w' || c_custkey w, 's' || c_nationkey % 3 s, coalesce(CASE WHEN c_custkey % 9 > 0 THEN 'n' || c_nationkey % 4 END, 'unknown') st, c_custkey % 5 = 0 x, coalesce(n = 'test', false) t, coalesce(n = 'validation', false) d, sha256('{_SEED}|w' || c_custkey) h FROM (SELECT *, {_NATIVES} n FROM customer) WHERE coalesce(n, '') <> 'unknown' AND c_custkey % 13 <> 0)"
    used: list[str] = []
    for role, (fits, tier) in _STEPS.items():
        free = "".join(f" AND w NOT IN (SELECT w FROM z_{u})" for u in used)
        out += f", p_{role} AS (SELECT *, {tier} tier FROM g WHERE {fits}{free}), r_{role} AS (SELECT *, row_number() OVER (PARTITION BY s, tier, st ORDER BY h, w) turn FROM p_{role}), z_{role} AS (SELECT w, s FROM r_{role} QUALIFY row_number() OVER (PARTITION BY s ORDER BY tier, turn, st) <= {_QUOTAS[role]})"
        used.append(role)
    return out


def _splits(load):
    c = F.col("c_custkey")
    k = c % 11
    native = F.when(k == 0, F.lit("test")).when(k == 1, F.lit("validation")).when(k == 2, F.lit("unknown")).when(k == 3, F.lit("train"))
    groups = load("customer").select(F.concat(F.lit("w"), c).alias("work_id"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("source"), F.when(c % 9 > 0, F.concat(F.lit("n"), F.col("c_nationkey") % 4)).alias("stratum"), F.when(native.isNotNull(), F.array(native)).alias("natives"), (c % 13 == 0).alias("historical"), (c % 5 == 0).alias("exposed"))
    return sp.assign_splits(groups, _QUOTAS, _SEED)


@query("assigned_splits", f"WITH {_assigned()} " + " UNION ALL ".join(f"SELECT w AS work_id, s AS source, '{r}' AS split FROM z_{r}" for r in _STEPS))
def assigned_splits(load):
    return _splits(load)[0]


@query("split_shortages", f"WITH {_assigned()} " + " UNION ALL ".join(f"SELECT s AS source, '{r}' AS split, {_QUOTAS[r]}::BIGINT AS required, (SELECT count(*) FROM p_{r} WHERE p_{r}.s = q.s) AS available FROM (SELECT DISTINCT s FROM g) q WHERE available < {_QUOTAS[r]}" for r in _STEPS))
def split_shortages(load):
    return _splits(load)[1]


@query("evaluation_pool", """
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, doc_id || '?')) p, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) x FROM documents),
o AS (SELECT p, min_by(doc_id, (sha256('3|' || doc_id), doc_id)) r, bool_or(x) bad FROM d GROUP BY p), k AS (SELECT r, row_number() OVER (ORDER BY sha256('4|' || r), r) n FROM o WHERE NOT bad)
SELECT doc_id, CASE WHEN bad THEN 'historical_exposure' WHEN doc_id <> o.r THEN 'same_paper_or_duplicate' WHEN n <= 50 THEN 'evaluation' WHEN n <= 70 THEN 'development' ELSE 'reserve' END AS part, CASE WHEN NOT bad THEN o.r END AS representative
FROM d JOIN o USING (p) LEFT JOIN k ON k.r = o.r
""")
def evaluation_pool(load):
    d = load("documents")
    g = d.where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("g"))
    links = g.join(g.groupBy("g").agg(F.min("doc_id").alias("b")), "g").select(F.col("doc_id").alias("a"), "b")
    return sp.evaluation_pool(d.select("doc_id"), links, load("labels").where("toxic = 1").select("doc_id"), 50, 20, 3)


@query("supervised_tasks", """
SELECT o_orderkey AS task_id, CASE WHEN NOT (o_custkey % 9 = 0 OR coalesce(bool_or(l_returnflag = 'A' OR (l_linestatus = 'O' AND l_linenumber % 3 > 0)), false)) THEN 'no_detector_supervision' END AS reason
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
""")
def supervised_tasks(load):
    o = load("orders")
    tasks = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("doc_id"), F.lit(0).alias("start"), F.lit(9).alias("end"))
    found = load("lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") == "A").alias("software"), (F.col("l_linestatus") == "O").alias("versions"), (F.col("l_linenumber") % 3).alias("n_links"))
    covered = o.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_custkey") % 9 == 0, F.lit(True)).alias("software"), F.lit(False).alias("versions"))
    return sp.supervised_tasks(tasks, found, covered).select("task_id", "reason")


@query("owned_overlaps", f'WITH s AS ({_SPANS}) SELECT x.doc_id, x.id AS a, y.id AS b FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.id < y.id AND x."start" < y."end" AND y."start" < x."end"')
def owned_overlaps(load):
    return sp.owned_overlaps(_gold(load).select(F.col("id").alias("task_id"), "doc_id", "start", "end"))


_ALIASES, _CUES = ("est", "Onor", "the", "der"), ("tion", "Schaft")
_LINES = "l AS (SELECT doc_id, k - 1 AS \"start\", x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) k FROM documents) WHERE x <> '')"
_W = "[^\\pL\\pM\\p{Nd}\\p{Pc}]"


def _hit(alias: str, tail: str = "") -> str:
    flag = "" if len(alias) <= 3 else "(?i)"
    end = tail or f"($|{_W})"
    return f"regexp_matches(text, '{flag}(^|{_W}){alias}{end}')"


_TAIL = r"(\s+[,(:-]?|[,(:-])\s*((?i)(version|ver\.?|release)\s*)?(?i)[vr]?\s*\d+(\.\d+)*([a-z]\d*)?($|[^A-Za-z0-9_\pL])"


def _passages(load):
    d = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("start", "text")).where("text <> ''")
    return d.withColumn("end", F.col("start") + 1)


@query("selected_passages", f"""
WITH {_LINES}, h AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_hit(a)} THEN '{a}' END" for a in _ALIASES)}], lambda x: x IS NOT NULL) ca, {' OR '.join(_hit(a, _TAIL) for a in _ALIASES)} v, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('42|' || doc_id || '|' || "start"), "start") r FROM l),
s AS (SELECT *, r > 3 AND len(ca) > 0 sig FROM h), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY NOT v, "start") k FROM s)
SELECT doc_id, "start", ca AS candidate_aliases, CASE WHEN r <= 3 THEN 'random_whole_passage' WHEN v THEN 'literal_name_version_candidate' ELSE 'literal_name_candidate' END AS selection_reason FROM q WHERE r <= 3 OR (sig AND k <= 3)
""")
def selected_passages(load):
    return sp.select_passages(_passages(load), _ALIASES).select("doc_id", "start", "candidate_aliases", "selection_reason")


@query("topped_up", f"""
WITH {_LINES}, f AS (SELECT *, {' OR '.join(f"contains(lower(text), '{c.lower()}')" for c in _CUES)} c FROM l WHERE "start" % 4 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY "start") k FROM f), s AS (SELECT *, c AND k <= 2 s FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY sha256('42|' || doc_id || '|' || "start"), "start") r FROM s)
SELECT doc_id, "start", CASE WHEN s THEN 'training_gap_candidate' ELSE 'random_whole_passage' END AS selection_reason FROM r WHERE s OR r <= 1 ORDER BY doc_id, NOT s, CASE WHEN s THEN k ELSE r END LIMIT 72
""")
def topped_up(load):
    c = _passages(load)
    return sp.top_up(c, c.where("start % 4 = 0").select("doc_id", "start", "end"), _CUES, signal_per_parent=2, random_per_parent=1).select("doc_id", "start", "selection_reason")


@query("passage_issues", f"WITH {_LINES} SELECT doc_id, \"start\", 'CONTEXT_EXCEEDS_LIMIT' AS code FROM l JOIN documents d USING (doc_id) WHERE length(d.text) > 6000")
def passage_issues(load):
    c = _passages(load).join(load("documents").select("doc_id", F.lit(0).alias("context_start"), F.length("text").alias("context_end")), "doc_id")
    return sp.passage_candidates(c)[1].select("doc_id", "start", "code")


@query("paper_sample", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('9|' || doc_id), doc_id) <= 12")
def paper_sample(load):
    return sp.paper_sample(load("documents").select("lang", "doc_id"), "lang", "doc_id", 12, 9)


_PICK = "('0x' || substr(sha256('{0}|' || draw), 1, 8))::BIGINT % n"


@query("uniform_draws", f"""
WITH d AS (SELECT DISTINCT source, lang, doc_id FROM documents), a AS (SELECT source, row_number() OVER (ORDER BY source) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT source FROM d)),
b AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 i, count(*) OVER (PARTITION BY source) n FROM (SELECT DISTINCT source, lang FROM d)),
c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 i, count(*) OVER (PARTITION BY source, lang) n FROM d), w AS (SELECT unnest(range(1, 2001)) draw)
SELECT draw, a.source, b.lang, c.doc_id FROM w JOIN a ON a.i = {_PICK.format(6).replace('% n', '% a.n')} JOIN b ON b.source = a.source AND b.i = {_PICK.format(7).replace('% n', '% b.n')} JOIN c ON c.source = b.source AND c.lang = b.lang AND c.i = {_PICK.format(8).replace('% n', '% c.n')}
""")
def uniform_draws(load):
    return sp.uniform_draws(load("documents").select("source", "lang", "doc_id"), ["source", "lang", "doc_id"], 2000, 6)


@query("paper_link_groups", """
WITH RECURSIVE g AS (SELECT l_orderkey p, l_linenumber r, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [l_partkey, l_partkey + 1, l_suppkey] ELSE [l_partkey, l_suppkey] END) e FROM lineitem),
x AS (SELECT DISTINCT a.p, a.e a, b.e b FROM g a JOIN g b USING (p, r)), reach AS (SELECT p, a, b FROM x UNION SELECT reach.p, reach.a, x.b FROM reach JOIN x ON x.p = reach.p AND x.a = reach.b),
k AS (SELECT p, a e, min(b) link FROM reach GROUP BY p, a), q AS (SELECT DISTINCT l_orderkey p, l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 7 ELSE 0 END e FROM lineitem), j AS (SELECT p, e, link, q.p IS NOT NULL hit FROM q FULL JOIN k USING (p, e)),
m AS (SELECT (SELECT count(*) FROM q)::BIGINT predicted_links, (SELECT count(*) FROM q SEMI JOIN k USING (p, e))::BIGINT correct_links, (SELECT count(DISTINCT (p, link)) FROM k)::BIGINT gold_links, (SELECT count(DISTINCT (p, link)) FROM k SEMI JOIN q USING (p, e))::BIGINT recalled_links),
f AS (SELECT *, correct_links / predicted_links AS precision, recalled_links / gold_links AS recall FROM m)
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM f
""")
def paper_link_groups(load):
    li = load("lineitem")
    ids = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_partkey", F.col("l_partkey") + 1, "l_suppkey")).otherwise(F.array("l_partkey", "l_suppkey"))
    predicted = li.select(F.col("l_orderkey").alias("paper"), (F.col("l_partkey") + F.when(F.col("l_suppkey") % 4 == 0, 7).otherwise(0)).alias("entity_id"))
    return sp.paper_link_metrics(li.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("row_id"), ids.alias("entity_ids")), predicted)


@query("paired_bootstrap")
def paired_bootstrap(load):
    li = load("lineitem")
    hit = lambda c: F.count_if(c)
    per = li.groupBy(F.col("l_orderkey").alias("paper")).agg(hit(F.col("l_suppkey") % 4 > 0).alias("tp"), hit(F.col("l_suppkey") % 7 == 0).alias("fp"), hit(F.col("l_suppkey") % 4 == 0).alias("fn"), hit(F.col("l_partkey") % 3 > 0).alias("tp2"), hit(F.col("l_partkey") % 5 == 0).alias("fp2"), hit(F.col("l_partkey") % 3 == 0).alias("fn2"))
    return sp.paired_bootstrap(per, draws=500, low=12, high=487)
