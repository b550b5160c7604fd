"""Queries of the registry and of linkage. part is the catalogue, an order a paper, a part name in it a mention."""

from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators import linkage as ln
from mentionforge.operators import registry as rg
from mentionforge.plans.catalog import query
from mentionforge.plans.texts import _EXACT, _STEM, _STOP
from mentionforge.session import dealt

_LOOSE = "nullif(regexp_replace({0}, '[^\\pL\\pM\\p{{Nd}}]+', '', 'g'), '')"


#: Bytes of the catalogue's file that one task is dealt: 58,000 rows where names repeat, each of which claims five forms.
ENTITY_BYTES = 256 << 10


def _entities(load):
    """The catalogue's entities, dealt out by id: its file is a scan of one task, and the forms that its rows claim are many times its bytes."""
    none = F.array().cast("array<string>")
    return dealt(load("part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", task_bytes=ENTITY_BYTES).select(
        F.col("p_partkey").alias("entity_id"), F.array("p_name").alias("names"), F.array("p_brand").alias("aliases"),
        F.when(F.col("p_size") % 4 == 0, F.array(F.concat(F.lit("pkg"), F.pmod("p_partkey", F.lit(97))))).otherwise(none).alias("packages"),
        F.when(F.col("p_size") % 5 == 0, F.array("p_name")).otherwise(none).alias("catalogue_names"),
    )


_CLAIMS = "SELECT p_partkey e, p_name x, 'name' k FROM part UNION ALL SELECT p_partkey, p_brand, 'alias' FROM part UNION ALL SELECT p_partkey, 'pkg' || p_partkey % 97, 'package' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, p_name, 'czi' FROM part WHERE p_size % 5 = 0"
_FORMS = f"c AS ({_CLAIMS}), f AS (SELECT 'exact' key_type, {_EXACT.format('x')} form, e, k FROM c UNION ALL SELECT 'loose', {_LOOSE.format(_EXACT.format('x'))}, e, k FROM c), p AS (SELECT key_type, form, e, list_sort(list(DISTINCT k)) pr FROM f WHERE form <> '' GROUP BY ALL)"


@query("surface_forms", f"WITH {_FORMS} SELECT key_type, form, count(*)::BIGINT AS n_entities, min(e) AS first_entity, min_by(pr, e) AS first_provenance FROM p GROUP BY ALL")
def surface_forms(load):
    f = rg.surface_forms(_entities(load))
    return f.select("key_type", "form", F.size("entities").cast("long").alias("n_entities"), F.element_at("entities", 1)["entity_id"].alias("first_entity"), F.element_at("entities", 1)["provenance"].alias("first_provenance"))


@query("form_coverage", f"""
WITH {_FORMS}, q AS (SELECT DISTINCT w FROM (SELECT p_name w FROM part UNION ALL SELECT upper(replace(p_name, ' ', '')) FROM part UNION ALL SELECT o_orderpriority FROM orders)),
x AS (SELECT form, count(*) n FROM p WHERE key_type = 'exact' GROUP BY form), y AS (SELECT DISTINCT form FROM p WHERE key_type = 'loose'),
j AS (SELECT q.w, x.n, y.form IS NOT NULL l FROM q LEFT JOIN x ON x.form = {_EXACT.format('q.w')} LEFT JOIN y ON y.form = {_LOOSE.format(_EXACT.format('q.w'))})
SELECT count(*)::BIGINT AS names, count(n)::BIGINT AS exact, count(*) FILTER (l)::BIGINT AS loose, count(*) FILTER (n > 1)::BIGINT AS ambiguous_exact, count(*) FILTER (n IS NULL AND NOT l)::BIGINT AS missing FROM j
""")
def form_coverage(load):
    part = load("part")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))))).union(load("orders").select("o_orderpriority")).distinct()
    return rg.form_coverage(rg.surface_forms(_entities(load)), names)


@query("czi_flags", f"""
WITH {_FORMS}, l AS (SELECT p_partkey r, p_name, CASE WHEN p_size % 10 = 0 THEN 'dummy package' ELSE p_type END d FROM part WHERE p_size % 5 = 0),
o AS (SELECT r, count(DISTINCT e) n FROM l JOIN p ON key_type = 'exact' AND form = {_EXACT.format('p_name')} AND e <> r AND (list_contains(pr, 'name') OR list_contains(pr, 'alias') OR list_contains(pr, 'package')) GROUP BY r),
x AS (SELECT r, list_filter([CASE WHEN d = 'dummy package' THEN 'placeholder_description' END, CASE WHEN n > 0 THEN 'name_collision' END], lambda v: v IS NOT NULL) fl FROM l LEFT JOIN o USING (r))
SELECT r AS record, r AS entity_id, fl AS flags, CASE WHEN len(fl) > 0 THEN 'low_trust' ELSE 'unaudited' END AS trust FROM x
""")
def czi_flags(load):
    links = load("part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("record"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 10 == 0, F.lit("dummy package")).otherwise(F.col("p_type")).alias("description"))
    return rg.catalogue_flags(links, rg.form_claims(_entities(load)))


_EAV = "SELECT l_partkey s, 'status' k, l_returnflag v, CASE WHEN l_linenumber % 2 = 0 THEN 'en' ELSE 'de' END lang FROM lineitem UNION ALL SELECT l_partkey, 'line', l_linestatus, NULL FROM lineitem"


@query("eav_pivot", f"""
WITH b AS (SELECT DISTINCT s, k, CASE WHEN coalesce(lang, 'en') = 'en' THEN 0 ELSE 1 END r, v FROM ({_EAV}))
SELECT s, list(v ORDER BY r, v) FILTER (k = 'status') AS status, list(v ORDER BY r, v) FILTER (k = 'line') AS line FROM b GROUP BY s
""")
def eav_pivot(load):
    li = load("lineitem")
    lang = F.when(F.col("l_linenumber") % 2 == 0, F.lit("en")).otherwise(F.lit("de"))
    b = li.select(F.col("l_partkey").alias("s"), F.lit("status").alias("k"), F.col("l_returnflag").alias("v"), lang.alias("lang"))
    b = b.unionByName(li.select(F.col("l_partkey").alias("s"), F.lit("line").alias("k"), F.col("l_linestatus").alias("v"), F.lit(None).cast("string").alias("lang")))
    return rg.pivot_bindings(b, ["status", "line"])


@query("entity_merge")
def entity_merge(load):
    none = F.array().cast("array<string>")
    rec = lambda df, key, source, packages, repo: df.select(F.concat(F.lit(f"{source}:"), key).alias("key"), F.lit(source).alias("source"), packages.alias("packages"), none.alias("rrids"), repo.alias("repo_keys"))
    part, supp, cust = load("part"), load("supplier"), load("customer")
    pkg = lambda k: F.array(F.concat(F.lit("pypi:p"), k))
    repo = lambda k: F.array(F.concat(F.lit("github.com/o/r"), F.pmod(k, F.lit(500))))
    records = rec(part, "p_partkey", "wikidata", pkg("p_partkey"), repo("p_partkey")).unionByName(rec(supp, "s_suppkey", "biotools", pkg("s_suppkey"), none)).unionByName(rec(cust, "c_custkey", "ecosystems", F.when(F.col("c_custkey") % 2 == 0, pkg("c_custkey")).otherwise(none), repo("c_custkey")))
    return rg.merge_records(records)


@query("entity_records", """
WITH m AS (SELECT p_name entity_id, p_partkey k, p_brand nm, p_type d, p_size FROM part), g AS (SELECT DISTINCT entity_id, nm, min(k) OVER (PARTITION BY entity_id, nm) f FROM m)
SELECT entity_id, (SELECT list(nm ORDER BY f) FROM g WHERE g.entity_id = m.entity_id) AS names, min_by(d, k) AS description, max(p_size) AS sitelinks FROM m GROUP BY entity_id
""")
def entity_records(load):
    m = load("part").select(F.col("p_name").alias("entity_id"), F.col("p_partkey").alias("key"), F.lit("wikidata").alias("source"), F.col("p_brand").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("description"), F.col("p_size").alias("sitelinks"))
    return rg.entities(m).select("entity_id", "names", "description", "sitelinks")


_POP = "pop AS (SELECT p_partkey e, count(l_partkey) n, 1 + p_size % 3 ns FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"


def _mention_names(load):
    return load("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(load("part"), "p_partkey").select(F.col("p_name").alias("name")).distinct()


_CAND = f"""{_FORMS}, nm AS (SELECT DISTINCT p_name w FROM part SEMI JOIN lineitem ON l_partkey = p_partkey), q AS (SELECT w, {_EXACT.format('w')} x, {_LOOSE.format(_EXACT.format('w'))} l, list_distinct(list_filter(regexp_extract_all({_EXACT.format('w')}, '[a-z0-9]+'), lambda z: length(z) >= 2)) tk FROM nm),
h AS (SELECT DISTINCT form, unnest(list_distinct(list_filter(regexp_extract_all(form, '[a-z0-9]+'), lambda z: length(z) >= 2))) token FROM p WHERE key_type = 'exact'),
tm AS (SELECT w, form FROM (SELECT w, x, len(tk) n, unnest(tk) token FROM q WHERE len(list_filter(tk, lambda z: length(z) >= 3)) > 0) JOIN h USING (token) WHERE form <> x GROUP BY w, form, n HAVING count(*) = n),
cd AS (SELECT w, e, 0 m FROM q JOIN p ON key_type = 'exact' AND form = x UNION ALL SELECT w, e, 1 FROM q JOIN p ON key_type = 'loose' AND form = l UNION ALL SELECT w, e, 2 FROM tm JOIN p USING (form) WHERE key_type = 'exact'),
cand AS (SELECT w, e, min(m) m FROM cd GROUP BY w, e QUALIFY row_number() OVER (PARTITION BY w ORDER BY min(m), e) <= 12)"""


@query("candidates", f"WITH {_CAND} SELECT w AS name, e AS entity_id, ['exact', 'loose', 'token'][m + 1] AS match FROM cand")
def candidates(load):
    return ln.candidates(_mention_names(load), rg.form_claims(_entities(load)))


_TCAND = f"""{_FORMS}, tk AS (SELECT p_partkey task, k, w FROM (SELECT p_partkey, unnest([upper(p_brand), p_name, replace(p_name, ' ', '')]) w, unnest([0, 1, 2]) k FROM part SEMI JOIN lineitem ON l_partkey = p_partkey)),
q AS (SELECT DISTINCT w, {_EXACT.format('w')} x, {_LOOSE.format(_EXACT.format('w'))} l, list_distinct(list_filter(regexp_extract_all({_EXACT.format('w')}, '[a-z0-9]+'), lambda z: length(z) >= 2)) ws FROM tk),
h AS (SELECT DISTINCT form, unnest(list_distinct(list_filter(regexp_extract_all(form, '[a-z0-9]+'), lambda z: length(z) >= 2))) token FROM p WHERE key_type = 'exact'),
tm AS (SELECT w, form FROM (SELECT w, x, len(ws) n, unnest(ws) token FROM q WHERE len(list_filter(ws, lambda z: length(z) >= 3)) > 0) JOIN h USING (token) WHERE form <> x GROUP BY w, form, n HAVING count(*) = n),
hit AS (SELECT w, e, 0 m, w f FROM q JOIN p ON key_type = 'exact' AND form = x UNION ALL SELECT w, e, 1, w FROM q JOIN p ON key_type = 'loose' AND form = l UNION ALL SELECT w, e, 2, form FROM tm JOIN p USING (form) WHERE key_type = 'exact'),
best AS (SELECT task, e, min((m, k, f)) b FROM tk JOIN hit USING (w) GROUP BY task, e)"""


@query("task_candidates", f"WITH {_TCAND} SELECT task, e AS entity_id, ['exact', 'loose', 'token'][b[1] + 1] AS match, b[3] AS matched_form FROM best QUALIFY row_number() OVER (PARTITION BY task ORDER BY b[1], e) <= 12")
def task_candidates(load):
    part = load("part").join(load("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    tasks = part.select(F.col("p_partkey").alias("task"), F.array(F.upper("p_brand"), F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("surface_forms"))
    return ln.task_candidates(tasks, rg.form_claims(_entities(load)))


def _popularity(load):
    n = load("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("mentions"))
    return load("part").join(n, "p_partkey", "left").select(F.col("p_partkey").alias("entity_id"), F.coalesce("mentions", F.lit(0)).alias("mentions"), (1 + F.col("p_size") % 3).alias("n_sources"))


@query("fast_text_match", f"WITH {_CAND}, {_POP} SELECT w AS name, max_by(e, (n, ns, e)) AS entity_id, max(n)::BIGINT AS popularity, count(*)::BIGINT AS n_candidates FROM cand JOIN pop USING (e) WHERE m = 0 GROUP BY w")
def fast_text_match(load):
    return ln.fast_match(ln.exact_candidates(_mention_names(load), rg.form_claims(_entities(load))), _popularity(load))


def _tasks(load):
    """(task, paper, name, context, entity_ids): a name in an order, with the descriptions of its lines."""
    j = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey"))
    word = F.when(F.col("l_linenumber") % 2 == 0, F.lit("Python")).otherwise(F.lit("table"))
    ctx = F.concat_ws(" ", "p_brand", "p_type", word)
    g = j.groupBy(F.col("l_orderkey").alias("paper"), F.col("p_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(ctx)), " ").alias("context"), F.array_sort(F.collect_set("l_partkey")).alias("entity_ids"))
    return g.withColumn("task", F.concat_ws("|", "paper", "name"))


_TASKS = "tasks AS (SELECT l_orderkey paper, p_name w, string_agg(DISTINCT x, ' ' ORDER BY x) ctx, list(DISTINCT l_partkey) g FROM (SELECT l_orderkey, l_partkey, p_name, p_brand || ' ' || p_type || ' ' || CASE WHEN l_linenumber % 2 = 0 THEN 'Python' ELSE 'table' END x FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)"
_TOK = f"list_transform(list_filter(regexp_extract_all(lower({{0}}), '[a-z][a-z0-9]+'), lambda x: x NOT IN ({_STOP})), lambda x: {_STEM})"
_ETEXT = "p_name || ' ' || p_brand || ' ' || p_type"
_IDF = f"idf AS (SELECT token, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 idf FROM (SELECT p_partkey, unnest(list_distinct({_TOK.format(_ETEXT)})) token FROM part) GROUP BY token)"


@query("tfidf", f"WITH {_IDF} SELECT token, idf FROM idf")
def tfidf(load):
    texts = load("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return ln.inverse_frequency(texts, "p_partkey", "text")


_SCORE = f"""{_CAND}, {_TASKS}, {_IDF}, dc AS (SELECT DISTINCT w, ctx FROM tasks),
un AS (SELECT ln(1 + count(*)) + 1 u FROM part),
cw AS (SELECT w, ctx, token, count(*) * coalesce(idf, (SELECT u FROM un)) v FROM (SELECT w, ctx, unnest(list_filter({_TOK.format('ctx')}, lambda y: NOT list_contains({_TOK.format('w')}, y))) token FROM dc) LEFT JOIN idf USING (token) GROUP BY w, ctx, token, idf),
cn AS (SELECT w, ctx, token, v / sqrt(sum(v * v) OVER (PARTITION BY w, ctx)) v FROM cw),
ew AS (SELECT w, e, token, count(*) * idf v FROM (SELECT w, e, unnest(list_filter({_TOK.format(_ETEXT)}, lambda y: NOT list_contains({_TOK.format('w')}, y))) token FROM cand JOIN part ON e = p_partkey) JOIN idf USING (token) GROUP BY w, e, token, idf),
en AS (SELECT w, e, token, v / sqrt(sum(v * v) OVER (PARTITION BY w, e)) v FROM ew),
sim AS (SELECT w, ctx, e, sum(cn.v * en.v) s FROM cn JOIN en USING (w, token) GROUP BY ALL),
sc AS (SELECT dc.w, dc.ctx, cand.e, round([2.0, 1.4, 0.5][m + 1]::DOUBLE + 4.0::DOUBLE * coalesce(s, 0) + CASE WHEN p_size % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * (p_size % 3) + least(1.5::DOUBLE, 0.35::DOUBLE * ln(1 + p_size))
  + CASE WHEN dc.ctx LIKE '%Python%' AND p_size % 4 < 2 THEN CASE WHEN p_size % 4 = 0 THEN 0.6::DOUBLE ELSE -0.6::DOUBLE END ELSE 0 END, 4) score
  FROM dc JOIN cand USING (w) JOIN part ON p_partkey = cand.e LEFT JOIN sim ON sim.w = dc.w AND sim.ctx = dc.ctx AND sim.e = cand.e),
best AS (SELECT w, ctx, CASE WHEN max(score) >= 2.2 THEN min_by(e, (-score, e)) END e, max(score) score FROM sc GROUP BY ALL)"""


def _resolved(load, tasks=None):
    """(name, context, entity_id, score) of each distinct name and context: tasks that agree in both are resolved once. Candidates
    and contexts are each used twice, off exchanges that Spark reuses."""
    cand, part = candidates(load), load("part")
    contexts = (tasks or _tasks(load)).select("name", "context").distinct()
    texts = part.select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), "p_size", F.col("p_type").alias("description"))
    idf = ln.inverse_frequency(texts, "entity_id", "text")
    unknown = F.log(F.lit(1 + part.count())) + 1
    left = ln.vectors(contexts.withColumn("ctx", F.col("context")), ["name", "context"], "ctx", "name", idf, unknown)
    rows = cand.join(texts.hint("merge"), "entity_id")  # files of the catalogue look small enough to broadcast
    right = ln.vectors(rows.select("name", "entity_id", "text"), ["name", "entity_id"], "text", "name", idf, unknown)
    sim = ln.similarity(left, right, ["name"], "context", "entity_id")
    eco = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("pypi"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("cran"))).otherwise(F.array().cast("array<string>"))
    scored = contexts.join(rows, "name").join(sim, ["name", "context", "entity_id"], "left").select(
        "name", "context", "entity_id", F.when(F.col("match") == "exact", F.lit("name")).otherwise(F.col("match")).alias("match"), "similarity", F.lit(False).alias("by_url"),
        (F.col("p_size") % 2 == 0).alias("wikidata"), (1 + F.col("p_size") % 3).alias("n_sources"), F.col("p_size").alias("sitelinks"), ln.cue_set(F.col("context")).alias("cues"), eco.alias("ecosystems"), "description",
    )
    return ln.best_candidate(scored.withColumn("score", ln.context_score()), ["name", "context"])


@query("context_resolve", f"WITH {_SCORE} SELECT w AS name, ctx AS context, e AS entity_id, score FROM best")
def context_resolve(load):
    return _resolved(load)


def _predicted(load):
    tasks = _tasks(load)
    return tasks.join(_resolved(load, tasks), ["name", "context"]).select("task", "paper", "name", "entity_ids", "entity_id")


_LINKED = f"{_SCORE}, pr AS (SELECT paper, w, g, e FROM tasks JOIN best USING (w, ctx))"


@query("link_metrics", f"""
WITH {_LINKED}, k AS (SELECT count(e)::BIGINT predicted_links, count(*) FILTER (list_contains(g, e))::BIGINT correct_links, count(*)::BIGINT gold_links, count(*) FILTER (e IS NOT NULL AND NOT list_contains(g, e))::BIGINT wrong_entity, 0::BIGINT linked_nil, count(*) FILTER (e IS NULL)::BIGINT missed FROM pr),
r AS (SELECT *, correct_links / nullif(predicted_links, 0) AS precision, correct_links / nullif(gold_links, 0) AS recall FROM k)
SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r
""")
def link_metrics(load):
    p = _predicted(load)
    return ln.link_metrics(p.select("task", "entity_ids"), p.select("task", "entity_id"))


@query("paper_links", f"""
WITH {_LINKED}, a AS (SELECT DISTINCT paper, e FROM pr WHERE e IS NOT NULL), b AS (SELECT DISTINCT l_orderkey paper, l_partkey e FROM lineitem)
SELECT (SELECT count(*) FROM a)::BIGINT AS predicted, (SELECT count(*) FROM a SEMI JOIN b USING (paper, e))::BIGINT AS correct, (SELECT count(*) FROM b)::BIGINT AS gold
""")
def paper_links(load):
    return ln.paper_links(load("lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("entity_id")), _predicted(load).select("paper", "entity_id"))


@query("bootstrap_ci")
def bootstrap_ci(load):
    p = _predicted(load)
    per = p.groupBy("paper").agg(F.count_if(F.array_contains("entity_ids", F.col("entity_id"))).alias("correct"), F.count("entity_id").alias("predicted"), F.count("*").alias("gold"))
    return ln.bootstrap(per, draws=200)


@query("extraction_recall", """
WITH g AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT DISTINCT l_orderkey, lower(p_name) f FROM g WHERE l_linenumber % 2 = 1)
SELECT count(*)::BIGINT AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM x WHERE x.l_orderkey = g.l_orderkey AND x.f = lower(p_name)))::BIGINT AS recalled FROM g
""")
def extraction_recall(load):
    g = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", t.exact_form(F.col("p_name")).alias("form"))
    found = g.where("l_linenumber % 2 = 1").select("l_orderkey", "form").distinct().withColumn("_h", F.lit(1))
    return g.join(found, ["l_orderkey", "form"], "left").agg(F.count("*").alias("gold"), F.count("_h").alias("recalled"))


@query("seen_unseen", """
WITH m AS (SELECT l_orderkey, p_name, l_orderkey % 5 = 0 test, l_quantity > 25 hit FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (SELECT DISTINCT lower(p_name) f FROM m WHERE NOT test)
SELECT (v.f IS NOT NULL) AS seen, count(*)::BIGINT AS gold, count(*) FILTER (hit)::BIGINT AS found, count(*) FILTER (hit) / count(*) AS recall FROM m LEFT JOIN v ON v.f = lower(p_name) WHERE test GROUP BY ALL
""")
def seen_unseen(load):
    m = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", t.exact_form(F.col("p_name")).alias("form"), (F.col("l_quantity") > 25).alias("hit"))
    train = m.where("l_orderkey % 5 <> 0").select("form").distinct().withColumn("_s", F.lit(True))
    j = m.where("l_orderkey % 5 = 0").join(train, "form", "left")
    return j.groupBy(F.col("_s").isNotNull().alias("seen")).agg(F.count("*").alias("gold"), F.count_if("hit").alias("found"), (F.count_if("hit") / F.count("*")).alias("recall"))
