"""Queries of sequential span operators, and of the event windows that also run as a stream."""

from pyspark.sql import functions as F

from mentionforge.operators import spans as sp
from mentionforge.plans.catalog import query
from mentionforge.streaming.events import latency_windows


@query("viterbi")
def viterbi(load):
    e = load("events")
    scores = F.array(*[(F.pmod(F.col("event_id") * k, F.lit(17)) / 3).cast("double") for k in (3, 5, 7, 11, 13)])
    tokens = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("k"), (F.col("event_id") * 4).alias("start"), (F.col("event_id") * 4 + 3).alias("end"), F.floor(F.col("event_id") / 3).cast("int").alias("word"), scores.alias("scores"))
    return sp.decode_wordpieces(tokens)


_TAILS = (" 1.2.3", "®", "The", " 42", "", "-h, 2021", "™® ")
_GLUED = "|".join(sp.GLUED)


@query("boundary_repair", rf"""
WITH d AS (SELECT doc_id, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) k FROM documents),
t AS (SELECT min(doc_id) doc_id, w, ([{", ".join(f"'{x}'" for x in _TAILS)}])[1 + k % 7] t FROM d WHERE w <> '' GROUP BY ALL),
b AS (SELECT doc_id, w || regexp_replace(t, ', .*', '') b, regexp_extract(t, ', .*') || ' here' r FROM t),
v AS (SELECT *, coalesce(nullif(regexp_extract(b, '[\s(\[](v?\d+(?:\.\d+)+(?:[-+][\w.]+)*\s*)$', 1), ''), regexp_extract(b, '[\s(\[](\d{{2,4}}\s*)$', 1)) v FROM b),
m AS (SELECT *, b[1:length(b) - length(v)] b1 FROM v), n AS (SELECT *, length(regexp_extract(b1, '[®™©℠]+$')) tm FROM m), o AS (SELECT *, b1[1:length(b1) - tm] b2 FROM n),
c AS (SELECT *, CASE WHEN length(b2) > 2 AND v = '' AND tm = 0 AND regexp_matches(r, '^,\s*\d{{4}}\b') THEN length(regexp_extract(b2, '-[a-z]$')) ELSE 0 END ci FROM o), e AS (SELECT *, b2[1:length(b2) - ci] b3 FROM c),
g AS (SELECT *, length(regexp_extract(b3, '[a-z]({_GLUED})$', 1)) gl FROM e), h AS (SELECT *, b3[1:length(b3) - gl] b4 FROM g), i AS (SELECT *, length(regexp_extract(b4, '\s+$')) ws FROM h),
j AS (SELECT *, CASE WHEN v <> '' THEN ['absorbed_version'] ELSE [] END || list_transform(range(tm), lambda x: 'trademark_suffix') || CASE WHEN ci > 0 THEN ['citation_suffix'] ELSE [] END
  || CASE WHEN gl > 0 THEN ['glued_function_word'] ELSE [] END || CASE WHEN ws > 0 THEN ['whitespace_trim'] ELSE [] END events FROM i)
SELECT doc_id, 'VERSION' AS label, 8 + length(b1) AS start, 8 + length(b) AS "end", events FROM j WHERE v <> ''
UNION ALL SELECT doc_id, 'SOFTWARE', 8, 8 + length(b4) - ws, events FROM j WHERE length(b4) > ws
""")
def boundary_repair(load):
    """Every word of the documents, with an ending of each kind that it stands with."""
    words = load("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "w")).where("w <> ''")
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), F.pmod(F.col("k") + 1, F.lit(7)) + 1)
    d = words.groupBy("w", tail.alias("t")).agg(F.min("doc_id").alias("doc_id")).withColumn("text", F.concat(F.lit("We used "), "w", "t", F.lit(" here")))
    end = 8 + F.length("w") + F.length(F.regexp_replace("t", ", .*", ""))
    return sp.repair_boundaries(d.select("doc_id", "text", F.lit(8).cast("long").alias("start"), end.cast("long").alias("end"), F.lit("SOFTWARE").alias("label")))


@query("dictionary_scan")
def dictionary_scan(load):
    names = load("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"))
    return sp.dictionary_scan(load("documents").select("doc_id", "text"), names)


_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query("phrase_matches", f"""
WITH w AS (SELECT doc_id, {_W} w FROM documents), g AS (SELECT doc_id, unnest(w) name FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
n AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[a-z0-9]+'), ' ') name FROM benchmark)
SELECT doc_id, name, count(*)::BIGINT AS n FROM g JOIN n USING (name) WHERE name <> '' GROUP BY ALL
""")
def phrase_matches(load):
    names = load("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return sp.phrase_matches(load("documents").select("doc_id", "text"), names)


@query("relaxed_match")
def relaxed_match(load):
    j = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("k"), F.col("p_name").alias("name"), "l_linenumber")
    return sp.relaxed_match(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 2").withColumn("name", F.substring("name", 1, 6)))


@query("latency_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(value)::BIGINT AS n, avg(value) AS mean, max(value) AS most FROM events GROUP BY ALL")
def latency_by_window(load):
    return latency_windows(load("events"))
