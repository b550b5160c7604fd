"""Queries of token supervision. In documents the first word of a line is software (in every fifth line with the blank behind it, in
every seventh once more together with the second word), its last word a version; two lines of three are covered."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.operators import supervision as sv
from mentionforge.plans.catalog import query

_GIVEN = r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) w, generate_subscripts(string_split_regex(text, '[ \n]'), 1) k FROM documents),
p AS (SELECT doc_id, w, k, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1 a FROM w),
t AS (SELECT doc_id, a, a + length(w) b, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 i, count(*) OVER (PARTITION BY doc_id) n FROM p WHERE w <> ''),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) - 1 k FROM documents),
m AS (SELECT doc_id, l, k, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(l) - 1 s, regexp_extract(l, '^[^ ]+') f, regexp_extract(l, '^[^ ]+ ([^ ]+)', 1) g, regexp_extract(l, '[^ ]+$') z FROM l),
e AS (SELECT doc_id, s a, s + length(f) + (k % 5 = 4 AND length(l) > length(f))::INTEGER b, 'SOFTWARE' kind FROM m WHERE f <> ''
  UNION SELECT doc_id, s, s + length(f) + 1 + length(g), 'SOFTWARE' FROM m WHERE k % 7 = 6 AND g <> ''
  UNION SELECT doc_id, s + length(l) - length(z), s + length(l), 'VERSION' FROM m WHERE z <> '' AND length(l) > length(z)),
o AS (SELECT DISTINCT x.doc_id, x.a, x.b, x.kind FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.a < y.b AND y.a < x.b AND (x.a, x.b, x.kind) <> (y.a, y.b, y.kind)),
h AS (SELECT e.doc_id, e.a, e.b, e.kind, min(i) i, max(i) j, min(t.a) ta, max(t.b) tb, any_value(n) n FROM e LEFT JOIN t ON t.doc_id = e.doc_id AND t.a < e.b AND e.a < t.b GROUP BY ALL),
v AS (SELECT doc_id, n, w, 48 * w s, least(48 * w + 64, n) z FROM (SELECT doc_id, n, unnest(range(greatest(ceil((n - 64) / 48), 0)::BIGINT + 1)) w FROM (SELECT DISTINCT doc_id, n FROM t))),
q AS (SELECT h.doc_id, a, b, kind, max_by(w, least(i - s, z - 1 - j) * 1000000 - w) w FROM h JOIN v ON v.doc_id = h.doc_id AND i >= s AND j < z GROUP BY ALL),
r AS (SELECT h.*, q.w, CASE WHEN o.a IS NOT NULL THEN 'overlapping_entity' WHEN i IS NULL OR ta <> h.a OR tb <> h.b THEN 'token_boundary' WHEN q.w IS NULL THEN 'window_limit' END reason
  FROM h LEFT JOIN o USING (doc_id, a, b, kind) LEFT JOIN q USING (doc_id, a, b, kind))
"""


def _offsets(text):
    return [m.span() for m in re.finditer(r"[^ \n]+", text)]


def _supervised(load):
    d = load("documents").select("doc_id", "text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "l")).withColumn("n", F.length("l"))
    lines = lines.withColumn("s", F.sum(F.col("n") + 1).over(W.partitionBy("doc_id").orderBy("k")) - F.col("n") - 1)
    lines = lines.withColumns({"f": F.length(F.regexp_extract("l", "^[^ ]+", 0)), "g": F.length(F.regexp_extract("l", "^[^ ]+ ([^ ]+)", 1)), "z": F.length(F.regexp_extract("l", r"[^ ]+\z", 0))})
    s = F.col("s")
    span = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    odd = F.when((F.col("k") % 5 == 4) & (F.col("n") > F.col("f")), 1).otherwise(0)
    entities = F.array(
        F.when(F.col("f") > 0, span(s, s + F.col("f") + odd, "SOFTWARE")), F.when((F.col("k") % 7 == 6) & (F.col("g") > 0), span(s, s + F.col("f") + 1 + F.col("g"), "SOFTWARE")),
        F.when((F.col("z") > 0) & (F.col("n") > F.col("z")), span(s + F.col("n") - F.col("z"), s + F.col("n"), "VERSION")),
    )
    regions = lines.where("k % 3 <> 2 and n > 0").select("doc_id", s.alias("start"), (s + F.col("n")).alias("end"), F.lit(True).alias("software"), (F.col("k") % 2 == 0).alias("versions"))
    return sv.token_supervision(d, regions, lines.select("doc_id", F.inline(F.array_compact(entities))), 64, 16, _offsets)


@query("token_supervision", _GIVEN + r""",
c AS (SELECT t.doc_id, t.i, max(CASE WHEN k % 3 <> 2 THEN 6 ELSE 0 END) x, max(CASE WHEN k % 3 <> 2 AND k % 2 = 0 THEN 24 ELSE 0 END) y FROM t JOIN m ON m.doc_id = t.doc_id AND m.s <= t.a AND t.b <= m.s + length(l) GROUP BY ALL),
g AS (SELECT t.doc_id, t.i, max(CASE WHEN reason IS NULL THEN (CASE kind WHEN 'SOFTWARE' THEN 2 ELSE 8 END) * (CASE WHEN t.i = r.i THEN 1 ELSE 2 END) END) bit, max(CASE WHEN reason IS NULL THEN r.w END) w, bool_or(reason IS NOT NULL) masked
  FROM t JOIN r ON r.doc_id = t.doc_id AND t.i BETWEEN r.i AND r.j GROUP BY ALL),
u AS (SELECT t.doc_id, t.i, max_by(w, least(t.i - s, z - 1 - t.i) * 1000000 - w) w FROM t JOIN v ON v.doc_id = t.doc_id AND t.i >= s AND t.i < z GROUP BY ALL),
f AS (SELECT t.doc_id, t.i, CASE WHEN coalesce(g.masked, FALSE) THEN 31 ELSE coalesce(g.bit, 31 - coalesce(c.x, 0) - coalesce(c.y, 0)) END a, coalesce(g.w, u.w) o FROM t JOIN u USING (doc_id, i) LEFT JOIN g USING (doc_id, i) LEFT JOIN c USING (doc_id, i))
SELECT v.doc_id, v.w::INTEGER AS "window", v.s AS start, v.z AS "end", list(a ORDER BY i) AS allowed, list(o = v.w AND a <> 31 ORDER BY i) AS active FROM v JOIN f ON f.doc_id = v.doc_id AND f.i >= v.s AND f.i < v.z GROUP BY ALL
""")
def token_supervision(load):
    return _supervised(load).select("doc_id", F.inline("windows")).withColumn("allowed", F.col("allowed").cast("array<int>"))


@query("supervision_exclusions", _GIVEN + """SELECT doc_id, kind, a::BIGINT AS start, b::BIGINT AS "end", reason FROM r WHERE reason IS NOT NULL""")
def supervision_exclusions(load):
    return _supervised(load).select("doc_id", F.inline("exclusions"))
