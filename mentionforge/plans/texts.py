"""Queries of the text functions over documents, pages and part names."""

from pyspark.sql import functions as F

from mentionforge.functions import text as t
from mentionforge.operators import segments
from mentionforge.plans.catalog import query

_LEAD = "SELECT doc_id, "
_V = "replace(regexp_replace(replace(replace({0}, '﷑', chr(10) || chr(10)), '﷐', chr(10)), '[ \\t]+', ' ', 'g'), chr(160), ' ')"
_CRS = "regexp_replace(regexp_replace(text, '\\r\\n?', '﷐', 'g'), '\\n{3,}', '﷑', 'g')"
_COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_EXACT = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query("norm_v1", f"SELECT doc_id, {_V.format(f'''regexp_replace({_CRS}, '\\n\\n?', chr(10), 'g')''')} AS text FROM documents")
def norm_v1(load):
    return load("documents").select("doc_id", t.normalize_v1(F.col("text")).alias("text"))


@query("norm_v2", f"SELECT doc_id, {_V.format(_CRS)} AS text FROM documents")
def norm_v2(load):
    return load("documents").select("doc_id", t.normalize_v2(F.col("text")).alias("text"))


@query("token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END::INTEGER AS n_tokens FROM documents")
def token_estimate(load):
    return load("documents").select("doc_id", t.token_estimate(F.col("text")).alias("n_tokens"))


@query("exact_form", f"SELECT p_partkey, {_EXACT.format('p_name')} AS form FROM part")
def exact_form(load):
    return load("part").select("p_partkey", t.exact_form(F.col("p_name")).alias("form"))


@query("loose_form", f"SELECT doc_id, nullif(regexp_replace({_EXACT.format('text')}, '[^\\pL\\pM\\p{{Nd}}]+', '', 'g'), '') AS form FROM documents")
def loose_form(load):
    return load("documents").select("doc_id", t.loose_form(F.col("text")).alias("form"))


@query("text_digest", f"SELECT doc_id, sha256({_COLLAPSED.format('text')}) AS digest FROM documents")
def text_digest(load):
    return load("documents").select("doc_id", t.text_digest(F.col("text")).alias("digest"))


@query("shingles", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pM\p{Nd}\p{Pc}]+') ws FROM documents)
SELECT doc_id, len(list_distinct(CASE WHEN len(ws) < 5 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END))::INTEGER AS n_shingles FROM w
""")
def shingles(load):
    return load("documents").select("doc_id", F.size(t.shingles(F.col("text"))).alias("n_shingles"))


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g'), '^www\.', '')"


@query("url_parts", f"SELECT page_id, {_HOST} AS host, len(list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> ''))::INTEGER AS n_parts FROM pages")
def url_parts(load):
    host, parts = t.host_and_parts(F.col("url"))
    return load("pages").select("page_id", host.alias("host"), F.size(parts).alias("n_parts"))


@query("repo_key", r"""
WITH u AS (
  SELECT o_orderkey, o_orderkey % 6 k, lower(o_orderpriority) p FROM orders
), m AS (SELECT *, regexp_replace(p, '[^a-z]', '', 'g') n FROM u)
SELECT o_orderkey, CASE k WHEN 0 THEN 'github.com/' || n || '/' || o_orderkey WHEN 1 THEN 'github.com/' || n || '/r' || o_orderkey
  WHEN 2 THEN 'gitlab.com/' || n || '/sub/r' || o_orderkey WHEN 3 THEN 'sourceforge.net/' || n || o_orderkey ELSE NULL END AS key FROM m
""")
def repo_key(load):
    n = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "")
    k = F.pmod("o_orderkey", F.lit(6))
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.GitHub.com/"), n, F.lit("/"), "o_orderkey", F.lit(".git")))
        .when(k == 1, F.concat(F.lit("git@github.com:"), n, F.lit("/r"), "o_orderkey", F.lit(".git")))
        .when(k == 2, F.concat(F.lit("git+https://gitlab.com/"), n, F.lit("/Sub/r"), "o_orderkey", F.lit("/-/tree/main")))
        .when(k == 3, F.concat(F.lit("sourceforge.net/projects/"), n, "o_orderkey", F.lit("/files")))
        .when(k == 4, F.concat(F.lit("https://github.com/"), n))
        .otherwise(F.concat(F.lit("https://example.org/"), n, F.lit("/x")))
    )
    return load("orders").select("o_orderkey", t.repo_key(url).alias("key"))


@query("package_id", r"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pypi' ELSE 'cran' END AS ecosystem, CASE WHEN p_size % 2 = 0 THEN lower(regexp_replace(replace(p_name, ' ', '_.'), '[-_.]+', '-', 'g')) ELSE lower(trim(replace(p_name, ' ', '_.'))) END AS package FROM part")
def package_id(load):
    eco = F.when(F.col("p_size") % 2 == 0, F.lit("pypi")).otherwise(F.lit("cran"))
    return load("part").select("p_partkey", eco.alias("ecosystem"), t.package_id(eco, F.replace("p_name", F.lit(" "), F.lit("_."))).alias("package"))


@query("doi_norm", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'doi:10.1234/x' || o_orderkey WHEN 1 THEN 'pmcid:pmc' || o_orderkey ELSE 'other:v ' || o_orderkey END AS identifier FROM orders")
def doi_norm(load):
    k = F.pmod("o_orderkey", F.lit(3))
    kind = F.when(k == 0, F.lit("doi")).when(k == 1, F.lit("pmcid")).otherwise(F.lit("other"))
    value = F.when(k == 0, F.concat(F.lit("https://dx.doi.org/10.1234/X"), "o_orderkey")).when(k == 1, F.concat(F.lit("https://x.org/PMC"), "o_orderkey", F.lit("/"))).otherwise(F.concat(F.lit(" V%20"), "o_orderkey"))
    return load("orders").select("o_orderkey", t.identifier(kind, value).alias("identifier"))


@query("ids_in_text", r"""
SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all('see PMC' || (10000 + doc_id) || ', 10.1234/' || source || '. ' || text, 'PMC[0-9]{5,}|10\.[0-9]{4,9}/[^\s"<>]+'),
  lambda x: rtrim(lower(x), '.,;)')))) AS ids FROM documents
""")
def ids_in_text(load):
    text = F.concat(F.lit("see PMC"), F.col("doc_id") + 10000, F.lit(", 10.1234/"), "source", F.lit(". "), "text")
    return load("documents").select("doc_id", t.ids_in_text(text).alias("ids"))


@query("fold_variants", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS fold FROM part")
def fold_variants(load):
    return load("part").select("p_partkey", t.alnum_fold(F.concat_ws(" ", "p_name", "p_brand")).alias("fold"))


_STOP = ", ".join(f"'{w}'" for w in t.CONTEXT_STOPWORDS)
_STEM = "CASE " + " ".join(f"WHEN ends_with(x, '{e}') AND length(x) - {len(e)} >= 4 THEN x[:-{len(e) + 1}]" for e in t.STEM_ENDINGS) + " ELSE x END"


@query("context_tokens", f"SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda x: x NOT IN ({_STOP})), lambda x: {_STEM}) AS tokens FROM documents")
def context_tokens(load):
    return load("documents").select("doc_id", t.context_tokens(F.col("text")).alias("tokens"))


@query("kwic", f"""
WITH h AS (SELECT doc_id, text, instr(text, 'the') - 1 s FROM documents WHERE instr(text, 'the') > 0)
SELECT doc_id, {_COLLAPSED.format("substr(text, greatest(s - 250, 0) + 1, s - greatest(s - 250, 0)) || '[[' || substr(text, s + 1, 3) || ']]' || substr(text, s + 4, 250)")} AS context FROM h
""")
def kwic(load):
    d = load("documents").withColumn("s", F.instr("text", "the") - 1).where("s >= 0")
    return d.select("doc_id", t.kwic(F.col("text"), F.col("s"), F.col("s") + 3).alias("context"))


@query("align_unique", "SELECT doc_id, CASE WHEN instr(text, word) > 0 AND instr(substr(text, instr(text, word) + 1), word) = 0 THEN instr(text, word) - 1 END::INTEGER AS start FROM (SELECT doc_id, text, string_split(text, ' ')[3] word FROM documents) WHERE word <> ''")
def align_unique(load):
    d = load("documents").withColumn("word", F.get(F.split("text", " "), F.lit(2))).where("word <> ''")
    return d.select("doc_id", t.only_occurrence("text", "word").cast("int").alias("start"))


_PATTERNS = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for n, p in segments.SECTION_PATTERNS) + " END"


@query("sections", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Abstract' || chr(10) || text || chr(10) || 'References' || chr(10) || '[1] x' ELSE text END AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k FROM d),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a0 FROM l),
m AS (SELECT doc_id, length(text) n, a0, {_PATTERNS.replace("(h,", "(substr(lower(trim(line, ' ' || chr(9) || chr(13))), 1, 80),")} kind FROM o),
b AS (SELECT doc_id, n, a0 s, kind FROM m WHERE kind IS NOT NULL UNION ALL SELECT doc_id, length(text), -1, 'unknown' FROM d),
r AS (SELECT doc_id, kind, greatest(s, 0) s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) e FROM b),
k AS (SELECT *, count(*) FILTER (kind <> 'unknown' AND e > s) OVER (PARTITION BY doc_id) named FROM r)
SELECT doc_id, kind AS section, s::BIGINT AS start, e::BIGINT AS "end" FROM k WHERE (e > s AND kind <> 'unknown') OR (named = 0 AND kind = 'unknown')
""")
def sections(load):
    d = load("documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Abstract\n"), "text", F.lit("\nReferences\n[1] x"))).otherwise(F.col("text")))
    return segments.sections(d.select("doc_id", "text"))


@query("sentences")
def sentences(load):
    return segments.sentences(load("documents").select("doc_id", "text"))


@query("chunks")
def chunks(load):
    return segments.chunks(load("documents").select("doc_id", "text"))


@query("token_windows", """
WITH d AS (SELECT doc_id, len(string_split(text, ' ')) n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, n, 48)) a FROM d)
SELECT doc_id, a::INTEGER AS start, least(a + 64, n)::INTEGER AS "end" FROM s WHERE a = 0 OR a + 16 < n
""")
def token_windows(load):
    d = load("documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return segments.token_windows(d, "n", 64, 16).select("doc_id", "start", "end")


@query("window_owner", """
WITH d AS (SELECT doc_id, len(string_split(text, ' ')) n FROM documents),
w AS (SELECT doc_id, n, i, 48 * i s, least(48 * i + 64, n) e FROM (SELECT doc_id, n, unnest(range(greatest(ceil((n - 64) / 48), 0)::BIGINT + 1)) i FROM d)),
t AS (SELECT doc_id, unnest(range(n)) p FROM d),
o AS (SELECT doc_id, p, max_by(i, least(p - s, e - 1 - p) * 1000000 - i) o FROM t JOIN w USING (doc_id) WHERE p >= s AND p < e GROUP BY doc_id, p)
SELECT doc_id, o::INTEGER AS "window", min(p)::INTEGER AS first, max(p)::INTEGER AS last, count(*) AS n FROM o GROUP BY doc_id, o
""")
def window_owner(load):
    """The words of every document that each of its windows owns."""
    d = load("documents").select("doc_id", F.split("text", " ").alias("words")).select("doc_id", F.size("words").alias("size"), "words")
    d = d.select("doc_id", "size", F.posexplode("words").alias("token", "word"))  # sizes before words: a text is split once
    return segments.window_owner(d, 64, 16).groupBy("doc_id", "window").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count("*").alias("n"))


@query("annotation_tasks")
def annotation_tasks(load):
    return segments.annotation_tasks(load("documents").select("doc_id", "text"), "2.1", "h")


@query("article_sentences")
def article_sentences(load):
    d = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"), F.lit(0).alias("start"))
    return segments.sentence_regions(d.where("text <> ''"))
