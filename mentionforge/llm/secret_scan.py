"""Secret scans with corpus-wide ownership: candidates are found text by text, hashed, and counted by distinct owners and
repositories, which separates examples that are copied widely from credentials that one owner holds."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import free_names, saved, table
from mentionforge.session import map_in_arrow, spread

#: Kinds in the order in which spans that start together are listed; the first three are the base ones.
KINDS = ("assign", "access", "hex", "opaque")
#: The base patterns. The lengths below drop matches that are too short.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no look
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
LEAST = {"assign": 12, "access": 18}
#: A candidate is copied if so many owners, or so many repositories of whatever owners, hold it.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 4


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base matches, by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long runs of high entropy with letters of both cases and digits, outside the base spans (which are in order of start)."""
    out, k, reached = [], 0, 0
    for m in OPAQUE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reached, k = max(reached, taken[k][2]), k + 1
        s = m[0]
        if reached <= m.start() and re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s) and entropy(s) >= 3.5:
            out.append((m.start(), 3, m.end(), s))
    return out


def label_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            counts, digests, lists = ([], [], []), [], []
            for t in part.column(4):
                text = t.as_py() or ""
                spans = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(label_of(spans).encode()).hexdigest())
                lists.append([{"start": a, "kind": k, "end": b, "digest": hashlib.sha256(s.encode()).digest()} for a, k, b, s in spans + opaque_spans(text, spans)])
            cols = [*(part.column(k) for k in range(4)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, found)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


_SCHEMA = "doc_id bigint, text_hash bigint, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<start:int,kind:int,end:int,digest:binary>>"


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, base digest, and `secrets`, an array of (start, kind, end, live).

    A repository is the pair of owner and repository column. A candidate that `copied_owners` owners or more hold, or
    `copied_repositories` repositories or more, is copied; others are live. Base spans are always listed; opaque ones only if live. Null text counts as empty, null owners and
    repositories are one unknown owner or repository, repeated rows get a row each, and rows without id are scanned too."""
    t = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), t.alias("text"))
    scanned = saved(map_in_arrow(rows, _scan, _SCHEMA), "scanned")
    each = scanned.where(F.size("found") > 0).select("doc_id", "text_hash", "owner", "repository", F.explode("found").alias("f"))
    held = each.select(F.col("f.digest").alias("digest"), "owner", "repository").distinct()
    owners = held.groupBy("digest").agg(F.count_distinct("owner").alias("n_owners"), F.count("*").alias("n_repositories"))
    marked = each.select("doc_id", "text_hash", "f", F.col("f.digest").alias("digest")).distinct().join(owners, "digest")
    marked = marked.withColumn("live", (F.col("n_owners") < copied_owners) & (F.col("n_repositories") < copied_repositories)).where("live or f.kind < 3")
    listed = marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct(F.col("f.start").alias("start"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end"), "live"))).alias("secrets"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    out = scanned.join(listed, on, "left").select("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "secrets")
    return out.withColumn("secrets", F.coalesce("secrets", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")))


def op9(spark, sf_dir: str) -> DataFrame:
    s = scan_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    live = F.size(F.filter("secrets", lambda x: x["live"])).cast("long")
    return s.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), live.alias("n_live"), (F.size("secrets") - live).alias("n_copied"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", **options) -> DataFrame:
    """docs with every live secret's span replaced by mark (overlapping spans by one), n_chars set anew where it exists. Other
    columns may have any name; what happens to odd rows is said at scan_secrets."""
    i, h, found = free_names(docs.columns, "_id", "_hash", "_live")
    s = scan_secrets(docs, **options)
    live = s.where(F.exists("secrets", lambda x: x["live"])).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.filter("secrets", lambda x: x["live"]).alias(found)).dropDuplicates([i, h]).hint("merge")  # grows with the table
    joined = docs.join(live, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = F.greatest(acc["at"], x["start"])
        text = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(fresh, x["end"]).alias("at"), text.alias("out"))

    clean = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_FINDERS = (
    ("assign", 0, rf"""(?:{_KEYS})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 12"),
    ("access", 1, "(AKIA[A-Z0-9]+)", 1, "length(v) >= 18"),
    ("hex", 2, "([0-9a-f]{16,})", 1, "true"),
    ("opaque", 3, "([A-Za-z0-9+/_=-]{24,})", 1, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND -list_sum(list_transform(map_values(list_aggregate(string_split(v, ''), 'histogram')), lambda c: c / length(v) * log2(c / length(v)))) >= 3.5"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT doc_id, source, lang, '{name}' kind, {rank} rk, v, p0::BIGINT s, (p0 + length(mt))::BIGINT e FROM (
  SELECT doc_id, source, lang, mt, v, sum(length(pc)) OVER w + sum(length(mt)) OVER w - length(mt) p0 FROM (
    SELECT doc_id, source, lang, unnest(a) mt, unnest(b) v, unnest(c[1:len(a)]) pc, generate_subscripts(a, 1) k FROM (
      SELECT doc_id, source, lang, regexp_extract_all(t, '{pattern}', 0) a, regexp_extract_all(t, '{pattern}', {g}) b, regexp_split_to_array(t, '{pattern}') c FROM d) WHERE len(a) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE {ok})"""
    for name, rank, pattern, g, ok in _FINDERS
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') source, coalesce(lang, '') lang, coalesce(text, '') t FROM documents), f AS ({_FOUND}),
o AS (SELECT * FROM f WHERE rk < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.rk < 3 AND b.s < f.e AND f.s < b.e)),
n AS (SELECT v, count(DISTINCT source) < {COPIED_OWNERS} AND count(DISTINCT (source, lang)) < {COPIED_REPOSITORIES} live FROM o GROUP BY v), l AS (SELECT * FROM o JOIN n USING (v) WHERE rk < 3 OR live),
g AS (SELECT doc_id, count(*) FILTER (rk = 0) a, count(*) FILTER (rk = 1) b, count(*) FILTER (rk = 2) c, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rk) FILTER (rk < 3) base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rk) sp, count(*) FILTER (live) x, count(*) FILTER (NOT live) y FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT n_assign, coalesce(b, 0)::BIGINT n_access, coalesce(c, 0)::BIGINT n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(sp, '') spans,
  coalesce(x, 0)::BIGINT n_live, coalesce(y, 0)::BIGINT n_copied
FROM d LEFT JOIN g USING (doc_id)
"""
