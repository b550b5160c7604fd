"""URL filters: listed rules first, then association rules mined from labelled URLs with FP-growth.

A URL becomes a set of tokens; FP-growth finds token combinations that go with the bad label; rules under the
confidence or support bound go, and so do rules that a shorter rule covers or that held-out urls speak against. Matching joins
every URL token with an inverted index that holds each rule under its rarest token, then checks the rest of the rule on the row."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.functions import scores
from mentionforge.llm.common import ascii_lower, bounded_sample, free_names, saved, table

#: (host, path, verdict): the list of op1.
LISTED = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BAD = "label=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and path up to ? or #; both empty for null or no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host words, the host's last two labels, path words with digits as '#' (a file ending is one), and
    query keys."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    mark = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("s:"), ascii_lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1)))),
        mark("w:", F.split(host, "[.-]")), mark("p:", F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "[/.]+")),
        mark("q:", F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1))),
        F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
    ))


RULES_DDL = "rule_id string, tokens array<string>, anchor string, n_urls bigint, n_bad bigint, confidence double, support double, lift double"


def mine_rules(labelled: DataFrame, min_lift: float = 1.5, z: float = 3.0, min_support: float = 0.002, min_rows: int = 10, most_rows: int = 200_000, most_tokens: int = 24, folds: int = 5) -> DataFrame:
    """Rules (rule_id, tokens, anchor, n_urls, n_bad, confidence, support, lift) that predict the bad label, from rows (url, bad).

    A url is bad if at least half of its labelled rows are. One in `folds` urls, by hash, is held out; FP-growth mines the others
    for token sets that `min_rows` bad urls, and a share `min_support` of all, hold. A set is a rule if its confidence is
    `min_lift` times the share of bad urls, Wilson's lower bound of it at `z` is over that share, no set of one token less is a
    rule, and the held-out urls that it fits are bad more often than all are.

    Fitting bounds: about `most_rows` labelled urls by hash, urls of at most `most_tokens` tokens; a support bound s then bounds
    the sets by 2^most_tokens / s whatever the size of the table. Unlabelled or null rows are left out; without bad urls there
    are no rules."""
    urls = labelled.where("url is not null and bad is not null").groupBy("url").agg((F.avg(F.col("bad").cast("int")) >= 0.5).alias("bad"))
    held = F.pmod(F.xxhash64("url", F.lit(folds)), F.lit(folds)) == 0
    rows = saved(bounded_sample(urls, "url", most_rows).select("bad", held.alias("held"), url_tokens(F.col("url")).alias("items")).where(F.size("items") <= most_tokens), "baskets")
    n, share = rows.where("not held").agg(F.count("*"), F.avg(F.col("bad").cast("int"))).first()
    if not share:
        return labelled.sparkSession.createDataFrame([], RULES_DDL)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    baskets = rows.where("not held").select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), numPartitions=tasks).fit(baskets.repartition(tasks))
    sets = saved(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("n_bad"))
    rules = bad.join(sets.select(F.col("items").alias("tokens"), F.col("freq").alias("n_urls")).hint("merge"), "tokens")
    rules = rules.withColumn("confidence", F.col("n_bad") / F.col("n_urls")).withColumn("support", F.col("n_bad") / n).withColumn("lift", F.col("confidence") / share)
    least, _ = scores.wilson(F.col("n_bad"), F.col("n_urls"), z)
    rules = saved(rules.where((F.col("lift") >= min_lift) & (least > share)).withColumn("rule_id", F.array_join("tokens", " ")), "rules")
    shorter = rules.select(F.col("rule_id").alias("short_id"))
    less = rules.select("rule_id", F.explode(F.transform("tokens", lambda x: F.array_join(F.array_remove("tokens", x), " "))).alias("short_id"))
    covered = less.join(shorter, "short_id", "left_semi").select("rule_id").distinct()
    rules = rules.join(covered, "rule_id", "left_anti")
    single = sets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    anchors = rules.select("rule_id", F.explode("tokens").alias("token")).join(single, "token")
    anchors = anchors.groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    rules = rules.join(anchors, "rule_id").select(*[c.split()[0] for c in RULES_DDL.split(", ")])
    tried = _fitting(rows.where("held").select("bad", F.col("items").alias("_t")), rules).groupBy("rule_id").agg(F.avg(F.col("bad").cast("int")).alias("_held"))
    return saved(rules.join(tried.where(F.col("_held") > share).select("rule_id"), "rule_id", "left_semi"), "rules")


def _fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with their tokens _t) by every rule that fits them, found by the rules' rarest tokens."""
    hits = rows.withColumn("anchor", F.explode("_t")).join(rules, "anchor")
    return hits.where(F.size(F.array_except("tokens", "_t")) == 0)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a mined rule fits: (url, mined_rule, mined_confidence), the surest rule each."""
    hits = _fitting(urls.where("url is not null").select("url").distinct().withColumn("_t", url_tokens(F.col("url"))), rules)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "support", F.col("rule_id"))).alias("b"))
    return best.select("url", F.col("b.rule_id").alias("mined_rule"), F.col("b.confidence").alias("mined_confidence"))


def url_filter(pages: DataFrame, rules: DataFrame, listed=LISTED) -> DataFrame:
    """pages (with a column url) plus host, path, rule, verdict, mined_rule and mined_confidence, which replace columns of those
    names; others may have any name.

    Null or malformed urls have empty host and path and are allowed; urls are read whole, however long; repeated rows keep a row
    each; an empty table gives none; the join is on the distinct url, and a url that a third of the rows hold is one row on the
    mined side."""
    host, path = host_and_path(F.col("url"))
    out = pages.drop("host", "path", "rule", "verdict", "mined_rule", "mined_confidence").join(match_rules(pages, rules), "url", "left")
    out = out.withColumn("host", host).withColumn("path", path)
    (r,) = free_names(out.columns, "_r")
    out = out.withColumn(r, listed_rule(F.col("host"), F.col("path"), listed))
    mined = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", F.col(r)["rule"]).withColumn("verdict", F.coalesce(F.col(r)["verdict"], mined)).drop(r)


def op1(spark, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the number in its url's path; its labels are the page's: low quality or toxic is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#0-9]*([0-9]{1,18})', 1) as bigint)").alias("doc_id"))
    rules = mine_rules(shown.join(labels.hint("merge"), "doc_id").select("url", "bad"))
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
