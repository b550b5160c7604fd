"""Shared helpers of the training-data operators: tables, saved intermediates, samples, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionforge.operators.graph import connected as components
from mentionforge.operators.graph import materialize as saved

__all__ = ["SPACE", "UPPER", "ascii_lower", "bounded_sample", "components", "free_names", "saved", "table", "words_of"]

#: The white space of the word rule [^\x20\x09-\x0D]+, as the inside of a regex class.
SPACE = " \\t\\n\\x0B\\f\\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores added as keep it apart from those that are taken; case does not count."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; an empty array for null."""
    core = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{SPACE}]+"))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at the most, chosen by a hash of the key, one for each key (the least one): for fitting only, the same
    rows in every run. Rows without key are left out."""
    known = df.where(F.col(key).isNotNull())
    n = known.count()
    cut = int((1 << 31) * min(1.0, most / max(1, n)))
    chosen = known.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 31)) < F.lit(cut))
    rest = [c for c in df.columns if c != key]
    if not rest:
        return chosen.distinct()
    return chosen.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col("_r")[c].alias(c) if c != key else F.col(key) for c in df.columns])
