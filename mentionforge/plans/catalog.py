"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mentionforge.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXTS = frozenset(("documents", "pages"))


def query(name: str, sql: str | None = None):
    """Registers (load) -> DataFrame under a name, where load reads a table of the folder, with the SQL that DuckDB runs."""

    def keep(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def load(table: str) -> DataFrame:
                scan = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                return spread(scan) if table in TEXTS else scan  # texts cost more to work on than to move

            return build(load)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name-matching baseline over the catalogue."""
    return QUERIES["fast_text_match"](spark, sf_dir)


from mentionforge.plans import annotating, contracting, corpus, evaluation, importing, linking, logging, mapping, predicting, reviewing, sequences, splitting, summarizing, supervising, texts  # noqa: E402,F401  they register
