"""A corpus pipeline of five stages over documents: toxicity, near-duplicates, repeated passages, secrets, packing.

documents has the columns doc_id, text, lang, source and n_chars; more columns are carried along, whatever their names, up to
the last stage. Null and empty texts are kept by every stage and packed as an end id; rows without id are kept, lose no
passage and are linked with nothing; repeated rows stay or go together; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentionforge.llm import minhash_dedup, packing, secret_scan, substring_dedup, toxicity
from mentionforge.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, fitted to labels, scores under 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component linked at 0.8 over five-word shingles."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of 50-byte strings that an earlier one holds."""
    return substring_dedup.drop_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with live-looking credentials replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024."""
    return packing.digest(packing.pack(docs, special=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]
#: Token ids and a fitted model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
