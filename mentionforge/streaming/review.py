"""Review as a stream, and snapshots that it starts from: decisions arrive, each task's state is kept by Spark, a row comes out for each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mentionforge.operators import review_log as rl
from mentionforge.session import ship
from mentionforge.sources import files as fs

OUT_DDL = "task_id string, seq bigint, decision_id string, outcome string, revision bigint, task string, annotation string, status string"
TABLES = ("items", "original_items", "decisions", "occurrences", "coverage", "aliases", "alias_groups")


class _Review(StatefulProcessor):
    """A task's item and the ids of its applied decisions are its state; a batch's decisions are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "task string, annotation string, revision bigint, status string")
        self.seen = handle.getMapState("seen", "decision_id string", "mark string")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        row = initial.iloc[0]
        self.state.update((row["task"], row["annotation"], int(row["revision"]), row["status"]))
        for ident, mark in json.loads(row["seen"] or "{}").items():
            self.seen.updateValue((ident,), (mark,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        given = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.seq, str(r.decision_id), str(r.payload)))
        held = self.state.get() if self.state.exists() else None
        task = rl.Task(*held) if held else None
        out = []
        for r in given:
            if task is None:
                outcome = "UNKNOWN_TASK"
            else:
                if self.seen.containsKey((r.decision_id,)):
                    task.seen[r.decision_id] = self.seen.getValue((r.decision_id,))[0]
                outcome = task.decide(r.payload) if r.payload is not None else "INVALID_DECISION"
                if outcome == "applied":
                    self.seen.updateValue((r.decision_id,), (task.mark(r.decision_id),))
            out.append((key[0], r.seq, r.decision_id, outcome, task.revision if task else None, None, None, None))
        if task is not None:
            state = (rl.canonical(task.task), rl.canonical(task.annotation), task.revision, task.status)
            self.state.update(state)
            out.append((key[0], None, None, None, task.revision, state[0], state[1], state[3]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT_DDL.split(", ")]).astype({"seq": "Int64", "revision": "Int64"})

    def close(self) -> None:
        pass


@F.pandas_udf(T.StringType())
def _marks(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: rl.digest(json.loads(p)))


def review_stream(decisions: DataFrame, items: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """A stream of decisions (decision_id, task_id, seq, payload) as rows (OUT_DDL): one for each decision with its outcome, and one for each
    task that a batch touched, with its annotation then. items (ITEM_DDL) are where it starts, and applied the decisions that
    led there, which are told again without effect. Needs the RocksDB state store. Across tasks decision ids are not compared."""
    ship(items.sparkSession)
    marks = items.select("task_id", F.lit("{}").alias("seen"))
    if applied is not None:
        told = applied.select("task_id", "decision_id", _marks("payload").alias("mark")).groupBy("task_id").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("decision_id", "mark")))).alias("seen"))
        marks = items.select("task_id").join(told, "task_id", "left").withColumn("seen", F.coalesce("seen", F.lit("{}")))
    start = items.join(marks, "task_id").select("task_id", "task", "annotation", F.col("revision").cast("long").alias("revision"), "status", "seen")
    return decisions.select("task_id", "seq", "decision_id", "payload").groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Review(), outputStructType=OUT_DDL, outputMode="Update", timeMode="None", initialState=start.groupBy("task_id"))


def latest_items(told: DataFrame, items: DataFrame) -> DataFrame:
    """Items after what a stream told, with those that it did not touch as they were."""
    last = told.where("annotation is not null").groupBy("task_id").agg(F.max_by(F.struct("task", "annotation", "revision", "status"), "revision").alias("s")).select("task_id", "s.*")
    return items.join(last.select("task_id"), "task_id", "left_anti").select(*last.columns).unionByName(last)


def write_snapshot(original: DataFrame, items: DataFrame, decisions: DataFrame, path: str, role: str) -> dict[str, str]:
    """Writes a snapshot of one role: items, the ones that review began with, the applied decisions between them, and what reference_tables
    read off the items. Returns the digests of its tables. A snapshot with problems is refused, and so is a role that is held out."""
    if role not in ("train", "dev", "demo"):
        raise fs.Refused(f"SPLIT_NOT_PERMITTED: {role}")
    if bad := rl.snapshot_problems(items, decisions, role).select("code").distinct().orderBy("code").limit(10).collect():
        raise fs.Refused(", ".join(r[0] for r in bad))
    tables = {"items": items, "original_items": original, "decisions": decisions, **rl.reference_tables(items)}
    for name, df in tables.items():
        fs.write_once(df, f"{path}/{name}")
    return {name: fs.content_digest(df) for name, df in tables.items()}


def read_snapshot(spark: SparkSession, path: str, role: str, digests: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """original items, items and decisions of a snapshot: its tables are those that were written, it has no problem, its side tables are what
    its items say, and its decisions lead from where they began to where they are."""
    schemas = {"items": rl.ITEM_DDL, "original_items": rl.ITEM_DDL, "decisions": "decision_id string, task_id string, seq bigint, payload string"}
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    items, original, decisions = (read(name, schemas[name]) for name in ("items", "original_items", "decisions"))
    if bad := rl.snapshot_problems(items, decisions, role).select("code").distinct().orderBy("code").limit(10).collect():
        raise fs.Refused(", ".join(r[0] for r in bad))
    tables = {"items": items, "original_items": original, "decisions": decisions, **rl.reference_tables(items)}
    for name, df in tables.items():
        if fs.content_digest(read(name, df.schema)) != digests[name]:
            raise fs.Refused(f"MISSING_OR_CHANGED: {name}")
        if fs.content_digest(df) != digests[name]:
            raise fs.Refused(f"SNAPSHOT_SIDECAR_MISMATCH: {name}")
    again, _ = rl.fold_log(original, decisions)
    if again.exceptAll(items).limit(1).count() or items.exceptAll(again).limit(1).count():
        raise fs.Refused("SNAPSHOT_HISTORY_MISMATCH")
    return original, items, decisions
