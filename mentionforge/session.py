"""Sessions, and the way Python functions of this package reach executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "mentionforge", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; callers pass master, memory and partition settings."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that they need no install of their own."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="mentionforge-"), "mentionforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def give_back() -> None:
    """Hands memory that this process has freed back to the system: a worker lives on after its task, and what it once held would
    count against the executor while others work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(function: Callable) -> Callable:
    """A function from batches to batches that gives memory back when a task has read its result."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(giving_back(function), schema)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan of fewer tasks than there are cores, dealt out over them; larger ones as they are. For scans and
    projections of them only: the number of tasks is read off the plan."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if tasks >= cores else scan.repartition(cores)


#: Bytes of a scanned table, as files hold them, that one task is dealt.
TASK_BYTES = 8 << 20


def dealt(scan: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """A table scan dealt out by its keys over tasks whose number follows its size, so that what one of them sorts and holds stays the
    same as the table grows. For scans and projections of them only: the size is read off the plan."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, -(-size // (task_bytes or TASK_BYTES))), *keys)
