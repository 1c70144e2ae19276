"""Tables written to the shared folder to cut lineage.

A staged table lives under the folder that the session names in
``spark.checkpoint.dir``; a folder of our own is used only where that setting is
absent and all of Spark runs on this machine, as in tests. Staged tables survive the
loss of any executor. What a block stages under :func:`released` goes at its end. What
a query returns may read what it staged, so that stays; :func:`sweep_staged` removes it
once it is old.

A table that is broadcast goes to the driver first. A graph takes more than a hundred
joins, most of them of tables that grow with it, so what is staged is joined with
Spark's bound on broadcasts lowered to ``BROADCAST_BYTES``: their sum is bounded then,
whatever the size of the graph.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only where the session names no checkpoint folder and is local.
FALLBACK_DIR = "/tmp/claimloom-checkpoints"
#: What a table may have to be broadcast in the making of a staged one, unless the session allows less.
BROADCAST_BYTES = 1 << 20
_BOUNDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


class Staged(NamedTuple):
    """A written table and the place that holds it."""

    df: DataFrame
    path: str


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local session without one gets one, any other raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        named = FALLBACK_DIR
    return named.rstrip("/")


#: The places that each open block of :func:`released` has handed out.
_HANDED_OUT: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    if _HANDED_OUT:
        _HANDED_OUT[-1].append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes what is staged inside the block once it ends; nothing lazy that reads it may leave the block."""
    _HANDED_OUT.append([])
    try:
        yield
    finally:
        for path in _HANDED_OUT.pop():
            drop_staged(spark, path)


#: Of each session that stages tables just now: how many, and the settings that come back after the last.
_STAGING: dict[str, tuple[int, dict[str, str | None]]] = {}
_STAGING_LOCK = threading.Lock()


@contextmanager
def few_broadcast(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside the block broadcast small tables alone; blocks may be open on several threads."""
    session = spark._jsparkSession.sessionUUID()
    with _STAGING_LOCK:
        n, before = _STAGING.get(session, (0, {}))
        if not n:
            before = {k: spark.conf.get(k, None) for k in _BOUNDS}
            allowed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
            for k in _BOUNDS:
                spark.conf.set(k, str(min(allowed, BROADCAST_BYTES)))
        _STAGING[session] = n + 1, before
    try:
        yield
    finally:
        with _STAGING_LOCK:
            n, before = _STAGING.pop(session)
            if n > 1:
                _STAGING[session] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, path: str | None = None) -> Staged:
    """Write ``df`` to the shared folder and return the reread table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with few_broadcast(spark):
        df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def stage_told(df: DataFrame, name: str, **totals: Column) -> tuple[Staged, dict]:
    """:func:`stage`, with totals of the rows that the same write takes."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(n) for n, c in totals.items()]), name)
    return staged, seen.get


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep_staged(spark: SparkSession, hours: float = 24) -> int:
    """Removes staged tables last written more than ``hours`` ago, and says how many; for a job that runs beside others, with hours to spare."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/claimloom")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    before = spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    old = [told.getPath() for told in files.listStatus(root) if told.getModificationTime() < before]
    for path in old:
        files.delete(path, True)
    return len(old)
