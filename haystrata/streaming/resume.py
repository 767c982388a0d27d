"""Incremental work: tasks already done, cached contexts, append-only results with a checkpoint."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_KEY = ["language", "repo", "name"]


def unfinished(tasks: DataFrame, outputs: DataFrame, key: list[str] = TASK_KEY) -> DataFrame:
    """Tasks whose key is not in the outputs; nulls are equal to nulls."""
    done = outputs.select(*[F.col(c).alias(f"__hs_done_{i}") for i, c in enumerate(key)])
    same = [tasks[c].eqNullSafe(done[f"__hs_done_{i}"]) for i, c in enumerate(key)]
    return tasks.join(done, same, "left_anti")


def cached_or_new(tasks: DataFrame, cache: DataFrame, compute, key: str = "cache_id") -> DataFrame:
    """Rows of the cache for the tasks it has, and compute(tasks) for the others. Both with the cache's columns."""
    ready = cache.join(tasks.select(key), key, "left_semi")
    return ready.unionByName(compute(tasks.join(cache.select(key), key, "left_anti")).select(*ready.columns))


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that start here keep their state in RocksDB, on disk and by changes, so a batch costs what its own keys cost."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def append_results(spark: SparkSession, source: str, ddl: str, target: str, checkpoint: str, key: list[str] = TASK_KEY, done: DataFrame | None = None, event_time: str | None = None, expire: str | None = None) -> None:
    """Run through the new JSON lines in source and append those whose key was never seen to target, once each; null keys are keys. Rerun at any time.

    The keys are the stream's state, so a batch reads neither target nor old lines, and target's files count only when their batch is complete. done: rows whose keys are finished elsewhere.
    event_time, expire: a key is forgotten so long after its row's time (a later row with it is appended again), which bounds the state.
    """
    rows = spark.readStream.schema(ddl).json(source)
    if done is not None:
        rows = unfinished(rows, done, key)
    rows = rows.withWatermark(event_time, expire).dropDuplicatesWithinWatermark(key) if event_time and expire else rows.dropDuplicates(key)
    with rocksdb_state(spark):
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
