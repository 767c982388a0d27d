"""Replies as a stream of task batches: every task is planned once and asked once, and a run that is stopped keeps its whole batches.

A run's folder has the plan (Parquet files of a few tasks each), the stream's checkpoint, and the replies, a folder of JSON lines for each batch. The
stream takes so many of the plan's files a batch, and a batch writes its replies over its own folder: one that was cut off is asked again when the run goes on, no other is.
A task that the plan holds is never planned again, null keys included, so calling ask_all() with more tasks asks only those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame

from haystrata.functions.provider import Provider, run_provider
from haystrata.streaming.resume import TASK_KEY, unfinished


class Enough(Exception):
    """As many batches as asked for were taken."""


def plan_tasks(tasks: DataFrame, folder: str, key: list[str] = TASK_KEY, done: DataFrame | None = None, file_tasks: int = 16) -> None:
    """Adds the tasks that neither the plan nor done has, one for each key, in files of at most file_tasks."""
    todo = tasks.dropDuplicates(key)
    for held in (_held(tasks, f"{folder}/plan"), done):
        todo = todo if held is None else unfinished(todo, held, key)
    todo.write.mode("append").option("maxRecordsPerFile", file_tasks).parquet(f"{folder}/plan")


def _held(tasks: DataFrame, path: str) -> DataFrame | None:
    try:
        return tasks.sparkSession.read.schema(tasks.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ask_planned(tasks: DataFrame, folder: str, out: str, ask: Callable[[DataFrame], DataFrame], batch_files: int, batches: int | None = None) -> int:
    """Runs ask() over the planned tasks that no batch has had yet and says how many batches it took. tasks names the columns only; batches: stop after so many."""
    spark, took = tasks.sparkSession, 0

    def one(batch: DataFrame, number: int) -> None:
        nonlocal took
        if batch.isEmpty():
            return
        if took == batches:
            raise Enough  # before anything is asked, so this batch is the next call's first
        ask(batch).write.mode("overwrite").json(f"{out}/batch-{number:08d}")
        took += 1

    stream = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", batch_files).parquet(f"{folder}/plan")
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Enough.__name__ not in str(e) or took != batches:
            raise
    return took


def ask_all(
    tasks: DataFrame, folder: str, out: str, make: Callable[[], Provider], key: list[str] = TASK_KEY, done: DataFrame | None = None, flush_tasks: int = 256, max_tokens: int = 1024,
    system_msg: str | None = None, temperature: float = 0.0, keep: list[str] | None = None, batches: int | None = None,
) -> int:
    """Asks for every task of tasks (key, prompt, …) that was not asked before, about flush_tasks at a time, all cores at once, and appends the rows with output to JSON lines under out.

    done: tasks that have replies from elsewhere. keep: the columns to write. Returns the batches that this call took. A failing task of Spark's is tried again
    by itself; a call that dies leaves at most one batch to be asked again.
    """
    slots = max(1, tasks.sparkSession.sparkContext.defaultParallelism)
    size = max(1, flush_tasks // slots)
    plan_tasks(tasks, folder, key, done, size)

    def ask(batch: DataFrame) -> DataFrame:
        rows = run_provider(batch, make, max_tokens, system_msg, temperature=temperature)
        return rows.select(*keep) if keep else rows

    return ask_planned(tasks, folder, out, ask, max(1, flush_tasks // size), batches)
