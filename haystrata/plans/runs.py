"""Whole runs on files: evaluate a model on a dataset, score stored outputs. Rerun at any time: finished tasks are not asked again."""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata import schema
from haystrata.functions import text
from haystrata.functions.provider import Provider, backend
from haystrata.operators import context, score
from haystrata.plans import evaluate
from haystrata.sources import readers, sinks
from haystrata.streaming import replies
from haystrata.streaming.resume import TASK_KEY, unfinished


def _held(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table that read() gives, None where its path does not exist yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def provider_maker(model: str, backend_name: str | None = None, base_url: str | None = None, code_context_size: int = 16384, tensor_parallel_size: int = 1, trust_remote_code: bool = False, attn_implementation: str | None = None) -> Callable[[], Provider]:
    """What makes a worker's provider. Without a name: 'openai' if there is a base_url, else 'vllm'."""
    cls = backend(backend_name, base_url)
    name = backend_name or ("openai" if base_url else "vllm")
    more = {"openai": {"base_url": base_url}, "vllm": {"context_size": code_context_size, "tensor_parallel_size": tensor_parallel_size}, "hf": {"trust_remote_code": trust_remote_code, "attn_implementation": attn_implementation}}.get(name, {})
    return cls if name == "echo" else lambda: cls(model, **more)


def build_or_read_tasks(repos: DataFrame, folder: str | None, code_context_size: int, languages: list[str] | None, clean_mode: str, count=context.space_tokens) -> DataFrame:
    """Tasks of the dataset's needles. With a folder, tasks kept there are read and only those of further needles are built and added."""
    needles, files = readers.needles_of(repos), readers.files_of(repos)
    if languages:
        needles = needles.where(F.col("language").isin(languages))
    ordered = evaluate.ordered_files(files, readers.deps_of(repos))
    if folder is None:
        return evaluate.build_tasks(needles, ordered, code_context_size, languages, clean_mode, count)
    path = f"{folder}/ntoken={code_context_size}/clean={clean_mode}"
    kept = _held(lambda: repos.sparkSession.read.parquet(path))
    todo = needles if kept is None else unfinished(needles, kept)
    evaluate.build_tasks(todo, ordered, code_context_size, languages, clean_mode, count).write.mode("append").parquet(path)
    # one row a task, even if two runs have built it
    return repos.sparkSession.read.parquet(path).join(needles.select(*TASK_KEY), TASK_KEY, "left_semi").dropDuplicates(TASK_KEY)


def evaluate_model(
    spark: SparkSession, model: str, base_url: str | None = None, backend_name: str | None = None, tensor_parallel_size: int = 1, code_context_size: int = 16 * 1024, max_new_tokens: int = 1024,
    result_dir: str = "results", languages: list[str] | None = None, caching: bool = True, system_message: str | None = None, dataset: str | None = None, clean_mode: str = "none",
    make: Callable[[], Provider] | None = None, count=context.space_tokens, eval_ignore_comments: bool = False, trust_remote_code: bool = False, attn_implementation: str | None = None, flush_tasks: int = 256,
) -> str:
    """Asks the model for every task that the result folder has no output of, once, in batches of about flush_tasks (streaming/replies.py), scores all
    outputs and returns the printed table. make: another provider than the backend's. Cleaned contexts are scored without comments."""
    repos = readers.read_dataset(spark, readers.dataset_path(dataset))
    make = make or provider_maker(model, backend_name, base_url, code_context_size, tensor_parallel_size, trust_remote_code, attn_implementation)
    out = sinks.output_name(result_dir, code_context_size, model)
    tasks = build_or_read_tasks(repos, f"{result_dir}/tasks" if caching else None, code_context_size, languages, clean_mode, count)
    done = _held(lambda: readers.read_jsonl(spark, out, schema.OUTPUT))
    kept = [f.name for f in spark.createDataFrame([], schema.OUTPUT).schema]
    replies.ask_all(evaluate.with_prompt(tasks), f"{out}.run", out, make, TASK_KEY, done, flush_tasks, max_new_tokens, system_message, keep=kept)
    return score_file(spark, out, eval_ignore_comments or clean_mode != "none", dataset)


def score_file(spark: SparkSession, model_output_path: str, ignore_comments: bool = False, dataset: str | None = None, train_size: str | None = None, mode: str = "backup") -> str:
    """Scores stored outputs against the dataset's needles, writes the score document beside them and returns the printed table.

    Outputs are one file or a folder of JSON lines; of outputs of the same task one counts. No outputs give a table of headings.
    """
    repos = readers.read_dataset(spark, readers.dataset_path(dataset))
    outputs = readers.read_jsonl(spark, model_output_path, schema.OUTPUT).dropDuplicates(TASK_KEY)
    rows, scores = evaluate.score_all(outputs, readers.needles_of(repos), readers.files_of(repos), ignore_comments)
    stem = os.path.basename(model_output_path.rstrip("/")).removesuffix(".jsonl")
    named = spark.range(1).select(text.model_name(F.lit(stem)).alias("m")).select("m", text.train_context("m").alias("t")).first()
    place = F.struct(F.col("needle_token_start").alias("token_start"), F.col("needle_token_end").alias("token_end"))
    results = rows.select("language", "repo", "name", F.col("position_ratio").alias("needle_position"), "is_best_similar", "best_similar_score", "best_target", place.alias("position"))
    document = score.score_document(named["m"], train_size or named["t"], scores, results, datetime.datetime.now().isoformat())
    sinks.save_scores(document, sinks.scores_name(model_output_path.rstrip("/")), mode)
    return sinks.score_table(score.pivot_scores(scores))
