"""Sinks: versioned tables, JSON lines, score documents with backup, printed tables."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder for files that all executors read: in spark.checkpoint.dir, else in the SparkContext's checkpoint folder. A temporary one, removed at exit, only where both are unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if base:
        return f"{base.rstrip('/')}/haystrata-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="haystrata-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and what reads it twice reads the same."""
    path = work_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def output_name(folder: str, context_size: int, model: str) -> str:
    return f"{folder}/ntoken_{context_size}/{model.replace('/', '_slash_')}.jsonl"


def scores_name(output: str) -> str:
    return output.removesuffix(".jsonl") + "-SCORES.json"


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """A new version of a table; versions are never overwritten, so a stage can read one while it writes the next."""
    path = f"{folder}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def append_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def obfuscate_dataset(repos: DataFrame, path: str, obfuscate) -> str:
    """The dataset with obfuscate(content, language) in place of every file's content, as JSON rows by the side of path; returns where."""
    files = repos.select("language", "repo_ord", F.explode("content").alias("path", "content")).withColumn("content", obfuscate("content", "language"))
    one = files.groupBy("language", "repo_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "content")))).alias("content"))
    out = obfuscated_name(path)
    repos.drop("content").join(one, ["language", "repo_ord"], "left").write.mode("error").json(out)
    return out


def save_scores(document: dict, path: str, mode: str = "backup") -> bool:
    """Write a score document. An existing one is moved to the first free .bak name (backup), kept (ignore) or an error."""
    if os.path.exists(path):
        if mode == "ignore":
            return False
        if mode == "error":
            raise FileExistsError(path)
        name = path + ".bak"
        while os.path.exists(name):
            name += ".bak"
        os.rename(path, name)
    with open(path, "w") as f:
        json.dump(document, f)
    return True


def obfuscated_name(path: str) -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}-obfuscated{ext}"


def score_table(pivoted: DataFrame) -> str:
    """A printed table of pass rates: a row a scope, 'all' starred, percent with one decimal, ^ at a threshold's highest and _ at its lowest scope."""
    rows = [r.asDict() for r in pivoted.orderBy(F.col("scope") != "all", "scope").collect()]  # a row a language
    cols = [c for c in pivoted.columns if c != "scope"]
    lines = ["\t".join(["scope", *cols])]
    for r in rows:
        cells = []
        for c in cols:
            own = [x[c] for x in rows if x["scope"] != "all" and x[c] is not None]
            mark = "" if r[c] is None or r["scope"] == "all" or not own else "^" if abs(r[c] - max(own)) < 0.01 else "_" if abs(r[c] - min(own)) < 0.01 else ""
            cells.append("" if r[c] is None else f"{100 * r[c]:.1f}{mark}")
        lines.append("\t".join([("*" if r["scope"] == "all" else "") + r["scope"], *cells]))
    return "\n".join(lines)
