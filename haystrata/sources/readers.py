"""Sources: datasets in one JSON document, JSON lines, dependency folders, checkouts, result folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata import schema
from haystrata.sources.trees import read_tree


def dataset_path(path: str | None = None, version: str = "latest", cache: str = ".", override: str | None = None) -> str:
    """The dataset to read: an explicit path, else an override that must exist, else the cached version (json or json.gz)."""
    if path:
        return path
    if override:
        if not os.path.exists(override):
            raise FileNotFoundError(override)
        return override
    for name in (f"{cache}/dataset-{version}.json", f"{cache}/dataset-{version}.json.gz"):
        if os.path.exists(name):
            return name
    raise FileNotFoundError(f"no cached dataset {version} in {cache}; put dataset-{version}.json there")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row a repository: language, repo_ord, the seed columns, content, dependency, functions, needles. Never inferred: file paths are map keys."""
    text = spark.read.text(path, wholetext=True)
    langs = text.select(F.explode(F.from_json("value", schema.DATASET)).alias("language", "repos"))
    return langs.select("language", F.posexplode("repos").alias("repo_ord", "r")).select("language", "repo_ord", "r.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    langs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema.SEEDS)).alias("language", "repos"))
    return langs.select("language", F.posexplode("repos").alias("repo_ord", "r")).select("language", "repo_ord", "r.*")


def files_of(repos: DataFrame) -> DataFrame:
    """language, repo, file_ord, path, content of read_dataset()."""
    return repos.select("language", "repo", F.posexplode("content").alias("file_ord", "path", "content"))


def deps_of(repos: DataFrame) -> DataFrame:
    """language, repo, src_ord, src, dst (array) of read_dataset()."""
    return repos.select("language", "repo", F.posexplode("dependency").alias("src_ord", "src", "dst"))


def functions_of(repos: DataFrame) -> DataFrame:
    files = repos.select("language", "repo", F.posexplode("functions").alias("topo_idx", "path", "fns"))
    return files.select("language", "repo", "topo_idx", "path", F.posexplode("fns").alias("fn_ord", "f")).select("language", "repo", "topo_idx", "path", "fn_ord", "f.*")


def needles_of(repos: DataFrame) -> DataFrame:
    """One row a needle with needle_ord and n_needles. Repositories without the key have none."""
    rows = repos.select("language", "repo", F.size("needles").alias("n_needles"), F.posexplode("needles").alias("needle_ord", "n"))
    return rows.select("language", "repo", "n_needles", "needle_ord", "n.*")


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with a given schema; a bad line fails the read."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def read_dependency_dir(spark: SparkSession, folder: str) -> DataFrame:
    """repo, dependency of every *.json in a folder: the first language of a file counts, the later file wins a repository."""
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    repos = text.select("file", F.posexplode(F.map_values(F.from_json("value", schema.DATASET))).alias("lang_ord", "repos")).where("lang_ord = 0")
    rows = repos.select("file", F.posexplode("repos").alias("ord", "r")).select("file", "ord", "r.repo", "r.dependency")
    return rows.groupBy("repo").agg(F.max_by("dependency", F.struct("file", "ord")).alias("dependency"))


def ingest_checkout(spark: SparkSession, root: str, entrypoint: str, suffixes: list[str]) -> DataFrame:
    """path, content of the files of a local checkout under the entry point with one of the suffixes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.expr(f"substring_index(path, '{root.rstrip('/')}/', -1)"), "^/", "")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    return raw.select(path.alias("path"), "content").where(F.col("path").startswith(entrypoint.removeprefix("/")) & keep).select("path", F.decode("content", "UTF-8").alias("content"))


def read_git_tree(spark: SparkSession, checkout: str, sha: str, entrypoint: str = "", suffixes: list[str] | None = None) -> DataFrame:
    """path, content of the files of a commit under the entry point with one of the suffixes (all without any), read from git's objects whatever is checked out (sources/trees.py)."""
    entry = entrypoint.removeprefix("/")
    return read_tree(spark, checkout, sha, [entry] if entry else None, suffixes).select("path", "content")


def read_results(spark: SparkSession, folder: str, min_bytes: int = 10 << 20, ddl: str = schema.OUTPUT) -> DataFrame:
    """Model outputs under a folder in files of at least min_bytes, with their file name."""
    rows = spark.read.schema(ddl).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.withColumn("file", F.col("_metadata.file_path")).where(F.col("_metadata.file_size") >= min_bytes)


def model_context(configs: DataFrame) -> DataFrame:
    """model, train_size of a table of model configurations: the largest of the known length keys in thousands, else N/A."""
    # Names that configurations give their longest context.
    known = ["max_position_embeddings", "n_positions", "max_seq_len", "seq_length", "model_max_length", "max_sequence_length", "max_seq_length", "seq_len"]
    keys = [c for c in known if c in configs.columns]
    most = F.greatest(*keys) if len(keys) > 1 else F.col(keys[0]) if keys else F.lit(None)
    return configs.select("model", F.coalesce(F.concat((F.nullif(most, F.lit(0)) / 1024).cast("int").cast("string"), F.lit("k")), F.lit("N/A")).alias("train_size"))


def crawl_filter(repos: DataFrame, commits: DataFrame, files: DataFrame, since: str = "2024-01-01", min_commits: int = 50, min_bytes: int = 65536, suffixes: list[str] | None = None, stars: int = 100) -> DataFrame:
    """Repositories with enough stars, enough commits since a UTC day and enough source bytes, most stars first."""
    active = commits.groupBy("repo").agg(F.count_if(F.col("ts") >= F.to_timestamp(F.lit(since))).alias("n")).where(F.col("n") >= min_commits)
    keep = F.lit(suffixes is None)
    for s in suffixes or []:
        keep = keep | F.col("path").endswith(s)
    large = files.where(keep).groupBy("repo").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= min_bytes)
    return repos.where(F.col("stars") >= stars).join(active.select("repo"), "repo", "left_semi").join(large.select("repo"), "repo", "left_semi").orderBy(F.desc("stars"))


def decode_contents(rows: DataFrame) -> DataFrame:
    """Rows (path, encoding, content) of a contents listing: base64 ones, decoded as UTF-8."""
    return rows.where("encoding = 'base64'").withColumn("content", F.decode(F.unbase64("content"), "UTF-8"))
