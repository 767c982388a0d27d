"""Curation: unique names, size bins, sampling, global offsets, merges, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haystrata.operators.running import sums_before

REPO = ["language", "repo"]


def unique_names(functions: DataFrame) -> DataFrame:
    """Functions whose name occurs once in their repository."""
    once = functions.groupBy(*REPO, "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*REPO, "name")
    return functions.join(once, [*REPO, "name"], "left_semi")


def functions_per_repo(functions: DataFrame) -> DataFrame:
    """language, repo, n_functions."""
    return functions.groupBy(*REPO).agg(F.count(F.lit(1)).alias("n_functions"))


def pending(rows: DataFrame, results: DataFrame | None, key: list[str], overwrite: bool = False) -> DataFrame:
    """The rows that a stage still has to do: those whose key has no result yet, all of them to overwrite."""
    return rows if overwrite or results is None else rows.join(results.select(*key), key, "left_anti")


def repo_sizes(files: DataFrame) -> DataFrame:
    """language, repo, n_chars: code points of all files."""
    return files.groupBy(*REPO).agg(F.sum(F.length("content")).alias("n_chars"))


def bin_first(functions: DataFrame, sizes: DataFrame, num_bins: int = 64) -> DataFrame:
    """The first function (topo_idx, fn_ord) in each of the repository's bins of global_start_byte."""
    rows = functions.join(sizes, REPO).withColumn("bin", F.floor(F.col("global_start_byte") / F.greatest(F.lit(1), F.floor(F.col("n_chars") / num_bins))))
    first = F.min_by(F.struct(*functions.columns), F.struct("topo_idx", "fn_ord"))
    return rows.groupBy(*[F.col(c).alias(f"__hs_{c}") for c in REPO], "bin").agg(first.alias("f")).select("f.*", "bin")


def sample_per_repo(rows: DataFrame, k: int, seed: int = 0, by: str = "md5") -> DataFrame:
    """At most k rows a repository, in the order of a seeded hash of path and name, with needle_ord and n_needles."""
    text = F.concat_ws("/", F.lit(str(seed)), "path", "name")
    w = Window.partitionBy(*REPO).orderBy(F.md5(text) if by == "md5" else F.xxhash64(text), "path", "name")
    got = rows.withColumn("__hs_n", F.row_number().over(w)).where(F.col("__hs_n") <= k)  # cut in each task before the shuffle
    return got.withColumn("needle_ord", F.col("__hs_n") - 1).drop("__hs_n").withColumn("n_needles", F.count(F.lit(1)).over(Window.partitionBy(*REPO)).cast("int"))


def select_needles(functions: DataFrame, files: DataFrame, max_len: int = 2000, num_bins: int = 64, max_fn_per_repo: int = 10, seed: int = 0) -> DataFrame:
    """Needles: functions with a name of their own and at most max_len bytes, the first in each bin, then a seeded sample."""
    if num_bins < max_fn_per_repo:
        raise ValueError("num_bins must be at least max_fn_per_repo")
    short = unique_names(functions).where(F.col("end_byte") - F.col("start_byte") <= max_len)
    return sample_per_repo(bin_first(short, repo_sizes(files), num_bins), max_fn_per_repo, seed)


def global_offsets(files: DataFrame, order: str = "topo_idx") -> DataFrame:
    """files, without their content, with the code points and lines of the files before them in their repository. Only numbers are shuffled and sorted."""
    rows = files.withColumn("__chars", F.length("content").cast("long")).withColumn("__lines", F.size(F.split("content", "\n")).cast("long")).drop("content")
    return sums_before(rows, REPO, order, {"chars_before": "__chars", "lines_before": "__lines"}, orders=files).drop("__chars", "__lines")


def with_global_spans(functions: DataFrame, files: DataFrame) -> DataFrame:
    """functions (start and end lines and bytes in their file) with the spans in the whole repository."""
    base = global_offsets(files).select(*REPO, "path", "chars_before", "lines_before")
    out = functions.join(base, [*REPO, "path"])
    for end in ("start", "end"):
        out = out.withColumn(f"global_{end}_line", F.col(f"{end}_line") + F.col("lines_before")).withColumn(f"global_{end}_byte", F.col(f"{end}_byte") + F.col("chars_before"))
    return out.drop("chars_before", "lines_before")


def merge_dependency(repos: DataFrame, deps: DataFrame) -> DataFrame:
    """repos with the dependency of their repo; rows without one stay as they are."""
    one = deps.groupBy("repo").agg(F.any_value("dependency").alias("new"))
    return repos.join(one, "repo", "left").withColumn("dependency", F.coalesce("new", "dependency") if "dependency" in repos.columns else F.col("new")).drop("new")


def merge_last(rows: DataFrame, lines: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """rows left-joined with the value of the last line (by order) of their key."""
    last = lines.groupBy(*key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key, "left")


def merge_annotation(needles: DataFrame, annotations: DataFrame, order: str = "line_no") -> DataFrame:
    """needles with the description of the last annotation of (repo, name); null without one."""
    ann = annotations.withColumnRenamed("annotation", "description")
    return merge_last(needles.drop("description"), ann, ["repo", "name"], "description", order)


def histogram(values: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """(bin, n) over equal bins from the least to the most; the most falls in the last."""
    lo, hi = F.min(column).alias("lo"), F.max(column).alias("hi")
    rows = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(values.agg(lo, hi)))  # one row
    cell = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins).cast("long"), F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1))
    return rows.groupBy(cell.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def smallest_last(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """The row with the least value, the last by ordinal among ties. One row, by a pre-aggregated minimum."""
    return rows.agg(F.min_by(F.struct("*"), F.struct(F.col(value), -F.col(ordinal))).alias("r")).select("r.*")
