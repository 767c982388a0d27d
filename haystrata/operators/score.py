"""Scoring: best match of a reply, threshold grid, pass@1 by scope, pivot, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haystrata.functions.bleu import similarity
from haystrata.functions.text import fences, strip

THRESHOLDS = [i / 10 for i in range(11)]


def best_match(replies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every reply (rid) with its most similar needle: the smallest nid of the highest positive similarity, null and 0 without one."""
    top = pairs.where("sim > 0").groupBy("rid").agg(F.max_by("nid", F.struct("sim", -F.col("nid"))).alias("best_nid"), F.max("sim").alias("best_sim"))
    return replies.join(top, "rid", "left").withColumn("best_sim", F.coalesce("best_sim", F.lit(0.0)))


def threshold_grid(rows: DataFrame, thresholds=None) -> DataFrame:
    """rows (rid, scope, ok boolean, sim) once for each threshold, with passed: ok and sim at least the threshold."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds or THRESHOLDS]))
    return rows.withColumn("threshold", grid).withColumn("passed", F.col("ok") & (F.col("sim") >= F.col("threshold")))


def pass_by_scope(grid: DataFrame) -> DataFrame:
    """(scope, threshold, n, pass_at_1) for each scope and for all rows. Empty input gives no rows."""
    sets = grid.groupingSets([["threshold"], ["threshold", "scope"]], "threshold", "scope").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_at_1"), F.grouping("scope").alias("g"))
    return sets.where("n > 0").select(F.when(F.col("g") == 1, "all").otherwise(F.col("scope")).alias("scope"), "threshold", "n", "pass_at_1")


def pivot_scores(scores: DataFrame, thresholds=None) -> DataFrame:
    """One row a scope, one column t<threshold> a threshold."""
    thresholds = thresholds or THRESHOLDS
    wide = scores.groupBy("scope").pivot("threshold", thresholds).agg(F.first("pass_at_1"))
    return wide.toDF("scope", *[f"t{int(round(t * 10)):02d}" for t in thresholds])


def extremes(scores: DataFrame) -> DataFrame:
    """Languages' rates with whether they are a threshold's highest or, if not, lowest (within 0.01)."""
    w = Window.partitionBy("threshold")
    rows = scores.where("scope <> 'all'").withColumn("hi", F.max("pass_at_1").over(w)).withColumn("lo", F.min("pass_at_1").over(w))
    high = F.abs(F.col("pass_at_1") - F.col("hi")) < 0.01
    return rows.select("scope", "threshold", "pass_at_1", high.alias("is_max"), (~high & (F.abs(F.col("pass_at_1") - F.col("lo")) < 0.01)).alias("is_min"))


def sanitize(outputs: DataFrame, first_function=None) -> DataFrame:
    """outputs (…, reply) with code: the first function of the first fenced block that has one, else the first block, else the stripped reply.

    first_function(block column, language column) -> column; without it the first block counts.
    """
    blocks = fences("reply")
    picked = F.element_at(F.filter(F.transform(blocks, lambda b: first_function(b, F.col("language"))), lambda x: x.isNotNull()), 1) if first_function else F.lit(None)
    return outputs.withColumn("code", F.when(F.size(blocks) == 0, strip("reply")).otherwise(F.coalesce(picked, F.get(blocks, F.lit(0)))))


def score_outputs(outputs: DataFrame, needles: DataFrame, first_function=None) -> DataFrame:
    """Evaluation rows of outputs (language, repo, name, output, positions) against needles (language, repo, name, needle_ord, code).

    Only the first reply counts. is_best_similar: the most similar of the repository's needles is the one that was asked for.
    """
    rows = outputs.withColumn("rid", F.to_json(F.struct("language", "repo", "name"))).withColumn("reply", F.get("output", F.lit(0)))
    rows = sanitize(rows, first_function)
    key = F.to_json(F.struct("language", "repo"))
    pairs = similarity(rows.select("rid", key.alias("key"), F.col("code").alias("text")), needles.select(F.col("needle_ord").alias("nid"), key.alias("key"), F.col("code").alias("text")))
    best = best_match(rows, pairs)
    names = needles.select("language", "repo", F.col("needle_ord").alias("best_nid"), F.col("name").alias("best_target"))
    out = best.join(names, ["language", "repo", "best_nid"], "left")
    return out.withColumn("is_best_similar", F.coalesce(F.col("best_target") == F.col("name"), F.lit(False))).withColumnRenamed("best_sim", "best_similar_score").drop("rid", "best_nid", "reply")


def score_document(model: str, train_size: str, scores: DataFrame, results: DataFrame, when: str) -> dict:
    """The score document of one model, for a JSON sink. A model's evaluation rows are bounded by its task set."""
    table: dict = {}
    for r in scores.orderBy("scope", "threshold").collect():
        table.setdefault(r["scope"], {})[str(r["threshold"])] = {"pass@1": r["pass_at_1"]}
    rows: dict = {}
    for r in results.collect():
        d = r.asDict(recursive=True)
        rows.setdefault(d.pop("language"), []).append(d)
    return {model: {"eval_date": when, "train_size": train_size, "scores": table, "results": rows}}
