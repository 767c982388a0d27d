"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are each due c = target / source size copies. The whole part is taken at once; the fraction is a copy
probability that rounding settles. Two documents with fractional probabilities meet: word mass moves from one to the
other, in one of the two directions by chance with the odds that keep both probabilities' expectations, until one of them
is 0 or 1. The words a source takes therefore stay at its target but for the last document left over.

Rounding runs as a reduction tree. Documents of a source are dealt into buckets of about BUCKET_ROWS by a hash, so a hot
source has many; a bucket leaves one undecided document, and FAN_IN buckets' leftovers meet on the next level until one is
left for each source, which is rounded to the nearer side. Documents go largest first, so leftovers tend to be small. All
chance comes from hashes of the seed and the document, so reruns and other partitionings agree.

Cases. Null texts have size 0 and are taken 0 times; a null source is one of its own, the last in order; null ids are like any other. Ties of
size go by chance. Other columns are not read; empty tables give no rows; sources without words have target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import fits, numbered, staged

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_ROWS = 2_000
FAN_IN = 64
SEED = 17
#: Alike rows that one task writes out.
BLOCK_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) for sizes (source, size): shares by weight of all words, stopped at cap times the source's size.

    Sources take the weights in turn, by code point with null last. What goes over a stop is shared again by weight among
    the others until none is over. An empty table gives no rows; sources without words have target 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = numbered(by.withColumn("__hs_null", F.col("source").isNull()), "__hs_null", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__hs_n") % len(weights) + 1).cast("int"))
    by = staged(by.select("source", "source_size", "n_docs", weight.alias("w"), (F.col("source_size") * cap).cast("double").alias("most")))
    total = float(by.agg(F.sum("source_size")).first()[0] or 0)
    rate, stopped = 0.0, -1
    while True:  # scalars only come to the driver; each round stops at least one more source
        over = (F.col("most") < F.col("w") * rate) if stopped >= 0 else F.lit(False)
        n, fixed, w = by.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == stopped or not w:
            break
        stopped, rate = n, (total - (fixed or 0.0)) / w
    return by.select("source", "source_size", "n_docs", F.least("most", F.col("w") * rate).alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """p after pairwise rounding in the given order, and the index of the one that may still be fractional (-1: none).

    key: uniform 64-bit numbers, the chance of each document.
    """
    p = p.tolist()
    size, luck = size.tolist(), (key.astype(np.float64) / 2.0**64).tolist()
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1.0 - p[i]) * a, p[j] * b)  # words from j to i
        down = min(p[i] * a, (1.0 - p[j]) * b)  # words from i to j
        if luck[j] * (up + down) < down:
            i_ends, j_ends = up == (1.0 - p[i]) * a, up == p[j] * b
            p[i], p[j] = (1.0 if i_ends else p[i] + up / a), (0.0 if j_ends else p[j] - up / b)
        else:
            i_ends, j_ends = down == p[i] * a, down == (1.0 - p[j]) * b
            p[i], p[j] = (0.0 if i_ends else p[i] - down / a), (1.0 if j_ends else p[j] + down / b)
        if i_ends:
            i = -1 if j_ends else j
    return np.array(p), i


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "luck", "rid"], ascending=[False, True, True], kind="stable")
    key = pdf["luck"].to_numpy(np.int64).view(np.uint64)
    p, i = pivot(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), key)
    if pdf["final"].iloc[0] and i >= 0:
        p[i] = float(p[i] >= 0.5)
        i = -1
    return pdf.assign(p=p, open=np.arange(len(p)) == i)


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of docs (doc_id, text, source).

    size: words of the text (null: 0). Rows without words are taken 0 times. Rows that are alike in id, source and size are told apart by a
    number from 0 on, so any number of them spreads over the buckets and any partitioning gives the same rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    alike = staged(docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))  # map-side: a hot class is a row a task
    names = ["doc_id", "source", "size"]
    few = alike.where(F.col("n") <= BLOCK_ROWS).select(*names, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    many = alike.where(F.col("n") > BLOCK_ROWS).select(*names, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK_ROWS).cast("long"))).alias("at"))
    many = many.repartition("doc_id", "source", "size", "at").select(*names, F.explode(F.sequence(F.col("at"), F.least(F.col("at") + BLOCK_ROWS, F.col("n")) - 1)).alias("copy"))
    docs = staged(few.union(many).withColumn("rid", F.monotonically_increasing_id()))
    by = source_targets(docs, weights, cap).withColumn("c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    by = staged(by.withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows)).withColumnRenamed("source", "__hs_source"))
    few = fits(by)
    most = by.agg(F.max("buckets")).first()[0] or 1
    rows = docs.join(F.broadcast(by) if few else by, F.col("source").eqNullSafe(F.col("__hs_source")))
    luck = F.xxhash64(F.lit(seed), "source", "doc_id", "size", "copy")
    rows = rows.withColumn("whole", F.floor("c")).withColumn("p", F.col("c") - F.col("whole")).withColumn("luck", luck).withColumn("bucket", F.pmod(F.xxhash64(F.col("luck")), F.col("buckets")))
    rows = staged(rows.select("rid", "doc_id", "source", "size", "source_size", "target", "whole", "p", "luck", "bucket"))
    cols = "rid long, source string, size long, p double, luck long, bucket long, final boolean"
    live = rows.where("size > 0 and p > 0").select("rid", "source", "size", "p", "luck", "bucket")
    settled, level = [], 0
    while True:
        final = most <= 1
        done = staged(live.withColumn("final", F.lit(final)).groupBy("source", "bucket").applyInPandas(_round, cols + ", open boolean"))
        settled.append(done.where("not open").select("rid", F.col("p").cast("long").alias("extra")))
        if final:
            break
        level += 1
        live = done.where("open").select("rid", "source", "size", "p", F.xxhash64("luck", F.lit(level)).alias("luck"), F.floor(F.col("bucket") / fan_in).alias("bucket"))
        most = -(-most // fan_in)
    extra = settled[0]
    for x in settled[1:]:
        extra = extra.union(x)
    out = rows.join(extra, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce("extra", F.lit(0)))).cast("long").alias("taken"))


