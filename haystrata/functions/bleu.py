"""Sentence BLEU-4 with Chen and Cherry's fourth smoothing, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haystrata.functions.text import tokens

#: Up to so many bytes of distinct n-grams of needles are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _grams(words: str = "w") -> Column:
    """All n-grams of an array of words, n from 1 to 4, as (n, g). Words are read by position, so the work is linear in the array."""
    of = [f"transform(slice({words}, 1, size({words}) - {n - 1}), (x, i) -> struct({n} as n, concat_ws(' ', {', '.join(f'get({words}, i + {k})' for k in range(n))}) as g))" for n in range(1, 5)]
    return F.expr("concat(" + ", ".join(f"if(size({words}) < {n}, array(), {e})" for n, e in enumerate(of, 1)) + ")")


def _starts(words: str = "w") -> Column:
    """For each word of an array, the word and the three after it, null beyond the end. Without a lambda, so Spark compiles it."""
    return F.arrays_zip(*[F.col(words) if k == 0 else F.slice(words, F.lit(k + 1), F.size(words)) for k in range(4)])


def _begun() -> Column:
    """The n-grams that begin at the words w0 to w3, n from 1 to 4, as (n, g); null where there are fewer words. Without a lambda, too."""
    return F.array(*[F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("g"))) for n in range(1, 5)])


def formula(h: str = "h", r: str = "r") -> Column:
    """The score from matches m1..m4 and the lengths of candidate h and reference r."""
    parts, zeros = [], "1"
    for n in range(1, 5):
        den = f"greatest(1, {h} - {n - 1})"
        smooth = f"ln(cast({h} as double)) / (5 * pow(2D, {zeros})) / {den}"
        p = f"case when m{n} > 0 then m{n} / cast({den} as double) when {h} > 1 then {smooth} else 0D end"
        parts.append(f"case when {p} > 0 then 0.25D * ln({p}) else 0D end")
        zeros += f" + if(m{n} = 0, 1, 0)"
    return F.expr(f"case when m1 = 0 then 0D else (case when {h} > {r} then 1D else exp(1 - {r} / cast({h} as double)) end) * exp({' + '.join(parts)}) end")


def _spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, if the scan has fewer. Large tables have more and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def similarity(replies: DataFrame, needles: DataFrame) -> DataFrame:
    """replies (rid, key, text) against the needles (nid, key, text) of the same key: (rid, nid, sim) of pairs with a common word.

    Up to BROADCAST_BYTES of needle n-grams go to every executor, so that of the replies' n-grams only matching ones are shuffled.
    """
    a = _spread(replies.select("rid", "key", "text")).select("rid", "key", tokens("text").alias("w"))
    b = needles.select("nid", "key", tokens("text").alias("w"))
    ref = b.select("nid", "key", F.size("w").alias("r"), F.explode(_grams()).alias("x")).groupBy("nid", "key", "r", "x.n", "x.g").agg(F.count(F.lit(1)).alias("have"))
    vocabulary = ref.where("n = 1").select("key", F.col("g").alias("first")).distinct()
    cand = a.select("rid", "key", F.size("w").alias("h"), F.inline(_starts()).alias("w0", "w1", "w2", "w3"))
    if (ref.agg(F.sum(F.octet_length("g") + F.octet_length("key") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        ref, vocabulary = F.broadcast(ref), F.broadcast(vocabulary)
    cand = cand.join(vocabulary.withColumnRenamed("first", "w0"), ["key", "w0"], "left_semi")  # of the words, only those that a needle has begin an n-gram
    cand = cand.select("rid", "key", "h", F.inline(_begun())).where("g is not null")
    hits = cand.join(ref, ["key", "n", "g"]).groupBy("rid", "h", "nid", "r", "n", "g", "have").agg(F.count(F.lit(1)).alias("got"))
    pairs = hits.groupBy("rid", "h", "nid", "r").agg(*[F.sum(F.when(F.col("n") == n, F.least("got", "have")).otherwise(0)).alias(f"m{n}") for n in range(1, 5)])
    return pairs.select("rid", "nid", formula().alias("sim"))
