"""Shared plumbing of the training-data operators.

Tables are narrowed to the columns an operator needs before anything else happens, so extra columns, whatever
their names, cannot clash with working columns. Text kernels take whole Arrow string arrays and work on their UTF-8
buffers with numpy; they cut a batch into pieces of a few megabytes (always at row ends), so a worker's memory follows
its longest text, not the batch.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast, by its values' own sizes; above, a shuffled join does the same.
BROADCAST_BYTES = 16 << 20
#: Rows of one key from which on they are joined without a shuffle: there is one such key in so many rows at most.
HOT_ROWS = 100_000
#: Distinct label values that are counted on the driver.
MAX_LEVELS = 10_000
#: Bytes of text that a kernel takes at once.
PIECE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII upper case to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir, else the SparkContext's checkpoint folder. Only a local
    master gets a temporary folder of its own, removed at exit; a cluster without a shared folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_haystrata_scratch", None)
        if not folder:
            folder = spark._haystrata_scratch = tempfile.mkdtemp(prefix="haystrata-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, gives exact sizes to AQE."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/haystrata-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """A scratch folder that clear_staged() removes, and the end of a local session's process."""
    spark.__dict__.setdefault("_haystrata_staged", []).append(path)
    if _local(spark):  # one machine's folder: nothing is left when the process ends
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)


def clear_staged(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Removes the tables that this session has staged, from the since-th on and but for those whose paths keep has, and says how many; call it when no result that reads them is needed any more."""
    held = spark.__dict__.setdefault("_haystrata_staged", [])
    gone = [path for path in held[since:] if path not in keep]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        held.remove(path)
    return len(gone)


def staged_paths(spark: SparkSession) -> list[str]:
    """Where this session's staged tables are, the last one last."""
    return list(spark.__dict__.get("_haystrata_staged", []))


def fits(df: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the columns of df (all of them if none are named) take at most limit bytes as a hash table: 64 a row, 8 a value and the length of strings and arrays."""
    columns = columns or tuple(df.columns)
    size = sum((F.octet_length(F.col(c)) if dict(df.dtypes)[c] == "string" else F.size(c) * 8 if dict(df.dtypes)[c].startswith("array") else F.lit(0) for c in columns), F.lit(0))
    return (df.agg(F.sum(F.coalesce(size, F.lit(0)) + 64 + 8 * len(columns))).first()[0] or 0) <= limit


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has: name, with underscores after it."""
    held = {c.lower() for t in tables for c in t.columns}
    while name.lower() in held:
        name += "_"
    return name


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """left_semi or left_anti of docs with a staged one-column table of ids, broadcast only when it fits()."""
    own = fresh("__hs_id", docs)
    ids = ids.select(F.col(ids.columns[0]).alias(own))
    ids = F.broadcast(ids) if fits(ids) else ids
    return docs.join(ids, docs[key] == F.col(own), how)


def join_counted(rows: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of their key's row in table, which has one row a key and n, the key's rows, and is staged or cheap to make twice.

    All rows of one key would be one task's: keys of hot_rows rows or more, of which there are few, meet theirs by a broadcast.
    """
    more = [c for c in table.columns if c not in (key, "n")]
    to, names = fresh("__hs_key", rows), {c: fresh(f"__hs_{c}", rows) for c in more}
    hot = table.where(F.col("n") >= hot_rows).select(F.col(key).alias(to), *[F.col(c).alias(names[c]) for c in more])
    both = rows.join(F.broadcast(hot), rows[key] == F.col(to), "left")
    few = both.where(F.col(to).isNotNull()).select(*rows.columns, *[F.col(names[c]).alias(c) for c in more])
    rest = both.where(F.col(to).isNull()).select(*rows.columns).join(table.where(F.col("n") < hot_rows).drop("n"), key)
    return few.unionByName(rest)


def merged_levels(levels: list[tuple[float, int]], classes: int) -> list[tuple[float, float, float, int]]:
    """(lowest, highest, mean, rows) of at most `classes` ordered bins of the (value, rows) levels: while there are more, the two neighbours with the fewest rows meet."""
    low, n = (np.array(x, float) for x in zip(*sorted(levels)))
    high, total = low.copy(), low * n
    while len(low) > classes:
        i = int(np.argmin(n[:-1] + n[1:]))
        n[i], total[i], high[i] = n[i] + n[i + 1], total[i] + total[i + 1], high[i + 1]
        low, high, n, total = np.delete(low, i + 1), np.delete(high, i + 1), np.delete(n, i + 1), np.delete(total, i + 1)
    return [(float(a), float(b), float(t / k), int(k)) for a, b, t, k in zip(low, high, total, n)]


def labelled_sample(docs: DataFrame, labels: DataFrame, value, per_class: int, where=None, classes: int = 10) -> tuple[DataFrame, dict[float, int]]:
    """At most per_class rows of each label value, smallest hash of doc_id first, as a staged table (text, y), and the rows of each value there are.

    This is the documented bound of the fitted models' training data; the texts stay on the executors. value: a column of labels,
    whole or fractional. More than `classes` values are merged with their neighbours into so many bins, each named by its mean, so
    that all labels count; over MAX_LEVELS values are an error. A doc_id with several labels counts with the largest, one with several
    texts with the smallest; null labels and ids are left out; null texts are empty.
    """
    held = labels.select("doc_id", (F.col(value) if isinstance(value, str) else value).cast("double").alias("__hs_y")).dropna()
    held = held.where(where) if where is not None else held
    held = staged(held.groupBy("doc_id").agg(F.max("__hs_y").alias("__hs_y")))
    levels = [tuple(r) for r in held.groupBy("__hs_y").count().limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{value} has over {MAX_LEVELS} values; ratings need fewer levels")
    bins = merged_levels(levels, classes) if levels else []
    parts = [held.where(F.col("__hs_y").between(a, b)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", F.lit(y).alias("__hs_y")) for a, b, y, _ in bins]
    ids = functools.reduce(DataFrame.union, parts) if parts else held
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__hs_t")).join(F.broadcast(ids), "doc_id")  # per_class ids a class
    rows = rows.groupBy("doc_id").agg(F.min("__hs_t").alias("text"), F.first("__hs_y").alias("y"))
    return staged(rows.select("text", "y")), {y: n for _, _, y, n in bins}


# --- numpy text kernels ---


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more at the end). Nulls are empty."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows, `rows` at most if that is given, whose texts have `limit` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > limit or i - begin == rows):
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word [^\\x20\\x09-\\x0D]+, and the number of words before each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = full.copy()
    starts[1:] &= ~full[:-1] | edge[1:-1]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offs)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _BASE_INV))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial from prefix sums, over runs of words of 1 MB or one word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(max(1 << 20, 1 << int(b - a).bit_length()))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words inside one text, and the index of each run's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(len(h) - n + 1, bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    at = np.flatnonzero(inside)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ h[at + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return mix(out), at


def owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each word index lies in."""
    return np.searchsorted(first, at, "right") - 1


def grouped(batches: Iterable[pa.RecordBatch], column: str, schema: pa.Schema, fn, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """fn(piece) -> dict of columns, over the pieces of each batch; the body of a mapInArrow function."""
    for batch in batches:
        for piece in pieces(batch, column, rows=rows):
            out = fn(piece)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in ((k, out[k]) for k in schema.names)], schema=schema)


# --- distributed order and components ---


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with __hs_n, the 0-based position in the given order: range partitions, sorted inside, offset by the counts before them."""
    part = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__hs_m", F.monotonically_increasing_id()).withColumn("__hs_p", F.spark_partition_id()))
    counts = sorted(part.groupBy("__hs_p").agg(F.count(F.lit(1)), F.min("__hs_m")).collect())  # one row a partition
    at, base = 0, []
    for p, n, low in counts:
        base.append((p, at - low))
        at += n
    if not base:
        return part.withColumn("__hs_n", F.lit(0).cast("long")).drop("__hs_m", "__hs_p")
    shift = F.broadcast(df.sparkSession.createDataFrame(base, "__hs_p int, __hs_s long"))
    return part.join(shift, "__hs_p").withColumn("__hs_n", F.col("__hs_m") + F.col("__hs_s")).drop("__hs_m", "__hs_p", "__hs_s")


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(v, root) of every vertex of the undirected edges (a long, b long): root is the smallest vertex it can reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges stay as they are: a logarithmic
    number of rounds, each a few shuffles of edge rows, with a star's minimum pre-aggregated before its shuffle. The edges of a hub
    (hot_rows or more, as the root of a large component has) meet that minimum where they are.
    """
    cur = staged(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    seen = None
    while True:
        both = cur.union(cur.selectExpr("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(join_counted(both.where("v > u"), low, "u", hot_rows).selectExpr("v a", "m b").distinct())
        least = large.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("m"))
        cur = staged(join_counted(large, least, "a", hot_rows).selectExpr("inline(array(struct(a, m b), struct(b a, m b)))").where("a <> b").distinct())
        now = cur.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return cur.selectExpr("a v", "b root").union(cur.selectExpr("b v", "b root").distinct())
