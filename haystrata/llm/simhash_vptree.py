"""SimHash near-duplicates: exact Hamming-ball links by a forest of vantage-point trees.

Every document gets a 64-bit fingerprint; fingerprints within `radius` differing bits are linked and the result is the
smallest doc_id that links reach. Exact copies collapse first: the search only sees distinct fingerprints.

Search. With b blocks of bits, two fingerprints within r bits agree on at least b - r whole blocks. One tree for each
choice of b - r blocks therefore sees every linked pair under one branch of its top level, whose metric is the Hamming
distance on the chosen blocks with triangle bound 0: no boundary copies at all. (A tree over all 64 bits alone prunes
badly: distances of unrelated fingerprints crowd around 32 with deviation 4, so at radius 4 each level copies about 60 %
of the rows across its boundary.) Under a top branch every fingerprint is placed by its full Hamming distance to the branch's vantage
point, and by the triangle bound only fingerprints whose distances to it differ by radius at most are compared: sweep() takes the
branches of a task at once, in order of that distance, and each fingerprint's comparisons end with the first that is too far
out. A branch of over LEAF rows is split further by vantage points of its own, at their median distance, with the boundary bands on
both sides compared (vp_pairs); one too large for a task becomes annulus shards, where a fingerprint that the bound cannot keep apart
from the next annulus is copied into it (split_large). b grows with the number of fingerprints, so a top branch stays small.

Links leave a task as a spanning star, never as pairs; components() joins the stars.

Cases. Null and empty texts have fingerprint zero and link like others. Ties: component_id is the smallest doc_id, nulls do not count; a
group whose ids are all null has none. Repeated rows stay repeated; other columns are not read; empty tables give no rows. Very long
texts take linear time and BLOCK shingles of memory at once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import LOWER, components, fits, flat, grouped, join_counted, fresh, keep_ids, staged, words

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
SHINGLE = 4
RADIUS = 4
#: Rows of one top branch that a single task takes; larger ones are split by vantage points across tasks.
SHARD_ROWS = 50_000
#: Rows of a top branch above which it is split by further vantage points.
LEAF = 256
#: Rows of branches that a task handles at once, or one branch.
CHUNK_ROWS = 500_000
#: Shingles whose bits are counted at once.
BLOCK = 250_000
#: Each byte's bits, one to each byte of a 64-bit lane.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, pos: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[pos:pos+length] for every pair. data needs 8 spare bytes at its end."""
    lane8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lane4 = np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
    pos, end = pos.copy(), pos + length
    h = np.full(len(pos), np.uint64((seed + int(_P5)) & (2**64 - 1)))
    long = np.flatnonzero(length >= 32)
    if len(long):
        acc = [np.full(len(long), np.uint64((seed + s) & (2**64 - 1))) for s in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        left, at = length[long] // 32, pos[long].copy()
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                acc[k][live] = _rotl(acc[k][live] + lane8[at[live] + 8 * k] * _P2, 31) * _P1
            at[live] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        hl = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            hl = (hl ^ (_rotl(acc[k] * _P2, 31) * _P1)) * _P1 + _P4
        h[long], pos[long] = hl, at
    h += length.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(pos + 8 <= end)
        h[i] = _rotl(h[i] ^ (_rotl(lane8[pos[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
        pos[i] += 8
    i = np.flatnonzero(pos + 4 <= end)
    h[i] = _rotl(h[i] ^ (lane4[pos[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    pos[i] += 4
    for _ in range(3):
        i = np.flatnonzero(pos < end)
        h[i] = _rotl(h[i] ^ (data[pos[i]].astype(np.uint64) * _P5), 11) * _P1
        pos[i] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The SimHash of each text as uint64; without words zero, under SHINGLE words from the whole sequence."""
    data, offs = flat(texts)
    starts, ends, first = words(data, offs)
    size = ends - starts
    n_words = np.diff(first)
    # words end to end with one space after each
    new = np.cumsum(size + 1) - (size + 1)
    line = np.full(int((size + 1).sum()) + 16, 32, np.uint8)
    step = np.repeat(new - starts, size)
    at = np.arange(len(step)) + np.repeat(starts - (np.cumsum(size) - size), size)
    line[at + step] = LOWER[data[at]]
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    base = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    begin = first[:-1][doc] + np.arange(len(doc)) - base[doc]
    last = begin + np.minimum(n_words[doc], SHINGLE) - 1
    ones = np.zeros((len(count), 64), np.int64)
    for i in range(0, len(doc), BLOCK):
        b, e, d = begin[i : i + BLOCK], last[i : i + BLOCK], doc[i : i + BLOCK]
        h = xxh64(line, new[b], new[e] + size[e] - new[b])
        fresh = np.r_[True, d[1:] != d[:-1]]
        run = np.arange(len(d)) - np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
        cut = np.flatnonzero(run % 255 == 0)  # so many that a byte of a lane cannot overflow
        sums = np.add.reduceat(_LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)], cut, axis=0)
        np.add.at(ones, d[cut], sums.astype("<u8").view(np.uint8).reshape(len(cut), 64))
    return np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_table(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, the long columns of keep, fp long) of every row of docs."""
    names = ["doc_id", *keep]
    schema = pa.schema([(n, pa.int64()) for n in (*names, "fp")])

    def run(batches):
        yield from grouped(batches, "text", schema, lambda b: {n: b.column(n) for n in names} | {"fp": pa.array(fingerprints(b.column("text")).view(np.int64))})

    columns = [F.col(n).cast("long").alias(n) for n in names]
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


# --- vantage-point search ---


def _direct(fp, a, b, radius, same):
    """Index pairs within radius between a and b (or inside a), over blocks of rows."""
    for i in range(0, len(a), 512):
        part = a[i : i + 512]
        near = np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= radius
        if same:
            near &= np.arange(i, i + len(part))[:, None] < np.arange(len(b))[None, :]
        x, y = np.nonzero(near)
        if len(x):
            yield part[x], b[y]


def vp_pairs(fp: np.ndarray, radius: int = RADIUS, leaf: int = 64):
    """All index pairs of distinct fingerprints within radius, as arrays: median splits, bands by the triangle bound."""
    todo = [(np.arange(len(fp)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= leaf:
                yield from _direct(fp, a, a, radius, True)
                continue
            d = np.bitwise_count(fp[a] ^ fp[a[0]]).astype(np.int64)
            cut = min(int(np.median(d)), int(d.max()) - 1)  # the vantage point itself is inside, the farthest outside
            inside = d <= cut
            todo += [(a[inside], None), (a[~inside], None), (a[inside & (d > cut - radius)], a[~inside & (d <= cut + radius)])]
        elif len(a) and len(b):
            if len(a) * len(b) <= leaf * leaf or min(len(a), len(b)) <= 8:
                yield from _direct(fp, a, b, radius, False)
                continue
            v = fp[a[0]]
            da, db = (np.bitwise_count(fp[x] ^ v).astype(np.int64) for x in (a, b))
            cut = min(int(np.median(da)), int(da.max()) - 1)
            if cut < 0:
                yield from _direct(fp, a, b, radius, False)
                continue
            todo += [(a[da <= cut], b[db <= cut + radius]), (a[da > cut], b[db > cut - radius])]


def sweep(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS):
    """Index pairs within radius in the same branch (key), for rows in order of key, then distance to the branch's vantage point, its first row."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(key)])
    far = np.bitwise_count(fp ^ np.repeat(fp[cut], size)).astype(np.int64)
    order = np.lexsort((far, np.repeat(np.arange(len(cut)), size)))
    far, fp = far[order], fp[order]
    end = np.repeat(cut + size, size)
    live = np.arange(len(fp))
    s = 1
    while len(live):
        live = live[live + s < end[live]]
        live = live[far[live + s] - far[live] <= radius]  # what is farther out stays so
        near = live[np.bitwise_count(fp[live] ^ fp[live + s]) <= radius]
        yield order[near], order[near + s], len(live)
        s += 1


def _stars(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (root, member) of the links between rows of the same key."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    value, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(value))

    def join(i, j):
        i, j = at[i], at[j]
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                return
            for x in (i, j):
                np.minimum.at(label, label[x], low)
                np.minimum.at(label, x, low)
            while (label[label] != label).any():
                label[:] = label[label]

    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    small = np.flatnonzero(np.repeat(size <= LEAF, size))
    for i, j, _ in sweep(key[small], fp[small], radius):
        if len(i):
            join(small[i], small[j])
    for k in np.flatnonzero(size > LEAF):
        for i, j in vp_pairs(fp[cut[k] : cut[k + 1]], radius):
            join(i + cut[k], j + cut[k])
    member = np.flatnonzero(label != np.arange(len(value)))
    return value[label[member]], value[member]


def pruned_share(keys: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[int, int]:
    """Pairs in the branches of one task, and those that the vantage points leave to compare."""
    order = np.argsort(keys, kind="stable")
    size = np.unique(keys, return_counts=True)[1].astype(np.int64)
    return int((size * (size - 1) // 2).sum()), sum(n for *_, n in sweep(keys[order], fp[order], radius))


def _blocks(n: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bit masks of b blocks, and the choices of b - radius of them, for about 4,096 of n fingerprints in a top branch."""
    for b in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (b - radius) / b) <= 4096:
            break
    edge = [round(64 * k / b) for k in range(b + 1)]
    return [((1 << y) - 1) ^ ((1 << x) - 1) for x, y in zip(edge, edge[1:])], list(combinations(range(b), b - radius))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_large(rows: DataFrame, radius: int, limit: int, levels: int = 6) -> DataFrame:
    """rows (k, fp) with branches of over `limit` rows cut into annuli around a vantage point of their own.

    Annuli are radius + 1 wide. By the triangle bound a link joins an annulus to itself or the next, so a fingerprint that
    is within radius of the next annulus is copied there. Branches that a level cannot cut smaller stay for the task's tree.
    """
    done = None
    for level in range(levels):
        large = staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.min("fp") if level % 2 == 0 else F.max("fp")).alias("v")).where(F.col("n") > limit).select("k", "v"))
        if large.isEmpty():
            break
        large = F.broadcast(large) if fits(large) else large  # a branch of one key is never one task's
        rest = rows.join(large.select("k"), "k", "left_anti")
        done = rest if done is None else done.union(rest)
        d, w = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))), radius + 1
        cut = rows.join(large, "k").select("k", "fp", d.alias("d"))
        cut = cut.select("k", "fp", F.explode(F.expr(f"filter(array(int(d / {w}), int((d + {radius}) / {w})), (x, i) -> i = 0 or x > int(d / {w}))")).alias("a"))
        rows = staged(cut.select(F.xxhash64("k", "a", F.lit(level)).alias("k"), "fp").distinct())
    return rows if done is None else done.union(rows)


def links(distinct: DataFrame, n: int, radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of n distinct fingerprints (fp) within radius."""
    masks, trees = _blocks(n, radius)
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in tree))))) for t, tree in enumerate(trees)]
    rows = split_large(distinct.select(F.explode(F.array(*keys)).alias("k"), "fp"), radius, limit)

    def run(batches):
        # rows come in order of key; whole branches are handled as soon as CHUNK_ROWS of them are there
        held_k, held_f, n = [], [], 0

        def flush(last: bool):
            nonlocal held_k, held_f, n
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            end = len(k) if last else int(np.searchsorted(k, k[-1]))
            a, b = _stars(k[:end], f[:end].view(np.uint64), radius)
            held_k, held_f, n = [k[end:]], [f[end:]], len(k) - end
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held_k.append(batch.column(0).to_numpy())
                held_f.append(batch.column(1).to_numpy())
                n += batch.num_rows
                if n > CHUNK_ROWS:
                    yield flush(False)
        if n:
            yield flush(True)

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Null texts are empty; empty texts have fingerprint zero and link like others. component_id is the smallest doc_id in
    the row's component (null ids are passed over; null only if the component has no other). Repeated rows stay repeated.
    """
    fps = staged(fingerprint_table(docs))
    reps = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    comp = staged(components(links(reps.select("fp"), reps.count(), radius, limit)))
    linked = comp.join(reps, comp.v == reps.fp).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    every = staged(reps.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")))
    return join_counted(fps, every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each near-duplicate group: the one with the smallest doc_id, nulls last.

    Rows are told apart by a row number, not by doc_id: of several with that doc_id (or of a group whose ids are all null) the first row stays.
    """
    at = fresh("__hs_row", docs)
    rows = staged(docs.withColumn(at, F.monotonically_increasing_id()))
    fps = staged(fingerprint_table(rows, at).withColumnRenamed(at, "row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    reps = staged(fps.groupBy("fp").agg(best))
    comp = staged(components(links(reps.select("fp"), reps.count())))
    roots = reps.join(comp, comp.v == reps.fp, "left").select(F.coalesce("root", "fp").alias("root"), "best.*")
    kept = staged(roots.groupBy("root").agg(best).select("best.row"))
    return keep_ids(rows, kept, "left_semi", at).drop(at)
