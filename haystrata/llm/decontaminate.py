"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

An item of m distinct shingles is contained at threshold t if at least ceil(t m) of them occur in a document. Its MinHash
sketch is its k = m - ceil(t m) + 1 smallest shingle hashes: a document that contains the item must hold one of any k of
its shingles, so probing the sketches finds every contained item, however long the document. Items are partitioned by
size, since k and the largest sketch hash of a partition (below which a document's hashes are worth probing: the
document's own sketch at that partition's scale) depend on size. Candidates are then verified on the words themselves.

Shingles are runs of 5 words, A-Z in lower case; an item of fewer words is one shingle, its whole sequence.

Cases. Null and empty texts contain nothing; items without words are never contained. Null ids are ids like others, and the filter looks at each row's own text only. Repeated documents or items give repeated pairs. Ties: containment
is whole numbers against ceil(t m), so an item at the threshold counts. An empty benchmark leaves all documents; an empty table has no rows. Very long texts take linear time and about 40 times their
bytes. Other columns pass the filter whatever they are called and are not read by the search. A benchmark of over ITEM_BYTES goes in slices, one index at a time, with one pass over the documents each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import LOWER, flat, grouped, owner, pieces, staged, windows, word_hashes, words

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of benchmark text up to which every task holds all items (4 to 8 times that in memory); above, slices of that size take turns.
ITEM_BYTES = 8 << 20
_LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER_ASCII).split()


def _needed(m: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * m - 1e-9))


class Index:
    """Sketches of items by shingle width and size class, and the shingles to verify with."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids, self.shingles, self.occurs = [], [], []
        for item_id, text in items:
            w = _words(text)
            if w:
                n = min(width, len(w))
                s = list(dict.fromkeys(b" " + b" ".join(w[i : i + n]) + b" " for i in range(len(w) - n + 1)))
                self.ids.append(item_id)
                self.shingles.append(s)
                self.occurs.append(n)
        parts = defaultdict(list)
        for i, s in enumerate(self.shingles):
            parts[self.occurs[i], len(s).bit_length()].append(i)
        self.parts = []
        for (n, _), members in sorted(parts.items()):
            h, of = [], []
            for i in members:
                text = pa.array([x[1:-1].decode() for x in self.shingles[i]])
                data, offs = flat(text)
                starts, ends, first = words(data, offs)
                own = np.unique(windows(word_hashes(data, starts, ends), first, n)[0])
                own = own[: len(self.shingles[i]) - _needed(len(self.shingles[i]), threshold) + 1]
                h.append(own)
                of.append(np.full(len(own), i))
            h, of = np.concatenate(h), np.concatenate(of)
            order = np.argsort(h, kind="stable")
            self.parts.append((n, h[order], of[order]))

    def candidates(self, texts: pa.Array) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch hash."""
        data, offs = flat(texts)
        data = LOWER[data]
        starts, ends, first = words(data, offs)
        base = word_hashes(data, starts, ends)
        found: set[tuple[int, int]] = set()
        runs = {n: windows(base, first, n) for n in {n for n, _, _ in self.parts}}
        for n, h, of in self.parts:
            got, at = runs[n]
            low = np.flatnonzero(got <= h[-1])
            got, at = got[low], at[low]
            k = np.searchsorted(h, got)
            hit = h[np.minimum(k, len(h) - 1)] == got
            for value, doc in set(zip(got[hit].tolist(), owner(first, at[hit]).tolist())):
                value = np.uint64(value)
                for i in range(int(np.searchsorted(h, value)), int(np.searchsorted(h, value, "right"))):
                    found.add((doc, int(of[i])))
        return found

    def contained(self, texts: pa.Array) -> list[tuple[int, int | None, int, int]]:
        """(text, item_id, shingles of the item, those that the text has) of every verified pair."""
        out, held = [], {}
        for doc, i in sorted(self.candidates(texts)):
            if doc not in held:
                held = {doc: b" " + b" ".join(_words(texts[doc].as_py())) + b" "}
            s = self.shingles[i]
            shared = sum(x in held[doc] for x in s)
            if shared >= _needed(len(s), self.threshold):
                out.append((doc, self.ids[i], len(s), shared))
        return out


def indexes(benchmark: DataFrame, width: int, threshold: float, item_bytes: int) -> Iterator[Broadcast]:
    """The broadcast index of each slice of the benchmark, one after another, at least one, with `more`: whether another follows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-total // item_bytes))
    for k in range(n_slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k) if n_slices > 1 else items
        index = benchmark.sparkSession.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x)), width, threshold))
        index.more = k < n_slices - 1
        yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every row of docs and item contained in it at the threshold.

    Null or empty texts contain nothing and items without words are never contained. Repeated documents or items give
    repeated rows. A benchmark of over item_bytes goes through in slices of that size, with one pass over docs for each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])
    out = None
    for index in indexes(benchmark, width, threshold, item_bytes):

        def one(batch, index=index):
            got = index.value.contained(batch.column(1))
            if not got:
                return None
            at, item, n, shared = zip(*got)
            return {"doc_id": batch.column(0).take(pa.array(at)), "item_id": item, "n_shingles": n, "n_shared": shared, "containment": [b / a for a, b in zip(n, shared)]}

        found = docs.mapInArrow(lambda it, one=one: grouped(it, "text", schema, one), "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
        if index.more:  # one index at a time on the driver and in a worker
            found = staged(found)
            index.unpersist()
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose own text contains no item; ids play no part. A pass over docs for each slice of the benchmark, the next over what is left."""
    for index in indexes(benchmark, width, threshold, item_bytes):

        def run(batches, index=index):
            for batch in batches:
                for piece in pieces(batch, "text"):
                    kept = np.ones(piece.num_rows, bool)
                    kept[[at for at, *_ in index.value.contained(piece.column(piece.schema.get_field_index("text")))]] = False
                    yield piece.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
        if index.more:  # one index at a time on the driver and in a worker
            docs = staged(docs)
            index.unpersist()
    return docs
