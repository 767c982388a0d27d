"""Token ids of a corpus as binary files: a static range asymmetric numeral system (rans.py) with one frequency table over all documents.

1. Documents are sorted by doc_id over range partitions (equal ids by a hash of the text, then by place), so repeated ids spread too.
2. Each partition is encoded by a tokenizer, an end id appended to each document, and cut into blocks of whole documents of BLOCK_IDS ids or more; a partition also counts its ids.
3. The counts of all partitions are summed in a shuffle to the shared table, whose size is the vocabulary's.
4. Blocks become bytes and runs of them files; a file's name ends in a number of its own and only the files that the manifest names count, so a task that runs again does no harm.
5. Reading takes the manifest's blocks in order over many tasks, by byte ranges; each task decodes its blocks from all checkpoints at once and verifies both checksums.

A folder has `table.bin`, `part-*.rans` and `manifest/` (Parquet: part, block, file, offset, bytes, n_docs, n_ids, first). Files are written and read through Arrow's file systems
(local, HDFS, S3, GCS), from the folder's URI.

Cases: null and empty texts have the end id only; null doc_ids come first; repeated rows are rows of their own; an empty table gives a folder without blocks, which reads as no rows; a text must fit a worker;
other columns are not read.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm import rans
from haystrata.llm.common import flat, pieces, remember, scratch, staged, words

#: Ids of a block (it ends with the document that reaches so many), blocks in memory at once, words that a worker remembers, bytes of text encoded at once.
BLOCK_IDS, READ_BLOCKS, CACHE_WORDS, TEXT_BYTES = 1 << 15, 64, 3 << 18, 1 << 21
BLOCK_DDL = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<int>, ids binary, seen array<int>, times array<long>"
MANIFEST_DDL = "part int, block int, file string, offset long, bytes long, n_docs int, n_ids long, first long"


class WordEncoder:
    """Ids of texts by the tokenizers library. by_words: a tokenizer that drops white space and never looks across it, as one that splits at white space before all else; each
    word then goes to the library once, as long as it is remembered, and a text's ids are its words' ids in order.

    Where the tokenizer lower-cases, keeps what one pattern finds and spells bytes as letters, a new word of common letters is cut by that pattern here and only its new parts
    go to the library's model; a letter is common if the whole tokenizer agrees on it in all of SEEN_IN."""

    SEEN_IN = ("{}", "a{}", "{}a", "9{}", "{}9", "!{}", "{}!", "{}{}", "'{}", "é{}a")

    def __init__(self, path: str, by_words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.pattern, self.spelled = None, {}
        self.forget()
        if by_words:
            self._learn_letters()

    def _learn_letters(self) -> None:
        import regex

        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        marks = {x["content"][:1] for x in made.get("added_tokens", [])}  # such tokens are found in any text
        if "Lowercase" not in steps or not {"NFC", "Replace", "Lowercase"}.issuperset(steps) or "Regex" not in split.get("pattern", {}) or (split.get("behavior"), split.get("invert")) != ("Removed", True) or [x["type"] for x in rest] != ["ByteLevel"] or rest[0].get("add_prefix_space"):
            return
        self.pattern = regex.compile(split["pattern"]["Regex"] + "|\n")
        # bytes that are visible Latin-1 characters are spelled as themselves, the others as U+0100 and on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letter = dict(zip(own, map(chr, own))) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}
        letters = [chr(c) for c in range(33, 0x250)]
        self.spelled = {ord(c): "".join(letter[b] for b in c.encode()) for c in letters}
        tests = [form.format(c, c) for c in letters for form in self.SEEN_IN]
        want = [x.ids for x in self.tokenizer.encode_batch_fast(tests, add_special_tokens=False)]
        agree = np.array([self._parts(x)[0].tolist() == w for x, w in zip(tests, want)]).reshape(len(letters), -1).all(1)
        self.common = np.zeros(0x251, bool)  # the last one is any other character
        self.common[[ord(c) for c, ok in zip(letters, agree) if ok and c not in marks]] = True

    def _parts(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each line has) of lines by their parts."""
        found = self.pattern.findall(lines.lower())
        at = self.parts.places(found)
        gone = np.flatnonzero(at < 0)
        if len(gone):
            asked = [found[i] for i in gone.tolist()]
            new = list(dict.fromkeys(asked))
            lists = [[] if x == "\n" else [t.id for t in self.tokenizer.model.tokenize(x.translate(self.spelled))] for x in new]
            self.parts.add(new, *_flattened(lists))
            at[gone] = self.parts.places(asked)
        begin, size = self.parts.spans(at)
        line = np.cumsum(at == self.parts.known.get("\n", -2))
        return self.parts.ids[_ranges(begin, size)], np.bincount(line, size, minlength=lines.count("\n") + 1).astype(np.int64)

    def forget(self) -> None:
        self.words, self.parts = _Remembered(), _Remembered()

    def learn(self, new: list[bytes]) -> None:
        """Remembers new words. Nothing made here is cyclic, so the collector rests: with a list a word it would look through all of them time and again."""
        resting = gc.isenabled()
        gc.disable()
        try:
            self._learn(new)
        finally:
            if resting:
                gc.enable()

    def _learn(self, new: list[bytes]) -> None:
        odd = new
        if self.pattern is not None:
            lines = b"\n".join(new).decode("utf-8", "replace")
            codes = np.frombuffer(lines.encode("utf-32-le", "replace"), np.uint32)
            unusual = np.bincount(np.cumsum(codes == 10), ~self.common[np.minimum(codes, 0x250)] & (codes != 10), minlength=len(new)) > 0
            odd, plain = ([w for w, x in zip(new, unusual.tolist()) if x == y] for y in (True, False))
            if plain:
                self.words.add(plain, *self._parts(b"\n".join(plain).decode()))
        if odd:
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)
            self.words.add(odd, *_flattened([x.ids for x in got]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        if not self.by_words:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(["" if x is None else x for x in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        self.words.shrink()
        self.parts.shrink()
        data, offs = flat(texts)
        starts, ends, first = words(data, offs)
        which, distinct = _numbered(data, starts, ends)
        at = self.words.places(distinct)
        gone = np.flatnonzero(at < 0)
        if len(gone):
            asked = [distinct[i] for i in gone.tolist()]
            self.learn(list(dict.fromkeys(asked)))
            at[gone] = self.words.places(asked)
        begin, size = (x[which] for x in self.words.spans(at))
        before = np.concatenate([[0], np.cumsum(size)])
        return self.words.ids[_ranges(begin, size)], np.diff(before[first])


class _Remembered:
    """Keys and the ids of each."""

    def __init__(self):
        self.known: dict = {}
        self.ids, self.ends, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def places(self, keys: list) -> np.ndarray:
        """Each key's number, -1 for those that are not known."""
        return np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the numbers begin, and how many there are."""
        self.uses[at] += 1
        begin = np.where(at > 0, self.ends[at - 1], 0)
        return begin, self.ends[at] - begin

    def add(self, new: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        ends = (self.ends[n - 1] if n else 0) + np.cumsum(sizes)
        while len(self.ends) < n + len(new):
            self.ends, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.uses))
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[ends[-1] - len(ids) : ends[-1]] = ids
        self.ends[n : n + len(new)] = ends
        self.known.update(zip(new, range(n, n + len(new))))

    def shrink(self) -> None:
        """Over CACHE_WORDS keys: forgets those that were used once, or all of them if that leaves more than half."""
        if len(self.known) <= CACHE_WORDS:
            return
        often = np.flatnonzero(self.uses[: len(self.known)] > 1)
        keys, kept, ids = list(self.known), len(often) <= CACHE_WORDS // 2, self.ids
        begin, size = self.spans(often)
        self.__init__()
        if kept and len(often):
            self.add([keys[i] for i in often.tolist()], ids[_ranges(begin, size)], size)


def _flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin, begin + 1 … of so many each, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number among the distinct ones (some may come twice) and their bytes: words of up to 16 bytes as two integers, longer ones one by one."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    size = ends - starts
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 16)[starts]
    low, high = (np.ascontiguousarray(rows[:, 8 * k : 8 * k + 8]).view("<u8")[:, 0] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in (0, 1))
    short = size <= 16
    short[np.searchsorted(starts, np.flatnonzero(data == 0), "right") - 1] = False  # a zero byte looks like a shorter word
    raw = data.tobytes()
    which = np.zeros(len(starts), np.int64)
    near = np.flatnonzero(short)
    order = near[np.argsort((low[near] * np.uint64(0x9E3779B97F4A7C15)) ^ (high[near] * np.uint64(0xC2B2AE3D27D4EB4F)))]
    edge = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])[: len(order)]
    which[order] = np.cumsum(edge) - 1
    distinct = [raw[a:b] for a, b in zip(starts[order[edge]].tolist(), ends[order[edge]].tolist())]
    far = np.flatnonzero(~short)
    names: dict[bytes, int] = {}
    for i, a, b in zip(far.tolist(), starts[far].tolist(), ends[far].tolist()):
        which[i] = len(distinct) + names.setdefault(raw[a:b], len(names))
    return which, distinct + list(names)


@functools.lru_cache(2)
def _encoder(path: str, by_words: bool) -> WordEncoder:
    return WordEncoder(path, by_words)


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part) in ascending order of doc_id over the partitions."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("i"))
    return keyed.repartitionByRange("doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i").select("doc_id", "text", F.spark_partition_id().alias("part"))


def tokenized(docs: DataFrame, path: str, end_id: int, by_words: bool) -> DataFrame:
    """Blocks (BLOCK_DDL) of ordered documents; the last row of a partition has its counts instead. The ids are 16 or 32 bits wide."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, by_words)
        vocabulary = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        counts = np.zeros(vocabulary, np.int64)
        held, names, sizes, total, block, first, part = [], [], [], 0, 0, 0, None

        def cut():
            nonlocal held, names, sizes, total, block, first
            row = {"part": part, "block": block, "first": first, "n_ids": total, "doc_ids": names, "lengths": sizes, "ids": np.concatenate(held).astype(kind).tobytes(), "seen": None, "times": None}
            block, first = block + 1, first + total
            held, names, sizes, total = [], [], [], 0
            return row

        for batch in batches:
            for piece in pieces(batch, "text", TEXT_BYTES):
                part, out = piece.column("part")[0].as_py(), []
                ids, size = encoder.encode(piece.column("text"))
                at = np.concatenate([[0], np.cumsum(size)])
                ids = np.insert(ids, at[1:], end_id).astype(np.uint32)
                at += np.arange(len(at))
                counts += np.bincount(ids, minlength=vocabulary)
                begin = 0
                for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                    names.append(doc)
                    sizes.append(int(size[k]) + 1)
                    total += sizes[-1]
                    if total >= BLOCK_IDS:
                        held.append(ids[at[begin] : at[k + 1]])
                        out.append(cut())
                        begin = k + 1
                if begin < len(size):
                    held.append(ids[at[begin] :])
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if part is not None:
            last = [cut()] if total else []
            seen = np.flatnonzero(counts)
            last.append({"part": part, "seen": seen.tolist(), "times": counts[seen].tolist()})
            yield pa.RecordBatch.from_pylist(last, schema=schema)

    return ordered(docs).mapInArrow(run, BLOCK_DDL)


def frequency_table(blocks: DataFrame) -> rans.Table:
    """The shared table of all ids; a row an id comes to the driver, as many as the vocabulary has at most."""
    sums = blocks.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n")).collect()
    counts = np.zeros(1 + max([0, *(r["seen"] for r in sums)]), np.int64)
    for r in sums:
        counts[r["seen"]] = r["n"]
    return rans.Table.of(counts)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


@functools.lru_cache(2)
def _table(folder: str) -> rans.Table:
    system, path = _place(folder)
    with system.open_input_file(f"{path}/table.bin") as f:
        return rans.Table.from_bytes(f.read())


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, by_words: bool = False) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to a new folder and returns its manifest. path: a file of the tokenizers library; by_words: see WordEncoder."""
    spark = docs.sparkSession
    blocks = staged(tokenized(docs, path, end_id, by_words), compression="zstd")
    system, place = _place(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/table.bin") as f:
        f.write(frequency_table(blocks).to_bytes())
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (system, place) = _table(folder), _place(folder)
        out, part, name, at = None, None, None, 0
        try:
            for batch in batches:
                for i in range(0, len(batch), READ_BLOCKS):
                    rows = batch.slice(i, READ_BLOCKS).to_pylist()
                    ids = [np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * r["n_ids"] else np.uint32).astype(np.uint32) for r in rows]
                    made = []
                    for r, own, coded in zip(rows, ids, rans.encode(ids, table)):
                        if r["part"] != part:
                            if out:
                                out.close()
                            part, at = r["part"], 0
                            name = f"part-{part:06d}-{r['block']:07d}-{uuid.uuid4().hex}.rans"
                            out = system.open_output_stream(f"{place}/{name}")
                        raw = rans.pack(r["doc_ids"], np.array(r["lengths"]), own, coded)
                        out.write(raw)
                        made.append({k: r[k] for k in ("part", "block", "n_ids", "first")} | {"file": name, "offset": at, "bytes": len(raw), "n_docs": len(r["doc_ids"])})
                        at += len(raw)
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
        finally:
            if out:
                out.close()

    files = blocks.where("ids is not null").select("part", "block", "first", "n_ids", "doc_ids", "lengths", "ids")
    files.mapInArrow(run, MANIFEST_DDL).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a folder that write_tokens() made: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    manifest = spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest")
    sums = sorted(manifest.groupBy("part").agg(F.sum("n_ids")).collect())  # one row a partition
    base, total = [], 0
    for part, n in sums:
        base.append((part, total))
        total += n
    based = manifest.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("first", F.col("first") + F.col("base")).drop("base")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // 256))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (system, place) = _table(folder), _place(folder)
        name, f = None, None
        for batch in batches:
            for i in range(0, len(batch), READ_BLOCKS):
                rows, raw = batch.slice(i, READ_BLOCKS).to_pylist(), []
                for r in rows:
                    if r["file"] != name:
                        name, f = r["file"], system.open_input_file(f"{place}/{r['file']}")
                    raw.append(f.read_at(r["bytes"], r["offset"]))
                columns: list[list] = [[] for _ in schema]
                for r, (names, lengths, ids) in zip(rows, rans.unpack(raw, table)):
                    ends = np.cumsum(lengths)
                    stream = memoryview(ids.astype("<u4").tobytes())
                    columns[0] += names
                    columns[1] += (r["first"] + ends - lengths).tolist()
                    columns[2] += lengths.tolist()
                    columns[3] += [zlib.crc32(stream[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                    if with_ids:
                        columns[4] += [ids[b - n : b].astype(np.int32) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema)

    return based.repartitionByRange(tasks, "part", "block").sortWithinPartitions("part", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def encode_corpus(docs: DataFrame, path: str, end_id: int = 2, by_words: bool = False) -> DataFrame:
    """write_tokens() to a folder of the shared scratch space, and read_tokens() of it."""
    folder = f"{scratch(docs.sparkSession)}/haystrata-tokens-{uuid.uuid4().hex}"
    remember(docs.sparkSession, folder)
    write_tokens(docs, folder, path, end_id, by_words)
    return read_tokens(docs.sparkSession, folder)
