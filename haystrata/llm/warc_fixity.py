"""Merkle fixity audit of WARC replicas, in DataFrame operations only (but for read_warc(), which unpacks files).

A replica is a table of records (file, seq, record bytes or their digest, length). Records get ordered offset ranges inside
their file and SHA-256 leaves; FAN_OUT consecutive leaves hash into a node, nodes into the next level, up to a root for
each file, and the files' roots into the replica's root. An audit compares replica roots and descends: on each level only the
children of mismatching nodes are compared, so equal branches cost nothing below their top, and what is left at the bottom are
the damaged offset ranges.

A file's records follow its seq (then id, then digest). Files are bounded by the writer's rotation; the tree's groups have
FAN_OUT rows. Null payloads are empty records; a node that only one replica has is a mismatch.

Cases. Null ids go by url into files of their own. Ties: records with the same id, digest and length are alike and keep any order. Repeated
rows are repeated records. Empty replicas have no rows and no root. Only page_id, url and html are read. Very long payloads are hashed whole.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haystrata.llm.common import staged

FAN_OUT = 16
#: Pages to a WARC file when a page table is written as an archive.
FILE_PAGES = 1000
#: Bytes read from a file at once, and of payloads in a batch of records.
CHUNK, BATCH_BYTES = 1 << 16, 8 << 20


def record(target: Column, payload: Column) -> Column:
    """A WARC/1.1 response record as text; nulls are empty."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(target, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(file, id, digest, length) of pages (page_id, url, html) as WARC records, file_pages ids to a file. Null ids spread over files of their own by url."""
    body = record(F.col("url").cast("string"), F.col("html").cast("string"))
    file = F.coalesce(F.floor(F.col("page_id") / file_pages), -1 - F.pmod(F.xxhash64("url"), F.lit(file_pages)))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), file.cast("long").alias("file"), body.alias("body"))
    return rows.select("file", "id", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("length"))


def warc_bytes(records: list[tuple[str, bytes]], packed: bool = True) -> bytes:
    """A WARC file of (target, payload) response records, each a gzip member of its own if packed."""
    out = []
    for target, payload in records:
        raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: " + target.encode() + b"\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
        out.append(gzip.compress(raw, mtime=0) if packed else raw)
    return b"".join(out)


def members_of(read: Callable[[int], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, unpacked) of the gzip members of a stream, one in memory at a time; from what is none on, the rest as it is."""
    at, data = 0, read(CHUNK)
    while data:
        if len(data) < 2:
            data += read(CHUNK)
        unpack, body, raw, size = zlib.decompressobj(31), [], [], 0
        good = data[:2] == b"\x1f\x8b"
        while good and data:
            try:
                body.append(unpack.decompress(data))
            except zlib.error:
                good = False
                break
            raw.append(data)
            size += len(data)
            if unpack.eof:
                break
            data = read(CHUNK)
        if not good or not unpack.eof:
            rest = b"".join([*raw, data, *iter(lambda: read(CHUNK), b"")])
            yield at, at + len(rest), rest
            return
        data = unpack.unused_data
        end = at + size - len(data)
        yield at, end, b"".join(body)
        at = end
        data = data or read(CHUNK)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """members_of() a file in memory."""
    return members_of(io.BytesIO(data).read)


def _parsed(read: Callable[[int], bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(begin, end, headers, payload) of the WARC records of a stream, one in memory at a time; what is no record any more ends as one with empty headers."""
    at, data = 0, bytearray(read(CHUNK))
    while data:
        seen = 0
        while (head := data.find(b"\r\n\r\n", seen)) < 0 and (more := read(CHUNK)):
            seen = max(0, len(data) - 3)
            data += more
        lines = bytes(data[:head]).decode("utf-8", "replace").split("\r\n") if head >= 0 else []
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        good = bool(lines) and lines[0].startswith("WARC/") and length.isascii() and length.isdigit()
        end = head + 4 + int(length) if good else 0
        while len(data) < end + 4 and (more := read(CHUNK)):
            data += more
        if not good or end > len(data):
            rest = bytes(data) + b"".join(iter(lambda: read(CHUNK), b""))
            yield at, at + len(rest), {}, rest
            return
        payload = bytes(data[head + 4 : end])
        end += 4 * (data[end : end + 4] == b"\r\n\r\n")
        yield at, at + end, headers, payload
        del data[:end]
        at += end
        data = data or bytearray(read(CHUNK))


def records_of(read: Callable[[int], bytes]) -> Iterator[tuple[int, int, int, int, dict[str, str], bytes]]:
    """(begin, end, inner begin, inner end, headers, payload) of each record of a WARC file that read() gives piece by piece: the range of its gzip member in the file (of the record itself in a plain
    file), and its place in what that unpacks to. What is no record any more ends as one with empty headers. A member or a record is in memory, never the file."""
    first = read(2)
    again = iter([first])
    whole = lambda n: next(again, b"") or read(n)
    if first != b"\x1f\x8b":
        for a, b, headers, payload in _parsed(whole):
            yield a, b, a, b, headers, payload
        return
    for a, b, body in members_of(whole):
        for x, y, headers, payload in _parsed(io.BytesIO(body).read):
            yield a, b, x, y, headers, payload


def records_in(data: bytes) -> Iterator[tuple[int, int, int, int, dict[str, str], bytes]]:
    """records_of() a file in memory."""
    return records_of(io.BytesIO(data).read)


def _below(spark: SparkSession, path: str) -> Column:
    """A file's path below the folder that is read (below the last folder without a wildcard); its own name if it is what is read."""
    fixed = []
    for part in path.rstrip("/").split("/"):
        if any(c in part for c in "*?[{"):
            break
        fixed.append(part)
    at = spark._jvm.org.apache.hadoop.fs.Path("/".join(fixed) or "/")
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.substring_index("path", "/", -1))


def _opener(path: str):
    """What opens a path of Spark's as a stream in a task, None where Arrow has no such file system."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    try:
        system, _ = pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return lambda x: system.open_input_stream(pafs.FileSystem.from_uri("file://" + x[5:] if x.startswith("file:/") and not x.startswith("file://") else x)[1], compression=None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, begin, end, kind, target, payload, digest, length) of the records of the WARC files, gzip members or plain, under a path that Spark reads. digest covers
    the record as it lies in the file's member. name is the file's path below what is read, so that files of one name in several folders stay apart. A task streams one file after another through Arrow's file
    systems, a record and BATCH_BYTES of them in memory; where Arrow has no such file system a file comes whole."""
    schema = pa.schema([("name", pa.string()), ("seq", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("target", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("length", pa.int64())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = files.select("path").first()
    streamed = first is not None and _opener(first[0]) is not None
    files = files.select(_below(spark, path).alias("name"), *(["path"] if streamed else [F.lit(None).cast("string").alias("path")]), *([] if streamed else ["content"]))

    def batches_of(name: str, read: Callable[[int], bytes]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for k, (a, b, _, _, h, payload) in enumerate(records_of(read)):
            rows.append((name, k, a, b, h.get("warc-type"), h.get("warc-target-uri"), payload, hashlib.sha256(repr(sorted(h.items())).encode() + payload).hexdigest(), b - a))
            size += len(payload)
            if size > BATCH_BYTES or len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        for batch in batches:
            for i, (name, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if streamed:
                    with _opener(at)(at) as f:
                        yield from batches_of(name, f.read)
                else:
                    yield from batches_of(name, io.BytesIO(batch.column(2)[i].as_py() or b"").read)

    return files.mapInArrow(run, "name string, seq long, begin long, end long, kind string, target string, payload binary, digest string, length long")


def archived(records: DataFrame) -> DataFrame:
    """(file, id, digest, length) of read_warc()'s records, for compare(): a file is a number from its name, an id the record's place in it."""
    return records.select(F.pmod(F.xxhash64("name"), F.lit(1 << 40)).alias("file"), F.col("seq").alias("id"), "digest", "length")


def leaves(records: DataFrame) -> DataFrame:
    """records (file, id, digest, length) with seq and the offset range [begin, end) in their file. The leaf digest covers range and record."""
    w = Window.partitionBy("file").orderBy("id", "digest", "length")
    rows = records.withColumn("seq", F.row_number().over(w) - 1).withColumn("end", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("begin", F.col("end") - F.col("length"))
    return rows.withColumn("h", F.sha2(F.concat_ws("|", "begin", "end", "digest"), 256))


def parents(nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The next level of nodes (file, seq, h): each hashes its children in order."""
    up = nodes.groupBy("file", F.floor(F.col("seq") / fan_out).alias("up")).agg(F.array_sort(F.collect_list(F.struct("seq", "h"))).alias("c"))
    return up.select("file", F.col("up").alias("seq"), F.sha2(F.concat_ws("", F.transform("c", lambda x: x["h"])), 256).alias("h"))


def tree(nodes: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of (file, seq, h) from the leaves up to one node a file."""
    levels = [nodes.select("file", "seq", "h")]
    most = (levels[0].agg(F.max("seq")).first()[0] or 0) + 1
    while most > 1:
        levels.append(staged(parents(levels[-1], fan_out)))
        most = -(-most // fan_out)
    return levels


def root(top: DataFrame, fan_out: int = 1024) -> str | None:
    """The replica's root over its files' roots, in a tree of its own; None without files. Comes to the driver as one string."""
    nodes = top.select(F.lit(0).alias("file"), F.col("file").alias("seq"), "h")
    span = nodes.agg(F.max("seq") - F.min("seq"), F.min("seq")).first()
    if span[0] is None:
        return None
    nodes, width = nodes.withColumn("seq", F.col("seq") - F.lit(span[1])), span[0] + 1
    while True:
        nodes, width = parents(nodes, fan_out), -(-width // fan_out)
        if width <= 1:
            return nodes.first()["h"]


def audit(one: DataFrame, two: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, seq, path) of the leaves under mismatching branches: path is the number of levels descended. one, two: leaves()."""
    a, b = tree(one, fan_out), tree(two, fan_out)
    height = max(len(a), len(b))
    # a lower tree goes on with its roots, which then stand on every higher level
    a, b = ([*x, *([parents_only(x[-1], fan_out, k) for k in range(height - len(x))])] for x in (a, b))
    bad = None
    if root(a[-1]) == root(b[-1]):
        return one.where("false").select("file", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("path"))
    for k in range(height - 1, -1, -1):
        x, y = a[k].withColumnRenamed("h", "x"), b[k].withColumnRenamed("h", "y")
        if bad is not None:
            up = bad.select("file", F.col("seq").alias("up"))
            x, y = (z.withColumn("up", F.floor(F.col("seq") / fan_out)).join(up, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        bad = staged(x.join(y, ["file", "seq"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("seq").cast("long").alias("seq")))
    return bad.withColumn("path", F.lit(height))


def parents_only(top: DataFrame, fan_out: int, k: int) -> DataFrame:
    for _ in range(k + 1):
        top = parents(top, fan_out)
    return top


def compare(one: DataFrame, two: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Every record of either replica: (file, seq, id, begin, end, digest, other_digest, status), places being the first replica's where it has the record.

    status: match; moved (the same record, its range shifted by damage before it); altered (another content under its id); missing (only
    in one) or extra (only in two). Records outside the damaged branches match by their branch's hash and are not compared
    again; those inside are paired by digest, then by id, in order of their places, so that a lost record does not damage those after it.
    """
    one, two = staged(leaves(one)), staged(leaves(two))
    bad = staged(audit(one, two, fan_out).select("file", "seq"))
    names = ["seq", "id", "begin", "end", "digest"]
    good = one.join(bad, ["file", "seq"], "left_anti").select("file", *names, F.col("digest").alias("other_digest"), F.lit("match").alias("status"))
    x, y = (z.join(bad, ["file", "seq"], "left_semi").select("file", *names) for z in (one, two))

    def placed(rows: DataFrame, key: str) -> DataFrame:
        """rows with k, which of the records with the same key of their file each is. A file's records are bounded by its writer."""
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("file", key).orderBy("seq")))

    x, y = staged(placed(x, "digest")), staged(placed(y, "digest"))
    moved = x.join(y.select("file", "digest", "k"), ["file", "digest", "k"], "left_semi").select("file", *names, F.col("digest").alias("other_digest"), F.lit("moved").alias("status"))
    x, y = (placed(a.join(b.select("file", "digest", "k"), ["file", "digest", "k"], "left_anti").drop("k"), "id") for a, b in ((x, y), (y, x)))
    y = y.select(F.col("file").alias("file2"), F.col("k").alias("k2"), *[F.col(n).alias(f"{n}2") for n in names])
    rest = x.join(y, (F.col("file") == F.col("file2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("k") == F.col("k2")), "full_outer")
    status = F.when(F.col("k2").isNull(), "missing").when(F.col("k").isNull(), "extra").otherwise("altered")
    rest = rest.select(F.coalesce("file", "file2").alias("file"), *[F.coalesce(n, f"{n}2").alias(n) for n in names[:-1]], "digest", F.col("digest2").alias("other_digest"), status.alias("status"))
    return good.union(moved).union(rest)


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: pages with the first character changed where page_id mod 211 is 7, every page from the 900th of its
    file's ids on lost where the file number mod 5 is 3, and the 120th where it is a multiple of 3. Bit rot, a torn file end and a record lost in the middle, at known places."""
    hit = F.col("page_id") % 211 == 7
    lost = (F.floor(F.col("page_id") / FILE_PAGES) % 5 == 3) & (F.col("page_id") % FILE_PAGES >= 900)
    html = F.when(hit, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    gone = (F.floor(F.col("page_id") / FILE_PAGES) % 3 == 0) & (F.col("page_id") % FILE_PAGES == 120)
    return pages.select("page_id", "url", html.alias("html")).where(~F.coalesce(lost | gone, F.lit(False)))
