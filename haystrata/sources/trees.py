"""File trees as a Spark source: a folder, or any commit of a checkout, with path, size and content of its files.

Beginnings, endings and whole names of paths are options of the source, so objects that they rule out are never opened; the driver lists names and sizes only. (Spark 4.1 can hand conditions to
such a source, but then keeps those of a table's first use for its later ones, so this one takes none.) A partition is
a run of files of PART_BYTES or PART_FILES at most; git's objects come from one `git cat-file` a partition. Content that is not UTF-8 has replacement characters. Links and
submodules are left out. Folders are read through Arrow's file systems (local, HDFS, S3, GCS); both must be visible to the executors.
"""

from __future__ import annotations

import functools
import subprocess
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, PART_FILES = 16 << 20, 1000
DDL = "path string, size long, content string"


@functools.lru_cache(4)
def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


class TreeSource(DataSource):
    """Options: path; commit, of a checkout at path; begins, ends and names, lists of path beginnings, endings and whole paths of which one of each list must hold, one a line."""

    @classmethod
    def name(cls) -> str:
        return "haystrata_tree"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = files  # path, size, object


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.commit = options["path"], options.get("commit")
        self.begins, self.ends, self.names = (tuple(x for x in options.get(k, "").split("\n") if x) for k in ("begins", "ends", "names"))

    def wants(self, path: str) -> bool:
        return (not self.begins or path.startswith(self.begins)) and (not self.ends or path.endswith(self.ends)) and (not self.names or path in self.names)

    def listed(self) -> Iterator[tuple[str, int, str]]:
        if self.commit:
            out = subprocess.run(["git", "-C", self.path, "ls-tree", "-r", "-l", "-z", "--full-tree", self.commit], check=True, capture_output=True).stdout
            for entry in out.decode("utf-8", "replace").split("\0"):
                meta, _, path = entry.partition("\t")
                if meta.startswith("100"):
                    _, _, blob, size = meta.split()
                    yield path, int(size), blob
            return
        system, root = file_system(self.path)
        for x in system.get_file_info(pafs.FileSelector(root, recursive=True)):
            if x.type == pafs.FileType.File:
                yield x.path[len(root) + 1 :], x.size or 0, x.path

    def partitions(self) -> list[Part]:
        out, own, total = [], [], 0
        for path, size, where in sorted(x for x in self.listed() if self.wants(x[0])):
            if own and (total + size > PART_BYTES or len(own) >= PART_FILES):
                out.append(Part(own))
                own, total = [], 0
            own.append((path, size, where))
            total += size
        return [*out, Part(own)] if own else out or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        if not partition.files:
            return
        if not self.commit:
            system, _ = file_system(self.path)
            for path, size, where in partition.files:
                with system.open_input_stream(where) as f:
                    yield path, size, f.read().decode("utf-8", "replace")
            return
        with subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path, _, blob in partition.files:
                git.stdin.write(blob.encode() + b"\n")
                git.stdin.flush()
                head = git.stdout.readline().split()
                if len(head) != 3:
                    raise OSError(f"git has no object {blob}")
                raw = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield path, len(raw), raw.decode("utf-8", "replace")


def read_tree(spark: SparkSession, path: str, commit: str | None = None, begins: list[str] | None = None, ends: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """path, size, content of the files of a folder, or of a commit of the checkout there; begins, ends and names as in TreeSource."""
    spark.dataSource.register(TreeSource)
    options = {"path": path, "commit": commit} | {k: "\n".join(v or []) for k, v in (("begins", begins), ("ends", ends), ("names", names))}
    return spark.read.format(TreeSource.name()).options(**{k: v for k, v in options.items() if v}).load()


def write_tree(files: DataFrame, folder: str) -> int:
    """Writes every row of files (path, content) as a file below a folder; a task that runs again writes the same. Says how many there are."""

    def one(path, content):
        system, root = file_system(folder)
        system.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{root}/{path}") as f:
            f.write((content or "").encode())
        return 1

    put = F.udf(one, "int", useArrow=False).asNondeterministic()  # a hundred rows at a time, whatever the table's size
    return files.select(put("path", "content").alias("n")).groupBy().sum("n").first()[0] or 0
