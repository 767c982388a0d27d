"""The tree source: folders and commits, conditions that reach it, objects that it never opens."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from haystrata.sources import readers, trees

FILES = {"a/x.py": "one\n", "a/y.txt": "two é", "b/c/z.py": "", "b/c/w.pyi": "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "top.py": "t" * 5000}


@pytest.fixture
def folder(tmp_path):
    for path, content in FILES.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(content)
    return str(tmp_path / "t")


def test_folders_and_picks(spark, folder):
    rows = trees.read_tree(spark, folder)
    assert {r["path"]: r["content"] for r in rows.collect()} == FILES and all(r["size"] == len(r["content"].encode()) for r in rows.collect())
    for picked, want in [({"ends": [".py"]}, {"a/x.py", "b/c/z.py", "top.py"}), ({"begins": ["b/"], "ends": [".py"]}, {"b/c/z.py"}), ({"names": ["top.py", "nope"]}, {"top.py"}), ({"begins": ["a/", "b/"], "ends": [".py", ".txt"]}, {"a/x.py", "a/y.txt", "b/c/z.py"}), ({"names": ["none"]}, set())]:
        for root in (folder, "file://" + folder, folder + "/"):
            assert {r["path"] for r in trees.read_tree(spark, root, **picked).collect()} == want
    both = rows.where(F.endswith("path", F.lit(".py"))).union(rows.where("path = 'a/y.txt'"))  # one table, two conditions
    assert sorted(r["path"] for r in both.collect()) == ["a/x.py", "a/y.txt", "b/c/z.py", "top.py"]


def test_ruled_out_objects_are_never_opened(folder):
    reader = trees.TreeReader({"path": folder, "begins": "b", "ends": ".py"})
    parts = reader.partitions()
    assert [f[0] for part in parts for f in part.files] == ["b/c/z.py"]
    os.remove(folder + "/a/x.py")  # what is opened must be there
    assert [x[0] for part in parts for x in reader.read(part)] == ["b/c/z.py"]


def test_partitions_are_bounded(folder, monkeypatch):
    monkeypatch.setattr(trees, "PART_FILES", 2)
    assert [len(p.files) for p in trees.TreeReader({"path": folder}).partitions()] == [2, 2, 1]
    monkeypatch.setattr(trees, "PART_BYTES", 1)
    assert len(trees.TreeReader({"path": folder}).partitions()) == 5


def test_commits_by_one_process_a_partition(spark, folder, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", folder, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    old = git("rev-parse", "HEAD")
    os.remove(folder + "/a/x.py")
    (open(folder + "/new.py", "w")).write("new")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert {r["path"]: r["content"] for r in trees.read_tree(spark, folder, old).collect()} == FILES
    assert {r["path"] for r in readers.read_git_tree(spark, folder, "HEAD", "/b", [".py"]).collect()} == {"b/c/z.py"}
    started = []
    real = subprocess.Popen
    monkeypatch.setattr(trees.subprocess, "Popen", lambda *a, **k: started.append(a[0]) or real(*a, **k))
    reader = trees.TreeReader({"path": folder, "commit": old})
    assert {x[0] for part in reader.partitions() for x in reader.read(part)} == set(FILES)
    assert sum("cat-file" in x for x in started) == 1
    with pytest.raises(OSError, match="no object"):
        list(reader.read(trees.Part([("p", 1, "0" * 40)])))


def test_written_trees(spark, tmp_path):
    df = spark.createDataFrame(list(FILES.items()) + [("n/u", None)], "path string, content string").repartition(3)
    assert trees.write_tree(df, str(tmp_path / "w")) == 6
    assert {r["path"]: r["content"] for r in trees.read_tree(spark, str(tmp_path / "w")).collect()} == FILES | {"n/u": ""}
    assert trees.write_tree(df.where("false"), str(tmp_path / "e")) == 0
