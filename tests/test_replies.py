"""Replies and results in streams: each task asked once, stopped runs go on, keys seen are not appended again."""

import json
import os
import uuid
from collections import Counter

import pytest

from haystrata.streaming import replies, resume

DDL = "language string, repo string, name string"


def asker(folder):
    """A provider that writes each question to a folder, and fails while there is a stop for it."""

    class Asked:
        def generate_reply(self, question, **_):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(question)
            if os.path.exists(f"{folder}.stop/{question}"):
                raise RuntimeError("the model is gone")
            return [question.upper()]

    return Asked


def asked(folder):
    return Counter((folder / f).read_text() for f in os.listdir(folder))


@pytest.fixture
def tasks(spark):
    return spark.range(100).selectExpr("'l' language", "case when id % 10 = 3 then null else 'r' end repo", "cast(id as string) name", "concat('q', id) prompt", "1 batch", "2 output_path").repartition(5)


def read(spark, tmp_path):
    return sorted((int(r["name"]), r["repo"], r["output"][0]) for r in spark.read.schema(f"{DDL}, output array<string>").option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect())


def want(n):
    return [(i, None if i % 10 == 3 else "r", f"Q{i}") for i in range(n)]


@pytest.mark.parametrize("flush", [1, 7, 40, 1000])
def test_each_task_is_asked_once(spark, tmp_path, tasks, flush):
    (tmp_path / "asked").mkdir()
    make = asker(str(tmp_path / "asked"))
    some = tasks.where("cast(name as int) < 12") if flush == 1 else tasks
    go = lambda rows: replies.ask_all(rows, str(tmp_path / "run"), str(tmp_path / "out"), make, flush_tasks=flush)
    n = some.count()
    batches = go(some.unionByName(some.limit(3)))  # repeated tasks are one task
    assert batches >= min(n, 100) // max(flush, 4) and read(spark, tmp_path) == want(n)
    assert asked(tmp_path / "asked") == Counter(f"q{i}" for i in range(n))
    assert go(some) == 0 and asked(tmp_path / "asked") == Counter(f"q{i}" for i in range(n))


def test_runs_that_stop_go_on(spark, tmp_path, tasks):
    (tmp_path / "asked").mkdir()
    (tmp_path / "asked.stop").mkdir()
    make = asker(str(tmp_path / "asked"))
    go = lambda rows=tasks, **more: replies.ask_all(rows, str(tmp_path / "run"), str(tmp_path / "out"), make, flush_tasks=20, **more)
    assert go(batches=2) == 2
    done = read(spark, tmp_path)
    assert 0 < len(done) <= 40 and asked(tmp_path / "asked") == Counter(f"q{i}" for i, _, _ in done)
    left = sorted({i for i in range(100)} - {i for i, _, _ in done})
    for i in left[::7]:
        (tmp_path / "asked.stop" / f"q{i}").touch()
    with pytest.raises(Exception, match="the model is gone"):
        go()
    kept = read(spark, tmp_path)
    assert set(done) <= set(kept)  # whole batches stay
    for f in (tmp_path / "asked.stop").iterdir():
        f.unlink()
    before = asked(tmp_path / "asked")
    go()
    assert read(spark, tmp_path) == want(100)
    after = asked(tmp_path / "asked")
    assert all(after[f"q{i}"] == before[f"q{i}"] for i, _, _ in kept)  # what was kept is not asked again
    assert sum(after.values()) - sum(before.values()) == 100 - len(kept)


def test_tasks_done_elsewhere_and_later_ones(spark, tmp_path, tasks):
    (tmp_path / "asked").mkdir()
    make = asker(str(tmp_path / "asked"))
    go = lambda rows: replies.ask_all(rows, str(tmp_path / "run"), str(tmp_path / "out"), make, done=tasks.where("cast(name as int) < 5"), keep=["language", "repo", "name", "output"])
    go(tasks.where("cast(name as int) < 30"))
    go(tasks)
    assert read(spark, tmp_path) == want(100)[5:] and set(asked(tmp_path / "asked").values()) == {1}
    assert go(tasks.where("false")) == 0


def test_resumed_results_keep_null_keys_once_and_read_only_new_lines(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    go = lambda **more: resume.append_results(spark, str(src), DDL, out, str(tmp_path / "cp"), **more)
    row = {"language": "l", "repo": None, "name": "n"}
    (src / "1.json").write_text("".join(json.dumps(x) + "\n" for x in (row, row, row | {"name": "m"})))
    go()
    (src / "2.json").write_text("".join(json.dumps(x) + "\n" for x in (row, row | {"name": None}, row | {"name": None})))
    go()
    go()
    got = Counter((r["repo"], r["name"]) for r in spark.read.parquet(out).collect())
    assert got == Counter({(None, "n"): 1, (None, "m"): 1, (None, None): 1})
    batches = sorted(x for x in os.listdir(f"{out}/_spark_metadata") if x.isdigit())
    assert len(batches) == 2  # one for each delivery, none for a run without new lines


def test_results_done_elsewhere_and_keys_that_expire(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ddl = "name string, ts timestamp"
    line = lambda n, ts: json.dumps({"name": n, "ts": ts}) + "\n"
    (src / "1.json").write_text(line("a", "2024-01-01T00:00:00Z") + line("b", "2024-01-01T00:00:00Z"))
    done = spark.createDataFrame([("b",), (None,)], "name string")
    go = lambda: resume.append_results(spark, str(src), ddl, str(tmp_path / "out"), str(tmp_path / "cp"), ["name"], done, "ts", "1 hour")
    go()
    (src / "2.json").write_text(line("a", "2024-01-01T00:30:00Z") + line("c", "2024-01-02T00:00:00Z"))
    go()
    (src / "3.json").write_text(line("a", "2024-01-02T01:00:00Z") + line("c", "2024-01-02T00:30:00Z") + line(None, "2024-01-02T00:30:00Z"))
    go()
    got = Counter(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter({"a": 2, "c": 1})
