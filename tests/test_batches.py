"""Syntax functions get few rows at a time, whatever a table's size, so that a worker's memory follows its texts."""

import pytest
from pyspark.sql import functions as F

from haystrata.functions import syntax

FORMS = {"functions": syntax.extract_functions, "spans": syntax.comment_spans, "bare": syntax.without_comments, "obfuscated": syntax.obfuscated, "renamed": syntax.renamed_functions}


@pytest.mark.parametrize("name", FORMS)
def test_no_batch_of_thousands_of_texts(spark, name):
    rows = spark.range(10).select(F.lit("# a\ndef f(): return 1\n").alias("code"), F.lit("python").alias("language"))
    plan = rows.select(FORMS[name]("code", "language"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_values_of_rows(spark):
    rows = spark.createDataFrame([("# é\ndef f(): return 1\n", "python"), (None, "python"), ("int f() { return 1; } // x", "cpp")], "code string, language string")
    got = rows.select(*[f("code", "language").alias(k) for k, f in FORMS.items()]).collect()
    assert [[tuple(x) for x in r["functions"]] for r in got] == [[("f", 1, 2, 5, 22)], [], [("f", 0, 1, 0, 21)]]
    assert [[tuple(x) for x in r["spans"]] for r in got] == [[(0, 4)], [], [(22, 26)]]
    assert [r["bare"] for r in got] == ["\ndef f(): return 1\n", "", "int f() { return 1; } "]
    assert [r["obfuscated"] for r in got] == ["\0\0\0\n\ndef f(): return 1\n", "", "int f() { return 1; } \0\0\0\n"]
    assert [r["renamed"] for r in got] == ["# é\ndef function_0(): return 1\n", None, "int function_0() { return 1; } // x"]


def test_trees_are_written_without_large_batches(spark, tmp_path, monkeypatch):
    from haystrata.sources import trees

    rows = spark.createDataFrame([("a/b.py", "é\n"), ("c.txt", None)], "path string, content string")
    monkeypatch.setattr(type(rows), "mapInPandas", lambda *_: pytest.fail("batches of 10,000 files"))
    assert trees.write_tree(rows, str(tmp_path)) == 2 and trees.write_tree(rows.limit(0), str(tmp_path)) == 0
    assert (tmp_path / "a/b.py").read_text() == "é\n" and (tmp_path / "c.txt").read_text() == ""
