"""Subword counters: files of three libraries, the same counts in batches, texts and contexts."""

import pickle

import pytest
from pyspark.sql import functions as F

from haystrata.functions import tokens
from haystrata.operators import context
from haystrata.plans import evaluate

P = pytest.importorskip("public_tokenizers")
FILES = [("byte_bpe_50k.json", None), ("byte_bpe_50k.tiktoken", P.PATTERN), ("byte_bpe_multi_50k.tiktoken", P.PATTERN), ("word_bpe_49k.json", None), ("piece_bpe_32k.model", None)]
TEXTS = ["", "def foo(a):\n    return a * 2\n", "é日本 <|endoftext|> naïve", " ", "x" * 3000, None, "one two"]


def plain(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    if name.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return lambda x: len(s.encode(x))
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(e.encode_ordinary(x))


@pytest.mark.parametrize("name, pattern", FILES)
def test_counts_equal_their_library(spark, name, pattern):
    count = pickle.loads(pickle.dumps(tokens.SubwordCounter(P.path(name), pattern)))
    want = [None if x is None else plain(name)(x) for x in TEXTS]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string").repartition(2)
    assert [r["n"] for r in df.select("i", count("x").alias("n")).orderBy("i").collect()] == want
    assert [None if x is None else count.text(x) for x in TEXTS] == want


def test_the_same_vocabulary_counts_the_same():
    a, b = tokens.SubwordCounter(P.path("byte_bpe_50k.json")), tokens.SubwordCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(a.text(x) == b.text(x) for x in TEXTS if x is not None)


def test_wrong_files_are_errors():
    for path, pattern in (("x.txt", None), (P.path("byte_bpe_50k.tiktoken"), None)):
        with pytest.raises(ValueError):
            tokens.SubwordCounter(path, pattern).text("a")


def test_budgets_and_contexts_in_subwords_equal_loops(spark):
    count, one = tokens.SubwordCounter(P.path("byte_bpe_50k.json")), plain("byte_bpe_50k.json")
    body = "\n".join(f"    value_{i} = compute(é{i}, {i * i})" for i in range(30))
    files = spark.createDataFrame([("python", "r", f"f{k}.py", k, f"def f{k}():\n{body}") for k in range(3)], "language string, repo string, path string, file_idx int, content string")
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("n_tok", count(F.concat("line", F.lit("\n"))))
    for backward in (False, True):
        got = {r["path"]: r["n"] for r in context.budget_lines(lines, ["path"], 200, backward).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in range(3):
            rows, run, n = f"def f{k}():\n{body}".split("\n"), 0, 0
            for x in reversed(rows) if backward else rows:
                run += one(x + "\n")
                if run > 200:
                    break
                n += 1
            assert got[f"f{k}.py"] == n
    needles = spark.createDataFrame([("python", "r", "f1.py", "f1", 0, 40, 2, 5, "d")], "language string, repo string, path string, name string, start_byte int, end_byte int, needle_ord int, n_needles int, description string")
    task = evaluate.build_tasks(needles, files, 900, count=count).first()
    assert task["code_context_ntokens"] <= 930 and task["needle_token_end"] - task["needle_token_start"] == one(f"def f1():\n{body}".encode()[:40].decode())
    assert "# Path: f0.py" in task["code_context"] and "# Path: f1.py" in task["code_context"]
    stats = evaluate.token_stats(files, count).first()["tokens"]
    assert stats == sum(one(f"# current path: f{k}.py\ndef f{k}():\n{body}") for k in range(3))


def test_chunks_add_up_and_are_encoded_once():
    import random

    count = tokens._many(P.path("byte_bpe_50k.json"), None)
    count.known.clear()
    random.seed(7)
    some = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "​", "'s", " 'll", "a", "é", "ſ", "日本", "1", "١", "!?", "<|endoftext|>", "_", "-", " –", "«", "́", "\U0001f600", "\x00", "word"]
    texts = ["".join(random.choices(some, k=random.randint(0, 14))) for _ in range(3000)]
    asked, ids = [], count.ids
    count.ids = lambda x: asked.extend(x) or ids(x)
    try:
        assert count(texts) == [len(x) for x in ids(texts)]
        asked.clear()
        assert count(["one two, three\n"] * 1000) == [len(ids(["one two, three\n"])[0])] * 1000
        assert sum(map(len, asked)) < 100  # before: the text 1,000 times
    finally:
        count.ids = ids


def test_costs_from_lines_that_are_held(spark):
    count = tokens.SubwordCounter(P.path("byte_bpe_50k.json"))
    files = spark.createDataFrame([("python", "r", f"f{k}.py", k, f"a\nb{k} c\n") for k in range(3)], "language string, repo string, path string, file_idx int, content string")
    lines = context.line_costs(files, count)
    assert lines.count() == 12
    assert sorted(map(tuple, context.file_costs(files, count, lines).collect())) == sorted(map(tuple, context.file_costs(files, count).collect()))
