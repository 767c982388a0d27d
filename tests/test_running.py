"""Running sums in blocks against loops, and plans that keep texts and hot groups out of one task."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from haystrata.operators import context, curate
from haystrata.operators.running import sums_before
from haystrata.plans import evaluate


@pytest.mark.parametrize("bits, spread, backward", [(1, 40, False), (2, 40, True), (3, 10**6, False), (12, 2**62, True), (12, 30, False), (5, 0, True)])
def test_sums_equal_a_loop(spark, bits, spread, backward):
    rng = random.Random(bits)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(-spread, spread), rng.randint(0, 9), rng.randint(-5, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v int, w int").select("*", F.lit(1).alias("block"))
    got = Counter((r["k"], r["o"], r["v"], r["w"], r["x"], r["y"]) for r in sums_before(df, ["k"], "o", {"x": "v", "y": "w"}, backward, bits).collect())
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    before = lambda r, i: sum(q[i] for q in by[r[0]] if (q[1] > r[1] if backward else q[1] < r[1]))
    assert got == Counter((*r, before(r, 2), before(r, 3)) for r in rows)
    assert sums_before(df.where("false"), ["k"], "o", {"x": "v"}).count() == 0


def test_a_hot_group_is_many_blocks(spark):
    df = spark.range(20_000).selectExpr("if(id < 0, 'x', 'r') k", "id o", "1 v").repartition(4)
    got = sums_before(df, ["k"], "o", {"x": "v"}, bits=6)
    assert got.where("x <> o").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3 and "windowspecdefinition(k" in plan and all("__hs_block" in x for x in plan.split("\n") if "Window [" in x)


def test_annotation_requests_equal_a_loop_and_shuffle_no_text_by_repository(spark):
    rng = random.Random(5)
    files, needles, lines = [], [], defaultdict(list)
    for r in range(6):
        for i in range(rng.randint(1, 30)):
            own = [f"r{r}f{i}l{k}" for k in range(rng.choice([1, 2, 7, 60]))]
            files.append(("l", f"r{r}", f"p{i}", i, "\n".join(own)))
            lines[f"r{r}"] += own
        for n in range(5):
            a = rng.randrange(len(lines[f"r{r}"]))
            needles.append(("l", f"r{r}", f"n{n}", a, min(len(lines[f"r{r}"]), a + rng.randint(1, 9))))
    f = spark.createDataFrame(files, "language string, repo string, path string, file_idx int, content string")
    n = spark.createDataFrame(needles + needles[:2], "language string, repo string, name string, global_start_line int, global_end_line int").select("*", F.lit(1).alias("first"), F.lit(2).alias("t"))
    for span, back in ((4, 10), (4096, 100), (32, 0)):
        got = Counter((r["repo"], r["name"], r["prompt"].split("```\n")[1].rsplit("\n```")[0].removesuffix("\n")) for r in evaluate.annotation_requests(n, f, back, span).collect())
        assert got == Counter((r, x, "\n".join(lines[r][max(0, a - back) : b])) for _, r, x, a, b in needles + needles[:2])
    plan = evaluate.annotation_requests(n, f)._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in plan or "first <" not in plan


def test_token_stats_equal_the_whole_text(spark):
    rng = random.Random(2)
    rows = [("python", f"r{r}", f"p{i}", rng.choice(["", "a b", "a b\n", " x", "é\t", "one\ntwo "])) for r in range(8) for i in range(rng.randint(1, 9))]
    got = {r["repo"]: r["tokens"] for r in evaluate.token_stats(spark.createDataFrame(rows, "language string, repo string, path string, content string")).collect()}
    for r in {x[1] for x in rows}:
        whole = "".join(f"# current path: {p}\n{c}" for _, q, p, c in sorted(rows) if q == r)
        assert got[r] == context.space_tokens.text(whole)
    own = evaluate.token_stats(spark.createDataFrame(rows, "language string, repo string, path string, content string"), context.space_tokens.__class__(lambda x: len(x)))
    assert {r["repo"]: r["tokens"] for r in own.collect()} == {q: sum(len(f"# current path: {p}\n{c}") for _, x, p, c in rows if x == q) for q in {x[1] for x in rows}}


def test_samples_are_cut_before_their_shuffle(spark):
    df = spark.range(100).selectExpr("'l' language", "if(id < 0, 'x', 'r') repo", "cast(id as string) path", "cast(id as string) name")
    plan = curate.sample_per_repo(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and curate.sample_per_repo(df, 3).count() == 3
