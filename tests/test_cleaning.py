"""Comment cleaning, padding and token places against a loop; token counters; prompts; annotation; providers; streams and slices."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haystrata.functions import provider, syntax, text
from haystrata.operators import context, curate, deps
from haystrata.plans import evaluate
from haystrata.sources import sinks
from haystrata.streaming import resume


def tok(s):
    return len(s.split()) + 1


def bare(code, keep=(), blank=False):
    """Python code of one statement or comment a line without its comments."""
    out = []
    for line in code.split("\n"):
        at = line.find("#")
        out.append(line if at < 0 or line[at:] in keep else line[:at])
    return "\n".join(out)


def loop(files, own, a, b, ratio, size, mode):
    """Prefix, needle and suffix by a plain loop over lines, cleaned file by file."""
    content = dict(files)[own]
    needle = content[a:b]
    pre = int(size * ratio - tok(needle) / 2)
    suf = size - tok(needle) - pre

    def forward(lines, left):
        out, used = "", 0
        for x in lines:
            if used + tok(x + "\n") > left:
                return out + "...\n", used + 2, True
            out, used = out + x + "\n", used + tok(x + "\n")
        return out, used, False

    out, left, broke = "", pre, False
    for x in reversed([f"# Path: {own}", *content[:a].split("\n")]):
        if tok(x + "\n") > left:
            broke = True
            break
        out, left = x + "\n" + out, left - tok(x + "\n")
    before, after, names = [], [], [p for p, _ in files]
    i = names.index(own) - 1
    while i >= 0 and left > 0 and not broke:
        part, used, broke = forward([f"# Path: {names[i]}", *files[i][1].split("\n")], left)
        before.insert(0, (names[i], files[i][1], part))
        left, i = left - used, i - 1
    end, used, broke = forward(content[b:].split("\n"), suf)
    left, i = suf - used, names.index(own) + 1
    while i < len(names) and left > 0 and not broke:
        part, used, broke = forward([f"# Path: {names[i]}", *files[i][1].split("\n")], left)
        after.append((names[i], files[i][1], part))
        left, i = left - used, i + 1
    old = ["".join(p for *_, p in before) + out, needle, end + "".join(p for *_, p in after)]
    if mode == "none":
        return old
    keep = {f"# Path: {p}" for p in [x for x, *_ in before] + [own] + [x for x, *_ in after]}
    whole = lambda name, code, part: f"# Path: {name}\n" + "\n".join(bare(code).split("\n")[: part.count("\n") - 1]) + "...\n"
    new = [(whole(*before[0]) if before else "") + bare("".join(p for *_, p in before[1:]) + out, keep), bare(needle, keep), bare(end + "".join(p for *_, p in after[:-1]), keep) + (whole(*after[-1]) if after else "")]
    if mode == "positional_padding":
        lost = [tok(x) - tok(y) for x, y in zip(old, new)]
        share, k, pads = int(lost[1] * ratio), 0, []
        for need in (share + lost[0] - 1, lost[1] - share + lost[2] - 1):
            pads.append("")
            while need > 0:
                line = f"# Line Number {k}\n"
                pads[-1], need, k = pads[-1] + line, need - tok(line), k + 1
        new = [pads[0] + "\n" + new[0], new[1], new[2] + pads[1] + "\n"]
    return new


@pytest.mark.parametrize("mode", evaluate.CLEAN_MODES)
def test_cleaning_modes_equal_a_loop(spark, mode):
    rng = random.Random(5)
    line = lambda: rng.choice(["x = 1", "y = 2  # why this is so", "# a whole line of remarks", "z = 3", "# Path: elsewhere.py", "w = (1)"])
    rows, needles, want = [], [], {}
    for r in range(20):
        files = [(f"f{i}.py", "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(rng.randint(1, 6))]
        rows += [("python", f"r{r}", p, i, c) for i, (p, c) in enumerate(files)]
        own, content = rng.choice(files)
        lines = content.split("\n")
        i = rng.randrange(len(lines))
        a = len("\n".join(lines[:i])) + (i > 0)
        b = a + len("\n".join(lines[i : i + 2]))
        k = rng.randint(0, 4)
        needles.append(("python", f"r{r}", own, "n", "what it does", a, b, k, 5))
        want[f"r{r}"] = (files, own, a, b, (k + 0.5) / 5)
    f = spark.createDataFrame(rows, "language string, repo string, path string, file_idx int, content string")
    n = spark.createDataFrame(needles, "language string, repo string, path string, name string, description string, start_byte int, end_byte int, needle_ord int, n_needles int")
    for size in (20, 90):
        got = {x["repo"]: x for x in evaluate.build_tasks(n, f, size, clean_mode=mode).collect()}
        for repo, args in want.items():
            pre, needle, suf = loop(*args, size, mode)
            x = got[repo]
            assert x["code_context"] == pre + needle + suf, (repo, size)
            assert (x["needle_token_start"], x["needle_token_end"], x["code_context_ntokens"]) == (tok(pre), tok(pre) + tok(needle), tok(pre) + tok(needle) + tok(suf))


def test_counter_of_a_tokenizer_in_batches(spark):
    made = text.Counter(setup=lambda: lambda s: len(s) // 3 + 1)
    df = spark.createDataFrame([("",), ("abcdefg",), (None,)], "t string")
    assert [r["n"] for r in df.select(made("t").alias("n")).collect()] == [1, 3, None]
    assert made.text("abcdefg") == 3
    files = spark.createDataFrame([("python", "r", "a.py", 0, "x = 1\ny = 2"), ("python", "r", "b.py", 1, "z")], "language string, repo string, path string, file_idx int, content string")
    costs = {r["file_idx"]: (r["n_tok"], r["before"]) for r in context.file_costs(files, made).collect()}
    lines = lambda *x: sum(len(y + "\n") // 3 + 1 for y in x)
    assert costs == {0: (lines("# Path: a.py", "x = 1", "y = 2"), 0), 1: (lines("# Path: b.py", "z"), costs[0][0])}
    needle = spark.createDataFrame([("python", "r", "a.py", "n", "d", 0, 5, 0, 1)], "language string, repo string, path string, name string, description string, start_byte int, end_byte int, needle_ord int, n_needles int")
    assert evaluate.build_tasks(needle, files, 60, clean_mode="positional_padding", count=made).count() == 1


def test_prompts_follow_their_template(spark):
    rows = spark.createDataFrame([("a\nb\na", "1", "2"), ("b", "1", "2")], "template string, a string, b string")
    assert [r["p"] for r in rows.select(text.prompt("template", {"a": "a", "b": "b"}).alias("p")).collect()] == ["121", "2"]
    with pytest.raises(PySparkException, match="no such part"):
        rows.select(text.prompt(F.lit("a\nc"), {"a": "a", "b": "b"})).collect()
    assert [tuple(r) for r in spark.range(1).select(text.actual_ratio(F.lit(3), F.lit(4)), text.actual_ratio(F.lit(0), F.lit(0)), text.repo_tail(F.lit("o/r"))).collect()] == [(0.75, None, "r")]


def test_annotation_reaches_into_the_files_before(spark):
    files = spark.createDataFrame([("l", "r", "a", 0, "a0\na1\na2"), ("l", "r", "b", 1, "b0\nb1\nb2")], "language string, repo string, path string, file_idx int, content string")
    needles = spark.createDataFrame([("l", "r", "n", 4, 5), ("l", "r", "first", 0, 1)], "language string, repo string, name string, global_start_line int, global_end_line int")
    for back, want in ((2, "a2\nb0\nb1"), (100, "a0\na1\na2\nb0\nb1"), (0, "b1")):
        got = {r["name"]: r["prompt"] for r in evaluate.annotation_requests(needles, files, back).collect()}
        assert f"```\n{want}\n```" in got["n"] and "```\na0\n```" in got["first"]

    class Says:
        def generate_reply(self, q, max_tokens=0, temperature=0.0, **_):
            return [f"<desc_start>{max_tokens} {temperature}<desc_end>"]

    done = spark.createDataFrame([("r", "first")], "repo string, name string")
    assert [(r["name"], r["annotation"]) for r in evaluate.annotate(needles, files, Says, done).collect()] == [("n", "2048 0.2")]


def test_blocked_replies_waits_and_stop_sequences(monkeypatch):
    asked, slept = [], []
    monkeypatch.setattr(provider.time, "sleep", slept.append)

    class RateLimitError(Exception):
        pass

    class APIError(Exception):
        body = {"error": {"message": provider.BLOCKED}}

    def fails(errors):
        def call():
            asked.append(1)
            if errors:
                raise errors.pop(0)
            return "ok"

        return call

    assert provider.retried(fails([RateLimitError(), ValueError()])) == "ok" and slept == [10.0, 1.0]
    asked.clear()
    with pytest.raises(provider.Rejected):
        provider.retried(fails([APIError(), APIError()]))
    assert len(asked) == 1

    class Chat:
        chat_template = "x"

        def apply_chat_template(self, messages, tokenize):
            return "".join(f"<{m['role']}>{m['content']}</s>" for m in messages)

    assert provider.stop_sequence(Chat()) == "</s>" and provider.model_stops("no such model") == []


def test_crate_targets_and_stage_flags(spark):
    meta = {"packages": [{"targets": [{"name": "a", "src_path": "/t/crates/a/src/lib.rs", "kind": ["lib", "x"]}, {"name": "b", "src_path": "/t/crates/b/main.rs", "kind": ["bin"]}, {"name": "t", "src_path": "/t/crates/t.rs", "kind": ["test", "bin"]}, {"name": "o", "src_path": "/t/other/lib.rs", "kind": ["lib"]}]}]}
    df = spark.createDataFrame([("r", json.dumps(meta))], "repo string, metadata string")
    assert {(r["name"], r["kind"]) for r in deps.crate_targets(df, "crates").collect()} == {("a", "lib"), ("b", "bin")}
    rows, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [curate.pending(rows, d, ["k"], o).count() for d, o in ((None, False), (done, False), (done, True))] == [2, 1, 2]


def test_orphans_are_errors(spark):
    rows = spark.range(40).selectExpr("'l' language", "'r' repo", "cast(id as string) name")
    with pytest.raises(ValueError, match="not in the dataset"):
        evaluate.score_all(rows.withColumn("output", F.array(F.lit("x"))), rows.where("false").selectExpr("language", "repo", "name", "name path", "0 needle_ord", "0 start_line", "1 end_line"), rows.selectExpr("language", "repo", "name path", "name content"))


def test_obfuscated_dataset_and_partial_files(spark, tmp_path):
    repos = spark.createDataFrame([("python", 0, "r", {"a.py": "x = 1 # no\n"})], "language string, repo_ord int, repo string, content map<string,string>")
    out = sinks.obfuscate_dataset(repos, str(tmp_path / "d.json"), syntax.obfuscated)
    assert out.endswith("d-obfuscated.json")
    assert spark.read.schema("content map<string,string>").json(out).first()["content"] == {"a.py": "x = 1 \0\0\0\n\n"}
    assert syntax.clean_partial_file("a # b\nc\nd", "python", 3, "#", "p") == "# Path: p\na \nc...\n"
    assert syntax.padding("#", 9, tok, 4) == ("# Line Number 4\n# Line Number 5\n", 6)


def test_no_text_crosses_an_exchange_for_offsets(spark):
    files = spark.createDataFrame([("l", "r", 0, "x")], "language string, repo string, topo_idx int, content string").repartition(3, "topo_idx")
    plan = curate.global_offsets(files)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    below = [b for a, b in zip(lines, lines[1:]) if "hashpartitioning(language" in a]
    assert below and all("__hs_v0" in b and "content" not in b for b in below)


def test_git_tree_of_an_older_commit(spark, tmp_path):
    import subprocess

    from haystrata.sources import readers

    def git(*args):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True).stdout.decode().strip()

    git("init", "-q")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a é.py").write_text("old = 'é'\n")
    (tmp_path / "p" / "b.txt").write_text("t")
    (tmp_path / "q.py").write_text("q")
    git("add", "-A")
    git("commit", "-qm", "one")
    sha = git("rev-parse", "HEAD")
    (tmp_path / "p" / "a é.py").write_text("new")
    git("commit", "-qam", "two")
    got = lambda **o: {r["path"]: r["content"] for r in readers.read_git_tree(spark, str(tmp_path), sha, **o).collect()}
    assert got(entrypoint="p", suffixes=[".py"]) == {"p/a é.py": "old = 'é'\n"}
    assert set(got()) == {"p/a é.py", "p/b.txt", "q.py"} and got(entrypoint="none") == {}


def test_tasks_with_separators_in_their_names_stay_apart(spark):
    from haystrata.operators import score

    rows = [("l", "r", "a", ["x y"]), ("l", "r\x1fa", "", ["x y"]), ("l\x1fr", "a", "", ["x y"])]
    outs = spark.createDataFrame(rows, "language string, repo string, name string, output array<string>")
    needles = outs.select("language", "repo", "name", F.lit(0).alias("needle_ord"), F.lit("x y").alias("code"))
    got = score.score_outputs(outs, needles).collect()
    assert len(got) == 3 and all(r["is_best_similar"] for r in got)


def test_modes_share_one_search_for_comments(spark, monkeypatch):
    from pyspark.sql import functions as F

    from haystrata.operators import context

    files = spark.createDataFrame([("python", "r", "f.py", 0, "# one\nx = 1\ny = 2\n# two\nz = 3")], "language string, repo string, path string, file_idx int, content string")
    needles = files.select("language", "repo", "path", F.lit("y").alias("name"), F.lit(12).alias("start_byte"), F.lit(17).alias("end_byte"), F.lit(0).alias("needle_ord"), F.lit(1).alias("n_needles"))
    rows = context.make_context(needles, files, 1000, parts=True)
    both = context.clean_modes(rows, {"bare": False, "padded": True})
    assert both._jdf.queryExecution().executedPlan().toString().count("BatchEvalPython") == 1
    got = {r["clean_mode"]: r["code_context"] for r in both.collect()}
    for mode, pad in (("bare", False), ("padded", True)):
        assert got[mode] == context.clean_contexts(rows, pad).first()["code_context"]
    assert "# one" not in got["bare"] and "y = 2" in got["bare"] and "# Line Number 0" in got["padded"]


def test_of_a_run_of_comment_lines_the_tokenizer_reads_the_first(monkeypatch):
    read = []
    whole = syntax.tokenize.generate_tokens

    def counted(readline):
        return whole(lambda: read.append(readline()) or read[-1])

    monkeypatch.setattr(syntax.tokenize, "generate_tokens", counted)
    run = "# é\n" + "  # it's x\n" * 500
    code = run + "def f():\n" + run + "    'said'\n\t# tab\n#\n    return (\n" + run + "1)  # end\n"
    raw = code.encode()
    assert [raw[a:b].decode() for a, b in syntax.comments(code, "python")] == ["# é", *["# it's x"] * 500, "# é", *["# it's x"] * 500, "'said'", "# tab", "#", "# é", *["# it's x"] * 500, "# end"]
    assert len(read) < 20


def test_runs_in_strings_and_line_ends_in_comments_are_read_whole():
    for code, want in (
        ("x = '''\n# a\n# b ''' # c\n# d\n# e\n", ["# c", "# d", "# e"]),
        ("# a\n# b\nx = '''\n# ''' # c\n# d\ny = 1", ["# a", "# b", "# c", "# d"]),
        ("# a\n# b\nx = '''\n# c\n# d\n", ["# a", "# b"]),
        ("x = 1 \\\n# a\n# b\ny = 2", ["# a", "# b"]),
        ("f'''{\n# a\n# b\nx}'''", ["# a", "# b"]),
        ("# a\n# b\r\n# c\n", ["# a", "# b", "# c"]),
    ):
        raw = code.encode()
        assert [raw[a:b].decode() for a, b in syntax.comments(code, "python")] == want, code


def test_padding_lines_are_counted_once():
    def loop_of(tokens, k):
        out = ""
        while tokens > 0:
            out, tokens, k = out + f"# Line Number {k}\n", tokens - count(f"# Line Number {k}\n"), k + 1
        return out, k

    count = lambda x: 3 + ("7" in x)
    for tokens, k in ((-1, 4), (0, 0), (1, 0), (10_000, 0), (10_000, 2_000), (50, syntax._Numbered.HELD - 3), (50, syntax._Numbered.HELD + 3)):
        assert syntax.padding("#", tokens, count, k) == loop_of(tokens, k)
    asked = []
    counted = lambda x: asked.append(x) or 5
    for _ in range(100):
        syntax.padding("#", 5_000, counted)
    assert len(asked) == len(set(asked))
    assert text.space_tokens.text(" a\x1cb c \x85d\n\te\x0bf\x0cg\rh ") == 7


def test_contexts_without_neighbour_files_are_not_shuffled(spark):
    files = spark.createDataFrame([("python", f"r{i}", "f.py", 0, f"x = {i}\ny = 2\nz = 3") for i in range(3)], "language string, repo string, path string, file_idx int, content string")
    needle = lambda f: f.select("language", "repo", "path", F.lit("y").alias("name"), F.lit(6).alias("start_byte"), F.lit(11).alias("end_byte"), F.lit(0).alias("needle_ord"), F.lit(1).alias("n_needles"))
    rows = context.make_context(needle(files), files, 1000, parts=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    more = files.union(files.limit(0).union(spark.createDataFrame([("python", "r9", "g.py", 0, "g = 1"), ("python", "r9", "h.py", 1, "h = 1")], files.schema)))
    with_others = context.make_context(needle(files).union(needle(more.where("path = 'g.py'"))), more, 1000, parts=True)
    assert rows.schema.simpleString() == with_others.schema.simpleString()
    alone = with_others.where("repo <> 'r9'")
    assert sorted(map(str, rows.collect())) == sorted(map(str, alone.collect()))
    assert {r["repo"]: r["code_context"] for r in rows.collect()} == {f"r{i}": f"# Path: f.py\nx = {i}\n\ny = 2\nz = 3\n" for i in range(3)}
