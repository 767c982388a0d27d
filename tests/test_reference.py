import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from haystrata.functions import bleu, syntax, text
from haystrata.functions.bleu import similarity
from haystrata.functions.provider import Echo, backend, run_provider
from haystrata.operators import context, curate, deps, graph, score
from haystrata.plans import evaluate, runs
from haystrata.sources import readers, sinks
from haystrata.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bleu_goldens(spark):
    cases = [("a b c d e", "a b c d e", 1.0), ("a b", "a b", 0.221389), ("", "", 1.0), ("x", "y", None)]
    r = spark.createDataFrame([(i, str(i), c[0]) for i, c in enumerate(cases)], "rid int, key string, text string")
    n = spark.createDataFrame([(i, str(i), c[1]) for i, c in enumerate(cases)], "nid int, key string, text string")
    got = {x["rid"]: x["sim"] for x in similarity(r, n).collect()}
    for i, c in enumerate(cases):
        assert c[2] is None and i not in got or got[i] == pytest.approx(c[2], abs=1e-6)


def plain_bleu(a, b):
    """Sentence BLEU-4 of two lists of words by loops, smoothed as in bleu.formula()."""
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    logs, zeros = 0.0, 1
    for n in range(1, 5):
        m, den = (grams(a, n) & grams(b, n)).total(), max(1, len(a) - n + 1)
        if n == 1 and not m:
            return None
        p = m / den if m else math.log(len(a)) / (5 * 2**zeros) / den if len(a) > 1 else 0
        zeros += not m
        logs += 0.25 * math.log(p) if p > 0 else 0
    return (1 if len(a) > len(b) else math.exp(1 - len(b) / len(a))) * math.exp(logs)


@pytest.mark.parametrize("limit", [bleu.BROADCAST_BYTES, 0])
def test_bleu_equals_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(bleu, "BROADCAST_BYTES", limit)
    r = random.Random(limit)
    texts = lambda n: [(i, f"k{i % 3}", " ".join(r.choice("a b c d é".split()) for _ in range(r.randint(1, 9)))) for i in range(n)]
    replies, needles = texts(60), texts(12)
    rows = spark.createDataFrame([*replies, (60, "k0", None), (61, None, "a b"), (62, "k0", "a")], "rid int, key string, text string")
    got = {(x["rid"], x["nid"]): x["sim"] for x in similarity(rows, spark.createDataFrame(needles, "nid int, key string, text string")).collect()}
    want = {(i, j): plain_bleu(t.split(), u.split()) for i, k, t in [*replies, (62, "k0", "a")] for j, o, u in needles if k == o}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_bleu_makes_no_rows_of_replies_in_lambdas(spark):
    rows = spark.createDataFrame([(1, "k", "a b")], "id int, key string, text string")
    plan = similarity(rows.withColumnRenamed("id", "rid"), rows.withColumnRenamed("id", "nid"))._jdf.queryExecution().optimizedPlan().toString()
    made = ["lambdafunction" in x for x in plan.split("\n") if "Generate" in x]
    assert len(made) == 4 and sum(made) == 2  # those of the needles' n-grams and of their first words


def test_pass_at_k(spark):
    for k, n, c, want in [(1, 10, 3, 0.3), (10, 100, 5, 0.416248), (10, 12, 0, 0.0), (1, 1, 0, 0.0), (1, 1, 1, 1.0)]:
        assert one(spark, text.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want, abs=1e-6)


def test_topological_order():
    assert graph.topological_order({"a": ["b", "c"], "b": ["c"], "c": ["a"], "d": ["zz"]}) == ["c", "b", "a", "zz", "d"]
    deep = {str(i): [str(i + 1)] for i in range(5000)}
    assert graph.topological_order(deep)[0] == "5000"


def test_topo_order_frame(spark):
    df = spark.createDataFrame([("l", "r", 0, "a", ["b"]), ("l", "r", 1, "b", [])], "language string, repo string, src_ord int, src string, dst array<string>")
    assert [x["path"] for x in graph.topo_order(df).orderBy("topo_idx").collect()] == ["b", "a"]


def test_fences_and_capture(spark):
    f = text.FENCE
    cases = [(f"a\n{f}py\nx\n{f}\nb\n{f}\ny\n{f}", ["x\n", "y\n"]), (f"{f}\nx", []), (f"{f}c++\nx\n{f}", []), (f"  {f}\nx\n{f}\nfoo\n{f}", ["x\n"])]
    for t, want in cases:
        assert one(spark, text.fences(F.lit(t))) == want
    for t, want in [("plain", "plain"), ("a<desc_end>b", "a"), ("<desc_start>x<desc_start>y<desc_end>z", "y")]:
        assert one(spark, text.between(F.lit(t), "<desc_start>", "<desc_end>")) == want


def test_line_budgets(spark):
    df = spark.createDataFrame([(1, i, 3) for i in range(3)], "k int, line_no int, n_tok int")
    assert sorted(r["line_no"] for r in context.budget_lines(df, ["k"], 7).collect()) == [0, 1]
    assert sorted(r["line_no"] for r in context.budget_lines(df, ["k"], 7, backward=True).collect()) == [1, 2]


def _loop_context(files, own, a, b, ratio, size):
    """The context by a plain loop over lines."""
    tok = lambda s: len(s.split()) + 1
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
    names = [p for p, _ in files]
    i = names.index(own) - 1
    while i >= 0 and left > 0 and not broke:
        part, used, broke = forward([f"# Path: {names[i]}", *files[i][1].split("\n")], left)
        out, left, i = part + out, left - used, i - 1
    end, used, broke = forward(content[b:].split("\n"), suf)
    left, i = suf - used, names.index(own) + 1
    while i < len(names) and left > 0 and not broke:
        part, used, broke = forward([f"# Path: {names[i]}", *files[i][1].split("\n")], left)
        end, left, i = end + part, left - used, i + 1
    return out + needle + end


def test_context_equals_loop(spark):
    rng = random.Random(4)
    rows, needles, want = [], [], {}
    for r in range(25):
        files = [(f"f{i}.py", "\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 7)))) for i in range(rng.randint(1, 5))]
        rows += [("python", f"r{r}", p, i, c) for i, (p, c) in enumerate(files)]
        own, content = rng.choice(files)
        a = rng.randint(0, len(content))
        b = rng.randint(a, len(content))
        needles.append(("python", f"r{r}", own, "n", a, b, rng.randint(0, 4), 5))
        want[f"r{r}"] = (files, own, a, b, (needles[-1][6] + 0.5) / 5)
    f = spark.createDataFrame(rows, "language string, repo string, path string, file_idx int, content string")
    n = spark.createDataFrame(needles, "language string, repo string, path string, name string, start_byte int, end_byte int, needle_ord int, n_needles int")
    for size in (3, 12, 40):
        got = {x["repo"]: x["code_context"] for x in context.make_context(n, f, size).collect()}
        for repo, args in want.items():
            assert got[repo] == _loop_context(*args, size), (repo, size)


def test_curation(spark):
    fns = spark.createDataFrame([("l", "r", "p", "a", 0, 0, 0, 5, 0), ("l", "r", "p", "b", 0, 1, 5, 9, 5), ("l", "r", "p", "c", 0, 2, 9, 12, 9), ("l", "r", "p", "c", 0, 3, 12, 14, 12)], "language string, repo string, path string, name string, topo_idx int, fn_ord int, start_byte int, end_byte int, global_start_byte long")
    files = spark.createDataFrame([("l", "r", "p", "x" * 20)], "language string, repo string, path string, content string")
    assert {r["name"] for r in curate.unique_names(fns).collect()} == {"a", "b"}
    got = curate.select_needles(fns, files, num_bins=1, max_fn_per_repo=1).collect()
    assert [(r["name"], r["needle_ord"], r["n_needles"]) for r in got] == [("a", 0, 1)]
    with pytest.raises(ValueError):
        curate.select_needles(fns, files, num_bins=1, max_fn_per_repo=2)
    ann = spark.createDataFrame([("r", "a", "old", 0), ("r", "a", "new", 1)], "repo string, name string, annotation string, line_no int")
    got = {r["name"]: r["description"] for r in curate.merge_annotation(fns, ann).collect()}
    assert got == {"a": "new", "b": None, "c": None}


def test_edges(spark):
    def edges(lang, files):
        df = spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string")
        return {(e["src"], e["dst"]) for e in deps.EDGES[lang](df).collect()}

    assert edges("cpp", {"a/x.cc": '#include "y.h"\n# include <z.h>', "a/y.h": "", "include/z.h": ""}) == {("a/x.cc", "a/y.h"), ("a/x.cc", "include/z.h")}
    assert edges("python", {"p/a.py": "import p.b\nfrom . import c\nfrom .d import x", "p/b.py": "", "p/c.py": "", "p/d.py": ""}) == {("p/a.py", "p/b.py"), ("p/a.py", "p/c.py"), ("p/a.py", "p/d.py")}
    assert edges("java", {"s/a/X.java": "import a.b.Y;\nimport c.*;", "s/a/b/Y.java": "", "s/c/Z.java": "", "s/a/W.java": "X x;"}) == {("s/a/X.java", "s/a/b/Y.java"), ("s/a/X.java", "s/c/Z.java"), ("s/a/W.java", "s/a/X.java")}
    assert edges("go", {"a/main.go": "util.Run()", "b/util.go": ""}) == {("a/main.go", "b/util.go")}
    assert edges("rust", {"src/lib.rs": "mod a;\nuse crate::a::b::f;", "src/a/mod.rs": "", "src/a/b.rs": ""}) == {("src/lib.rs", "src/a/mod.rs"), ("src/lib.rs", "src/a/b.rs")}
    assert edges("typescript", {"s/a.ts": 'import {x} from "./b";\nrequire("../c/d.js")', "s/b.ts": "", "c/d.js": ""}) == {("s/a.ts", "s/b.ts"), ("s/a.ts", "c/d.js")}


def test_syntax():
    py = '"""mod"""\ndef f(a):\n    """doc"""\n    # c\n    return "# no"\n'
    assert [f[0] for f in syntax.functions(py, "python")] == ["f"]
    assert syntax.remove_comments(py, "python") == '"""mod"""\ndef f(a):\n    \n    \n    return "# no"\n'
    c = 'int add(int a, int b) { /* x */ return a + b; } // é "q"\nchar* s = "// no";\n'
    assert [f[0] for f in syntax.functions(c, "cpp")] == ["add"]
    assert syntax.remove_comments(c, "cpp") == 'int add(int a, int b) {  return a + b; } \nchar* s = "// no";\n'
    assert len(syntax.obfuscate(c, "cpp").encode()) == len(c.encode())
    for lang, code, name in [("java", "class A { public int f(int x) { return x; } }", "f"), ("go", "func F(x int) int { return x }", "F"), ("rust", "impl A { fn g(&self) -> i32 { 1 } }", "g"), ("typescript", "export function h(x: number): number { return x }", "h")]:
        assert [f[0] for f in syntax.functions(code, lang)] == [name], lang
    assert syntax.rename_functions("def f(): return f()", "python") == "def function_0(): return function_0()"


def test_dataset_evaluation_and_sinks(spark, tmp_path):
    body = "def foo(a):\n    b = a + 1\n    return b * 2\n"
    data = {"python": [{"repo": "o/r", "commit_sha": "1", "entrypoint_path": "p", "topic": "t", "content": {"p/z.py": "import p.a\n" + body.replace("foo", "zed").replace("* 2", "- x"), "p/a.py": body}, "needles": [{"name": "foo", "start_line": 0, "end_line": 3, "start_byte": 0, "end_byte": len(body) - 1, "path": "p/a.py", "description": "adds"}, {"name": "zed", "start_line": 1, "end_line": 4, "start_byte": 11, "end_byte": 11 + len(body) - 1, "path": "p/z.py", "description": "zeds"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(data))
    repos = readers.read_dataset(spark, str(tmp_path / "d.json")).cache()
    files = readers.files_of(repos)
    assert [r["path"] for r in files.orderBy("file_ord").collect()] == ["p/z.py", "p/a.py"]
    lists = evaluate.dependency_lists(files, "python")
    ordered = evaluate.ordered_files(files, lists)
    assert [r["path"] for r in ordered.orderBy("file_idx").collect()] == ["p/a.py", "p/z.py"]
    needles = readers.needles_of(repos)
    tasks = evaluate.build_tasks(needles, ordered, 1000).cache()
    assert tasks.count() == 2 and "def foo" in tasks.first()["code_context"]

    class Right:
        def generate_reply(self, q, **_):
            return ["```python\n" + (body if "adds" in q else "nothing here") + "```"]

    outputs = evaluate.evaluate(tasks, Right).cache()
    rows, scores = evaluate.score_all(outputs, needles, files)
    assert {r["name"]: r["is_best_similar"] for r in rows.collect()} == {"foo": True, "zed": False}
    assert {(r["scope"], r["threshold"]): r["pass_at_1"] for r in scores.collect()}["all", 0.8] == 0.5
    assert resume.unfinished(tasks, outputs).count() == 0
    table = sinks.score_table(score.pivot_scores(scores))
    assert "*all" in table and "50.0" in table
    path = str(tmp_path / "s.json")
    doc = score.score_document("m", "N/A", scores, rows.select("language", "name"), "now")
    assert sinks.save_scores(doc, path) and sinks.save_scores(doc, path) and (tmp_path / "s.json.bak").exists()
    assert not sinks.save_scores(doc, path, "ignore")
    assert [r["repo"] for r in readers.read_seeds(spark, str(tmp_path / "d.json")).collect()] == ["o/r"]
    assert evaluate.build_tasks(needles, ordered, 1000, clean_mode="no_padding").count() == 2
    with pytest.raises(ValueError):
        evaluate.build_tasks(needles, ordered, 1000, clean_mode="x")
    with pytest.raises(ValueError):
        backend("x")


def test_jsonl_dependency_dir_and_stream(spark, tmp_path):
    (tmp_path / "deps").mkdir()
    for k, d in (("a", {"x": ["y"]}), ("b", {"x": ["z"]})):
        (tmp_path / "deps" / f"{k}.json").write_text(json.dumps({"python": [{"repo": "r", "dependency": d}]}))
    assert readers.read_dependency_dir(spark, str(tmp_path / "deps")).first()["dependency"] == {"x": ["z"]}
    src = tmp_path / "in"
    src.mkdir()
    row = {"language": "l", "repo": "r", "name": "n"}
    ddl = "language string, repo string, name string"
    (src / "1.json").write_text(json.dumps(row) + "\n")
    go = lambda: resume.append_results(spark, str(src), ddl, str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    (src / "2.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"name": "m"}) + "\n")
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), ddl).collect()
    out = run_provider(spark.createDataFrame([("hi",)], "prompt string"), Echo)
    assert out.first()["output"] == ["hi"]


def test_names_and_small_columns(spark):
    assert sinks.scores_name(sinks.output_name("r", 1024, "a/b")) == "r/ntoken_1024/a_slash_b-SCORES.json"
    assert one(spark, text.model_name(F.lit("a_slash_b_c"))) == "a/bc"
    assert one(spark, text.decode_chars(F.lit("104 233"))) == "hé"
    assert one(spark, text.drop_relative(F.lit("../a/./b"))) == "a/b"
    assert one(spark, text.line_slice(F.lit("a\nb\nc"), F.lit(1), F.lit(9))) == "b\nc"
    assert one(spark, text.train_context(F.lit("gpt-4-turbo-x"))) == "128k" and one(spark, text.train_context(F.lit("gpt-4o"))) == "N/A"
    ask = one(spark, text.annotation_prompt(F.lit("foo"), F.lit("x = 1")))
    assert ask.count("\"foo\"?") == 3 and "\nx = 1\n" in ask and "(foo)" in ask
    assert [m["role"] for m in one(spark, text.messages(F.lit("u"), F.lit("")))] == ["user"]


def test_runs_on_files(spark, tmp_path):
    body = "def foo(a):\n    b = a + 1\n    return b * 2\n"
    data = {"python": [{"repo": "o/r", "commit_sha": "1", "entrypoint_path": "p", "topic": "t", "content": {"p/a.py": body, "p/b.py": body.replace("foo", "bar").replace("* 2", "- x")}, "dependency": {"p/a.py": [], "p/b.py": ["p/a.py"]}, "needles": [{"name": n, "start_line": 0, "end_line": 3, "start_byte": 0, "end_byte": len(body) - 1, "path": p, "description": d} for n, p, d in (("foo", "p/a.py", "adds"), ("bar", "p/b.py", "takes"))]}]}
    (tmp_path / "d.json").write_text(json.dumps(data))
    asked = tmp_path / "asked"
    asked.mkdir()

    class Right:
        def generate_reply(self, q, **_):
            with open(asked / str(hash(q)), "a") as f:
                f.write("x")
            return ["```python\n" + body + "```"]

    folder = str(tmp_path / "results")
    for _ in range(2):  # the second run has nothing left to ask
        table = runs.evaluate_model(spark, "org/m", code_context_size=1000, result_dir=folder, dataset=str(tmp_path / "d.json"), make=Right)
        assert sum(len(x.read_text()) for x in asked.iterdir()) == 2
    out = sinks.output_name(folder, 1000, "org/m")
    document = json.loads((tmp_path / "results" / "ntoken_1000" / "org_slash_m-SCORES.json").read_text())
    assert document["org/m"]["scores"]["all"]["0.8"]["pass@1"] == 0.5 and "*all" in table
    assert {r["name"]: r["best_target"] for r in document["org/m"]["results"]["python"]} == {"foo": "foo", "bar": "foo"}
    assert (tmp_path / "results" / "ntoken_1000" / "org_slash_m-SCORES.json.bak").exists()
    assert runs.score_file(spark, out, ignore_comments=True, dataset=str(tmp_path / "d.json"), mode="ignore") == table
    with pytest.raises(ValueError):
        runs.provider_maker("m", "no such")


def edges_of(spark, lang, files):
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string")
    return {(e["src"], e["dst"]) for e in deps.EDGES[lang](df).collect()}


def test_use_trees(spark):
    cases = [
        ("crate::{a, b::{c, d as e}, self}", ["crate::a", "crate::b::c", "crate::b::d", "crate"]),
        ("a::b", ["a::b"]), ("{a, b}", ["a", "b"]), ("crate::*", ["crate"]), ("x::{self}", ["x"]), ("a::{b::{c::{d}}, e::*,}", ["a::b::c::d", "a::e"]),
        ("super::super::x as y", ["super::super::x"]), ("a::{\n  b ,\n\tc as _\n}", ["a::b", "a::c"]), ("", []), ("a::{}", []), ("{{}}}", []), ("a::{b", ["a::b"]),
    ]
    for tree, want in cases:
        assert one(spark, deps.use_paths(F.lit(tree))) == want, tree


def test_rust_modules(spark):
    files = {
        "src/lib.rs": "mod a;\nuse crate::{a, b::{c, d as e}, self};\nuse std::{io, fmt};", "src/a/mod.rs": "use self::x::Y; use super::b; mod x; use x::deep::Z;", "src/a/x.rs": "use super::super::b::c; use super::Q; use serde::Deserialize;",
        "src/b.rs": "use self::c::f; use super::a::x; // use crate::d;\nconst S: &str = r#\"use crate::d;\"#;", "src/b/c.rs": "", "src/b/d.rs": "use crate::nowhere::N;", "src/d.rs": "",
    }
    want = {("src/lib.rs", "src/a/mod.rs"), ("src/lib.rs", "src/b/c.rs"), ("src/lib.rs", "src/b/d.rs"), ("src/a/mod.rs", "src/a/x.rs"), ("src/a/mod.rs", "src/b.rs"), ("src/a/x.rs", "src/b/c.rs"), ("src/a/x.rs", "src/a/mod.rs"),
            ("src/b.rs", "src/b/c.rs"), ("src/b.rs", "src/a/x.rs"), ("src/b/d.rs", "src/lib.rs")}
    assert edges_of(spark, "rust", files) == want


def test_names_in_comments_and_literals_make_no_edges(spark):
    assert edges_of(spark, "java", {"a/A.java": '// see B\nString s = "C"; /* D */ char q = \'"\'; String t = """\nE "F" """; G g;', **{f"a/{x}.java": "" for x in "BCDEFG"}}) == {("a/A.java", "a/G.java")}
    assert edges_of(spark, "go", {"m.go": 'x := "util.Do" // see util.Do\ny := `io.Read`\n/* net.Dial */ z := a.b.c; log . Print()', **{f"p/{x}.go": "" for x in ("util", "io", "net", "a", "b", "log")}}) == {("m.go", "p/a.go"), ("m.go", "p/log.go")}
    assert edges_of(spark, "cpp", {"a.cc": '/*\n#include "b.h"\n*/\nauto s = R"x(\n#include "c.h"\n)x";\n#include "d.h" // "e.h"', **{f"{x}.h": "" for x in "bcde"}}) == {("a.cc", "d.h")}
    assert edges_of(spark, "python", {"p/__init__.py": "from . import a\nfrom .b import x as y", "p/a.py": 's = """\nimport p.b\n"""\nimport os, p.c as k, \\\n  p.d\nfrom fromage import b # import p.b', **{f"p/{x}.py": "" for x in "bcd"}}) == {("p/__init__.py", "p/a.py"), ("p/__init__.py", "p/b.py"), ("p/a.py", "p/c.py"), ("p/a.py", "p/d.py")}


def brute_resolve(files, src, m, configs):
    """A TypeScript path by search over all configurations, patterns and names."""
    import posixpath

    norm = lambda p: posixpath.normpath("/" + p).lstrip("/")
    ends = lambda s: next((x for x in (s, s + ".ts", s + ".js", s + "/index.ts", s + "/index.js", s[:-3] + ".ts" if s.endswith(".js") else s) if x in files and x.endswith((".ts", ".js"))), None)
    here = posixpath.dirname(src)
    if m.startswith(("./", "../")) or m in (".", ".."):
        return ends(norm(f"{here}/{m}"))
    above = [d for d in configs if d == "" or here == d or here.startswith(d + "/")]
    if not above:
        return None
    d = max(above, key=len)
    base, paths = configs[d]
    at = norm(f"{d}/{base}") if base is not None else d
    fits = []
    for p, targets in paths.items():
        head, star, tail = p.partition("*")
        if star and m.startswith(head) and m.endswith(tail) and len(m) >= len(head) + len(tail):
            fits.append(((0, len(head), len(tail)), m[len(head) : len(m) - len(tail)], targets))
        elif not star and p == m:
            fits.append(((1, 0, 0), "", targets))
    if fits:
        _, mid, targets = max(fits, key=lambda x: x[0])
        return next((x for t in targets if (x := ends(norm(f"{at}/{t.replace('*', mid)}")))), None)
    return ends(norm(f"{at}/{m}")) if base is not None else None


def test_path_aliases_equal_a_search(spark):
    rng = random.Random(12)
    dirs = ["", "app", "app/src", "lib", "lib/core"]
    names = [f"{d}/{n}".lstrip("/") for d in dirs for n in ("a.ts", "b.ts", "c.js", "x/index.ts", "y.css")]
    patterns = ["@/*", "@lib/*", "@lib/core/*", "@*", "a", "*", "x*", "@/*.gen", "b/*"]
    specs = ["./a", "../b", "@/a", "@lib/b", "@lib/core/c", "@lib/core/x", "a", "x", "b/a", "@/a.gen", "src/a", "core/b", "react", ".", "@zz", "xx", "c.js", "./a.js"]
    rows, want = [], set()
    for r in range(40):
        files = {n: "" for n in names if rng.random() < 0.8}
        configs = {}
        for d in rng.sample(dirs, rng.randint(0, 3)):
            paths = {p: rng.sample(["src/*", "*", "core/*", "../lib/*", "./x", "a", "app/src/*"], rng.randint(1, 3)) for p in rng.sample(patterns, rng.randint(0, 4))}
            base = rng.choice([None, ".", "src", "..", "./"])
            configs[d] = (base, paths)
            options = {"paths": paths} | ({"baseUrl": base} if base is not None else {})
            rows.append((f"r{r}", f"{d}/tsconfig.json".lstrip("/"), "// own\n" + json.dumps({"compilerOptions": options})[:-2] + ",}}"))
        for n in list(files):
            if n.endswith((".ts", ".js")):
                mine = rng.sample(specs, 6)
                files[n] = "\n".join(rng.choice(['import {{q}} from "{}"', "require('{}')", 'export * from "{}"', 'import("{}")']).format(m) for m in mine)
                want |= {(f"r{r}", n, dst) for m in mine if (dst := brute_resolve(files, n, m, configs)) and dst != n}
        rows += [(f"r{r}", n, c) for n, c in files.items()]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {(e["repo"], e["src"], e["dst"]) for e in deps.typescript_edges(df).collect()}
    assert got == want and len(want) > 300


def test_masking_is_linear(spark):
    import time

    for lang, text_ in (("java", '"' * 400_000), ("java", "/*" * 300_000), ("rust", 'r#"' * 200_000), ("python", "'" * 400_000), ("cpp", 'R"(' * 200_000), ("go", "`a" * 300_000), ("typescript", "\\`" * 300_000), ("java", '"' + "\\n" * 300_000)):
        began = time.time()
        df = spark.createDataFrame([(text_,)], "t string")
        df.select(F.length(deps.code_only("t", lang)), F.length(deps.code_only("t", lang, True))).collect()
        assert time.time() - began < 20, (lang, text_[:4])


FORMS = {
    "typescript": [
        ("function g(a: {b: number}): void { x }", ["g"]), ("function h(): {a: number} { x }", ["h"]), ("export default async function k<T extends {a: {b: T}}>(x: T = {a: 1}): Promise<{c: T} | {d: T}> { if (x) { y } }", ["k"]),
        ("const f = function (a) { x }; const g = (b) => { y }", []), ("class A { m(a: number) { function inner() { return {a: 1} } } }", ["inner"]), ("function a() {} function b() {}", ["a", "b"]), ("export function* gen(): Iterable<number> { yield 1 }", ["gen"]),
        ("foo(function named(x) { y })", []), ("function d(cb = () => { return {} }) { z }", ["d"]), ("interface I { f(): {a: number} }\nfunction after() { x }", ["after"]),
    ],
    "java": [
        ("class A { Object f() { return new B() { public int g(int x) { return x; } }; } }", ["f", "g"]), ("class A { A(int x) { y(); } public A() {} void m() throws E, F { for (int i = 0; i < 2; i++) { z(); } } }", ["m"]),
        ('class A { @B({1, 2}) @C("x") public static <T extends D> Map<String, T> n(@E T t) { if (a) { b(); } else if (c) { d(); } return null; } }', ["n"]), ("record P(int x) { int twice() { return 2 * x; } }", ["twice"]),
        ("class A { void m() { run(() -> { x(); }, new C() { void n() { } }); synchronized (this) { y(); } try (R r = s()) { } catch (E e) { } switch (k) { } } }", ["m", "n"]), ("interface I { int f(int x); default int g() { return 1; } }", ["g"]),
    ],
    "cpp": [
        ("int* p() { return 0; }", []), ("int& r() { return x; }", []), ("int f(int a = g(1)) { if (a) { return 1; } }", ["f"]), ("void A::m() { x(); }", []), ("struct S { int m() { return 1; } }; int after() { return 2; }", ["after"]),
        ("template <class T> std::vector<T> v(T x) { return {x}; }", ["v"]), ("namespace n { static inline int k() noexcept { return 1; } }", ["k"]), ("auto t() -> int { return 1; }", ["t"]), ("int main() { auto l = [](int x) { return x; }; while (1) { } do { } while (0); }", ["main"]),
    ],
    "go": [
        ("func f(x interface{}) interface{} { return struct{ a int }{1} }", ["f"]), ("func (r R) m() { x() }", []), ("func g[T any, U comparable](a []T) (b struct{ c int }) { for i := 0; i < 3; i++ { } }", ["g"]), ("var v = func(x int) { y }", []), ("func a() {}\nfunc b() { if x := f(); x { } }", ["a", "b"]),
    ],
    "rust": [
        ("pub fn f<T: Into<u8>>(x: T) -> [u8; { 1 + 1 }] where T: Copy { let s = S { a: 1 }; }", ["f"]), ("impl A { pub(crate) async unsafe fn m(&self) { match x { _ => { } } } } trait T { fn sig(&self); fn d(&self) { } }", ["m", "d"]), ("fn a() {} fn b() -> impl Fn(u8) -> u8 { |x| { x } }", ["a", "b"]),
    ],
}


@pytest.mark.parametrize("lang", sorted(FORMS))
def test_function_forms(lang):
    for code, want in FORMS[lang]:
        got = syntax.functions(code, lang)
        assert [f[0] for f in got] == want, (code, got)
        raw = ("/* ééé { */\n" + code).encode()
        for name, l0, l1, a, b in syntax.functions("/* ééé { */\n" + code, lang):
            assert raw[a:b].endswith(b"}") and name.encode() in raw[a:b] and l0 <= l1 and raw[a:b].count(b"{") == raw[a:b].count(b"}")
        # cut off anywhere, it is read without an error
        for k in range(0, len(code), 7):
            syntax.functions(code[:k], lang)


def test_syntax_is_linear_in_files_of_any_letters():
    import time

    for text_, lang in (("// é\n" * 100_000, "java"), ("int é() { }\n" * 30_000, "cpp"), ("function f(a: {b: c}) { }\n" * 30_000, "typescript"), ("{" * 200_000, "go"), ("(" * 200_000 + "}" * 200_000, "rust"), ("fn f() {\n" * 40_000, "rust")):
        began = time.process_time()
        syntax.comments(text_, lang)
        syntax.functions(text_, lang)
        assert time.process_time() - began < 5, (text_[:8], lang)
