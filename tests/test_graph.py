"""Order of repositories that are dealt out by component, and components, against loops."""

import random

from haystrata.operators import graph

DDL = "language string, repo string, src_ord int, src string, dst array<string>"


def random_deps(seed, repos=6):
    rng = random.Random(seed)
    rows = []
    for r in range(repos):
        names = [f"f{i}" for i in range(rng.randint(1, 40))]
        rng.shuffle(names)
        for i, s in enumerate(names):
            rows.append(("l" if r % 2 else "k", f"r{r}", 3 * i, s, None if rng.random() < 0.2 else [rng.choice([*names[max(0, i - 3) : i + 4], "gone", "lost é"]) for _ in range(rng.choice([0, 0, 1, 1, 2]))]))
    return rows


def test_split_repositories_equal_the_loop(spark):
    for seed in range(3):
        rows = random_deps(seed)
        df = spark.createDataFrame(rows, DDL)
        want = {}
        for lang, repo in {(r[0], r[1]) for r in rows}:
            for i, p in enumerate(graph.topological_order({r[3]: r[4] or [] for r in rows if r[1] == repo})):
                want[lang, repo, p] = i
        for split in (0, 20, 10**6):
            got = {(r["language"], r["repo"], r["path"]): r["topo_idx"] for r in graph.topo_order(df.repartition(3), split).collect()}
            assert got == want, (seed, split)
    assert graph.topo_order(df.where("false"), 0).count() == 0


def test_components_equal_a_search(spark):
    rng = random.Random(1)
    edges = [(f"v{rng.randint(0, 120)}", f"v{rng.randint(0, 120)}") for _ in range(80)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)] + [("solo", "solo")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [v] if v not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_walks_of_deep_and_wide_graphs():
    deep = {str(i): [str(i + 1)] for i in range(5000)}
    assert graph.topological_order(deep)[0] == "5000" and {r for r, _ in graph.walks(deep)} == {"0"}
    assert graph.walks({"a": ["b"], "c": ["b", "d"], "d": []}) == [("a", "b"), ("a", "a"), ("c", "d"), ("c", "c")]
