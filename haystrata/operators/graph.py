"""Dependency order of files: depth-first post-order, dependencies first.

A walk that starts at one key stays in its weakly connected component, so the order of a repository is that of its components, each walked by itself, merged by where their walks began:
the walks' blocks follow one another in the order of their first keys. A repository of over SPLIT_EDGES edges is dealt out by component that way, smaller ones are one task each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.operators.running import sums_before
from haystrata.sources import sinks


def topological_order(graph: dict[str, list[str]]) -> list[str]:
    """Keys in their order, each after what it depends on. Neighbours that are no keys come too; a visited set cuts cycles. Iterative."""
    return [x for _, x in walks(graph)]


#: Edges of a repository up to which it is ordered in one task.
SPLIT_EDGES = 200_000
REPO = ["language", "repo"]


def walks(graph: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(key where the walk began, node) of topological_order()."""
    seen, out = set(), []
    for root in graph:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(graph.get(root, ())))]
        while stack:
            at, rest = stack[-1]
            fresh = next((x for x in rest if x not in seen), None)
            if fresh is None:
                out.append((root, at))
                stack.pop()
            else:
                seen.add(fresh)
                stack.append((fresh, iter(graph.get(fresh, ()))))
    return out


def topo_order(deps: DataFrame, split_edges: int = SPLIT_EDGES) -> DataFrame:
    """deps (language, repo, src_ord, src, dst array) -> (language, repo, path, topo_idx). A task holds one repository's edge list, or one component's of a large one, never its files."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = [x for _, x in _walked(pdf)]
        return pd.DataFrame({"language": pdf["language"].iloc[0], "repo": pdf["repo"].iloc[0], "path": paths, "topo_idx": range(len(paths))})

    edges = F.sum(F.when(F.size("dst") > 0, F.size("dst")).otherwise(0) + 1)
    large = deps.groupBy(*REPO).agg(edges.alias("n")).where(F.col("n") > split_edges).select(*REPO)
    whole = deps
    if not large.isEmpty():
        whole = deps.join(F.broadcast(large), REPO, "left_anti")  # at most one repository in so many edges
    out = whole.groupBy(*REPO).applyInPandas(order, "language string, repo string, path string, topo_idx int")
    return out if whole is deps else out.unionByName(_by_component(deps.join(F.broadcast(large), REPO, "left_semi")))


def _walked(pdf: pd.DataFrame) -> list[tuple[int, str]]:
    """(src_ord where the walk began, node) in order."""
    pdf = pdf.sort_values("src_ord", kind="stable")
    graph = {s: list(d) if d is not None else [] for s, d in zip(pdf["src"], pdf["dst"])}
    first = dict(zip(reversed(pdf["src"].tolist()), reversed(pdf["src_ord"].tolist())))
    return [(first[root], x) for root, x in walks(graph)]


def _by_component(deps: DataFrame) -> DataFrame:
    """topo_order() of repositories that are not whole in any task."""
    name = lambda c: F.to_json(F.struct(*REPO, F.col(c).alias("path")))
    pairs = deps.select(*REPO, "src", F.explode_outer("dst").alias("dst"))
    edges = pairs.where("dst is not null").select(name("src").alias("a"), name("dst").alias("b"))
    roots = components(edges)
    named = sinks.written(deps.withColumn("v", name("src")).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")).drop("v"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _walked(pdf)
        frame = pd.DataFrame(rows, columns=["begin", "path"])
        return pd.DataFrame({"language": pdf["language"].iloc[0], "repo": pdf["repo"].iloc[0], "begin": frame["begin"], "path": frame["path"], "at": frame.groupby("begin").cumcount()})

    blocks = sinks.written(named.groupBy(*REPO, "root").applyInPandas(order, "language string, repo string, begin long, path string, at long"))
    sizes = sums_before(blocks.groupBy(*REPO, "begin").agg(F.count(F.lit(1)).alias("n")), REPO, "begin", {"before": "n"})
    return blocks.join(sizes.drop("n"), [*REPO, "begin"]).select(*REPO, "path", (F.col("before") + F.col("at")).cast("int").alias("topo_idx"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the undirected edges (a, b): root is the least vertex it can reach. Each round links a vertex's greater neighbours to the least of its neighbours and itself,
    then its lesser ones (large and small stars), until nothing changes: a logarithmic number of rounds of two pre-aggregated shuffles."""
    own = edges.select("a", "b")
    ends = own.select(F.col("a").alias("v")).union(own.select("b")).distinct()
    now = sinks.written(own.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "w")
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()
        large = sinks.written(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = sinks.written(small.where("a <> b").distinct())
        seen = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if seen == state:
            return ends.join(now.withColumnsRenamed({"a": "v", "b": "root"}), "v", "left").withColumn("root", F.coalesce("root", "v"))
        state = seen
