"""Merkle manifest of a dataset by parent-preimage paths: a tree of SHA-256 leaves for each group of rows, and one over the groups' roots.

Every parent keeps its preimage, the concatenated hashes of its children, so a row needs no neighbour to prove itself: it joins the preimages of its
ancestors, excises its own 64-character slot of each for the siblings, and splices a replacement in for folding. Parents are made and joined
in blocks of six levels (64 nodes below one), and blocks take their own ancestors' preimages from the blocks above, so a
tree of n rows costs log64(n) grouped passes, of which only the first and the last touch all rows, by a key that is even however large a group is.
DataFrame functions only.

Cases: null values have the mark `-` in a leaf, a null group is the first one, null order values come first and are never altered; rows that tie in
group and order go by their leaf, equal rows by their place in the table, which changes no result; a lone leaf is its group's root and a lone
group's root is the root; an empty table has no rows; texts of any length are hashed whole in one pass and never shuffled; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import fits, join_counted, numbered, staged

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block: 2 ** LEVELS nodes below one.
LEVELS = 6
PATH = "array<struct<preimage:string,slot:int>>"


def digest(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """The hash of values: of each a mark if it is null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text])


def siblings(path: Column) -> Column:
    """The hash of a path's siblings from the leaf to the root: each preimage without the own slot."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * 64), F.substr(p["preimage"], p["slot"] * 64 + 65))), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's hash leads to: it is spliced into its slot of each preimage, whose hash goes on to the next."""
    return F.aggregate(path, start, lambda acc, p: digest(F.substr(p["preimage"], F.lit(1), p["slot"] * 64), acc, F.substr(p["preimage"], p["slot"] * 64 + 65)))


def _blocks(nodes: DataFrame, tier: int) -> DataFrame:
    """(k, b, n, p1.. pLEVELS, top) of nodes (k, pos, h, n): the preimages of each level above 2 ** LEVELS consecutive nodes, and the hash that is left. n: leaves of the tree."""
    out = nodes.groupBy("k", F.shiftright("pos", LEVELS).alias("b")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("c")).withColumn("h", F.transform("c", lambda x: x["h"])).drop("c")
    for j in range(1, LEVELS + 1):
        more = F.col("n") > F.lit(1 << (LEVELS * tier + j - 1)).cast("long")
        pairs = F.transform(F.sequence(F.lit(0), F.expr("cast((size(h) - 1) div 2 as int)")), lambda i: F.concat(F.get("h", 2 * i), F.coalesce(F.get("h", 2 * i + 1), F.lit(""))))
        out = out.withColumn(f"p{j}", F.when(more, pairs)).withColumn("h", F.when(more, F.transform(f"p{j}", lambda x: F.sha2(x, 256))).otherwise(F.col("h")))
    return out.withColumn("top", F.get("h", F.lit(0))).drop("h")


def _extended(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes (k, pos, …) with path: the preimages of the ancestors in their block, then those above it."""
    steps = [F.struct(F.get(f"q{j}", F.shiftright(F.expr(f"cast(pos & {(1 << LEVELS) - 1} as int)"), j)).alias("preimage"), F.shiftright("pos", j - 1).bitwiseAND(F.lit(1)).cast("int").alias("slot")) for j in range(1, LEVELS + 1)]
    path = F.concat(F.filter(F.array(*steps), lambda p: p["preimage"].isNotNull()), F.col("__hs_up")).cast(PATH)
    over = blocks.select("k", F.col("b").alias("__hs_b"), F.col("above").alias("__hs_up"), *[F.col(f"p{j}").alias(f"q{j}") for j in range(1, LEVELS + 1)])
    return nodes.withColumn("__hs_b", F.shiftright("pos", LEVELS)).join(over, ["k", "__hs_b"]).select(*nodes.columns, path.alias("path"))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, staged, and (k, top, n) of each tree, of nodes (k, pos, h, n) with pos from 0 to n - 1."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [staged(_blocks(nodes, 0))]
    while most > 1 << LEVELS * len(tiers):
        t = len(tiers)
        below = tiers[-1].where(F.col("n") > 1 << LEVELS * t)
        tiers.append(staged(_blocks(below.select("k", F.col("b").alias("pos"), F.col("top").alias("h"), "n"), t)))
    done = [x.where((F.col("n") <= 1 << LEVELS * (t + 1)) & (F.col("n") > (1 << LEVELS * t if t else 0))) for t, x in enumerate(tiers)]
    roots = done[0].select("k", "top", "n")
    for x in done[1:]:
        roots = roots.unionByName(x.select("k", "top", "n"))
    return tiers, roots


def paths(nodes: DataFrame, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes (k, pos, …) with path from the node to the top of above: (k, above), what follows each tree's root."""
    upper = None
    for t in reversed(range(len(tiers))):
        tops = tiers[t].where(F.col("n") <= 1 << LEVELS * (t + 1)).join(above, "k")
        if upper is not None:
            inner = _extended(tiers[t].where(F.col("n") > 1 << LEVELS * (t + 1)).withColumn("pos", F.col("b")).drop("b"), upper)
            tops = tops.unionByName(inner.withColumnRenamed("path", "above").withColumnRenamed("pos", "b"))
        upper = staged(tops) if t and t == len(tiers) - 1 else tops
    return _extended(nodes, upper)


@dataclass
class Manifest:
    """rows: k, pos, n, the group, the order, leaf, other (the leaf as found now). groups: k, the group, n, subroot, root, above (its path). tiers: the groups' blocks of preimages."""

    rows: DataFrame
    groups: DataFrame
    tiers: list[DataFrame]

    def parents(self) -> DataFrame:
        """k, level (1 above the leaves), pos, preimage and hash of every parent in the groups' trees."""
        out = None
        for t, x in enumerate(self.tiers):
            for j in range(1, LEVELS + 1):
                one = x.select("k", F.lit(LEVELS * t + j).alias("level"), "b", F.posexplode(f"p{j}").alias("i", "preimage"))
                one = one.select("k", "level", (F.shiftleft("b", LEVELS - j) + F.col("i")).alias("pos"), "preimage", F.sha2("preimage", 256).alias("hash"))
                out = one if out is None else out.unionByName(one)
        return out

    def proofs(self) -> DataFrame:
        """rows with path, from the leaf through its group's root to the root."""
        return paths(self.rows, self.tiers, self.groups.select("k", "above"))


def build(docs: DataFrame, columns=COLUMNS, group: str = "lang", order: str = "doc_id", found: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: a tree for each value of group, whose leaves hash the columns and ascend by order. found: columns as they are now, to be held against it."""
    now = [(found or {}).get(c, F.col(c)) for c in columns]
    hashed = docs.select(F.col(order).alias("__hs_o"), F.col(group).cast("string").alias("__hs_g"), leaf([F.col(c) for c in columns]).alias("leaf"), (leaf(now) if found else F.lit(None).cast("string")).alias("other"))
    hashed = staged(hashed.withColumn("__hs_i", F.monotonically_increasing_id()))
    rows = numbered(hashed.withColumn("__hs_g", F.coalesce(F.concat(F.lit("="), "__hs_g"), F.lit(""))), "__hs_g", "__hs_o", "leaf", "__hs_i").drop("__hs_i")
    groups = numbered(rows.groupBy("__hs_g").agg(F.count(F.lit(1)).alias("n"), F.min("__hs_n").alias("first")), "__hs_g").withColumnRenamed("__hs_n", "k")
    groups = staged(groups)
    if fits(groups):
        rows = rows.join(F.broadcast(groups), "__hs_g")
    else:
        rows = join_counted(rows, groups.withColumn("size", F.col("n")), "__hs_g").withColumnRenamed("size", "n")
    rows = rows.select("k", (F.col("__hs_n") - F.col("first")).alias("pos"), "n", "__hs_o", "leaf", F.coalesce("other", "leaf").alias("other"))
    tiers, roots = grow(rows.select("k", "pos", F.col("leaf").alias("h"), "n"))
    # the same over the groups' roots, as one tree
    tops = staged(roots.join(groups.select("k", "__hs_g"), "k").select(F.lit(0).cast("long").alias("k"), F.col("k").alias("pos"), F.col("top").alias("h"), F.col("n").alias("rows"), "__hs_g"))
    many = tops.count()
    tops = tops.withColumn("n", F.lit(many).cast("long"))
    over, root = grow(tops.select("k", "pos", "h", "n"))
    head = root.select("k", F.array().cast(PATH).alias("above"))
    up = paths(tops, over, head).join(root.select("k", F.col("top").alias("root")), "k")
    return Manifest(rows, staged(up.select(F.col("pos").alias("k"), "__hs_g", F.col("rows").alias("n"), F.col("h").alias("subroot"), "root", F.col("path").alias("above"))), tiers)


def verify(docs: DataFrame, columns=COLUMNS, group: str = "lang", order: str = "doc_id", found: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: its order column, leaf, subroot, root, proof_sha256, folded_root (from the leaf as found) and verified."""
    m = build(docs, columns, group, order, found)
    ends = m.groups.select("k", "n", "subroot", "root")
    rows = m.proofs().drop("n")
    rows = rows.join(F.broadcast(ends.drop("n")), "k") if fits(ends) else join_counted(rows, ends, "k")
    back = folded(F.col("path"), F.col("other"))
    out = rows.select(F.col("__hs_o").alias(order), "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(column: str = "n_chars", order: str = "doc_id", every: int = 7) -> dict[str, Column]:
    """The column as a tamperer leaves it: one more where `every` divides the CRC-32 of the decimal order value; nulls stay."""
    hit = F.crc32(F.col(order).cast("string").cast("binary")) % every == 0
    return {column: F.when(hit, F.col(column) + 1).otherwise(F.col(column))}
