"""Running sums over groups of any size: windows over blocks of bounded length and a join a level, in place of one sort of a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order that a block of one task spans.
BITS = 12


def sums_before(rows: DataFrame, key: list[str], order: str, values: dict[str, str], backward: bool = False, bits: int = BITS, orders: DataFrame | None = None) -> DataFrame:
    """rows with a column for each of values, {its name: the summed column}: the sum over the rows of the same key that come before by order, a whole-number column without
    nulls (after it, if backward). Rows of the same order count for none of each other. Null keys are a key.

    Rows are summed inside blocks of 2 ** bits orders, the blocks' sums the same way inside blocks of blocks, and added up; so a task has a block of a key at most,
    however many rows the key has. The number of levels follows from the least and the greatest order, read from orders if that is cheaper to read than rows.
    """
    at = F.col(order).cast("long") * (-1 if backward else 1)
    low, high = (orders if orders is not None else rows).agg(F.min(at), F.max(at)).first()
    low, levels = low or 0, 1
    while levels * bits < 63 and ((high or 0) - low) >> bits * levels:
        levels += 1
    named = {f"__hs_v{i}": c for i, c in enumerate(values.values())}
    one = rows.select("*", (at - F.lit(low)).alias("__hs_at"), *[F.col(c).cast("long").alias(v) for v, c in named.items()])
    out = _level(one, key, list(named), bits, levels)
    return out.select(*rows.columns, *[F.col(f"{v}_before").alias(name) for v, name in zip(named, values)])


def _level(rows: DataFrame, key: list[str], values: list[str], bits: int, levels: int) -> DataFrame:
    """rows (key, __hs_at, values) with {value}_before."""
    rows = rows.withColumn("__hs_block", F.shiftright("__hs_at", bits))
    w = Window.partitionBy(*key, "__hs_block").orderBy("__hs_at").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    if levels == 1:
        return inside
    sums = rows.groupBy(*key, F.col("__hs_block").alias("__hs_at")).agg(*[F.sum(v).alias(v) for v in values])
    over = _level(sums, key, values, bits, levels - 1)
    over = over.select(*[F.col(c).alias(f"__hs_k{i}") for i, c in enumerate(key)], F.col("__hs_at").alias("__hs_to"), *[F.col(f"{v}_before").alias(f"{v}_far") for v in values])
    same = [inside[c].eqNullSafe(over[f"__hs_k{i}"]) for i, c in enumerate(key)]
    both = inside.join(over, [*same, inside["__hs_block"] == over["__hs_to"]])
    return both.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"{v}_far") for v in values})
