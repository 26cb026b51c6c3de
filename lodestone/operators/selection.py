"""Exact order statistics of data of any size: no task and no buffer holds a group's values.

Each wanted rank keeps a bracket of values in which it lies and the number of values below. A pass
cuts the bracket at approximate quantiles, which are mergeable sketches, counts exactly what lies in
between and at the cuts, and keeps the one part that holds the rank: a fraction of the rows, or a
single value. When a bracket holds few rows, its values are sorted and the rank is read off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import cut

#: Cuts of a pass, and rows that a bracket may hold to be sorted in one aggregate.
CUTS, FEW = 128, 10_000


def _met(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside the brackets of their group that hold them."""
    inside = F.col("_v").between(F.col("lo"), F.col("hi"))
    if by:
        return rows.join(state.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in state.columns if c not in by)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [inside]).drop(*(f"_{c}" for c in by))
    return rows.join(F.broadcast(state), inside)  # a row a wanted rank


def order_values(df: DataFrame, value: str, ranks: DataFrame, by: list[str] = [], few: int = FEW, cuts: int = CUTS) -> DataFrame:
    """(by..., k, x): the k-th smallest non-null value of each group, for ranks (by..., k) with k from 1 to the group's count.

    df's groups may be of any size and its values may repeat: a value that fills a bracket becomes a
    bracket of its own. Ranks outside a group give no row. NaN counts as the largest value.
    """
    rows = cut(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")))
    ends = rows.groupBy(*by).agg(F.count("*").alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.lit(0).cast("long").alias("below"))
    if by:
        named = ranks.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("k").cast("long").alias("k")).distinct()
        state = ends.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))
    else:
        state = F.broadcast(ends).join(ranks.select(F.col("k").cast("long").alias("k")).distinct())
    state = cut(state.where("k BETWEEN 1 AND size"))
    key = [*by, "k"]
    while state.where((F.col("lo") < F.col("hi")) & (F.col("size") > few)).limit(1).count():
        wide = (F.col("lo") < F.col("hi")) & (F.col("size") > few)
        met = _met(rows, state.where(wide), by)
        at = met.groupBy(*key).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 10 * cuts))).alias("at"))
        cutting = state.where(wide).join(at.select(*(F.col(c).alias(f"_{c}") for c in key), "at"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).drop(*(f"_{c}" for c in key))
        less = F.size(F.filter("at", lambda x: x < F.col("_v")))
        part = 2 * less + F.array_contains("at", F.col("_v")).cast("int")  # odd parts are a cut's own value
        parts = _met(rows, cutting, by).groupBy(*key, "below", part.alias("part")).agg(F.count("*").alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("size").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # at most 2 * cuts + 1 rows
        held = parts.withColumn("upto", F.col("below") + upto).where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("size")))
        kept = [*key, "size", "lo", "hi", (F.col("upto") - F.col("size")).alias("below")]
        state = cut(state.where(~wide).select(*key, "size", "lo", "hi", "below").unionByName(held.select(*kept)))
    one = state.where("NOT lo < hi").select(*key, F.col("lo").alias("x"))
    few_ = _met(rows, state.where("lo < hi"), by).groupBy(*key, "below").agg(F.sort_array(F.collect_list("_v")).alias("all"))
    return one.unionByName(few_.select(*key, F.get("all", (F.col("k") - F.col("below") - 1).cast("int")).alias("x")))


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] = [], few: int = FEW) -> DataFrame:
    """(by..., p, x): exact quantiles of each group's non-null values, with linear interpolation between neighbouring ranks."""
    h = (F.col("n") - 1) * F.col("p")
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    asked = cut(sizes.withColumn("p", F.explode(F.array(*map(F.lit, probs)))).withColumns({"a": F.floor(h) + 1, "b": F.ceil(h) + 1, "t": h - F.floor(h)}))
    found = order_values(df, value, asked.select(*by, F.explode(F.array("a", "b")).alias("k")), by, few)

    def side(name: str, k: str) -> DataFrame:
        return found.select(*(F.col(c).alias(f"_{c}_{name}") for c in by), F.col("k").alias(f"_k_{name}"), F.col("x").alias(name))

    out = asked
    for name, k in (("xa", "a"), ("xb", "b")):
        out = out.join(side(name, k), [F.col(c).eqNullSafe(F.col(f"_{c}_{name}")) for c in by] + [F.col(k) == F.col(f"_k_{name}")])
    return out.select(*by, "p", (F.col("xa") + F.when(F.col("t") > 0, (F.col("xb") - F.col("xa")) * F.col("t")).otherwise(0.0)).alias("x"))


def wide_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = [], few: int = FEW) -> DataFrame:
    """(by..., a column a name of probs): quantiles() side by side."""
    q = quantiles(df, value, list(dict.fromkeys(probs.values())), by, few)
    return q.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("x"))).alias(n) for n, p in probs.items()))
