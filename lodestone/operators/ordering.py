"""Places and running sums in a global order, of which no task sees more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import range_of
from lodestone.sources.scratch import cut


def bounds(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Values that cut a numeric column into about equal ranges; one small row comes to the driver."""
    cuts = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(F.col(column).cast("double"), cuts, 20 * ranges).alias("b")).first().b if cuts else None
    return sorted(set(found or []))


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, ranges: int = 200) -> DataFrame:
    """df with, for each (new, old) of sums, the sum of `old` over the row and all rows before it in the order of a numeric column.

    Rows are dealt into ranges of that column whose sums, at most `ranges` rows, give every range its
    start; rows are sorted within a range only. The column's values should be distinct: of equal ones
    either may come first. df is written once, as it is read for the bounds, the sums and the rows.
    """
    df = cut(df)
    by = F.desc("_range") if descending else F.asc("_range")
    own = F.desc(order) if descending else F.asc(order)
    dealt = df.withColumn("_range", range_of(bounds(df, order, ranges), F.col(order).cast("double")))
    whole = dealt.groupBy("_range").agg(*(F.sum(old).alias(f"_{new}") for new, old in sums.items()))
    before = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = whole.select("_range", *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    within = Window.partitionBy("_range").orderBy(own).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.select("*", *(F.sum(old).over(within).alias(new) for new, old in sums.items()))
    # as literals, a row a range: Spark carries filters on _range's expression to the other side of a join, which lacks its columns
    known = {r["_range"]: r for r in starts.collect()}

    def start(new: str) -> Column:
        values = F.array(*(F.lit(known[i][f"_{new}"] if i in known else 0) for i in range(max(known, default=0) + 1)))
        return F.get(values.cast(f"array<{starts.schema[f'_{new}'].dataType.simpleString()}>"), F.col("_range"))

    return rows.select(*(F.col(c) for c in df.columns if c not in sums), *((F.col(new) + start(new)).alias(new) for new in sums))
