"""Aggregations of several grains: spreads, weights, audits, overlaps, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.selection import wide_quantiles


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean with sample and population deviation, smallest and largest."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd_sample"), F.stddev_pop(value).alias("sd_population"), F.min(value).alias("least"), F.max(value).alias("most"))


def described(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, ends and quartiles of a column; quartiles are exact, by selection."""
    ends = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    out = ends.join(F.broadcast(wide_quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})), F.lit(True), "left")  # one row each
    return out.select("n", "mean", "sd", "least", "q25", "q50", "q75", "most")


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets, of what they share and of what only one has: five rows."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full_outer")
    c = both.agg(F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count(F.col("in_a") + F.col("in_b")).alias("both"))
    c = c.withColumns({"a_only": F.col("a") - F.col("both"), "b_only": F.col("b") - F.col("both")})
    return c.unpivot([], ["a", "b", "both", "a_only", "b_only"], "part", "n")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and distinct values of each column, in one pass each over pre-summed values."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("value").alias("distinct"))


def class_shape(df: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """Share of the majority class, mean label and share of the top class."""
    c = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    s = F.sum("n")
    return c.groupBy(*by).agg((F.max("n") / s).alias("majority_share"), (F.sum(F.col("n") * F.col("label")) / s).alias("mean_severity"), (F.sum(F.when(F.col("label") == top, F.col("n")).otherwise(0)) / s).alias("severe_share"))


def class_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """n / (k * n_c) of the k classes that occur; null where fewer than two do."""
    c = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return c.withColumn("weight", F.when(F.count("*").over(w) >= 2, F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))))


def missing_audit(df: DataFrame) -> DataFrame:
    """What dropping rows without evidence takes from each fold's training rows and item, with warnings.

    Counts of (fold, item, label, none) come first; a held-out fold's training rows are all but its own.
    """
    none = (F.coalesce("status", F.lit("none")) == "none").cast("int")
    c = df.groupBy("fold", "item_id", "label", none.alias("none")).agg(F.count("*").alias("n"))
    train = c.join(df.select(F.col("fold").alias("held")).distinct(), F.col("fold") != F.col("held"))
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = train.groupBy("held", "item_id").agg(F.sum("n").alias("rows"), s(F.col("none") == 1).alias("none_rows"), s(F.col("label") == 3).alias("severe"), s((F.col("label") == 3) & (F.col("none") == 1)).alias("severe_removed"),
                                             *(s((F.col("label") == k) & (F.col("none") == 0)).alias(f"left_{k}") for k in range(4)))
    gone = F.least(*(F.col(f"left_{k}") for k in range(4))) == 0  # their product passes 64 bits from some 55,000 a class on
    return g.withColumns({"warn_rows": F.col("none_rows") > 0.4 * F.col("rows"), "warn_severe": F.col("severe_removed") > 0.3 * F.col("severe"), "warn_class": gone}).withColumnRenamed("held", "fold")


def strata(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df repeated for each stratifier as (stratum, value), `overall` included: one pass for all breakdowns."""
    parts = [F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value"))] + [F.struct(F.lit(n).alias("stratum"), c.cast("string").alias("value")) for n, c in columns.items()]
    return df.withColumn("_s", F.explode(F.array(*parts))).select("*", "_s.*").drop("_s")


def model_complementarity(df: DataFrame, by: list[str], a: str = "encoder_pred", b: str = "llm_pred") -> DataFrame:
    """Shares of both right, either alone, both wrong; who errs less; disagreement by one and by two or more."""
    ra, rb, d = F.col(a) == F.col("label"), F.col(b) == F.col("label"), F.abs(F.col(a) - F.col(b))
    ea, eb = F.abs(F.col(a) - F.col("label")), F.abs(F.col(b) - F.col("label"))
    m = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), m(ra & rb).alias("both_correct"), m(ra & ~rb).alias("a_only"), m(~ra & rb).alias("b_only"), m(~ra & ~rb).alias("both_wrong"),
                               m(ea < eb).alias("a_closer"), m(eb < ea).alias("b_closer"), m(d >= 1).alias("disagree_1"), m(d >= 2).alias("disagree_2"))


def correlations(df: DataFrame, x: str, y: str, by: list[str] = []) -> DataFrame:
    """Pearson, and the least-squares line of y on x."""
    return df.groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with tied ranks shared. Ranks come from one row a distinct value."""

    def ranks(c: str, name: str) -> DataFrame:
        v = df.groupBy(c).agg(F.count("*").alias("k"))
        before = F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return v.select(c, (F.coalesce(before, F.lit(0)) + (F.col("k") + 1) / 2.0).alias(name))

    return df.join(ranks(x, "rx"), x).join(ranks(y, "ry"), y).agg(F.corr("rx", "ry").alias("spearman"))


def best_per_cell(df: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    """Largest value of each pair, columns side by side."""
    return df.groupBy(rows).pivot(columns, names).agg(F.max(value))


def truncation_audit(df: DataFrame, by: list[str], tokens: str, longest: int) -> DataFrame:
    """Mean, exact median and 95th percentile, and largest number of tokens of each group, with the share over `longest`."""
    plain = df.groupBy(*by).agg(F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("most_tokens"), F.avg((F.col(tokens) > longest).cast("double")).alias("truncated_share"))
    q = wide_quantiles(df, tokens, {"median_tokens": 0.5, "p95_tokens": 0.95}, by)
    met = plain.join(q.select(*(F.col(c).alias(f"_{c}") for c in by), "median_tokens", "p95_tokens"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    return met.select(*by, "mean_tokens", "median_tokens", "p95_tokens", "most_tokens", "truncated_share")


def window_stats(df: DataFrame, keys: list[str], by: str, hits: str, chars: str, order: str, k: int) -> DataFrame:
    """(by, hit_rate, mean_hits, mean_top, mean_windows, mean_chars) over each key's k rows with most hits, ties by `order`.

    hit_rate is the share of keys with a hit, mean_hits and mean_top a key's hits in all and at most in
    one row, mean_windows its rows, mean_chars a row's length. `by` is one of the keys.
    """
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(hits), order))
    each = df.withColumn("_r", r).where(F.col("_r") <= k).groupBy(*keys).agg(F.count("*").alias("_n"), F.max(hits).alias("_top"), F.sum(hits).alias("_hits"), F.sum(chars).alias("_chars"))
    return each.groupBy(by).agg(F.avg((F.col("_top") > 0).cast("double")).alias("hit_rate"), F.avg("_hits").alias("mean_hits"), F.avg("_top").alias("mean_top"), F.avg("_n").alias("mean_windows"), (F.sum("_chars") / F.sum("_n")).alias("mean_chars"))


def parse_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of statuses, rates over parsed rows, share parsed."""
    n = F.count("status")
    of = lambda s: F.count_if(F.col("status") == s)
    return df.groupBy(*by).agg(*(of(s).alias(s) for s in ("supports", "against", "ambiguous", "none")), F.count_if(F.col("status").isNull()).alias("unparsed"),
                               F.when(n > 0, (of("supports") + of("against")) / n).alias("informative_rate"), F.when(n > 0, of("none") / n).alias("none_rate"), (n / F.count("*")).alias("parse_rate"))


def pivoted(df: DataFrame, by: list[str], over: str, values: list[str], value: str) -> DataFrame:
    """Means of `value` at (by..., over), a column for each of `values`."""
    return df.groupBy(*by).pivot(over, values).agg(F.avg(value))


def rate_deltas(a: DataFrame, b: DataFrame, key: str, rate: str) -> DataFrame:
    """(key, a, b, delta) of a rate in two runs, with the mean row under a null key."""
    met = a.select(key, F.col(rate).alias("a")).join(b.select(key, F.col(rate).alias("b")), key).withColumn("delta", F.col("b") - F.col("a"))
    return met.unionByName(met.agg(*(F.avg(c).alias(c) for c in ("a", "b", "delta"))).withColumn(key, F.lit(None).cast(met.schema[key].dataType)))


def seed_rollup(df: DataFrame, model: str, seed: str, value: str, a: str, b: str) -> DataFrame:
    """One row: means and spreads of two models' values over seeds both have, the paired difference's t, and how often b wins."""
    both = df.where(F.col(model).isin(a, b)).groupBy(seed).pivot(model, [a, b]).agg(F.first(value)).dropna()
    d = F.col(b) - F.col(a)
    return both.agg(
        F.count("*").alias("seeds"), F.avg(a).alias("mean_a"), F.stddev_samp(a).alias("sd_a"), F.avg(b).alias("mean_b"), F.stddev_samp(b).alias("sd_b"),
        F.count_if(d > 0).alias("wins"), F.when(F.stddev_samp(d) > 0, F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"),
    )
