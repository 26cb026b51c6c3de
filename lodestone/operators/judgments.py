"""Votes and judgments: from parsed replies to statuses, and from statuses to retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import argmax, jaccard

INFORMATIVE = ("supports", "against")


def vote_status(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, severity_hint) votes -> the most frequent status, `ambiguous` on ties, with the median hint of that status' votes cut to an integer.

    n_votes and agreement (largest share) come with it; null statuses don't vote.
    """
    v = votes.where(F.col("status").isNotNull())
    counts = v.groupBy(*keys, "status").agg(F.count("*").alias("n"), F.percentile("severity_hint", 0.5).alias("hint"))
    g = counts.groupBy(*keys).agg(F.max("n").alias("top"), F.sum("n").alias("n_votes"), F.sort_array(F.collect_list(F.struct("n", "status", "hint"))).alias("all"))  # four statuses at most
    won = F.filter("all", lambda x: x["n"] == F.col("top"))
    single = F.size(won) == 1
    return g.select(
        *keys,
        F.when(single, F.get(won, F.lit(0))["status"]).otherwise("ambiguous").alias("status"),
        F.when(single, F.get(won, F.lit(0))["hint"]).otherwise(F.get(F.filter("all", lambda x: x["status"] == "ambiguous"), F.lit(0))["hint"]).cast("int").alias("severity_hint"),
        "n_votes",
        (F.col("top") / F.col("n_votes")).alias("agreement"),
    )


def vote_labels(votes: DataFrame, keys: list[str], classes: int = 4, when_none: int | None = None) -> DataFrame:
    """Class votes -> fractions p and the most frequent class, the lowest of equals. Without any vote: null (or when_none) and zeros."""
    n = F.count("prediction")
    p = F.array(*(F.when(n > 0, F.count_if(F.col("prediction") == c) / n).otherwise(0.0) for c in range(classes)))
    g = votes.groupBy(*keys).agg(p.alias("p"), n.alias("n_votes"))
    return g.withColumn("prediction", F.when(F.col("n_votes") > 0, argmax(F.col("p"))).otherwise(F.lit(when_none).cast("int")))


def map_agreement(votes_json):
    """Largest over sum of a JSON map of counts; null if it is empty."""
    values = F.map_values(F.from_json(votes_json, "map<string,int>"))
    total = F.aggregate(values, F.lit(0), lambda s, x: s + x)
    return F.when(total > 0, F.array_max(values) / total)


def difficult_share(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Share of chains that call an item difficult and not confident, to four places."""
    hard = F.array_contains("difficult_items", F.col("item_id").cast("string"))
    return chains.groupBy(*keys, "item_id").agg(F.round(F.avg(hard.cast("double")), 4).alias("difficult_frac"))


def set_rates(sets: DataFrame, by: list[str]) -> DataFrame:
    """Rates of statuses at a grain, with the mean agreement of votes."""
    rate = lambda c: F.avg(c.cast("double"))
    return sets.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate(F.col("status").isin(*INFORMATIVE)).alias("informative_rate"),
        *(rate(F.col("status") == s).alias(f"{s}_rate") for s in ("supports", "against", "none", "ambiguous")),
        F.avg("agreement").alias("judge_agreement"),
    )


def window_rates(ranked: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """MRR of the first informative window and its presence in the first 1, 3, 5; groups without a judged window don't count."""
    good = F.min(F.when(F.col("status").isin(*INFORMATIVE), F.col("rank")))
    g = ranked.where(F.col("status").isNotNull()).groupBy(*by, *keys).agg(good.alias("r"))
    at = lambda k: F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double"))
    return g.groupBy(*by).agg(F.count("*").alias("groups"), F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"), *(at(k).alias(f"informative_at_{k}") for k in (1, 3, 5)))


def redundancy(ranked: DataFrame, keys: list[str], k: int, gap: int = 10) -> DataFrame:
    """Of the first k windows: mean pairwise Jaccard of turns, share of pairs at .5 or more, regions of centres over `gap` apart, span.

    Lists hold at most k windows, so pairs are made inside a row.
    """
    lists = ranked.where(F.col("rank") <= k).groupBy(*keys).agg(F.collect_list(F.struct("rank", "turn_ids")).alias("w"), F.sort_array(F.collect_list("center_turn_index")).alias("c"))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b["rank"] > a["rank"]), lambda b: jaccard(a["turn_ids"], b["turn_ids"]))))
    steps = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: F.when(b - a > gap, 1).otherwise(0))
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)).otherwise(0.0)
    g = lists.withColumn("p", pairs)
    return g.select(*keys, mean("p").alias("mean_jaccard"), mean(F.transform("p", lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0))).alias("near_dup_rate"),
                    (1 + F.aggregate(steps, F.lit(0), lambda s, v: s + v)).alias("regions"), (F.array_max("c") - F.array_min("c")).alias("span"))


def complementarity(sets: DataFrame, keys: list[str]) -> DataFrame:
    """One class for what two retrievers found, from their statuses side by side: a cell's first judged status by rank and window."""
    first = F.min(F.struct("rank", "window_no", "status"))["status"]
    wide = sets.where(F.col("status").isNotNull()).groupBy(*keys).pivot("retriever", ["bm25", "semantic"]).agg(first)
    a, b = F.col("bm25").isin(*INFORMATIVE), F.col("semantic").isin(*INFORMATIVE)
    kind = (
        F.when(F.col("bm25").isNull() | F.col("semantic").isNull(), "unpaired")
        .when(a & b & (F.col("bm25") == F.col("semantic")), "both_agree")
        .when(a & b, "both_disagree")
        .when(a, "bm25_only")
        .when(b, "semantic_only")
        .when((F.col("bm25") == "ambiguous") | (F.col("semantic") == "ambiguous"), "ambiguous")
        .otherwise("neither")
    )
    return wide.withColumn("kind", kind)


def hybrid_signal(kinds: DataFrame, least: int = 20) -> DataFrame:
    """Unique wins of either retriever; fusion is justified if both have at least `least`."""
    one = lambda k: F.count_if(F.col("kind") == k)
    return kinds.agg(one("bm25_only").alias("bm25_only"), one("semantic_only").alias("semantic_only"), F.count_if(F.col("kind").startswith("both")).alias("both")).withColumn(
        "justified", (F.col("bm25_only") >= least) & (F.col("semantic_only") >= least)
    )


def unique_jobs(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Each (participant, item, window) once, whichever configuration ranks it best: what a judge has to read."""
    w = Window.partitionBy(*keys).orderBy("rank", "config", "retriever")
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
