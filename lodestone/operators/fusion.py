"""Decisions from several models: gates, cascades, blends, nested searches, label-free selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import argmax, blend, renormalised, tempered, top_two
from lodestone.operators.metrics import cells, item_metrics


def pooled(runs: DataFrame, keys: list[str], p: str = "p", classes: int = 4) -> DataFrame:
    """Mean probability vector over runs, its argmax and margin between the two best."""
    g = runs.groupBy(*keys).agg(F.array(*(F.avg(F.col(p)[c]) for c in range(classes))).alias(p))
    best = F.sort_array(p, asc=False)
    return g.withColumns({"prediction": argmax(F.col(p)), "margin": best[0] - best[1]})


def gate(kind: str, p: Column, difficult: Column, tau: Column | float, share: Column | float) -> Column:
    """Whether a row goes on to the second model: vote (max p < tau), difficult (share), merged (either)."""
    vote, hard = F.array_max(p) < tau, difficult >= share
    return {"vote": vote, "difficult": hard, "merged": vote | hard}[kind]


def cascade(llm: Column, encoder: Column, routed: Column) -> Column:
    """The first model's class; where routed, that of its two likeliest which the second model likes better (ties: the first)."""
    two = top_two(llm)
    # get(): indexes come from data
    pick = F.when(F.get(encoder, two[1]) > F.get(encoder, two[0]), two[1]).otherwise(two[0])
    return F.when(routed, pick).otherwise(argmax(llm)).cast("int")


def one_hot(c: Column, classes: int = 4) -> Column:
    return F.array(*(F.when(c == k, 1.0).otherwise(0.0) for k in range(classes)))


def gate_sweep(df: DataFrame, taus: list[float], shares: list[float]) -> DataFrame:
    """Metrics and routed share of every gate and setting; the grid is a literal list, rows are counted into cells."""
    grid = [("vote", t, 0.0) for t in taus] + [("difficult", 0.0, d) for d in shares] + [("merged", t, d) for t in taus for d in shares]
    g = df.withColumn("_g", F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.lit(t).alias("tau"), F.lit(d).alias("share")) for k, t, d in grid))))
    tau, share = F.col("_g.tau"), F.col("_g.share")
    vote, hard = F.array_max("llm") < tau, F.col("difficult_frac") >= share
    routed = F.when(F.col("_g.gate") == "vote", vote).when(F.col("_g.gate") == "difficult", hard).otherwise(vote | hard)
    g = g.select("_g.*", "label", routed.alias("routed"), cascade(F.col("llm"), F.col("encoder"), routed).alias("prediction"))
    by = ["gate", "tau", "share"]
    c = g.groupBy(*by, F.col("label").alias("y"), F.col("prediction").alias("p")).agg(F.count("*").alias("n"), F.count_if("routed").alias("r"))
    return item_metrics(c, by).join(c.groupBy(*by).agg((F.sum("r") / F.sum("n")).alias("routed_share")), by)


def severity_routed(llm: Column, encoder: Column, least: int = 2) -> Column:
    return F.when(argmax(llm) >= least, argmax(llm)).otherwise(argmax(encoder))


def nested_choice(df: DataFrame, params: list[float], predict, metric: str = "macro_f1") -> DataFrame:
    """(fold, param): for each held-out fold the parameter that is best on all other folds; the smallest of equals.

    predict(param column) -> prediction column. Each fold and parameter is counted into cells once; a
    held-out fold's training cells are all cells less its own.
    """
    grid = df.withColumn("param", F.explode(F.array(*map(F.lit, params)))).withColumn("prediction", predict(F.col("param")))
    own = cells(grid, ["fold", "param"])
    folds = df.select(F.col("fold").alias("held")).distinct()
    train = own.join(folds, F.col("fold") != F.col("held")).groupBy("held", "param", "y", "p").agg(F.sum("n").alias("n"))
    scored = item_metrics(train, ["held", "param"])
    best = F.max_by("param", F.struct(F.round(metric, 12), -F.col("param")))
    return scored.groupBy(F.col("held").alias("fold")).agg(best.alias("param"))


def nested_blend(df: DataFrame, weights: list[float]) -> DataFrame:
    """df with the blend weight chosen on the other folds and the blended prediction."""
    predict = lambda w: argmax(blend(F.col("llm"), F.col("encoder"), w))
    return df.join(F.broadcast(nested_choice(df, weights, predict)), "fold").withColumn("prediction", predict(F.col("param")))  # a row a fold


def nested_route(df: DataFrame, taus: list[float], direction: str = "encoder_first", margin: float = 0.02) -> DataFrame:
    """df with tau and a routed prediction, threshold and items chosen on the other folds.

    encoder_first: the LLM's class where the encoder's best probability is under tau, the evidence's
    status is ambiguous or none, or the item is one that the LLM rates better (MAE lower by over
    `margin`); else the encoder's. llm_first: the encoder's class where the LLM's lead over its second
    class is under tau or the item is one that the encoder rates better; else the LLM's. tau is the
    first with the highest kappa.
    """
    if direction not in ("encoder_first", "llm_first"):
        raise ValueError("direction must be encoder_first or llm_first")
    llm, encoder = argmax(F.col("llm")), argmax(F.col("encoder"))
    errors = df.groupBy("fold", "item_id").agg(F.sum(F.abs(llm - F.col("label"))).alias("l"), F.sum(F.abs(encoder - F.col("label"))).alias("e"), F.count("*").alias("n"))
    folds = df.select(F.col("fold").alias("held")).distinct()
    gain = F.round(F.sum("e") / F.sum("n") - F.sum("l") / F.sum("n"), 12) * (1 if direction == "encoder_first" else -1)
    other = errors.join(folds, F.col("fold") != F.col("held")).groupBy("held", "item_id").agg((gain > margin).alias("other_item"))
    seen = df.join(F.broadcast(other), "item_id")  # a row a fold and item

    def route(tau: Column) -> Column:
        if direction == "encoder_first":
            away = (F.array_max("encoder") < tau) | F.coalesce("status", F.lit("none")).isin("ambiguous", "none") | F.col("other_item")
            return F.when(away, llm).otherwise(encoder)
        top = F.sort_array("llm", asc=False)
        return F.when((F.get(top, F.lit(0)) - F.get(top, F.lit(1)) < tau) | F.col("other_item"), encoder).otherwise(llm)

    # every held-out fold sees every other fold's rows: folds are few, and rows become cells at once
    grid = seen.where("fold <> held").withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).withColumn("prediction", route(F.col("tau")))
    chosen = item_metrics(cells(grid, ["held", "tau"]), ["held", "tau"]).groupBy("held").agg(F.max_by("tau", F.struct(F.round("qwk", 12), -F.col("tau"))).alias("tau"))
    mine = seen.where("fold = held").join(F.broadcast(chosen), "held")  # a row a fold
    return mine.withColumn("prediction", route(F.col("tau"))).drop("held", "other_item")


def item_source(df: DataFrame, a: str, b: str) -> DataFrame:
    """(fold, item_id, source): for each held-out fold and item, the prediction column with the higher macro F1 on the other folds; a on ties."""
    long = df.unpivot(["fold", "item_id", "label"], [a, b], "source", "prediction")
    own = cells(long, ["fold", "item_id", "source"])
    folds = df.select(F.col("fold").alias("held")).distinct()
    train = own.join(folds, F.col("fold") != F.col("held")).groupBy("held", "item_id", "source", "y", "p").agg(F.sum("n").alias("n"))
    scored = item_metrics(train, ["held", "item_id", "source"])
    first = F.when(F.col("source") == a, 1).otherwise(0)
    return scored.groupBy(F.col("held").alias("fold"), "item_id").agg(F.max_by("source", F.struct(F.round("macro_f1", 12), first)).alias("source"))


def fitted_temperature(df: DataFrame, p: str, grid: list[float]) -> DataFrame:
    """(fold, temperature): the grid value with the least mean negative log-likelihood on the other folds; the smallest of equals."""
    g = df.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    nll = -F.log(F.greatest(F.get(tempered(F.col(p), F.col("t")), F.col("label")), F.lit(1e-12)))
    own = g.groupBy("fold", "t").agg(F.sum(nll).alias("s"), F.count("*").alias("n"))
    folds = df.select(F.col("fold").alias("held")).distinct()
    loss = own.join(folds, F.col("fold") != F.col("held")).groupBy("held", "t").agg((F.sum("s") / F.sum("n")).alias("loss"))
    return loss.groupBy(F.col("held").alias("fold")).agg(F.min_by("t", F.struct(F.round("loss", 10), F.col("t"))).alias("temperature"))


def select_config(candidates: DataFrame, tie: float = 0.005) -> DataFrame:
    """The configuration of highest informative_rate; of those within `tie` the one with the least none_rate, ambiguous_rate,
    redundancy (missing counts worst), then prefix and retriever in fixed order, then rate."""
    worst = F.max("redundancy").over(Window.partitionBy(F.lit(0)))
    best = F.max("informative_rate").over(Window.partitionBy(F.lit(0)))
    c = candidates.withColumns({"_worst": F.coalesce(worst, F.lit(0.0)) + 1, "_best": best}).where(F.col("informative_rate") >= F.col("_best") - tie)
    place = lambda col, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(col)), F.lit(99))
    order = [F.asc("none_rate"), F.asc("ambiguous_rate"), F.asc(F.coalesce("redundancy", "_worst")), place("prefix", ["top3", "top5", "budget"]), F.least(place("retriever", ["bm25", "semantic", "hybrid_a50", "hybrid_a25", "hybrid_a75"]), F.when(F.col("retriever") == "hybrid_a75", 4).otherwise(99)), F.desc("informative_rate"), F.asc("config")]
    return c.withColumn("choice", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where("choice <= 1").drop("_worst", "_best", "choice")


def shortlist(candidates: DataFrame, prefix: str = "top5", tie: float = 0.005, most: int = 2) -> DataFrame:
    """Each configuration's best rate at a prefix; those within `tie` of the best, at most two."""
    best = candidates.where(F.col("prefix") == prefix).groupBy("config").agg(F.max("informative_rate").alias("rate"))
    top = F.max("rate").over(Window.partitionBy(F.lit(0)))
    return best.withColumn("_t", top).where(F.col("rate") >= F.col("_t") - tie).orderBy(F.desc("rate"), "config").limit(most).drop("_t")


def constrained_winner(runs: DataFrame, baseline: str, mae: float = 0.02, recall: float = 0.03, false_severe: float = 0.015) -> DataFrame:
    """The run of highest (qwk, macro_f1) among the baseline and those that pass against it; among all if none does.

    A run fails if its MAE is higher by over `mae` without a higher kappa, or if severe recall falls or
    false alarms rise by more than allowed.
    """
    base = runs.where(F.col("run") == baseline).select(F.col("mae").alias("m0"), F.col("qwk").alias("q0"), F.col("severe_recall").alias("s0"), F.col("false_severe_rate").alias("f0")).limit(1)
    fails = ((F.col("mae") > F.col("m0") + mae) & (F.col("qwk") <= F.col("q0"))) | (F.col("severe_recall") < F.col("s0") - recall) | (F.col("false_severe_rate") > F.col("f0") + false_severe)
    c = runs.join(F.broadcast(base)).withColumn("allowed", (F.col("run") == baseline) | ~F.coalesce(fails, F.lit(False)))  # one row
    best = F.max_by("run", F.struct("allowed", "qwk", "macro_f1"))
    return c.agg(best.alias("winner"), F.max("allowed").alias("constrained"))


def accepted(cascade_row: Column, better: Column) -> Column:
    """Whether a cascade may replace the better of its parts: higher kappa; F1, MAE and false alarms within limits; severe recall no lower."""
    return (
        (cascade_row["qwk"] > better["qwk"]) & (cascade_row["macro_f1"] >= better["macro_f1"] - 0.005) & (cascade_row["mae"] <= better["mae"] + 0.02)
        & F.coalesce(cascade_row["severe_recall"] >= better["severe_recall"] - 1e-9, F.lit(True)) & (cascade_row["false_severe_rate"] <= better["false_severe_rate"] + 0.015)
    )


#: Fixed value: the label of rows that a loss leaves out.
MASKED = -1


def missing_policy(train: DataFrame, policy: str) -> DataFrame:
    """Training rows under a policy for those without evidence (status `none`): zero leaves them, mask sets their label to MASKED and loss_weight 0, drop removes them."""
    if policy not in ("zero", "mask", "drop"):
        raise ValueError(f"unknown missing policy: {policy}")
    none = F.coalesce("status", F.lit("none")) == "none"
    if policy == "drop":
        return train.where(~none)
    if policy == "mask":
        return train.withColumn("loss_weight", F.when(none, 0.0).otherwise(1.0)).withColumn("label", F.when(none, MASKED).otherwise(F.col("label")))
    return train


def missing_policy_stats(train: DataFrame, policies: tuple[str, ...] = ("zero", "mask", "drop"), by: list[str] = []) -> DataFrame:
    """(by..., policy, n_train, n_no_evidence, n_train_effective); zero counts no row as without evidence."""
    none = F.coalesce("status", F.lit("none")) == "none"
    g = train.groupBy(*by).agg(F.count("*").alias("n_train"), F.count_if(none).alias("_none"))
    each = g.withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    lost = F.when(F.col("policy") == "zero", 0).otherwise(F.col("_none"))
    return each.select(*by, "policy", "n_train", lost.cast("long").alias("n_no_evidence"), (F.col("n_train") - lost).alias("n_train_effective"))


def model_frame(df: DataFrame, prediction: Column, items: DataFrame, classes: int = 4) -> DataFrame:
    """The frame that evaluations read: key, fold, label, prediction, the item's name, and the prediction as one-hot probabilities."""
    one_hot = F.array(*((F.col("prediction") == c).cast("double") for c in range(classes)))
    named = df.withColumn("prediction", prediction).join(items.select("item_id", "item_name"), "item_id", "left")
    return named.select("participant_id", "item_id", "item_name", "fold", "label", "prediction", one_hot.alias("probs"))


def selected_status(judged: list[DataFrame], config: str, retriever: str, prefix: str) -> DataFrame:
    """(participant_id, item_id, evidence_status) of the chosen configuration, from all shards of judgments; null counts as none."""
    whole = judged[0]
    for more in judged[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    mine = whole.where((F.col("config") == config) & (F.col("retriever") == retriever) & (F.col("prefix") == prefix))
    return mine.select("participant_id", "item_id", F.coalesce("status", F.lit("none")).alias("evidence_status"))


def aligned(runs: dict[str, DataFrame], keys: list[str], label: str = "label") -> DataFrame:
    """Predictions of several runs side by side, by key and not by place; only keys that all runs have, with the first run's label."""
    out = None
    for name, run in runs.items():
        mine = run.select(*keys, *([label] if out is None else []), F.col("prediction").alias(name))
        out = mine if out is None else out.join(mine, keys)
    return out


def attention_pool(scores: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """Softmax of scores within a bag and the weighted mean of values."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    out = scores.withColumn("attention", e / F.sum(e).over(w))
    return out.withColumn("pooled", F.sum(F.col("attention") * F.col(value)).over(w))


def renormalise(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn(p, renormalised(F.col(p)))
