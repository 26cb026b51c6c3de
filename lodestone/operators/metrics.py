"""Ordinal and binary metrics as functions of confusion cells.

Rows are counted into (group, label, prediction) cells once, which Spark sums before it shuffles;
every metric then works on at most classes² cells a group, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import running

CLASSES = 4


def cells(df: DataFrame, by: list[str] = [], label: str = "label", pred: str = "prediction", weight: Column | None = None) -> DataFrame:
    """(by..., y, p, n); rows without a prediction are no cell."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(pred).isNotNull()).groupBy(*by, F.col(label).alias("y"), F.col(pred).alias("p")).agg(n.alias("n"))


def confusion(df: DataFrame, by: list[str] = [], classes: int = CLASSES, **names: str) -> DataFrame:
    """All cells, zeros included, with the share of their row."""
    c = cells(df, by, **names)
    both = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda p: F.struct(y.alias("y"), p.alias("p"))))))
    grid = (c.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, both.alias("g")).select(*by, "g.*")
    full = grid.join(c, [*by, "y", "p"], "left").fillna(0, ["n"])
    row = F.sum("n").over(Window.partitionBy(*by, "y"))
    return full.withColumn("row_share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def _sum(cond: Column, n: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def f1_of(c: int) -> Column:
    """F1 of a class over grouped cells; 0 if it neither occurs nor is predicted."""
    hit, said, true = _sum((F.col("y") == c) & (F.col("p") == c)), _sum(F.col("p") == c), _sum(F.col("y") == c)
    return F.when(said + true > 0, 2 * hit / (said + true)).otherwise(0.0)


def macro_f1(classes: int = CLASSES, labels: str = "fixed") -> Column:
    """Mean F1 of all classes (fixed) or of those that occur or are predicted (observed)."""
    each = [f1_of(c) for c in range(classes)]
    total = sum(each[1:], each[0])
    if labels == "fixed":
        return total / classes
    present = [F.when(_sum((F.col("y") == c) | (F.col("p") == c)) > 0, 1).otherwise(0) for c in range(classes)]
    return total / sum(present[1:], present[0])


def kappa(classes: int = CLASSES) -> Column:
    """Quadratically weighted kappa over grouped cells; 0 where nothing can be expected to differ."""
    n = F.sum("n")
    observed = F.sum(F.col("n") * F.pow(F.col("y") - F.col("p"), 2))
    # sum of (i - j)^2 r_i c_j = n sum i^2 r_i + n sum j^2 c_j - 2 sum i r_i sum j c_j
    expected = F.sum(F.col("n") * F.pow("y", F.lit(2))) + F.sum(F.col("n") * F.pow("p", F.lit(2))) - 2 * F.sum(F.col("n") * F.col("y")) * F.sum(F.col("n") * F.col("p")) / n
    return F.when(expected > 0, 1 - observed / expected).otherwise(0.0)


def item_metrics(c: DataFrame, by: list[str] = [], classes: int = CLASSES, labels: str = "fixed") -> DataFrame:
    """Cells -> n, accuracy, macro_f1, qwk, mae, far_off_rate, within_one, f1 of the top class, severe_recall, false_severe_rate, signed_error."""
    n, top, gap = F.sum("n"), classes - 1, F.abs(F.col("y") - F.col("p"))
    return c.groupBy(*by).agg(
        n.alias("n"),
        (_sum(F.col("y") == F.col("p")) / n).alias("accuracy"),
        macro_f1(classes, labels).alias("macro_f1"),
        kappa(classes).alias("qwk"),
        (F.sum(F.col("n") * gap) / n).alias("mae"),
        (_sum(gap >= 2) / n).alias("far_off_rate"),
        (_sum(gap <= 1) / n).alias("within_one"),
        f1_of(top).alias(f"f1_class{top}"),
        _ratio(_sum((F.col("y") == top) & (F.col("p") == top)), _sum(F.col("y") == top)).alias("severe_recall"),
        _ratio(_sum((F.col("y") != top) & (F.col("p") == top)), _sum(F.col("y") != top)).alias("false_severe_rate"),
        (F.sum(F.col("n") * (F.col("p") - F.col("y"))) / n).alias("signed_error"),
        _ratio(_sum(gap == 1), _sum(gap > 0)).alias("off_by_one_of_errors"),
    )


def class_report(c: DataFrame, by: list[str] = [], classes: int = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 on empty."""
    roles = c.select(*by, "n", F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("s"), (F.col("y") == F.col("p")).cast("int").alias("h")),
                                                 F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("h")))).alias("r"))
    sums = roles.groupBy(*by, F.col("r.c").alias("class")).agg(F.sum(F.col("n") * F.col("r.t")).alias("support"), F.sum(F.col("n") * F.col("r.s")).alias("said"), F.sum(F.col("n") * F.col("r.h")).alias("hit"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select(*by, "class", "support", zero(F.col("hit"), F.col("said")).alias("precision"), zero(F.col("hit"), F.col("support")).alias("recall"),
                       zero(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def with_coverage(df: DataFrame, by: list[str] = []) -> DataFrame:
    """item_metrics() with n_total and coverage, the share of rows that have a prediction."""
    seen = df.groupBy(*by).agg(F.count("*").alias("n_total"), F.avg(F.col("prediction").isNotNull().cast("double")).alias("coverage"))
    m = item_metrics(cells(df, by), by)
    return m.join(seen, by) if by else m.join(F.broadcast(seen))  # one row


def totals(df: DataFrame, key: str = "participant_id", complete: int | None = None) -> DataFrame:
    """Sums of labels and predictions a participant; only of those with `complete` rows if given."""
    t = df.groupBy(key).agg(F.sum("label").alias("true_total"), F.sum("prediction").alias("pred_total"), F.count("*").alias("n_items"))
    return t.where(F.col("n_items") == complete) if complete else t


def position_kappa(t: DataFrame, by: list[str] = [], a: str = "true_total", b: str = "pred_total", weight: str | None = None) -> DataFrame:
    """Weighted kappa in which a value counts by its place among the values that occur on either side; rows may stand for `weight` ones."""
    seen = t.select(*by, F.explode(F.array(a, b)).alias("v")).distinct()
    place = seen.withColumn("k", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("v")) - 1)  # one row a distinct total
    y = place.select(*by, F.col("v").alias(a), F.col("k").alias("y"))
    p = place.select(*by, F.col("v").alias(b), F.col("k").alias("p"))
    c = t.groupBy(*by, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n")).join(y, [*by, a]).join(p, [*by, b])
    return c.groupBy(*by).agg(kappa().alias("total_qwk"))


def average_rank(c: str, by: list[str] = []) -> Column:
    """Rank with ties sharing their mean."""
    keys = [F.col(b) for b in by] or [F.lit(0)]
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0


def total_agreement(t: DataFrame) -> DataFrame:
    """MAE, Pearson, Spearman, means of totals. Ranks come from one row a distinct total, not from all rows."""
    def ranks(c: str) -> DataFrame:
        v = t.groupBy(c).agg(F.count("*").alias("k"))
        before = F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return v.select(c, (F.coalesce(before, F.lit(0)) + (F.col("k") + 1) / 2.0).alias(f"r_{c}"))

    r = t.join(ranks("true_total"), "true_total").join(ranks("pred_total"), "pred_total")
    return r.agg(
        F.avg(F.abs(F.col("true_total") - F.col("pred_total"))).alias("total_mae"),
        F.corr("true_total", "pred_total").alias("pearson"),
        F.corr("r_true_total", "r_pred_total").alias("spearman"),
        F.avg("true_total").alias("mean_true"),
        F.avg("pred_total").alias("mean_pred"),
    )


def band(total: Column, mode: str = "inclusive") -> Column:
    """Severity band 0..4. inclusive: 0-4, 5-9, 10-14, 15-19, 20 and over; digitize: a total of 4, 9, 14, 19 is in the next band."""
    out = F.lit(0)
    for i, edge in enumerate((4, 9, 14, 19)):
        out = F.when(total > edge if mode == "inclusive" else total >= edge, i + 1).otherwise(out)
    return out


def band_metrics(t: DataFrame, mode: str = "inclusive") -> DataFrame:
    """Exact and adjacent agreement of bands, their kappa, MAE and bias of totals."""
    b = t.withColumns({"label": band(F.col("true_total"), mode), "prediction": band(F.col("pred_total"), mode)})
    agreement = cells(b).agg((_sum(F.col("y") == F.col("p")) / F.sum("n")).alias("exact"), (_sum(F.abs(F.col("y") - F.col("p")) <= 1) / F.sum("n")).alias("adjacent"), kappa(5).alias("band_qwk"))
    size = t.agg(F.avg(F.abs(F.col("pred_total") - F.col("true_total"))).alias("total_mae"), F.avg(F.col("pred_total") - F.col("true_total")).alias("bias"))
    return agreement.join(F.broadcast(size))  # one row each


def binary_metrics(t: DataFrame, thresholds: list[int], truth: str = "true_total", score: str = "pred_total") -> DataFrame:
    """Sensitivity, specificity, precision, F1, balanced accuracy and the 2x2 cells at each threshold."""
    g = t.select(F.col(truth).alias("y"), F.col(score).alias("s")).groupBy("y", "s").agg(F.count("*").alias("n")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    yes, said = F.col("y") >= F.col("threshold"), F.col("s") >= F.col("threshold")
    c = g.groupBy("threshold").agg(_sum(yes & said).alias("tp"), _sum(~yes & said).alias("fp"), _sum(yes & ~said).alias("fn"), _sum(~yes & ~said).alias("tn"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sens, spec, prec = zero(F.col("tp"), F.col("tp") + F.col("fn")), zero(F.col("tn"), F.col("tn") + F.col("fp")), zero(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.select("threshold", "tp", "fp", "fn", "tn", sens.alias("sensitivity"), spec.alias("specificity"), prec.alias("precision"),
                    zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ((sens + spec) / 2).alias("balanced_accuracy"))


def roc_points(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """(score, a, b, tp, fp, pos, neg) at every distinct score: true and false rows at it, at or above it, and in all."""
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(truth.cast("long")).alias("a"), F.sum((~truth).cast("long")).alias("b"))
    whole = g.agg(F.sum("a").alias("pos"), F.sum("b").alias("neg"))  # one row
    return running(g, "score", {"tp": "a", "fp": "b"}, descending=True).join(F.broadcast(whole))


def ranking_quality(points: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, and average precision by steps."""
    auc = F.sum(F.col("b") * (2 * F.col("tp") - F.col("a")) / 2.0 / F.col("pos") / F.col("neg"))
    ap = F.sum(F.col("a") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.agg(auc.alias("auroc"), ap.alias("average_precision"))


def tuned_threshold(points: DataFrame, least_sensitivity: float = 0.85) -> DataFrame:
    """The score with the highest specificity among those sensitive enough; the highest such score."""
    p = points.select("score", (F.col("tp") / F.col("pos")).alias("sensitivity"), (1 - F.col("fp") / F.col("neg")).alias("specificity"))
    return p.where(F.col("sensitivity") >= least_sensitivity).agg(F.max_by(F.struct("score", "sensitivity", "specificity"), F.struct("specificity", "score")).alias("b")).select("b.*")


def calibration_bins(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence): bins are open below and closed above; a confidence of 0 is in none."""
    edges = F.array(*(F.lit(b / bins) for b in range(bins)))
    below = F.size(F.filter(edges, lambda e: e < F.col(confidence)))
    # an explode and no filter: Spark would move a filter below the projections and make the confidence anew for each edge
    place = F.explode(F.when((below > 0) & (F.col(confidence) <= 1), F.array(below - 1)).otherwise(F.array().cast("array<int>")))
    return df.withColumn("bin", place).groupBy("bin").agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))


def expected_calibration_error(bins: DataFrame, total: DataFrame) -> DataFrame:
    n = total.agg(F.count("*").alias("total"))
    return bins.join(F.broadcast(n)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))


def risk_coverage(df: DataFrame, confidence: str, correct: Column, order: str, coverages: list[float]) -> DataFrame:
    """Accuracy of the floor(c * n) most confident rows.

    Confidences are counted into distinct values first; only rows that tie with a cut are ranked, by
    `order`, so no task sorts the table.
    """
    by_value = df.groupBy(F.col(confidence).alias("v")).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("good"))
    run = running(by_value, "v", {"to": "n", "good_to": "good"}, descending=True)
    run = run.select("v", "n", (F.col("to") - F.col("n")).alias("above"), (F.col("good_to") - F.col("good")).alias("good_above"))
    size = by_value.agg(F.sum("n").alias("size"))
    cuts = run.join(F.broadcast(size)).withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).withColumn("keep", F.floor(F.col("coverage") * F.col("size") + 1e-9))
    cuts = cuts.where((F.col("above") < F.col("keep")) & (F.col("keep") <= F.col("above") + F.col("n")))
    tied = df.select(F.col(confidence).alias("v"), correct.cast("long").alias("ok"), order).join(F.broadcast(cuts), "v")  # a row a coverage
    place = F.row_number().over(Window.partitionBy("coverage").orderBy(order))
    rest = tied.withColumn("r", place).where(F.col("above") + F.col("r") <= F.col("keep"))
    return rest.groupBy("coverage").agg(F.first("keep").alias("kept"), ((F.first("good_above") + F.sum("ok")) / F.first("keep")).alias("accuracy"))


def deferred_mix(df: DataFrame, confidence: str, threshold: float, label: str = "label") -> DataFrame:
    """(label, deferred, kept, deferred_share): what classes the rows are from that a threshold of confidence leaves to people."""
    away = F.col(confidence) < threshold
    g = df.groupBy(label).agg(F.count_if(away).alias("deferred"), F.count_if(~away).alias("kept"))
    whole = df.agg(F.count_if(away).alias("_d"))  # one row
    return g.join(F.broadcast(whole)).withColumn("deferred_share", _ratio(F.col("deferred"), F.col("_d"))).drop("_d")


def wins(deltas: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """run_deltas() -> (metric, wins, losses, ties, mean_delta) of b against a over the keys, by each metric's direction."""
    better = F.when(F.col("metric").isin(lower_is_better), -F.col("delta")).otherwise(F.col("delta"))
    return deltas.groupBy("metric").agg(F.count_if(better > 0).alias("wins"), F.count_if(better < 0).alias("losses"), F.count_if(better == 0).alias("ties"), F.avg("delta").alias("mean_delta"))


def failure_report(df: DataFrame, weakest: int = 3) -> DataFrame:
    """(section, key, n, value): the items of lowest kappa, accuracy by evidence status, severe misses and false alarms by item."""
    items = item_metrics(cells(df, ["item_id"]), ["item_id"]).withColumn("qwk", F.round("qwk", 9)).orderBy("qwk", "item_id").limit(weakest)
    y, p = F.col("label"), F.col("prediction")
    text = lambda c: F.col(c).cast("string").alias("key")
    by_status = df.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.avg((y == p).cast("double")).alias("value"))
    by_item = df.groupBy("item_id").agg(F.count("*").alias("n"), F.avg(((y >= 2) & (p == 0)).cast("double")).alias("miss"), F.avg(((y == 0) & (p >= 2)).cast("double")).alias("alarm"))
    parts = [
        items.select(F.lit("weakest_items").alias("section"), text("item_id"), "n", F.col("qwk").alias("value")),
        by_status.select(F.lit("by_status"), text("status"), "n", "value"),
        by_item.select(F.lit("severe_misses"), text("item_id"), "n", "miss"),
        by_item.select(F.lit("false_alarms"), text("item_id"), "n", "alarm"),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def rank_recovery(df: DataFrame, ranked: Column, by: list[str] = []) -> DataFrame:
    """Of the label's place among ranked classes: top-1..3 accuracy, mean place, near misses and recoveries among errors."""
    r = df.withColumn("_r", F.array_position(ranked, F.col("label")))
    wrong = F.col("_r") > 1
    return r.groupBy(*by).agg(
        *(F.avg((F.col("_r") <= k).cast("double")).alias(f"top{k}") for k in (1, 2, 3)),
        F.avg("_r").alias("mean_place"),
        _ratio(F.count_if(F.col("_r") == 2), F.count_if(wrong)).alias("recovered_by_second"),
    )


def abstention(df: DataFrame, items: int = 8) -> DataFrame:
    """Participant totals where predictions may be null: covered share, nulls as 0, prorated mean times items."""
    return df.groupBy("participant_id").agg(
        F.avg(F.col("prediction").isNotNull().cast("double")).alias("coverage"),
        F.sum("label").alias("true_total"),
        F.sum(F.coalesce("prediction", F.lit(0))).alias("imputed_total"),
        F.coalesce(F.avg("prediction") * items, F.lit(0.0)).alias("prorated_total"),
    )


def run_deltas(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Two metric tables of one grain -> (keys..., metric, a, b, delta)."""
    long = lambda d, n: d.unpivot(keys, names, "metric", n)
    return long(a, "a").join(long(b, "b"), [*keys, "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def leaderboard(long: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """(run, metric, value) with rank within the metric and a flag of the best, by the metric's direction."""
    sign = F.when(F.col("metric").isin(lower_is_better), F.col("value")).otherwise(-F.col("value"))
    r = F.rank().over(Window.partitionBy("metric").orderBy(sign))
    return long.withColumn("rank", r).withColumn("best", F.col("rank") == 1)


def effective_weights(df: DataFrame, by: list[str] = [], label: str = "label", beta: float = 0.999, classes: int = CLASSES) -> DataFrame:
    """(by..., label, weight): (1 - beta) / (1 - beta^n) of each class with n rows, scaled to a mean of 1 over the classes that occur."""
    n = df.where(F.col(label).between(0, classes - 1)).groupBy(*by, label).agg(F.count("*").alias("n"))
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    return n.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(*by))).select(*by, label, "weight")


def _tasks(logits: str, label: str, gamma: float, classes: int) -> list[tuple[Column, Column, Column]]:
    """For each conditional task: (whether the row takes part, its focal loss, the loss's derivative by the task's logit)."""
    out = []
    for k in range(classes - 1):
        side = F.when(F.col(label) > k, 1.0).otherwise(-1.0)
        z = side * F.get(logits, F.lit(k)).cast("double")
        nll = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # -log of the true side's probability
        p = F.exp(-nll)
        wrong = F.exp(-(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))  # 1 - p without cancellation
        focal = F.pow(wrong, F.lit(float(gamma))) if gamma else F.lit(1.0)
        slope = side * (-gamma * focal * p * nll - focal * wrong)
        out.append((F.col(label) >= k, focal * nll, slope))
    return out


def corn_loss(df: DataFrame, logits: str, label: str = "label", weight: str | None = None, classes: int = CLASSES, by: list[str] = [], gamma: float = 0.0) -> DataFrame:
    """(by..., loss) of conditional ordinal logits (an array of classes - 1): the mean over all conditional tasks, weighted by `weight` if given.

    Task k asks the rows with a label of k or more whether it is more than k. With gamma > 0 what is
    already likely counts less: each loss is multiplied by (1 - p)^gamma, p being the true side's
    probability. Null and negative labels take no part; null logits add nothing, but count.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tasks = _tasks(logits, label, gamma, classes)
    sums = [F.coalesce(F.sum(F.when(on, w * loss)), F.lit(0.0)) for on, loss, _ in tasks]
    mass = [F.coalesce(F.sum(F.when(on, w)), F.lit(0.0)) for on, _, _ in tasks]
    total, whole = sum(sums[1:], sums[0]), sum(mass[1:], mass[0])
    return df.where(F.col(label) >= 0).groupBy(*by).agg((total / F.greatest(whole, F.lit(1.0))).alias("loss"))


def corn_gradient(df: DataFrame, logits: str, label: str = "label", weight: str | None = None, classes: int = CLASSES, by: list[str] = [], gamma: float = 0.0) -> DataFrame:
    """df with `gradient`, an array of classes - 1: the derivative of the corn_loss() of the row's group by each of the row's logits."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tasks = _tasks(logits, label, gamma, classes)
    valid = F.col(label) >= 0
    mass = [F.coalesce(F.sum(F.when(valid & on, w)), F.lit(0.0)) for on, _, _ in tasks]
    if by:
        sizes = df.groupBy(*by).agg(F.greatest(sum(mass[1:], mass[0]), F.lit(1.0)).alias("_mass")).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_mass")
        met = df.join(sizes, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    else:
        met = df.join(F.broadcast(df.agg(F.greatest(sum(mass[1:], mass[0]), F.lit(1.0)).alias("_mass"))), F.lit(True))  # one row
    each = F.array(*(F.when(valid & on, w * slope / F.col("_mass")).otherwise(0.0) for on, _, slope in tasks))
    return met.withColumn("gradient", each).select(*df.columns, "gradient")


def headline(nested: DataFrame, paths: dict[str, str], keep: list[str] = []) -> DataFrame:
    """Nested metric records -> a flat row: name -> path, as in total_qwk -> total.total_qwk."""
    return nested.select(*keep, *(F.col(p).alias(n) for n, p in paths.items()))
