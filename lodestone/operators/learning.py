"""The stacker, the assignment of groups to folds in turn, and the plug-in point of other models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.sequences import hash_order
from lodestone.operators.training import out_of_fold


def stratified_group_folds(df: DataFrame, group: str, k: int = 5, classes: int = 4, seed: str = "42") -> DataFrame:
    """(group, fold): whole groups into k folds of even size and class shares.

    Groups are put into one order, by the spread of their class counts, the counts, then a hash, and
    dealt to the folds in turn; so each fold gets as many of every kind as any other, give or take
    one. Places come from row numbers inside hash buckets of equal class counts and the sizes of the
    buckets before, so no task sees all groups.
    """
    names = [f"_{c}" for c in range(classes)]
    counts = df.groupBy(group).agg(*(F.count_if(F.col("label") == c).alias(n) for c, n in enumerate(names)))
    spread = F.array_max(F.array(*names)) - F.array_min(F.array(*names))
    signed = counts.withColumn("_spread", spread).withColumn("_h", hash_order(seed, group)).withColumn("_bucket", F.substring("_h", 1, 2))
    kind = ["_spread", *names, "_bucket"]
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("_spread"), *names, "_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a kind of class counts
    starts = signed.groupBy(*kind).agg(F.count("*").alias("_n")).select(*kind, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*kind).orderBy("_h", group)) - 1
    return signed.withColumn("_own", own).join(starts, kind).select(group, (F.pmod(F.col("_start") + F.col("_own"), F.lit(k)) + 1).cast("int").alias("fold"))


def stacker_features(df: DataFrame, classes: int = 4, items: int = 8) -> DataFrame:
    """20 columns: both models' probabilities, the first one's class and the item one-hot."""
    best = F.array_position("llm", F.array_max("llm")) - 1
    cols = {f"l{c}": F.get("llm", F.lit(c)) for c in range(classes)} | {f"e{c}": F.get("encoder", F.lit(c)) for c in range(classes)}
    cols |= {f"h{c}": (best == c).cast("double") for c in range(classes)} | {f"i{i}": (F.col("item_id") == i).cast("double") for i in range(1, items + 1)}
    return df.withColumns(cols).withColumn("_names", F.array(*map(F.lit, cols))).drop("_names")


def stacked(df: DataFrame, iterations: int = 50, l2: float = 1.0) -> DataFrame:
    """Out-of-fold predictions of a balanced multinomial logistic regression on standardised features: all folds in one fit.

    Rows keep their columns, with `prediction` and `stacked`, the probabilities.
    """
    x = stacker_features(df)
    names = [c for c in x.columns if c not in df.columns]
    out = out_of_fold(x, names, 4, iterations=iterations, l2=l2)
    return out.select(*df.columns, "prediction", F.col("probabilities").alias("stacked"))


def scored_by(df: DataFrame, model, output: str, kind: str = "double") -> DataFrame:
    """The plug-in point: model(iterator of pandas frames) -> the same with column `output`; batches come by Arrow."""
    return df.mapInPandas(model, StructType([*df.schema.fields, *StructType.fromDDL(f"{output} {kind}").fields]))
