"""End-to-end plans: each is one lazy DataFrame from its inputs to its result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, WINDOW_SEP, retrieval_method, tokens
from lodestone.operators import fusion, inference, judgments, metrics, retrieval, sequences


def evidence_dataset(raw: DataFrame, items: DataFrame, size: int = 3, how: retrieval.Ranking = retrieval.Ranking(k=3)) -> DataFrame:
    """Rows of turns and query items -> each participant's and item's best windows, packed.

    Turns, windows and scores are keyed by participant; items join as the small table they are.
    """
    windows = sequences.context_windows(sequences.turns(raw), size=size)
    docs = windows.select("participant_id", F.col("context_window_id").alias("doc_id"), F.col("center_turn_index").alias("pos"), "turn_ids", "window_text", tokens(F.col("window_text"), STOPWORDS).alias("tokens"))
    asked = items.select("item_id", tokens(F.col("glossary"), STOPWORDS).alias("tokens"))
    top = retrieval.bm25_top(docs, asked, how)
    texts = top.join(docs.select("participant_id", "doc_id", F.col("window_text").alias("text")), ["participant_id", "doc_id"])
    base = docs.select("participant_id").distinct().join(items.select("item_id"))
    return retrieval.packed(texts, base, WINDOW_SEP)


def decision_study(preds: DataFrame, replicates: int = 200) -> DataFrame:
    """Two models' probabilities -> the gated cascade against both, with paired intervals over participants."""
    routed = fusion.gate("merged", F.col("llm"), F.col("difficult_frac"), 0.8, 0.8)
    p = preds.withColumn("cascade_pred", fusion.cascade(F.col("llm"), F.col("encoder"), routed))
    reps = inference.replicate_metrics(p, "participant_id", ["encoder_pred", "cascade_pred"], replicates)
    return inference.paired_deltas(reps, "encoder_pred", "cascade_pred", ["macro_f1", "qwk", "mae", "accuracy"])


def retrieval_study(judged: DataFrame, tie: float = 0.005) -> DataFrame:
    """Judged sets -> the configuration chosen without labels."""
    rates = judgments.set_rates(judged, ["config", "retriever", "prefix"]).withColumn("redundancy", F.lit(None).cast("double"))
    return fusion.select_config(rates, tie)


def run_comparison(preds: DataFrame, runs: list[str]) -> DataFrame:
    """Metric rows of several prediction columns, overall and by item, from one pass over the rows."""
    long = preds.unpivot(["item_id", "label"], runs, "run", "prediction")
    c = metrics.cells(long, ["run", "item_id"])
    whole = metrics.item_metrics(c, ["run"]).withColumn("item_id", F.lit(0))
    return metrics.item_metrics(c, ["run", "item_id"]).unionByName(whole)


def overlap_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a cross-encoder: score over one plus rank."""
    for b in batches:
        yield b.assign(rerank_score=b["score"] / (1.0 + b["rank"] % 3))


def run_manifest(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """A row a run: where its evidence came from, its rows, participants and folds, and its headline metrics.

    preds are long (run, participant_id, fold, label, prediction); runs: run, dataset, evidence_column.
    """
    sizes = preds.groupBy("run").agg(F.count("*").alias("rows"), F.count_distinct("participant_id").alias("participants"), F.count_distinct("fold").alias("folds"))
    m = metrics.item_metrics(metrics.cells(preds, ["run"]), ["run"]).select("run", "accuracy", "macro_f1", "qwk", "mae")
    named = runs.withColumn("method", retrieval_method(F.col("dataset"), F.col("evidence_column")))
    return named.join(sizes, "run", "left").join(m, "run", "left")


def results_summary(manifest: DataFrame) -> DataFrame:
    """(run, metric, value, rank, best) of all runs with results."""
    return metrics.leaderboard(manifest.where("rows IS NOT NULL").unpivot(["run"], ["accuracy", "macro_f1", "qwk", "mae"], "metric", "value"), ["mae"])
