"""Ordered sequences: turns, gap-clipped windows, budgets, samples, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.functions.text import TURN_SEP, collapse, is_participant
from lodestone.operators.ordering import running
from lodestone.operators.selection import order_values
from lodestone.sources.scratch import cut


def turns(rows: DataFrame, gap_column: str | None = None) -> DataFrame:
    """(participant_id, pos, start_time, end_time, text[, ...]) with turn_index from 0 and turn_id `<id>_t0000`.

    One shuffle on participant_id; later steps keyed by it reuse that partitioning.
    """
    order = Window.partitionBy("participant_id").orderBy("pos")
    out = rows.withColumn("turn_index", F.row_number().over(order) - 1)
    return out.withColumn("turn_id", F.format_string("%s_t%04d", F.col("participant_id").cast("string"), F.col("turn_index"))).withColumn("text", collapse("text"))


def participant_only(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Utterances of participants, as far as a sequence tells them: if it marks any, those; else all that aren't interviewers'."""
    who = is_participant(F.col(speaker))
    group = Window.partitionBy("participant_id")
    marked = rows.withColumn("_who", who).withColumn("_any", F.max(F.coalesce(who, F.lit(False))).over(group))
    return marked.where(F.when(F.col("_any"), F.coalesce("_who", F.lit(False))).otherwise(F.coalesce("_who", F.lit(True)))).drop("_who", "_any")


def check_window_parameters(size: int, max_gap: float) -> None:
    if size < 1 or size % 2 == 0:
        raise ValueError("size must be odd and positive")
    if not math.isfinite(max_gap) or max_gap < 0:
        raise ValueError("max_gap must be finite and not negative")


def sessions(rows: DataFrame, max_gap: float, key: str = "participant_id", order: str = "turn_index", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """rows with session_id: a new session where time runs back or the gap to the row before is over max_gap."""
    by = Window.partitionBy(key).orderBy(order)
    broken = (F.col(start) < F.lag(start).over(by)) | (F.col(start) - F.lag(end).over(by) > max_gap)
    return rows.withColumn("_b", F.coalesce(broken.cast("int"), F.lit(0))).withColumn("session_id", F.sum("_b").over(by)).drop("_b")


def context_windows(rows: DataFrame, size: int = 5, max_gap: float = 60.0) -> DataFrame:
    """One window around each turn: up to size // 2 turns to each side, never across a break of sessions().

    All steps share one partitioning on participant_id; a window's frame is a ROWS frame inside its session.
    """
    check_window_parameters(size, max_gap)
    r = size // 2
    frame = Window.partitionBy("participant_id", "session_id").orderBy("turn_index").rowsBetween(-r, r)
    out = sessions(rows, max_gap)
    return out.select(
        "participant_id",
        F.format_string("%s_w%04d", F.col("participant_id").cast("string"), F.col("turn_index")).alias("context_window_id"),
        F.col("turn_id").alias("center_turn_id"),
        F.col("turn_index").alias("center_turn_index"),
        F.collect_list("turn_id").over(frame).alias("turn_ids"),
        F.first("start_time").over(frame).alias("start_time"),
        F.last("end_time").over(frame).alias("end_time"),
        F.count("*").over(frame).cast("int").alias("n_turns"),
        F.array_join(F.collect_list("text").over(frame), TURN_SEP).alias("window_text"),
    )


def word_budget(ranked: DataFrame, keys: list[str], budget: int, words: str = "n_words", rank: str = "rank") -> DataFrame:
    """The ranked rows that fit a budget of words, a separator costing one; the first always stays."""
    by = Window.partitionBy(*keys).orderBy(rank)
    used = F.sum(F.col(words) + F.when(F.col(rank) > 1, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used_words", used).where((F.col("used_words") <= budget) | (F.col(rank) == 1))


def token_budget(ranked: DataFrame, keys: list[str], budget: Column, tokens: str = "n_tokens", rank: str = "rank", sep_tokens: int = 1) -> DataFrame:
    """The ranked rows that fit a budget of tokens, none of them excepted, with budget_unused and excluded_next_len.

    A key whose first row is over budget has no row here; token_budget_stats() has all keys.
    """
    by = Window.partitionBy(*keys).orderBy(rank)
    cost = F.col(tokens) + F.when(F.col(rank) > 1, sep_tokens).otherwise(0)
    used = F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("used_tokens", used).withColumn("_next", F.lead(tokens).over(by)).withColumn("_budget", budget)
    kept = out.where(F.col("used_tokens") <= F.col("_budget"))
    last = F.max(rank).over(Window.partitionBy(*keys))
    return kept.withColumn("budget_unused", F.col("_budget") - F.max("used_tokens").over(Window.partitionBy(*keys))).withColumn(
        "excluded_next_len", F.max(F.when(F.col(rank) == last, F.col("_next"))).over(Window.partitionBy(*keys))
    ).drop("_next", "_budget")


def token_budget_stats(ranked: DataFrame, keys: list[str], budget: Column, tokens: str = "n_tokens", rank: str = "rank", sep_tokens: int = 1) -> DataFrame:
    """A row a key, empty packs included: budget, n_windows, total_tokens, unused_capacity, excluded_next_len (0 if nothing is left out)."""
    by = Window.partitionBy(*keys).orderBy(rank)
    first = F.row_number().over(by) == 1
    rows = ranked.withColumn("_budget", budget).withColumn("_first", first)
    rows = rows.withColumn("_used", F.sum(F.col(tokens) + F.when(F.col("_first"), 0).otherwise(sep_tokens)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("_used") <= F.col("_budget")
    total = F.coalesce(F.max(F.when(fits, F.col("_used"))), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.first("_budget").alias("budget"), F.count_if(fits).alias("n_windows"), total.alias("total_tokens"), (F.first("_budget") - total).alias("unused_capacity"),
        F.coalesce(F.min_by(tokens, F.when(~fits, F.col(rank))), F.lit(0)).alias("excluded_next_len"),
    )


def transcript_text(turns: DataFrame, key: str = "participant_id", order: str = "pos", text: str = "text") -> DataFrame:
    """(key, transcript): trimmed lines that aren't blank, in order, a line each; null if there is none."""
    rows = turns.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim(text).alias("line")))), lambda x: x["line"])
    found = rows.groupBy(key).agg(F.array_join(lines, "\n").alias("transcript"))
    return turns.select(key).distinct().join(found, key, "left")


def severe_then_random(rows: DataFrame, keys: list[str], order: str, k: int, severe: Column, seed: str = "42") -> DataFrame:
    """k rows a group: one severe one, if there is any, then others whatever they are; both by hash order."""
    by = hash_order(seed, *keys, order)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(severe, 0).otherwise(1), by, order)) == 1
    marked = rows.withColumn("_lead", first & severe)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("_lead"), 0).otherwise(1), by, order))
    return marked.withColumn("pick", place).where(F.col("pick") <= k).drop("_lead")


def prefix(ranked: DataFrame, keys: list[str], kind: str, budget: int = 350) -> DataFrame:
    """top3, top5 or budget."""
    if kind == "budget":
        return word_budget(ranked, keys, budget)
    return ranked.where(F.col("rank") <= int(kind.removeprefix("top")))


def hash_order(seed: str, *columns: str) -> Column:
    """A reproducible random order: the MD5 of a seed and columns, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def stable_sample(rows: DataFrame, keys: list[str], order: str, k: int, seed: str = "42") -> DataFrame:
    """k rows a group by hash order; whoever has no more than k keeps all. A WindowGroupLimit drops rows before the sort."""
    by = Window.partitionBy(*keys).orderBy(hash_order(seed, *keys, order), order)
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def first_k(rows: DataFrame, keys: list[str], order: str, k: int, text: str = "text") -> DataFrame:
    """The first k rows of a group whose text isn't blank."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.where(F.trim(text) != "").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def first_seen(rows: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """Distinct keys by first appearance."""
    out = rows.groupBy(key).agg(F.min(order).alias("first_pos")).orderBy("first_pos", key)
    return out.limit(limit) if limit else out


def group_split(rows: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, seed: str = "42") -> DataFrame:
    """(key, split): whole groups into train, validation, test, close to the shares and none of them empty.

    Groups go by the first 32 bits of their hash; the two bounds are exact order statistics of it, found
    by selection, so nothing is sorted as a whole. Groups of equal bits go together. Shares must be
    positive and leave a test share; fewer than three groups are an error.
    """
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("train and validation must be positive and sum to less than 1")
    groups = cut(rows.select(key).distinct().withColumn("_u", F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")))
    n = groups.count()
    if n < 3:
        raise ValueError("three groups are needed for train, validation and test")
    first = min(int((n - 1) * train) + 1, n - 2)
    second = min(max(int((n - 1) * (train + validation)) + 1, first + 1), n - 1)
    ranks = rows.sparkSession.createDataFrame([(first,), (second,)], "k long")
    a, b = (r.x for r in order_values(groups, "_u", ranks).orderBy("k").collect())
    place = F.when(F.col("_u") <= a, "train").when(F.col("_u") <= b, "validation").otherwise("test")
    return groups.select(key, place.alias("split"))


def informative_first(rows: DataFrame, keys: list[str], policy: str = "informative_first") -> DataFrame:
    """Ranked evidence with `status` re-ranked by it (supports and against, then ambiguous, then none) or without `none`."""
    status = F.coalesce("status", F.lit("none"))
    if policy == "filter":
        rows = rows.where(status != "none")
    priority = F.when(status.isin("supports", "against"), 0).when(status == "ambiguous", 1).otherwise(2)
    by = Window.partitionBy(*keys).orderBy(priority if policy == "informative_first" else F.lit(0), "rank")
    return rows.withColumn("new_rank", F.row_number().over(by))


def length_batches(rows: DataFrame, cap: int, largest: int, samples: int = 1, length: str = "n_tokens", key: str = "id") -> DataFrame:
    """rows with batch: filled by growing length until size * samples * length would pass cap, or `largest` is reached.

    The cut is sequential, so each Spark partition is batched by itself, after a sort by length inside
    it; a model is then run a batch at a time on the same executor.
    """

    def run(parts):
        import pandas as pd
        from pyspark import TaskContext

        n, size, batch = TaskContext.get().partitionId(), 0, 0
        for df in parts:
            out = []
            for v in df[length]:
                if size and ((size + 1) * samples * v > cap or size >= largest):
                    batch, size = batch + 1, 0
                size += 1
                out.append((n << 32) + batch)
            yield df.assign(batch=pd.Series(out, index=df.index, dtype="int64"))

    schema = StructType([*rows.schema.fields, StructField("batch", LongType())])
    return rows.sortWithinPartitions(length, key).mapInPandas(run, schema)


def padded_batches(rows: DataFrame, batch: str, ids: str = "input_ids", labels: str = "labels", pad: int = 0, ignore: int = -100) -> DataFrame:
    """rows with ids and labels padded on the right to the longest of their batch, and attention_mask; batches are bounded by whoever made them."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    grown = rows.withColumn("_n", longest)
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value).cast("bigint"), F.col("_n") - F.size(c)))
    mask = F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("_n") - F.size(ids)))
    return grown.withColumns({"attention_mask": mask, ids: fill(ids, pad), labels: fill(labels, ignore)}).drop("_n")


def row_index(rows: DataFrame, order: str, into: str = "row") -> DataFrame:
    """rows numbered from 0 in the order of a numeric column, by ranges and not in one task; sorting by it restores the order."""
    counted = running(rows.withColumn("_one", F.lit(1).cast("long")), order, {into: "_one"})
    return counted.withColumn(into, F.col(into) - 1).drop("_one")
