"""What evidence a reader gets, once windows have been judged: three rewrites of every ranked list, and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["participant_id", "item_id"]
POLICIES = ("filter", "informative_first", "fallback")
#: The id and score of a transcript that stands in for windows, and what parts windows in a pack.
TRANSCRIPT, SEPARATOR = "__transcript__", " [WINDOW_SEP] "


def evidence_policies(base: DataFrame, ranked: DataFrame, judged: DataFrame, sets: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(participant_id, item_id, policy, ids, scores, texts, pack, n_ranked, fell_back) for every row of base and each of POLICIES.

    base: KEY; ranked: KEY, rank, doc_id, score, text; judged: KEY, doc_id, status; sets: KEY, status of a
    list as a whole; transcripts: participant_id, text. `filter` drops windows judged `none` or not judged;
    `informative_first` also puts supports and against before ambiguous, each by rank; `fallback` is
    `filter`, but the participant's transcript alone where the list was judged `none` or nothing is left.
    A window judged twice counts by its smallest status. Keys without ranked rows have empty lists; without a transcript the stand-in is empty.
    """
    one = judged.groupBy(*KEY, "doc_id").agg(F.min("status").alias("status"))
    met = ranked.join(one, [*KEY, "doc_id"], "left").withColumn("status", F.coalesce("status", F.lit("none")))
    order = F.when(F.col("status").isin("supports", "against"), 0).when(F.col("status") == "ambiguous", 1).otherwise(2)
    row = F.struct("rank", F.col("doc_id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), "text", order.alias("order"))
    lists = met.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(F.col("status") != "none", row))).alias("kept"), F.count("*").alias("n_ranked"))
    whole = sets.groupBy(*KEY).agg(F.max((F.col("status") == "none").cast("int")).alias("none"))
    out = base.select(*KEY).join(lists, KEY, "left").join(whole, KEY, "left").join(transcripts.select("participant_id", F.col("text").alias("transcript")), "participant_id", "left")
    empty = F.array().cast("array<struct<rank:int,id:string,score:double,text:string,order:int>>")
    out = out.withColumns({"kept": F.coalesce(F.col("kept").cast("array<struct<rank:int,id:string,score:double,text:string,order:int>>"), empty), "n_ranked": F.coalesce("n_ranked", F.lit(0))})
    names = ("rank", "id", "score", "text", "order")
    by_order = F.array_sort(F.transform("kept", lambda x: F.struct(*(x[n].alias(n) for n in ("order", *names[:-1])))))
    first = F.transform(by_order, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    falls = (F.coalesce("none", F.lit(0)) == 1) | (F.size("kept") == 0)
    stand_in = F.array(F.struct(F.lit(1).alias("rank"), F.lit(TRANSCRIPT).alias("id"), F.lit(1.0).alias("score"), F.coalesce("transcript", F.lit("")).alias("text"), F.lit(0).alias("order")))

    def made(policy: str, rows: Column, fell: Column) -> Column:
        return F.struct(F.lit(policy).alias("policy"), rows.alias("rows"), fell.alias("fell_back"))

    every = F.array(made("filter", F.col("kept"), F.lit(False)), made("informative_first", first, F.lit(False)), made("fallback", F.when(falls, stand_in).otherwise(F.col("kept")), falls))
    each = out.select(*KEY, "n_ranked", F.explode(every).alias("p")).select(*KEY, "n_ranked", "p.*")
    field = lambda n: F.transform("rows", lambda x: x[n])
    return each.select(*KEY, "policy", field("id").alias("ids"), field("score").alias("scores"), field("text").alias("texts"), F.array_join(field("text"), SEPARATOR).alias("pack"), "n_ranked", "fell_back")


def policy_counts(rewritten: DataFrame) -> DataFrame:
    """(policy, n, changed, emptied, fell_back): lists that lost windows, that are empty, that gave way to a transcript."""
    lost = ~F.col("fell_back") & (F.size("ids") != F.col("n_ranked"))
    return rewritten.groupBy("policy").agg(F.count("*").alias("n"), F.count_if(lost).alias("changed"), F.count_if(F.size("ids") == 0).alias("emptied"), F.count_if("fell_back").alias("fell_back"))
