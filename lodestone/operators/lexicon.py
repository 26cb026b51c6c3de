"""Query terms: tiers, expanded queries, term sets, audits. Small tables, so plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, tokens

#: Which tiers a configuration uses, in order of the expanded query, and the kind of query a tier stands for.
CONFIGS = {
    "L0_CORE": ("core",),
    "L1_CORE_LAY": ("core", "lay"),
    "L2_CORE_CLINICAL": ("core", "clinical"),
    "L3_FULL": ("core", "lay", "clinical"),
}
KINDS = {"core": "item", "lay": "lay", "clinical": "clinical"}
#: Cues of an indirect relation.
INDIRECT = (
    "don't go out", "keep to myself", "withdrawn", "stopped", "gave up", "no point", "can't get out of bed", "force myself", "skip meals",
    "forget to eat", "stay in bed", "hard to get up", "hard to get going", "everything is an effort", "everything takes effort", "no get up and go",
    "going through the motions", "no longer interested in friends", "stop participating", "don't look forward", "hit the hay", "clock watching",
    "dragging my feet", "pace around", "pacing", "leg bouncing", "lose track",
)


def core_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct words of the glossary over two letters that aren't stopwords."""
    return items.select("item_id", F.explode(tokens(F.col("glossary"))).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(STOPWORDS)).distinct()


def expanded_queries(terms: DataFrame) -> DataFrame:
    """terms (item_id, tier, pos, term) -> (item_id, config, query): terms of the configuration's tiers in order."""
    tiers = [(c, t, i) for c, ts in CONFIGS.items() for i, t in enumerate(ts)]
    grid = terms.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.lit(t).alias("t"), F.lit(i).alias("i")) for c, t, i in tiers))))
    used = grid.where(F.col("_c.t") == F.col("tier")).select("item_id", F.col("_c.config").alias("config"), F.col("_c.i").alias("i"), "pos", "term")
    return used.groupBy("item_id", "config").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "pos", "term"))), lambda x: x["term"]), " ").alias("query"))


def flat_terms(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, term): core words with the other tiers' terms, of several words or not stopwords, over two letters."""
    other = terms.where("tier <> 'core'").select("item_id", F.lower(F.trim("term")).alias("term"))
    other = other.where((F.length("term") > 2) & (F.contains("term", F.lit(" ")) | ~F.col("term").isin(STOPWORDS)))
    return core_terms(items).union(other).distinct()


def kept_terms(terms: DataFrame) -> DataFrame:
    """What an audit leaves in primary queries."""
    return terms.where("decision = 'keep' AND relation <> 'related_nonspecific'")


def manifest(terms: DataFrame, cues: tuple[str, ...] = INDIRECT) -> DataFrame:
    """Every term with relation by its cues and whether it is in the primary query."""
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.contains(F.lower("term"), F.lit(c))
    return terms.withColumn("relation_class", F.when(cue, "indirect_manifestation").otherwise("direct_paraphrase")).withColumn(
        "in_primary_query", (F.col("decision") == "keep") & (F.col("relation") != "related_nonspecific")
    )


def decision_table(terms: DataFrame, decisions: tuple[str, ...] = ("keep", "remove")) -> DataFrame:
    return terms.groupBy("item_id").pivot("decision", list(decisions)).count().na.fill(0)


def contained_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts (id, item_id, text) ⨝ the item's terms -> (id, item_id, terms): those that the text contains."""
    return texts.join(terms, "item_id").where(F.contains(F.lower("text"), F.lower("term"))).groupBy("id", "item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def active_queries(queries: DataFrame, configs: dict[str, tuple[str, ...]] = CONFIGS) -> DataFrame:
    """queries (item_id, id, kind, pole, text) once for each configuration whose tiers stand for their kind, with `config`."""
    kinds = {c: [KINDS[t] for t in tiers] for c, tiers in configs.items()}
    fits = F.filter(F.array(*(F.when(F.col("kind").isin(ks), F.lit(c)) for c, ks in kinds.items())), lambda x: x.isNotNull())
    return queries.select(F.explode(fits).alias("config"), "*")


def query_payload(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(item_id, payload): one JSON document an item.

    poles, bipolar (more than one), n_queries, active_by_config (id:pole of each configuration's
    queries) and the queries themselves; clinical ones name those of `terms` (item_id, term) that they
    contain. An item's queries are a handful.
    """
    if terms is None:
        terms = queries.select("item_id", F.lit(None).cast("string").alias("term")).limit(0)
    known = terms.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    used = F.when(F.col("kind") == "clinical", F.filter(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("text"), F.lower(t))))
    row = F.struct("id", "pole", "kind", "text", used.alias("clinical_terms_used"))
    g = queries.join(known, "item_id", "left").groupBy("item_id").agg(F.sort_array(F.collect_list(row)).alias("q"))
    poles = F.array_sort(F.array_distinct(F.transform("q", lambda x: x["pole"])))

    def ids(tiers: tuple[str, ...]):
        kinds = [KINDS[t] for t in tiers]
        return F.transform(F.filter("q", lambda x: x["kind"].isin(kinds)), lambda x: F.concat(x["id"], F.lit(":"), x["pole"]))

    active = F.struct(*(ids(tiers).alias(c) for c, tiers in CONFIGS.items()))
    body = F.struct(poles.alias("poles"), (F.size(poles) > 1).alias("bipolar"), F.size("q").alias("n_queries"), active.alias("active_by_config"), F.col("q").alias("queries"))
    return g.select("item_id", F.to_json(body).alias("payload"))
