"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is the rate at which its source has
to be repeated to reach its target share. The number is the inverse of that distribution at a point
that a hash of seed and doc_id fixes, so a document's repetitions don't depend on where or how often
it is computed. The copies then go into one global order by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Up to so many probabilities in all, eight bytes each, the table of rates goes to every executor.
BROADCAST = 1 << 20


def unit_hash(*parts: Column) -> Column:
    """A number strictly between 0 and 1: the first 52 bits of the parts' MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): shares proportional to n_docs ** power, epochs * all documents in sum.

    power 1 keeps the shares, 0 makes them equal. A null source is a source of its own. One row a
    source, from counts that are summed before the shuffle.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    total = sizes.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.pow("n_docs", F.lit(power))).alias("all_shares"))
    rate = F.pow("n_docs", F.lit(power)) / F.col("all_shares") * F.col("all_docs") * F.lit(epochs) / F.col("n_docs")
    return sizes.join(F.broadcast(total), F.lit(True)).select("source", "n_docs", rate.alias("rate"))  # total has one row


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as a 53-bit number can tell it from 1.

    Terms are carried as logarithms, so large rates don't vanish.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def poisson_mix(docs: DataFrame, rates: DataFrame | None = None, seed: int = 42, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """The columns of docs with `copy` (from 1) and `order_key`, in the global order of order_key.

    rates: (source, rate), by default source_rates(). A source without a rate, or one of 0, leaves no
    copy; null sources match a null source of rates. Rows of equal doc_id get equal counts; a null
    doc_id counts as an empty string in the hash. Columns `copy` and `order_key` of docs are replaced,
    its `_point`, `_source`, `_below` and `_times` dropped; an empty table gives no rows. The table of
    rates is written and its size counted first: below BROADCAST probabilities no text moves until the
    copies do, into their order; a larger one is joined by source, where Spark splits a hot source.
    """
    docs = docs.drop("copy", "order_key", "_point", "_source", "_below", "_times")
    rates = source_rates(docs, power, epochs) if rates is None else rates
    known = cut(rates.where("rate > 0").select(F.col("source").alias("_source"), cumulative(F.col("rate")).alias("_below")))
    if (known.agg(F.sum(F.size("_below"))).first()[0] or 0) <= BROADCAST:
        known = F.broadcast(known)
    point = unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    counted = docs.withColumn("_point", point).join(known, F.col("source").eqNullSafe(F.col("_source")))
    times = F.size(F.filter("_below", lambda c: c <= F.col("_point")))
    copies = counted.withColumn("_times", times).where("_times > 0").drop("_source", "_below", "_point")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 15), 16, 10)
    return copies.withColumn("order_key", key.cast("bigint")).repartitionByRange("order_key").sortWithinPartitions("order_key", "doc_id", "copy")


#: Parameters: power 0.5, one epoch, seed 42.
SQL = """
WITH sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n_docs) / sum(sqrt(n_docs)) OVER () * sum(n_docs) OVER () / n_docs AS rate FROM sizes
),
terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)
),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
lists AS (SELECT source, list(below ORDER BY k) AS below FROM sums GROUP BY source),
points AS (
  SELECT *, (CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS point
  FROM documents
),
times AS (
  SELECT p.*, len(list_filter(l.below, lambda c: c <= p.point)) AS n
  FROM points p JOIN lists l ON p.source IS NOT DISTINCT FROM l.source
),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM times WHERE n > 0)
SELECT *, CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 15) AS BIGINT) AS order_key
FROM copies
"""
