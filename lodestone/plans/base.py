"""The driver's tables as the abstractions of this library: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import sql, table


def _weights(m: int, a: int, b: int, lift: int) -> str:
    """Four made-up class weights that lean to the label."""
    return ", ".join(f"CAST(1 + (o_orderkey * {a + c} + v * {b + c}) % {m + c} + CASE WHEN (o_orderkey * 7 + v) % 4 = {c} THEN {lift} ELSE 0 END AS DOUBLE) AS {'ab'[m > 7]}{c}" for c in range(4))


def _preds(also: str = "") -> str:
    return f"""
SELECT {also}participant_id, item_id, fold, label, status, difficult_frac, self_score,
  a0 / (a0 + a1 + a2 + a3) AS l0, a1 / (a0 + a1 + a2 + a3) AS l1, a2 / (a0 + a1 + a2 + a3) AS l2, a3 / (a0 + a1 + a2 + a3) AS l3,
  b0 / (b0 + b1 + b2 + b3) AS e0, b1 / (b0 + b1 + b2 + b3) AS e1, b2 / (b0 + b1 + b2 + b3) AS e2, b3 / (b0 + b1 + b2 + b3) AS e3,
  CASE WHEN a0 >= a1 AND a0 >= a2 AND a0 >= a3 THEN 0 WHEN a1 >= a2 AND a1 >= a3 THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END AS llm_pred,
  CASE WHEN b0 >= b1 AND b0 >= b2 AND b0 >= b3 THEN 0 WHEN b1 >= b2 AND b1 >= b3 THEN 1 WHEN b2 >= b3 THEN 2 ELSE 3 END AS encoder_pred
FROM (
  SELECT {also}participant_id, item_id, CAST(participant_id % 5 + 1 AS INT) AS fold,
    CAST((o_orderkey * 7 + v) % 4 AS INT) AS label,
    CASE (o_orderkey * 5 + v) % 7 WHEN 0 THEN 'supports' WHEN 1 THEN 'supports' WHEN 2 THEN 'against' WHEN 3 THEN 'ambiguous' ELSE 'none' END AS status,
    CAST((o_orderkey * 11 + v) % 10 AS DOUBLE) / 10 AS difficult_frac, CAST((o_orderkey * 3 + v) % 5 - 1 AS INT) AS self_score,
    {_weights(7, 3, 1, 5)}, {_weights(11, 5, 2, 7)}
  FROM (
    SELECT {also}o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(floor(o_orderkey / 8) AS BIGINT) AS participant_id, CAST(o_orderkey % 8 + 1 AS INT) AS item_id
    FROM orders
  ) AS numbered
) AS weighed
"""


#: Rated items, every order one: eight orders in turn are a participant's; two models' probabilities, an evidence status, a share of difficult votes.
PREDS = _preds()

#: Turns of conversations with made-up times: ten seconds each, and now and then a long pause.
TURNS = """
SELECT CAST(conv_id AS STRING) AS participant_id, CAST(turn AS INT) AS pos, role AS speaker, text,
  CAST(10 * turn + CASE WHEN turn >= 3 THEN 90 ELSE 0 END AS DOUBLE) AS start_time,
  CAST(10 * turn + 5 + CASE WHEN turn >= 3 THEN 90 ELSE 0 END AS DOUBLE) AS end_time
FROM conversations
"""

#: Documents as the utterances of their source.
UTTERANCES = "SELECT source AS participant_id, CAST(doc_id AS STRING) AS doc_id, doc_id AS pos, text FROM documents"

#: Documents that have an embedding, with it.
DOC_VECTORS = """
SELECT source AS participant_id, CAST(doc_id AS STRING) AS doc_id, doc_id AS pos, embedding FROM documents JOIN embeddings ON doc_id = vec_id
"""

#: Eight queries: frequent words of the corpus.
ITEMS = """
SELECT * FROM (VALUES (1, 'the and with of that'), (2, 'tion ing ation'), (3, 'de la que'), (4, 'und der die'), (5, 'license terms the the'), (6, 'zebra'), (7, 'that is not'), (8, 'een ment los'))
AS q(item_id, glossary)
"""

#: Parts as terms, twelve an item, in three tiers with an audit's decisions; some have a cue of an indirect relation, some are frequent words.
TERMS = """
SELECT CAST(floor(p_partkey / 12) AS INT) + 1 AS item_id, CASE p_size % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'lay' ELSE 'clinical' END AS tier, CAST(p_partkey % 12 + 10 AS INT) AS pos,
  CASE p_partkey % 11 WHEN 0 THEN p_name || ', stay in bed all day' WHEN 1 THEN 'Gave up on ' || p_name WHEN 2 THEN 'the' WHEN 3 THEN 'os' WHEN 4 THEN 'tion and the' ELSE p_name END AS term,
  CASE WHEN p_size % 5 = 0 THEN 'remove' ELSE 'keep' END AS decision, CASE WHEN p_partkey % 7 = 0 THEN 'related_nonspecific' ELSE 'direct' END AS relation
FROM part
"""

#: What the items of TERMS are about, a row a part.
GLOSSARIES = "SELECT CAST(floor(p_partkey / 12) AS INT) + 1 AS item_id, p_name || ' and the ' || p_type AS glossary FROM part"

#: Judgments of ranked windows under configurations, made from line items.
JUDGED = """
SELECT CAST(l_suppkey AS BIGINT) AS participant_id, CAST(l_partkey % 8 + 1 AS INT) AS item_id,
  CASE l_orderkey % 3 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' ELSE 'L3' END AS config, CASE CAST(floor(l_extendedprice) AS BIGINT) % 2 WHEN 0 THEN 'bm25' ELSE 'semantic' END AS retriever,
  CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'top3' WHEN 1 THEN 'top5' ELSE 'budget' END AS prefix,
  CASE (l_orderkey * 3 + l_partkey) % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'against' WHEN 2 THEN 'ambiguous' WHEN 5 THEN NULL ELSE 'none' END AS status,
  CAST((l_orderkey + l_partkey) % 4 AS INT) AS severity_hint, CAST(l_quantity / 50 AS DOUBLE) AS agreement, l_orderkey AS window_no, CAST(l_linenumber AS INT) AS rank
FROM lineitem
"""

#: Sentences asked for the items of TERMS, of three kinds; every fourth item has two poles.
ASKED = """
SELECT CAST(floor(p_partkey / 12) AS INT) + 1 AS item_id, 'Q' || CAST(p_partkey % 12 + 10 AS STRING) AS id, CASE p_partkey % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'lay' ELSE 'clinical' END AS kind,
  CASE WHEN CAST(floor(p_partkey / 12) AS INT) % 4 <> 0 THEN 'default' WHEN p_partkey % 12 < 6 THEN 'more' ELSE 'less' END AS pole, 'The person speaks of ' || p_name || ' and the os.' AS text
FROM part
"""

BASES = {"preds": PREDS, "turns": TURNS, "utterances": UTTERANCES, "doc_vectors": DOC_VECTORS, "items": ITEMS, "terms": TERMS, "glossaries": GLOSSARIES, "judged": JUDGED, "asked_of": ASKED}


def base(spark: SparkSession, folder: str, name: str, placed: bool = False) -> DataFrame:
    """The base `name`; placed (preds only) adds `place`, which orders rows as their table's files hold them."""
    if placed:
        orders = table(spark, folder, "orders").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("place"))
        df = spark.sql(_preds("place, ").replace("FROM orders", "FROM {orders}"), orders=orders)
    else:
        df = sql(spark, folder, BASES[name])
    if name == "preds":
        df = df.withColumns({"llm": F.array("l0", "l1", "l2", "l3"), "encoder": F.array("e0", "e1", "e2", "e3")})
    return df


def with_bases(text: str) -> str:
    """SQL with the bases it names in front, for DuckDB."""
    import re

    used = [n for n in BASES if re.search(rf"\b{n}\b", text)]
    ctes = ", ".join(f"{n} AS ({BASES[n].strip()})" for n in used)
    body = text.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
