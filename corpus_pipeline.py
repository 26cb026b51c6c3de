"""Corpus pipeline: quality rules, toxicity, near copies, mixing to target weights, piece encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, pieces, rules, simhash, toxicity
from lodestone.llm.common import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A stage's Python needs no SQL twin: learned models and piece lattices have none.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned list reject, null and empty texts with it.

    Null ids, ties and repeated rows are judged like any other row; an empty table stays empty; other
    columns than those of documents go.
    """
    learned = rules.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = rules.statistics(docs, *(c for c in COLUMNS if c not in ("doc_id", "text")), "text")
    # an explode and no filter: Spark would move a filter below the projections and split every text anew for each rule
    good = F.explode(F.when(~rules.base_failed() & rules.verdict(learned), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select(*COLUMNS, good.alias("_good")).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are toxic with a probability of 0.7 or more.

    Null and empty texts score as such; null ids and repeated rows stay or go like any other row; an
    empty table, or one without labels of both kinds, stays as it is; columns as in quality().
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(COLUMNS), model, threshold=0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies: five words a shingle, similarity 0.8.

    Texts without words, null ones too, are one group; repeated rows leave one; a null id stays only
    if its group has no other; an empty table stays empty; columns as in quality().
    """
    return simhash.drop_near_copies(docs.select(COLUMNS), words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents so that sources' shares go by the root of their sizes; shuffles globally.

    A null source is a source; rows of equal ids, null ones too, get equal counts; texts don't matter;
    an empty table stays empty; columns as in quality().
    """
    return mixing.poisson_mix(docs.select(COLUMNS), power=0.5, epochs=1.0, seed=42).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again; the ids stay with it.

    Null texts are empty ones; null ids and repeated rows stay; an empty table stays empty.
    """
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), nbest=3)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_copies", near_copies), ("mixing", mix), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}-{name}")
    return docs
