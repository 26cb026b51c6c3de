"""SpotSigs: spot signatures that localise a text by its common words.

A signature is a chain of content words that follows an anchor, an anchor being a common word. A
text's fingerprint is its set of signatures, told apart by a digest of the set; likeness is the
Jaccard similarity of two sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import range_of
from lodestone.llm.common import cut

#: Common words of the languages served; each is an anchor, and no anchor is content.
ANCHORS = """
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which
you were her all she there would their we him been has when who will no more if out so a i
le la les de des du et un une en que qui dans pour pas sur au par est ce il elle se ne plus avec son sa ou aux
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei nach
el los las y del se un una por con no su al lo como para más pero sus o este ya ha
""".split()
ANCHORS = sorted(set(ANCHORS))
#: Content words in a chain.
CHAIN = 2


def _after(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def signatures(docs: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """docs with column `out`: the sorted set of the text's signatures, 32-bit hashes; none for an empty text.

    Words are the lower-cased runs of letters and digits. A content word right behind an anchor
    starts a chain: the anchor, the word and the next content words, as far as there are any. In a
    text without a chain every content word starts one; a text without words has one signature, the
    whole of it. Every step is a projection of its own, so that no list is made twice; all of it
    stays within a row.
    """
    w, c, h = f"_{out}_w", f"_{out}_c", f"_{out}_h"
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn(w, F.filter(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))
    before = F.concat(F.array(F.lit("")), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))))
    # a content word behind an anchor carries it in front, with a mark between; anchors go
    marked = F.zip_with(before, F.col(w), lambda p, x: F.when(x.isin(ANCHORS), None).when(p.isin(ANCHORS), F.concat(p, F.lit("\x01"), x)).otherwise(x))
    d = d.withColumn(c, F.when(F.size(w) > 0, F.filter(marked, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))
    d = d.withColumn(h, F.transform(c, lambda x: F.hash(F.when(x.contains("\x01"), F.substring_index(x, "\x01", -1)).otherwise(x))))

    def chains(starts: Column) -> Column:
        for by in range(1, chain):
            starts = F.zip_with(starts, _after(F.col(h), by), lambda a, b: F.when(a.isNotNull(), F.hash(a, b)))
        return F.filter(starts, lambda x: x.isNotNull())

    d = d.withColumn(out, chains(F.transform(c, lambda x: F.when(x.contains("\x01"), F.hash(x)))))
    rest = F.when(F.size(h) > 0, chains(F.col(h))).when(F.length(t) > 0, F.array(F.hash(t))).otherwise(F.array().cast("array<int>"))
    return d.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(rest)).withColumn(out, F.sort_array(F.array_distinct(out))).drop(w, c, h)


def digest(sigs: str) -> Column:
    """The fingerprint's name: 32 hex digits of the set; equal sets have equal names."""
    return F.md5(F.array_join(F.col(sigs).cast("array<string>"), " "))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) with sigs, next_text and next_sigs of the row that follows in descending doc_id.

    After the last row comes the first. Equal ids are ordered by a hash of the text; null ids come
    last. Rows are dealt by ranges of ids (`ranges` numbers, by default twice the shuffle partitions)
    whose bounds are percentiles of a sample of some hundred ids a range, chosen by hash; the sample
    only says how even ranges are. Within a range the next row is the next row, and the first row of
    the next range is dealt to both. What is broadcast has an id and a hash a range.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(ids.count() // (100 * ranges) + 1)) == 0)
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(some.select(F.percentile_approx("doc_id", cuts, 20 * ranges).alias("b")).first().b or [])) if cuts else []
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), range_of(bounds, F.col("doc_id")).alias("range"))

    firsts = base.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("top"))  # nulls are least
    ring = Window.partitionBy(F.lit(0)).orderBy("range")  # one row a range, what follows the first range is the last
    before = F.coalesce(F.lead("range").over(ring), F.min("range").over(Window.partitionBy(F.lit(0))))
    ring = cut(firsts.select(F.col("top.doc_id").alias("d"), F.col("top.h").alias("k"), before.alias("before")))
    met = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    own = F.struct("range", F.lit(False).alias("lent"))
    lent = F.struct(F.col("before").alias("range"), F.lit(True).alias("lent"))
    dealt = base.join(F.broadcast(ring), met, "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, lent))))

    rows = signatures(dealt.select("doc_id", "text", "h", "to.range", "to.lent").repartition("range"), "text", "sigs")
    by = Window.partitionBy("range").orderBy("lent", F.desc_nulls_last("doc_id"), F.desc("h"))
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("next_text", F.lead(text).over(by)).withColumn("next_sigs", F.lead("sigs").over(by))
    return rows.where(~F.col("lent")).select("doc_id", text.alias("text"), "sigs", "next_text", "next_sigs")


def edit_probe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the
    next document, or all of it. Null texts are empty; repeated rows stay and follow each other;
    other columns are ignored; an empty table gives no rows.
    """
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    d = d.select("doc_id", "n_chars", "sigs", "next_sigs", F.concat(kept, F.substring("next_text", F.lit(1), third)).alias("edited"))
    d = signatures(d, "edited", "edited_sigs")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("sigs").alias("fingerprint"), digest("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs a < b of representatives with different signature sets at least `threshold` alike.

    Rows with equal sets are one representative, their smallest doc_id. Two sets that are alike
    enough differ in size by at most the factor `threshold`, so sizes are cut into partitions of that
    ratio and a set meets its own partition and the next. There it is looked up by its rarest
    signatures only: two sets that share `threshold` of their union share one among the first
    size - ceil(threshold * size) + 1 in order of rarity. Pairs whose sizes can't reach the threshold
    are dropped before sets are compared. Texts without words take no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    sets = signatures(docs.select("doc_id", "text"), "text", "sigs").where("size(sigs) > 0")
    reps = cut(sets.groupBy(digest("sigs").alias("name")).agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs")).select("id", "sigs", F.size("sigs").alias("n")))
    each = reps.select("id", "n", F.explode("sigs").alias("sig"))
    df = each.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    rare = each.join(df, "sig").withColumn("r", F.row_number().over(order)).where(F.col("r") <= prefix)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold) if threshold < 1 else 1.0)).cast("int")
    rare = rare.select("id", "n", "sig", part.alias("part"))
    left = rare.select(F.col("id").alias("x"), F.col("n").alias("nx"), "sig", "part")
    right = rare.select(F.col("id").alias("y"), F.col("n").alias("ny"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    # the smaller set is x; of equal sizes the smaller id, and equal partitions meet once
    meets = left.join(right, ["sig", "part"]).where((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    pairs = meets.where(F.col("nx") >= F.lit(threshold) * F.col("ny")).select("x", "y").distinct()
    named = pairs.join(reps.select(F.col("id").alias("x"), F.col("sigs").alias("sx")), "x").join(reps.select(F.col("id").alias("y"), F.col("sigs").alias("sy")), "y")
    alike = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), likeness("sx", "sy").alias("likeness"))
    return alike.where(F.col("likeness") >= threshold)
