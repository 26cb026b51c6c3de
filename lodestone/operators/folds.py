"""Whole groups into folds of even class shares, by a greedy rule over kinds of groups.

Groups with equal class counts are one kind, and what is decided one by one is a kind's copies, not
groups: as soon as k picks in a row have gone to k different folds, the folds differ as they did
before them, so all further picks repeat that round and are counted at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.sequences import hash_order
from lodestone.sources.scratch import cut

#: The largest table of kinds that comes to the driver; counts get coarser until there are no more.
KINDS = 50_000


def deal(vector: list[float], copies: int, folds: list[list[float]], totals: list[float]) -> list[int]:
    """How many of `copies` equal groups each fold gets; folds (class counts, then groups) are changed.

    A copy goes where its classes are scarcest: to the fold with the least sum of n_c * v_c / total_c²,
    which adds least to the squared deviations of class shares. Ties go to the fold with fewer rows,
    then fewer groups, then the first.
    """
    k, given, round_ = len(folds), [0] * len(folds), []

    def put(f: int, n: int) -> None:
        given[f] += n
        for c, v in enumerate(vector):
            folds[f][c] += n * v
        folds[f][-1] += n

    left = copies
    while left:
        load = []
        for f, has in enumerate(folds):
            s = 0.0
            for n, v, t in zip(has, vector, totals):
                if t:
                    s += n * v / (t * t)
            load.append((s, sum(has[:-1]), has[-1], f))
        best = min(load)[-1]
        put(best, 1)
        left -= 1
        round_ = [*round_[-k + 1 :], best] if k > 1 else [best]
        if len(set(round_)) == k and left >= k:
            for f in range(k):
                put(f, left // k)
            left %= k
    return given


def coarse(count: Column, bits: int) -> Column:
    """A count with all but its leading `bits` binary digits cleared."""
    shift = F.greatest(F.length(F.bin(count)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", count, shift), shift)


def _kinds(counts: DataFrame, names: list[str], limit: int) -> tuple[DataFrame, list]:
    """counts with `kind`, and the kinds' rows: the finest grain of counts that has at most `limit` of them."""
    largest = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    grains = [F.array(*names), *(F.array(*(coarse(F.col(n), b) for n in names)) for b in (6, 4, 3, 2, 1))]
    grains.append(F.array(F.length(F.bin(largest)).cast("long"), F.array_position(F.array(*names), largest)))  # at most 64 sizes of the largest class
    for grain in grains:
        marked = counts.withColumn("kind", grain)
        kinds = marked.groupBy("kind").agg(F.count("*").alias("copies"), *(F.sum(n).alias(n) for n in names))
        found = kinds.limit(limit + 1).collect()
        if len(found) <= limit:
            return marked, found
    raise ValueError(f"limit must allow {64 * len(names)} kinds")


def balanced_group_folds(df: DataFrame, group: str, k: int = 5, classes: int = 4, label: str = "label", seed: str = "42", limit: int = KINDS) -> DataFrame:
    """(group, fold) with fold in 1..k: folds that differ as little as the greedy rule can make them in their shares of every class.

    Kinds are dealt by falling spread of their class counts, then by the counts (see deal()). Within a
    kind groups go by hash, the first ones to the first fold. Labels outside 0..classes-1 don't count; a
    group without any counts as a group of no rows; a null group is a group; an empty table gives no rows.
    Only kinds come to the driver, at most `limit`: where more differ, their counts are taken coarser.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    names = [f"_{c}" for c in range(classes)]
    counts = cut(df.groupBy(group).agg(*(F.count_if(F.col(label) == c).alias(n) for c, n in enumerate(names))))
    marked, found = _kinds(counts, names, limit)
    vectors = [([r[n] / r.copies if r[n] % r.copies else r[n] // r.copies for n in names], r.copies, r.kind) for r in found]
    totals = [sum(r[n] for r in found) for n in names]
    folds = [[0] * classes + [0] for _ in range(k)]
    rows = []
    for vector, copies, kind in sorted(vectors, key=lambda x: (min(x[0]) - max(x[0]), x[0], x[2])):
        given, ends = deal(vector, copies, folds, totals), []
        for n in given:
            ends.append((ends[-1] if ends else 0) + n)
        rows.append((kind, ends))
    dealt = df.sparkSession.createDataFrame(rows, "kind array<bigint>, ends array<bigint>")
    marked = marked.withColumn("_h", hash_order(seed, group)).withColumn("_part", F.substring("_h", 1, 3))
    # a kind may hold most groups: its order is that of 4096 parts, numbered each by itself
    own = F.row_number().over(Window.partitionBy("kind", "_part").orderBy("_h", group))
    before = Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("kind", "_part").agg(F.count("*").alias("_n")).select("kind", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = marked.select(group, "kind", "_part", own.alias("_own")).join(starts, ["kind", "_part"]).join(F.broadcast(dealt), "kind")
    return placed.select(group, (F.size(F.filter("ends", lambda e: e < F.col("_start") + F.col("_own"))) + 1).alias("fold"))


def fold_shares(df: DataFrame, classes: int = 4, label: str = "label") -> DataFrame:
    """(label, spread): how far the folds' shares of each class differ, as a population deviation; df has a fold."""
    n = df.where(F.col(label).between(0, classes - 1)).groupBy(label, "fold").agg(F.count("*").alias("n"))
    folds, labels = df.select("fold").distinct(), df.where(F.col(label).between(0, classes - 1)).select(label).distinct()
    whole = labels.join(F.broadcast(folds)).join(n, [label, "fold"], "left").fillna(0, ["n"])  # a row a class and fold
    share = F.col("n") / F.sum("n").over(Window.partitionBy(label))
    return whole.select(label, share.alias("s")).groupBy(label).agg(F.stddev_pop("s").alias("spread"))
