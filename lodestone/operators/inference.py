"""Resampling over clusters. Draws are hashes, so any engine gives the same ones."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.metrics import CLASSES, item_metrics, position_kappa
from lodestone.operators.ordering import running
from lodestone.sources.scratch import cut


def draw(seed: int, replicate: Column, place: Column, n: Column) -> Column:
    """A number in 0..n-1 from the MD5 of seed, replicate and place."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


#: The constants and turns of MD5 (RFC 1321), and the digits of 0000 to 9999.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
DIGITS = np.array([list(b"%04d" % i) for i in range(10_000)], np.uint32)


def md5_starts(head: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of head and each row of ASCII digits, all rows at once; up to 55 bytes, one block of MD5.

    As hashlib gives them (tests compare); of the 64 steps the last three don't reach these bits.
    """
    size = len(head) + digits.shape[1]
    if size > 55:
        raise ValueError("more than one block")
    block = head + bytes(digits.shape[1]) + b"\x80"
    words: list = np.frombuffer(block + bytes(56 - len(block)) + (8 * size).to_bytes(8, "little"), "<u4").tolist()
    for k in range(digits.shape[1]):
        at = len(head) + k
        words[at // 4] = words[at // 4] + (digits[:, k] << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.full(len(digits), x, np.uint32) for x in START)
    for i in range(61):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((SINES[i] + words[g]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(SINES[i])
        turn = TURNS[i // 16][i % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    b += np.uint32(START[0])
    return b.byteswap()


def counted_draws(seed: int, replicate: int, n: int) -> np.ndarray:
    """How often a replicate draws each of n places: draw() for all places at once."""
    head, counts, drawn = f"{seed}:{replicate}:".encode(), np.zeros(n, np.int64), []
    for high in range(-(-n // 10_000)):
        some = min(n - 10_000 * high, 10_000)
        if high:
            drawn.append(md5_starts(head + str(high).encode(), DIGITS[:some]) % np.uint32(n))
        else:
            for width in range(1, 5):  # numbers below 10,000 have no zeros in front
                those = DIGITS[10 ** (width - 1) if width > 1 else 0 : min(10**width, some), 4 - width :]
                drawn.append(md5_starts(head, those) % np.uint32(n))
        if len(drawn) > 400:
            counts, drawn = counts + np.bincount(np.concatenate(drawn), minlength=n), []
    return counts + np.bincount(np.concatenate(drawn), minlength=n) if drawn else counts


#: Places a block, for sums over clusters and for draws as rows: all replicates' counts of a block are one group.
PLACES, ROWS = 16384, 2048


def _counts(spark: SparkSession, n: int, replicates: int, seed: int, size: int) -> DataFrame:
    """(replicate, block, counts): how often each replicate draws each place, a row for `size` places, a byte a place where that does, compressed.

    Replicates are dealt out; a task holds some 12 bytes a cluster, and what is shuffled is about half a byte a draw.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for replicate in b["id"].tolist():
                counts = counted_draws(seed, replicate, n)
                wide = 1 if counts.max() < 256 else 4
                counts = counts.astype(f"<u{wide}")
                rows = [zlib.compress(counts[at : at + size].tobytes(), 1) for at in range(0, n, size)]
                yield pd.DataFrame({"replicate": replicate, "block": np.arange(len(rows)), "wide": wide, "counts": rows})

    if n > 1 << 32:
        raise ValueError("draws have 32 bits")
    parts = min(replicates, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, replicates if n else 0, 1, max(parts, 1)).mapInPandas(run, "replicate long, block long, wide int, counts binary")


def _met(clusters: DataFrame, key: str, fold: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, replicates: int, seed: int, size: int | None = None) -> DataFrame:
    """fold(clusters of a block, replicates, counts[replicate, cluster]) over blocks of clusters, which have a row a key.

    clusters are a table written before. Places are the order of a numeric key, from running counts
    over its ranges. Clusters and counts meet by block, so neither goes through the driver or is whole
    in a task, and no draw is a row.
    """
    size = size or PLACES
    placed = running(clusters.withColumn("_one", F.lit(1).cast("long")), key, {"place": "_one"})
    placed = cut(placed.select(*clusters.columns, (F.col("place") - 1).alias("_place"), F.expr(f"(place - 1) div {size}").alias("block")))

    def run(some: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(drawn):
            return fold(some, np.zeros(0, np.int64), np.zeros((0, len(some))))
        at, out = some["_place"].to_numpy(np.int64) % size, []
        for i in range(0, len(drawn), CHUNK):
            part = drawn.iloc[i : i + CHUNK]
            counts = np.stack([np.frombuffer(zlib.decompress(x), f"<u{wide}")[at] for x, wide in zip(part["counts"], part["wide"])])
            out.append(fold(some, part["replicate"].to_numpy(np.int64), counts))
        return pd.concat(out, ignore_index=True)

    drawn = _counts(clusters.sparkSession, clusters.count(), replicates, seed, size)
    return placed.groupBy("block").cogroup(drawn.groupBy("block")).applyInPandas(run, schema)


def draws(clusters: DataFrame, key: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(replicate, key, weight): how often each replicate draws each cluster, with replacement, as many as there are."""

    def rows(some: pd.DataFrame, ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(counts)
        return pd.DataFrame({"replicate": ids[r], key: some[key].to_numpy()[c], "weight": counts[r, c].astype(np.int64)})

    kind = clusters.schema[key].dataType.simpleString()
    return _met(cut(clusters.select(key).distinct()), key, rows, f"replicate long, `{key}` {kind}, weight long", replicates, seed, ROWS)


def draw_sums(clusters: DataFrame, key: str, names: list[str], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(replicate, clusters, draws, *names): what draws() come to a replicate: different clusters, draws, and the sums of whole numbers over draws.

    A key has one value of each of `names`; nulls add nothing. A block of clusters is summed where its
    counts are, so a row is a block and a replicate, never a draw, and no cluster goes through the driver.
    """

    def sums(some: pd.DataFrame, ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        whole = counts.astype(np.int64)
        total = whole @ some[names].fillna(0).to_numpy(np.int64)
        return pd.DataFrame({"replicate": ids, "clusters": np.count_nonzero(whole, axis=1), "draws": whole.sum(1), **{n: total[:, i] for i, n in enumerate(names)}})

    schema = ", ".join(f"`{n}` long" for n in ("replicate", "clusters", "draws", *names))
    found = _met(cut(clusters.select(key, *names).distinct()), key, sums, schema, replicates, seed)
    return found.groupBy("replicate").agg(*(F.sum(n).alias(n) for n in ("clusters", "draws", *names)))


#: Up to so many bytes of clusters' numbers go to every executor; beyond, they meet the draws in blocks.
SENT_BYTES = 64 << 20
#: Replicates whose draws are multiplied at once with numbers that were sent.
TOGETHER = 4


def _replicated(vectors: DataFrame, key: str, names: list[str], replicates: int, seed: int) -> DataFrame:
    """A row a cluster with numbers `names` (a table written before) -> a row a replicate with their sums over its draws.

    Where the clusters' numbers are counted to fit, a task makes a replicate's counts and multiplies;
    else each block of clusters is multiplied with all replicates' counts of it.
    """
    schema = "replicate long, " + ", ".join(f"`{n}` long" for n in names)
    if vectors.count() * (len(names) + 1) * 8 <= SENT_BYTES:
        spark = vectors.sparkSession
        cells = vectors.select(key, *names).toPandas().sort_values(key)[names].to_numpy(float)  # places are the order of keys; whole numbers below 2^53
        sent = spark.sparkContext.broadcast(cells)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = sent.value
            for b in batches:
                ids = b["id"].to_numpy(np.int64)
                for at in range(0, len(ids), TOGETHER):
                    some = ids[at : at + TOGETHER]
                    total = np.stack([counted_draws(seed, r, len(cells)) for r in some.tolist()]).astype(float) @ cells
                    yield pd.DataFrame({"replicate": some, **{n: total[:, i].astype(np.int64) for i, n in enumerate(names)}})

        parts = min(replicates, 4 * spark.sparkContext.defaultParallelism)
        return spark.range(0, replicates if len(cells) else 0, 1, max(parts, 1)).mapInPandas(run, schema)

    def sums(some: pd.DataFrame, ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        total = counts.astype(np.float64) @ some[names].to_numpy(np.float64)  # whole numbers below 2^53
        return pd.DataFrame({"replicate": ids, **{n: total[:, i].astype(np.int64) for i, n in enumerate(names)}})

    return _met(vectors, key, sums, schema, replicates, seed).groupBy("replicate").agg(*(F.sum(n).alias(n) for n in names))


#: A prime below 2^31: squares of remainders fit 64 bits in any engine.
PRIME = 2147483647
#: P(X <= 0), P(X <= 1), ... of a Poisson distribution of mean 1; beyond lies less than 1 / PRIME.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
#: Replicates that are weighed at a time.
CHUNK = 256


def poisson_weights(points: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """[replicate, cluster]: how often a replicate counts a cluster, Poisson of mean 1, from remainders that square and add.

    A cluster's point is point(); any engine with 64-bit integers gives the same numbers.
    """
    a = (points.astype(np.int64) + seed * 48271) % PRIME
    r = replicates.astype(np.int64)[:, None]
    x = (a * a + r * 69621 + 1) % PRIME
    x = (x * x + a) % PRIME
    x = (x * x + r) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, side="right")


def point(key: Column) -> Column:
    """A cluster's number below PRIME: its first 32 bits of MD5, as a remainder."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % PRIME


def _weighted(vectors: DataFrame, key: str, names: list[str], replicates: int, seed: int) -> DataFrame:
    """As _replicated(), but by poisson_weights(): a cluster's weights are made beside its row.

    A task holds replicates x names sums, whatever the number of clusters, and these rows are all that
    is shuffled: no draw is ever a row. Replicates differ in size, by about the root of the number of clusters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((replicates, len(names))), False
        for b in batches:
            cells, points, seen = b[names].to_numpy(float), b["_point"].to_numpy(), True
            for at in range(0, replicates, CHUNK):
                some = np.arange(at, min(at + CHUNK, replicates))
                total[some] += poisson_weights(points, some, seed) @ cells
        if seen:
            yield pd.DataFrame({"replicate": np.arange(replicates), **{n: total[:, i] for i, n in enumerate(names)}})

    schema = "replicate long, " + ", ".join(f"`{n}` double" for n in names)
    summed = vectors.select(point(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_point"), *names).mapInPandas(run, schema)
    return summed.groupBy("replicate").agg(*(F.sum(n).cast("long").alias(n) for n in names))


def replicate_metrics(df: DataFrame, key: str, preds: list[str], replicates: int = 2000, seed: int = 42, classes: int = CLASSES, resampling: str = "draws") -> DataFrame:
    """(replicate, run, metrics...): every run under the same draws.

    Rows become confusion cells of a cluster first, side by side in one row; a replicate is the sum of
    the rows it draws. A run is a prediction column; rows without one of the predictions are left out
    of all runs. resampling: `draws` takes as many clusters as there are, with replacement, and makes
    replicates x clusters draws; `poisson` gives each cluster a Poisson weight of its own and makes none,
    which is the way for many clusters.
    """
    if resampling not in ("draws", "poisson"):
        raise ValueError("resampling must be draws or poisson")
    # no filter: Spark would move it below the projections and make the predictions anew for it
    whole = reduce(and_, (F.nanvl(F.col(p).cast("double"), F.lit(None)).isNotNull() for p in preds))
    grid = {f"{run}_{y}_{p}": (run, y, p) for run in preds for y in range(classes) for p in range(classes)}
    counted = df.groupBy(key).agg(F.count_if(whole).alias("_rows"), *(F.count_if(whole & (F.col("label") == y) & (F.col(run) == p)).alias(n) for n, (run, y, p) in grid.items()))
    vectors = cut(counted.where("_rows > 0").drop("_rows"))
    summed = (_replicated if resampling == "draws" else _weighted)(vectors, key, list(grid), replicates, seed)
    cell = F.explode(F.array(*(F.struct(F.lit(run).alias("run"), F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(n).alias("n")) for n, (run, y, p) in grid.items())))
    return item_metrics(summed.select("replicate", cell.alias("c")).select("replicate", "c.*").where("n > 0"), ["replicate", "run"], classes)


def replicate_totals(df: DataFrame, key: str, preds: list[str], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(replicate, run, total_qwk): kappa of participants' totals, a total counting by its place among those a replicate has.

    Rows without one of the predictions are left out of all runs.
    """
    whole = df.dropna(subset=[*preds])
    totals = cut(whole.groupBy(key).agg(F.sum("label").alias("true_total"), *(F.sum(p).alias(p) for p in preds)))

    def pairs(some: pd.DataFrame, ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """A block's counts of each pair of totals, for each run; clusters without a label are in none."""
        live, out = some["true_total"].notna().to_numpy(), []
        counts = counts[:, live].astype(np.float64)
        for p in preds:
            both, code = np.unique(some.loc[live, ["true_total", p]].to_numpy(np.int64), axis=0, return_inverse=True)
            n = np.array([np.bincount(code.ravel(), row, len(both)) for row in counts]).reshape(len(ids), len(both))
            r, c = np.nonzero(n)
            out.append(pd.DataFrame({"replicate": ids[r], "run": p, "true_total": both[c, 0], "pred_total": both[c, 1], "n": n[r, c].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)

    met = _met(totals, key, pairs, "replicate long, run string, true_total long, pred_total long, n long", replicates, seed)
    long = met.groupBy("replicate", "run", "true_total", "pred_total").agg(F.sum("n").alias("n"))
    return position_kappa(long, ["replicate", "run"], weight="n")


def intervals(reps: DataFrame, metrics: list[str], by: list[str] = ["run"]) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of each metric over replicates."""
    long = reps.unpivot(["replicate", *by], metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("ci_lo"), F.percentile("value", 0.975).alias("ci_hi"))


def paired_deltas(reps: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """b - a a replicate -> median, interval, share above 0, whether the interval leaves 0 out; replicates without a value drop out."""
    long = reps.unpivot(["replicate", "run"], metrics, "metric", "value")
    d = long.groupBy("replicate", "metric").agg((F.max(F.when(F.col("run") == b, F.col("value"))) - F.max(F.when(F.col("run") == a, F.col("value")))).alias("d")).where("d IS NOT NULL")
    out = d.groupBy("metric").agg(F.percentile("d", 0.5).alias("median"), F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("ci_lo"), F.percentile("d", 0.975).alias("ci_hi"), F.avg((F.col("d") > 0).cast("double")).alias("p_above"))
    return out.withColumn("excludes_0", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def paired_t(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    """Mean difference, its t statistic (null for fewer than two pairs or no spread), and wins of b."""
    d = F.col(b) - F.col(a)
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.when(F.stddev_samp(d) > 0, F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), F.count_if(d > 0).alias("wins"))
