"""Column functions on arrays: overlaps, greedy choice, decisions over probability vectors. No UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """|a and b| over the smaller size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def choose_diverse(candidates: Column, k: int, most: float = 0.5) -> Column:
    """The first k of a ranked list of structs with `turn_ids` whose overlap with those chosen before is at most `most`.

    If fewer than k pass, the list is filled up with what was skipped, in order; so its scores need
    not fall. One pass over a list of bounded length; no shuffle.
    """
    none = F.filter(candidates, lambda _: F.lit(False))
    start = F.struct(none.alias("taken"), none.alias("skipped"))

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc["taken"], lambda t: overlap(t["turn_ids"], x["turn_ids"]) > most)
        take = (F.size(acc["taken"]) < k) & ~near
        return F.struct(
            F.when(take, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"),
            F.when(take, acc["skipped"]).otherwise(F.concat(acc["skipped"], F.array(x))).alias("skipped"),
        )

    return F.aggregate(candidates, start, step, lambda acc: F.slice(F.concat(acc["taken"], acc["skipped"]), 1, k))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def argmax(p: Column) -> Column:
    """Place of the largest value from 0; the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def renormalised(p: Column) -> Column:
    total = lambda v: F.greatest(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    return bound(p, lambda v: bound(total(v), lambda t: F.transform(v, lambda x: x / t)))


def ranked_classes(p: Column) -> Column:
    """Classes by falling probability; the lower class first among equals."""
    return F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("c")))), lambda s: s["c"])


def top_two(p: Column) -> Column:
    """The two likeliest classes; of equal ones the higher class first."""
    return F.slice(F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("n"), (-i).alias("c")))), lambda s: -s["c"]), 1, 2)


def expected_class(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def ordinal_decode(p: Column, top: int = 3) -> Column:
    """The expected class rounded half to even, within 0..top."""
    return F.greatest(F.least(F.rint(expected_class(p)), F.lit(float(top))), F.lit(0.0)).cast("int")


def blend(a: Column, b: Column, weight: Column) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def tempered(p: Column, temperature: Column, least: float = 1e-9) -> Column:
    """softmax(log p / temperature)."""
    logs = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(least))) / temperature)
    return bound(logs, lambda all_: bound(F.array_max(all_), lambda top: bound(F.transform(all_, lambda x: F.exp(x - top)), renormalised)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: as an expression inside a lambda it would be made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def conditional_chain(logits: Column) -> Column:
    """Class probabilities of a chain of conditional logits: P(y > k) is the product of the first k + 1 sigmoids."""
    tails = F.aggregate(
        logits,
        F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("all")),
        lambda acc, z: F.struct((acc["p"] / (1 + F.exp(-z))).alias("p"), F.concat(acc["all"], F.array(acc["p"] / (1 + F.exp(-z)))).alias("all")),
        lambda acc: acc["all"],
    )
    return F.zip_with(tails, F.concat(F.slice(tails, 2, F.size(tails)), F.array(F.lit(0.0))), lambda a, b: a - b)


def chain_prediction(logits: Column) -> Column:
    """How many of the chain's cumulative probabilities are over one half."""
    tails = F.aggregate(
        logits,
        F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("n")),
        lambda acc, z: F.struct((acc["p"] / (1 + F.exp(-z))).alias("p"), (acc["n"] + F.when(acc["p"] / (1 + F.exp(-z)) > 0.5, 1).otherwise(0)).alias("n")),
    )
    return tails["n"]


def padded(a: Column, n: int, fill: Column) -> Column:
    """The first n values, filled up to n."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def range_of(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are not above value, by binary search; 0 for a null."""
    if not bounds:
        return F.lit(0)
    kind = "bigint" if all(isinstance(b, int) for b in bounds) else "double"
    every = F.split(F.lit(",".join(map(repr, bounds))), ",").cast(f"array<{kind}>")  # a constant
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(every, at + step - 1) <= value, at + step).otherwise(at))


def mean_pool(vectors: Column, mask: Column, size: int) -> Column:
    """The mean of those token vectors that the mask has, scaled to length 1; null if there is none."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, unit(F.transform(total, lambda x: x / F.size(kept))))
