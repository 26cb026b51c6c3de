"""SimHash fingerprints and their near pairs, by traversing pairs of nodes of a binary trie.

A fingerprint is a path of 64 bits in a binary trie. Two subtrees are walked together from a common
root: where both take the same branch no error is spent, where they part one is, and a pair of nodes
that spent more than the budget is dropped with everything below it.

To spread the walk, the trie is read from several starting bits. With a budget of k, of k + 1 blocks
of a fingerprint at least one is equal in both, so each rotation that brings a block to the front
gives subtrees that start with no error; a task walks whole subtrees. A subtree with more than
`crowded` fingerprints is divided in the same way once more by what lies below it, so no task takes a
crowded subtree whole and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_rows
from lodestone.llm.components import connected_components

#: Fixed bits of a subtree's path by level, for a budget of 3: a quarter of what is left each time.
LEVELS = ((0, 16), (16, 12), (28, 9))
#: Node pairs that advance together, and pairs found that are held before a forest is made of them.
NODES, HELD = 1 << 16, 1 << 20
#: Texts of a block that meet in one task, their shingles, and cells of a matrix in which they are compared.
BLOCK, BLOCK_SIZE, CELLS = 1024, 1 << 20, 1 << 22
#: Texts of a shingle up to which a join pairs them, and pairs a text up to which a task lists them.
FEW, EACH_TEXT = 32, 8


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; A-Z lower-cased, words parted at ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    runs = zip(*(parts[i:] for i in range(words))) if len(parts) > words else [parts]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(b" ".join(r), seed) for r in runs), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 where over half the hashes have it; no hash gives 0. Signed, as Spark's BIGINT."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of docs; null and empty texts have fingerprint 0."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [majority_bits(shingle_hashes(t, words, seed)) for t in b["text"]]}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, fp long", rows, 512)


def trie_pairs(keys: np.ndarray, roots: np.ndarray, depth: int, budget: int, most: int = NODES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of keys at most `budget` bits apart, within each subtree, some at a time.

    keys: sorted unsigned 64-bit paths; roots: the first index of each subtree and the end; within a
    subtree the first `depth` bits are equal. Nodes are ranges of keys. At most `most` node pairs of a
    level advance together; the others wait, deepest first, so a subtree with very many near pairs
    takes no more memory than its keys and some levels of so many node pairs.
    """
    lo, hi = roots[:-1].astype(np.int64), roots[1:].astype(np.int64)
    lo, hi = (x[roots[1:] - roots[:-1] > 1] for x in (lo, hi))
    waiting = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while waiting:
        depth, nodes = waiting.pop()
        if nodes.shape[1] > most:
            waiting.append((depth, nodes[:, most:]))
            nodes = nodes[:, :most]
        a0, a1, b0, b1, spent = nodes
        small = ((a1 - a0) * (b1 - b0) <= 16) | (depth >= 64)
        if small.any():
            yield _leaf_pairs(keys, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, spent = nodes[:, ~small]
        if not len(a0):
            continue
        am, bm, alone = _parting(keys, a0, a1, depth), _parting(keys, b0, b1, depth), a0 == b0
        turn = ~alone  # the mirror image of a node paired with itself is the same pair
        nodes = np.stack([np.concatenate(x) for x in zip((a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am[turn], a1[turn], b0[turn], bm[turn], spent[turn] + 1))])
        a0, a1, b0, b1, spent = nodes
        live = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        waiting.append((depth + 1, nodes[:, live]))


def _parting(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where in each sorted range, equal in its first `depth` bits, the next bit turns to 1."""
    lo, hi, bit = lo.copy(), hi.copy(), np.uint64(63 - depth)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = np.zeros(len(mid), bool)
        one[open_] = (keys[mid[open_]] >> bit) & np.uint64(1) == 1
        lo, hi = np.where(open_ & ~one, mid + 1, lo), np.where(open_ & one, mid, hi)
    return lo


def _leaf_pairs(keys, a0, a1, b0, b1, budget) -> tuple[np.ndarray, np.ndarray]:
    """Compares what is left in small node pairs."""
    counts = (a1 - a0) * (b1 - b0)
    which = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = (b1 - b0)[which]
    i, j = a0[which] + at // width, b0[which] + at % width
    near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
    return i[near], j[near]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links that join the same of n nodes: each node with the least node it reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def first_rotation(difference: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Whether no rotation before this one has both of a pair in one subtree: a pair is found once."""
    x = difference.view(np.uint64)
    own = np.ones(len(x), bool)
    for c in range(3):
        own &= (turn <= c) | (((x >> np.uint64(48 - 16 * c)) & np.uint64(0xFFFF)) != 0)
    return own


def _subtree_links(budget: int, level: int, pairs: bool):
    depth = sum(LEVELS[level])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(t: np.ndarray, key: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | ((key[1:] >> np.uint64(64 - depth)) != (key[:-1] >> np.uint64(64 - depth)))])
            roots, held = np.r_[starts, len(key)], [np.zeros((2, 0), np.int64)]
            for i, j in trie_pairs(key, roots, depth, budget):
                own = first_rotation(_restored(key[i], t[i], level) ^ _restored(key[j], t[j], level), (t[i] >> (2 * level)) & 3)
                held.append(np.stack([i[own], j[own]]))
                if not pairs and sum(x.shape[1] for x in held) > HELD + len(key):
                    held = [np.stack(forest(len(key), *np.concatenate(held, axis=1)))]
            i, j = np.concatenate(held, axis=1)
            if not pairs:
                i, j = forest(len(key), i, j)
            return pd.DataFrame({"table": t[i] >> (2 * (level + 1)), "a": _restored(key[i], t[i], level), "b": _restored(key[j], t[j], level)})

        held_t, held_k = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        for b in batches:  # sorted by subtree: only the last may go on in the next batch
            t = np.concatenate([held_t, b["turn"].to_numpy(np.int32)])
            k = np.concatenate([held_k, b["path"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)])
            if not len(t):
                continue
            same = (t == t[-1]) & (k >> np.uint64(64 - depth) == k[-1] >> np.uint64(64 - depth))
            last = int(np.argmax(same))
            held_t, held_k = t[last:], k[last:]
            if last:
                yield walk(t[:last], k[:last])
        if len(held_t):
            yield walk(held_t, held_k)

    return run


def _rotated(key: str, fixed: int, by: int) -> str:
    """SQL of key with the bits below the first `fixed` ones rotated left by `by`."""
    m = 64 - fixed
    if not by:
        return key
    mask = (1 << m) - 1
    low = f"({key} & {mask if mask < 1 << 63 else -1}L)"
    top = f"({key} & {~mask if fixed else 0}L)"
    return f"({top} | ((shiftleft({low}, {by}) | shiftrightunsigned({low}, {m - by})) & {mask if mask < 1 << 63 else -1}L))"


def near_links(fps: DataFrame, budget: int = 3, crowded: int = 4096, pairs: bool = False) -> DataFrame:
    """Distinct fingerprints (table, fp) -> links (table, a, b); only those of a table meet.

    By default links join exactly the fingerprints that a chain of steps of at most `budget` bits
    joins; within a task the pairs found are reduced to a spanning forest before they leave it. With
    `pairs` they are all pairs at most `budget` bits apart. budget: 1 to 3. Rows must be distinct and
    without nulls, other columns are ignored, and an empty table gives no links.
    """
    if not 1 <= budget <= 3:
        raise ValueError("budget must be 1, 2 or 3")
    rows, out = fps.select(F.col("table").cast("int").alias("turn"), F.col("fp").alias("key")), None
    for level, (fixed, width) in enumerate(LEVELS):
        turned = [F.expr(f"named_struct('turn', cast(turn * 4 + {c} as int), 'key', {_rotated('key', fixed, c * width)})") for c in range(4)]
        rows = rows.select(F.explode(F.array(*turned)).alias("r")).select("r.turn", "r.key")
        block = F.shiftrightunsigned("key", 64 - fixed - width)
        rows = rows.withColumn("block", block)
        more = None
        if level + 1 < len(LEVELS):
            heavy = cut(rows.groupBy("turn", "block").count().where(F.col("count") > crowded).select("turn", "block"))
            if not heavy.isEmpty():
                more = cut(rows.join(heavy, ["turn", "block"], "left_semi").select("turn", "key"))
                rows = rows.join(heavy, ["turn", "block"], "left_anti")
        # Spark sorts signed; flipping the sign bit makes that the unsigned order
        parts = (
            rows.select("turn", "block", F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("path"))
            .repartition("turn", "block")
            .sortWithinPartitions("turn", "path")
            .select("turn", "path")
        )
        links = parts.mapInPandas(_subtree_links(budget, level, pairs), "table int, a long, b long")
        out = links if out is None else out.unionAll(links)
        if more is None:
            break
        rows = more
    return out


def _restored(key: np.ndarray, turn: np.ndarray, level: int) -> np.ndarray:
    """Undoes the rotations of the levels passed; turn has a base-4 digit for each. Signed 64-bit."""
    for at in range(level, -1, -1):
        fixed, width = LEVELS[at]
        m = 64 - fixed
        low = np.uint64((1 << m) - 1)
        by = np.uint64(m) - ((turn >> (2 * (level - at))) & 3).astype(np.uint64) * np.uint64(width)
        part, back = key & low, by < np.uint64(m)
        shift = np.where(back, by, np.uint64(0))
        key = (key & ~low) | np.where(back, (part << shift) | (part >> (np.uint64(m) - shift) % np.uint64(64)), part) & low
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, budget: int = 3, crowded: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Two documents are linked if their fingerprints differ in at most `budget` bits; component_id is
    the smallest doc_id reachable by links, the document's own included. Null and empty texts have
    fingerprint zero and are linked like any other; a null doc_id keeps its row and names no
    component unless nothing else is reachable (then null); repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    each = cut(fingerprints(docs, words, seed))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = cut(connected_components(near_links(distinct.select(F.lit(0).alias("table"), "fp"), budget, crowded)))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each hash (a public finaliser of well-known constants)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different runs of `words` words of a text as 64-bit hashes, made from its words' hashes; a shorter text is one run."""
    each = shingle_hashes(text, 1, 42)
    if not len(each):
        return each
    words = min(words, len(each))
    out = np.zeros(len(each) - words + 1, np.uint64)
    for k in range(words):
        out = mixed(out + each[k : k + len(out)], k + 1)
    return np.unique(out)


def frequent_shingles(texts: DataFrame, words: int, sample: int = 10_000, most: int = 300_000) -> np.ndarray:
    """Shingles of two or more different texts (h, text) of a sample, the most frequent last.

    They only choose the order in which shingles are looked at: with any list the join finds the same.
    """
    some = texts.where(F.pmod(F.xxhash64("h"), F.lit(texts.count() // sample + 1)) == 0).dropDuplicates(["h"])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"t": np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, words).view(np.int64) for t in b["text"])])}

    counts = map_rows(some, ["text"], "t long", rows, 64).groupBy("t").count().where("count > 1")
    return counts.orderBy(F.desc("count"), "t").limit(most).toPandas()["t"].to_numpy(np.int64)[::-1].view(np.uint64)


def prefix(shingles: np.ndarray, similarity: float, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, by an order common to all sets, without one of which no set is `similarity` alike.

    The order is that of the hashes, then of `ranks` for those in `values` (sorted).
    """
    n = len(shingles)
    if len(values):
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        shingles = shingles[np.argsort(np.where(values[at] == shingles, ranks[at] + 1, 0), kind="stable")]
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1]


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x shares with each of y: products of 0/1 matrices, as many columns at a time as fit."""
    values = np.concatenate([*x, *y])
    rows = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    distinct, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    both = counts[codes] > 1  # what only one set has is shared with none
    columns = np.cumsum(counts > 1) - 1
    rows, codes, width = rows[both], columns[codes[both]], int((counts > 1).sum())
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    out, some = np.zeros((len(x), len(y)), np.float32), max(256, CELLS // (len(x) + len(y)))
    for at in range(0, width, some):
        i, j = np.searchsorted(codes, [at, at + some])
        m = np.zeros((len(x) + len(y), min(some, width - at)), np.float32)
        m[rows[i:j], codes[i:j] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _unit_links(similarity: float):
    """Links of a forest between the texts that are `first` and those that aren't (null: both); those with one root r are joined already."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, n, r = (rows[c].to_numpy(np.int64) for c in ("h", "n", "r"))
        sets = [np.asarray(v, np.int64) for v in rows["s"]]
        first = np.flatnonzero(rows["first"].isna() | rows["first"].eq(True))
        second = np.flatnonzero(rows["first"].isna() | rows["first"].eq(False))
        roots, at = np.unique(r, return_inverse=True)
        held: list[tuple[int, int]] = []
        if len(roots) > 1:
            common = overlaps([sets[k] for k in first], [sets[k] for k in second]).astype(float)
            near = common + 1e-9 >= similarity * (n[first][:, None] + n[second][None, :] - common)
            i, j = np.nonzero(near & (r[first][:, None] != r[second][None, :]))
            parent = list(range(len(roots)))

            def top(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for u, v in zip(first[i].tolist(), second[j].tolist()):
                x, y = top(at[u]), top(at[v])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    held.append((u, v))
        return pd.DataFrame({"a": h[[u for u, _ in held]], "b": h[[v for _, v in held]]}, dtype=np.int64)

    return run


def _unit_candidates(share: float, most: int):
    """Pairs of a shingle's texts whose places let them be alike, or only that they are more than `most` a text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, n, p = (rows[c].to_numpy(np.int64) for c in ("h", "n", "p"))
        rest = n - p
        can = np.minimum(rest[:, None], rest[None, :]) >= share * (n[:, None] + n[None, :]) - 1e-9
        i, j = np.nonzero(np.triu(can, 1))
        if len(i) > most * len(h):
            return pd.DataFrame({"t": rows["t"].iloc[:1], "x": [0], "y": [0], "dense": [True]})
        return pd.DataFrame({"t": rows["t"].iloc[0], "x": np.minimum(h[i], h[j]), "y": np.maximum(h[i], h[j]), "dense": False})

    return run


def fingerprint_pairs(texts: DataFrame, budget: int = 3, crowded: int = 4096) -> DataFrame:
    """Text hashes with fingerprints (h, f) -> candidates (x, y), x < y, of the trie walk: no more than some a text.

    The least hash of each fingerprint stands for it and is paired with all others that have it, and with those
    that stand for the fingerprints that near_links() joins with this one.
    """
    firsts = cut(texts.groupBy("f").agg(F.min("h").alias("first")))
    linked = near_links(firsts.select(F.lit(0).alias("table"), F.col("f").alias("fp")), budget, crowded).select("a", "b").distinct()
    of = lambda end: firsts.select(F.col("f").alias(end), F.col("first").alias(f"h{end}"))
    met = linked.join(of("a"), "a").join(of("b"), "b").select(F.least("ha", "hb").alias("x"), F.greatest("ha", "hb").alias("y"))
    same = texts.join(firsts, "f").where("h <> first").select(F.col("first").alias("x"), F.col("h").alias("y"))
    return met.unionAll(same)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, sample: int = 10_000, few: int = FEW, each_text: int = EACH_TEXT) -> DataFrame:
    """Links (a, b) that join the same text hashes as all pairs of docs whose sets of `words`-word shingles have a Jaccard similarity of `similarity`.

    SimHash finds first: pairs of the trie walk over the sets' fingerprints are held against the exact similarity, and
    what they join is one group from then on. Fingerprints of alike sets can be more than three bits apart, so an
    exact join completes the groups; it compares no two texts that are in one group already.

    Two alike sets share one of the first shingles of each, a fifth of them at 0.8, in any order that is
    common to all sets (the prefix filter), and their sizes and the places of that shingle leave room
    for the rest: texts for which that holds are candidates, so no pair is lost. Rare shingles come
    first. Every candidate is held against the exact similarity.

    Candidates of a shingle with at most `few` texts come from a join. Those of one with up to BLOCK
    texts are listed by a task if they are no more than `each_text` a text. They go on if they share so
    many of their first shingles that all others would do, and only then are whole sets compared. What is left is dense:
    many texts that are nearly alike. They are compared inside tasks, in blocks of bounded size, to
    which each text's set comes once, and of which only a forest of links leaves. Of a shingle with
    several blocks, the texts that are not joined with its largest part by then meet all its blocks.

    Texts without words are alike; null ids, repeated rows and further columns change nothing; an
    empty table has no links.
    """
    share = similarity / (1 + similarity)  # of two alike sets' sizes, what they have in common at least
    texts = docs.select(F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "text")
    order = frequent_shingles(texts, words, sample)
    ranks = np.argsort(order)
    values = order[ranks]

    def first_shingles(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()  # equal texts that are near each other have their shingles made once
        for b in batches:
            if len(seen) > 1 << 18:
                seen.clear()
            new = [k for k, h in enumerate(b["h"]) if not (h in seen or seen.add(h))]
            sets = [shingle_set(b["text"][k], words) for k in new]
            # texts without words share one made-up shingle
            yield {"h": [b["h"][k] for k in new], "n": list(map(len, sets)), "f": list(map(majority_bits, sets)), "t": [prefix(s, similarity, values, ranks).view(np.int64) if len(s) else np.zeros(1, np.int64) for s in sets]}

    made = map_rows(texts, ["h", "text"], "h long, n int, f long, t array<long>", first_shingles, 256)
    each = cut(made.groupBy("h").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("t").alias("t")))  # equal texts have equal sets
    walked = cut(fingerprint_pairs(each.select("h", "f")))
    # narrow bands of sizes: eight of them make up the factor `similarity`, so there are some hundred at most
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) * F.lit(8 / -math.log(similarity) if similarity < 1 else 64.0)).cast("int")
    rows = each.select(F.posexplode("t").alias("p", "t"), "h", "n").select("t", "h", "n", "p", band.alias("band"))
    met = cut(rows.join(rows.groupBy("t").count().where("count > 1").select("t"), "t"))
    around = Window.partitionBy("t").orderBy("band")  # a row a band, not a text
    bands = met.groupBy("t", "band").agg(F.count("*").alias("same"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    bands = bands.select("t", "band", "same", F.lag("hi").over(around).alias("below"), F.lead("lo").over(around).alias("above"))
    # a text that is alike has from `similarity` times as many shingles up to what this one's place leaves room for
    near = (F.col("same") > 1) | (F.col("below") >= similarity * F.col("n") - 1e-6) | (F.col("above") <= F.col("n") / similarity - F.col("p") / share + 1e-6)
    met = cut(met.join(bands, ["t", "band"]).where(near).select("t", "h", "n", "p"))
    shared = cut(met.join(met.groupBy("t").agg(F.count("*").alias("texts"), F.sum("n").alias("size")).where("texts > 1"), "t"))

    def enough(n, p, n2, p2):
        """Whether the shingles from the shared one on can be as many as the two sets must share."""
        return F.least(n - p, n2 - p2) >= F.lit(share) * (n + n2) - 1e-9

    small = shared.where(F.col("texts") <= few)
    other = small.select("t", F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("p").alias("p2"))
    pairs = small.join(other, "t").where((F.col("h") < F.col("h2")) & enough(F.col("n"), F.col("p"), F.col("n2"), F.col("p2"))).select(F.col("h").alias("x"), F.col("h2").alias("y"))
    listed = cut(shared.where((F.col("texts") > few) & (F.col("texts") <= BLOCK)).select("t", "h", "n", "p").groupBy("t").applyInPandas(_unit_candidates(share, each_text), "t long, x long, y long, dense boolean"))
    pairs = pairs.unionAll(listed.where("NOT dense").select("x", "y")).distinct()
    # of the set whose first shingles end first, what lies in the other set at all lies in its first shingles
    of = lambda end: each.select(F.col("h").alias(end), F.col("n").alias(f"n{end}"), F.col("t").alias(f"t{end}"))
    most = F.size(F.array_intersect("tx", "ty")) + F.greatest(F.col("nx") - F.size("tx"), F.col("ny") - F.size("ty"))
    pairs = cut(pairs.join(of("x"), "x").join(of("y"), "y").where(most >= F.lit(share) * (F.col("nx") + F.col("ny")) - 1e-9).select("x", "y"))
    dense = shared.where(F.col("texts") <= BLOCK).join(listed.where("dense").select("t"), "t", "left_semi").unionAll(shared.where(F.col("texts") > BLOCK))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK), F.ceil(F.col("size") / BLOCK_SIZE)).cast("int")
    dense = cut(dense.withColumn("blocks", blocks).select("t", "h", "n", "blocks", F.pmod(F.xxhash64("h", "t"), "blocks").cast("int").alias("block")))

    def shingles(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"h": b["h"], "s": [shingle_set(t, words).view(np.int64) for t in b["text"]]}

    # one row a text, named by ids alone before any text moves: copies in any number are dealt by their own ids and end there
    needed = pairs.select(F.explode(F.array("x", "y")).alias("h")).union(walked.select(F.explode(F.array("x", "y")).alias("h"))).union(dense.select("h")).distinct()
    # (no semi join here: Spark would move it, and with it the shuffle of all copies, before the minimum)
    named = texts.select("h", "id").groupBy("h").agg(F.min("id").alias("id")).join(needed, "h")
    nodes = texts.join(named, ["h", "id"], "left_semi").dropDuplicates(["h", "id"])
    sets = cut(map_rows(nodes, ["h", "text"], "h long, s array<long>", shingles, 256))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("h").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("h").alias("y"), F.col("s").alias("sy")), "y")
        common = F.size(F.array_intersect("sx", "sy"))
        return both.where(common + 1e-9 >= F.lit(similarity) * (F.size("sx") + F.size("sy") - common)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    found = cut(alike(walked))
    groups = cut(connected_components(found))
    group = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    apart = F.coalesce("rx", "x") != F.coalesce("ry", "y")
    links = found.unionAll(alike(pairs.join(group("x"), "x", "left").join(group("y"), "y", "left").where(apart).select("x", "y")))

    def compared(rows: DataFrame) -> DataFrame:
        return rows.join(sets, "h").groupBy("t", "one", "two").applyInPandas(_unit_links(similarity), "a long, b long")

    within = dense.join(groups, dense.h == groups.node, "left").select("t", "h", "n", F.coalesce("root", "h").alias("r"), F.col("block").alias("one"), F.lit(-1).alias("two"), F.lit(None).cast("boolean").alias("first"))
    links = cut(links.unionAll(compared(within)))
    large = dense.where("blocks > 1")
    if large.isEmpty():
        return links
    roots = connected_components(links).withColumnsRenamed({"node": "h", "root": "r"})
    left = cut(large.join(roots, "h", "left").withColumn("r", F.coalesce("r", "h")))
    # the texts of the root that most have are joined already: only the others need to meet what the blocks hold
    parts = left.groupBy("t", "r").agg(F.count("*").alias("texts"), F.sum("n").alias("size"))
    whole = parts.groupBy("t").agg(F.sum("texts").alias("texts"), F.sum("size").alias("size"), F.max(F.struct("texts", "r", "size")).alias("top"))
    chunks = F.greatest(F.ceil((F.col("texts") - F.col("top.texts")) / BLOCK), F.ceil((F.col("size") - F.col("top.size")) / BLOCK_SIZE)).cast("int")
    left = left.join(whole.where("texts > top.texts").select("t", F.col("top.r").alias("main"), chunks.alias("chunks")), "t")
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = left.select("t", "h", "n", "r", "block", places("chunks").alias("two")).select("t", "h", "n", "r", F.col("block").alias("one"), "two", F.lit(False).alias("first"))
    other = left.where("r <> main").withColumn("two", F.pmod(F.xxhash64("t", "h"), "chunks").cast("int"))
    other = other.select("t", "h", "n", "r", places("blocks").alias("one"), "two", F.lit(True).alias("first"))
    return links.unionAll(compared(held.unionAll(other)))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """docs with one document of each group of near copies left: the smallest doc_id, of equal ids the smallest text hash.

    Groups are joined by equal texts and by near_copies(); texts without words, null ones too, are
    one group. A null doc_id stays only where the group has no other; repeated rows leave
    one; an empty table gives none. All columns stay, `_k` and `_g` excepted.

    Texts are told apart by 96 bits of hashes. near_copies() knows them by 64 bits; of texts that
    share those by chance one is compared and the others stay, so no document is lost by a collision.
    """
    marked = docs.withColumns({"_k": F.xxhash64("text"), "_g": F.hash("text")})
    ids = marked.select("doc_id", F.col("_k").alias("h"), F.col("_g").alias("g"))
    roots = cut(connected_components(near_copies(docs, words, similarity, **options)))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "g"))
    classes = ids.groupBy("h", "g").agg(first.alias("first"))  # copies are gone before anything is joined
    classes = classes.withColumn("met", F.col("g") == F.min("g").over(Window.partitionBy("h")))
    root = F.when(F.col("met"), F.coalesce("root", "h")).otherwise(F.xxhash64("h", "g"))
    grouped = classes.join(roots, classes.h == roots.node, "left").select("first", root.alias("root"), "met")
    kept = grouped.groupBy("root", "met").agg(F.min("first").alias("first")).select(*(F.col(f"first.{a}").alias(b) for a, b in (("doc_id", "_id"), ("h", "_h"), ("g", "_i"))))
    same = (F.col("_k") == F.col("_h")) & (F.col("_g") == F.col("_i")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    out = marked.join(kept, same).drop("_id", "_h", "_i")
    if not ids.groupBy("doc_id", "h", "g").count().where(F.col("count") > 1).isEmpty():
        out = out.dropDuplicates(["doc_id", "_k", "_g"])
    return out.drop("_k", "_g")
