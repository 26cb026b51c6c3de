"""Exact dense retrieval: a stated set of queries against all documents, as products of blocks.

Documents and queries are packed into blocks of rows, a matrix each. Every pair of blocks is one
matrix product inside a task. A task takes a block of queries past many blocks of documents and holds
the k best so far of each query and participant; only these leave it and are ranked once more, so what
is shuffled grows with the queries and not with pairs of blocks. No vector goes through the driver,
and no pair of a document and a query is ever a row unless all_scores() asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import cut

#: Rows of a block of documents and of queries. A block of documents with 64 numbers a row takes 1 MB, its scores 16 MB.
DOCS, QUERIES = 2048, 1024
#: Rows that a task holds before it lets them go, and participants that it tells apart.
HELD, PEOPLE = 1 << 21, 1 << 12
#: Scores are rounded, so that equal vectors tie in any order of summation.
PLACES = 9


def _units(rows: list[np.ndarray]) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows])
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def document_blocks(docs: DataFrame, size: int = DOCS) -> DataFrame:
    """(participants, ids, places, m): up to `size` documents a row, m their unit vectors; packed where they are. Rows without an embedding go."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                yield pd.DataFrame({"participants": [part["p"].tolist()], "ids": [part["d"].tolist()], "places": [part["pos"].tolist()], "m": [_units(list(part["embedding"])).tobytes()]})

    named = docs.where("embedding IS NOT NULL").select(F.col("participant_id").cast("string").alias("p"), F.col("doc_id").cast("string").alias("d"), F.col("pos").cast("long").alias("pos"), "embedding")
    return named.mapInPandas(pack, "participants array<string>, ids array<string>, places array<long>, m binary")


def query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """(block, items, keys, orders, q): the queries in n rows, q their vectors one after another. An item's queries may lie in several blocks."""
    block = F.pmod(F.xxhash64("item_id", "query_ord", F.col("query_key")), F.lit(n))
    row = F.struct(F.col("item_id").cast("long").alias("item"), F.col("query_ord").cast("long").alias("ord"), F.col("query_key").cast("string").alias("key"), "embedding")
    lists = queries.where("embedding IS NOT NULL").groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("all"))
    each = lambda c: F.transform("all", lambda x: x[c])
    return lists.select("block", each("item").alias("items"), each("key").alias("keys"), each("ord").alias("orders"), F.flatten(each("embedding")).cast("array<double>").alias("q"))


def _best(scores: np.ndarray, who: np.ndarray, places: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each column's k largest scores for each participant; ties to the smaller place."""
    rows, cols = [], []
    for p in np.unique(who):
        at = np.flatnonzero(who == p)
        part = scores[at]
        if k is None or len(at) <= k:
            r, c = np.nonzero(np.ones(part.shape, bool))
        else:
            least = np.partition(part, len(at) - k, axis=0)[len(at) - k]
            r, c = np.nonzero(part >= least)
            order = np.lexsort((places[at][r], -part[r, c], c))
            r, c = r[order], c[order]
            first = np.searchsorted(c, np.arange(part.shape[1]))
            keep = np.arange(len(c)) - first[c] < k
            r, c = r[keep], c[keep]
        rows.append(at[r])
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


_FOUND = ["p", "item", "d", "pos", "s", "winning_query", "ord"]


class _Asked:
    """A block of queries, and the k best documents so far of each item for each participant; with k None all leave at once."""

    def __init__(self, k: int | None, items: np.ndarray, orders: np.ndarray, keys: list, flat: np.ndarray) -> None:
        self.k, self.orders, self.keys = k, orders, np.array(keys, object)
        self.q = _units(list(flat.reshape(len(items), -1)))
        self.starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        self.sizes, self.items = np.diff(np.append(self.starts, len(items))), items[self.starts]
        self.clear()

    def clear(self) -> None:
        self.people: dict[str | None, int] = {}
        self.least = np.empty((0, len(self.items)))  # a participant's k-th best score of each item
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.kept = self.held = 0

    def meet(self, people: list, places: np.ndarray, ids: list, m: np.ndarray) -> None:
        scores = np.round(m @ self.q.T, PLACES)
        if len(self.items) == len(self.orders):
            best, winner = scores, np.broadcast_to(np.arange(len(self.items)), scores.shape)
        else:
            best = np.maximum.reduceat(scores, self.starts, axis=1)
            at = np.where(scores == np.repeat(best, self.sizes, axis=1), np.arange(len(self.orders)), len(self.orders))
            winner = np.minimum.reduceat(at, self.starts, axis=1)  # an item's queries are in order: the first of equal ones
        who = np.array([self.people.setdefault(p, len(self.people)) for p in people])
        names = np.array(ids, object)
        if len(self.people) > len(self.least):
            more = np.full((max(2 * len(self.people), 16), len(self.items)), -np.inf)
            more[: len(self.least)] = self.least
            self.least = more
        for p in np.unique(who):
            at = np.flatnonzero(who == p)
            part = best if len(at) == len(who) else best[at]
            if self.k is None or np.isneginf(self.least[p]).any():
                r, c = _best(part, np.zeros(len(at), int), places[at], self.k)
            else:
                r, c = np.nonzero(part >= self.least[p])
            if len(r):
                row = at[r]
                self.parts.append((c, np.full(len(r), p), part[r, c], places[row], names[row], winner[row, c]))
                self.held += len(r)
        if self.k is not None and self.held > max(2 * self.kept, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Leaves the k best of what is held; ties to the smaller place."""
        c, p, s, pos, names, won = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((pos, -s, p, c))
        c, p, s = c[order], p[order], s[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1])))
        rank = np.arange(len(c)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        last = rank == self.k - 1
        self.least[p[last], c[last]] = np.maximum(self.least[p[last], c[last]], s[last])
        keep = rank < self.k
        order = order[keep]
        self.parts = [(c[keep], p[keep], s[keep], pos[order], names[order], won[order])]
        self.kept = self.held = len(order)

    def leave(self) -> Iterator[pa.RecordBatch]:
        """Rows of what is held; what comes later still has to be as good as the k-th best of them."""
        if self.held and self.k is not None:
            self.settle()
        named = np.array([*self.people, None], object)
        for part in self.parts:
            for at in range(0, len(part[0]), 1 << 16):
                c, p, s, pos, names, won = (x[at : at + (1 << 16)] for x in part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(named[p], pa.string()), pa.array(self.items[c]), pa.array(names, pa.string()), pa.array(pos), pa.array(s), pa.array(self.keys[won], pa.string()), pa.array(self.orders[won]),
                ], _FOUND)
        self.parts, self.kept, self.held = [], 0, 0
        if len(self.people) > PEOPLE:
            self.clear()


def _products(docs: DataFrame, queries: DataFrame, k: int | None, size: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Asked] = {}
        for b in batches:
            for at_row in range(b.num_rows):  # one pair of blocks at a time becomes Python's; the rest stays as it came
                block = b.column("block")[at_row].as_py()
                if block not in asked:
                    items, orders, flat = (b.column(c)[at_row].values.to_numpy() for c in ("items", "orders", "q"))
                    asked[block] = _Asked(k, items.copy(), orders.copy(), b.column("keys")[at_row].as_py(), flat)
                one = asked[block]
                people, ids = (b.column(c)[at_row].as_py() for c in ("participants", "ids"))
                m = np.frombuffer(b.column("m")[at_row].as_buffer(), np.float64).reshape(len(ids), one.q.shape[1])
                one.meet(people, b.column("places")[at_row].values.to_numpy().copy(), ids, m)
                if k is None or len(one.people) > PEOPLE or sum(x.held for x in asked.values()) > HELD:
                    for x in asked.values():
                        yield from x.leave()
        for x in asked.values():
            yield from x.leave()

    sc = docs.sparkSession.sparkContext
    n = max(1, -(-queries.count() // size[1]))
    runs = -(-2 * sc.defaultParallelism // min(n, sc.defaultParallelism))  # of documents: the more blocks of queries, the fewer
    blocks = cut(document_blocks(docs, size[0]), **{"parquet.block.size": 1 << 24}).coalesce(runs)
    pairs = blocks.crossJoin(query_blocks(queries, n))  # blocks, not rows: a stated query set against all documents
    return pairs.mapInArrow(run, "p string, item long, d string, pos long, s double, winning_query string, ord long")


def _merged(found: DataFrame) -> DataFrame:
    return found.groupBy("p", "item", "d", "pos").agg(F.max("s").alias("score"), F.max_by("winning_query", F.struct("s", -F.col("ord"))).alias("winning_query"))


def _named(one: DataFrame, docs: DataFrame, queries: DataFrame, *more: str) -> DataFrame:
    kinds = docs.schema
    return one.select(F.col("p").cast(kinds["participant_id"].dataType).alias("participant_id"), F.col("item").cast(queries.schema["item_id"].dataType).alias("item_id"), F.col("d").cast(kinds["doc_id"].dataType).alias("doc_id"), "pos", "score", "winning_query", *more)


def _asked(queries: DataFrame) -> DataFrame:
    """queries with query_key and query_ord: one query an item is its own."""
    if "query_ord" in queries.columns:
        return queries
    return queries.withColumns({"query_key": F.col("item_id").cast("string"), "query_ord": F.lit(0)})


def nearest(docs: DataFrame, queries: DataFrame, k: int, size: tuple[int, int] = (DOCS, QUERIES)) -> DataFrame:
    """(participant_id, item_id, doc_id, pos, score, winning_query, rank): the k documents of each participant nearest to each item.

    docs: participant_id, doc_id, pos (a number, distinct within a participant), embedding; queries:
    item_id (a number), embedding, and query_key and query_ord where items have several. score is the
    largest cosine to any of the item's queries, winning_query the first that has it. The best of an
    item over all its queries are among the best of each block of them, so no block sees all. Order:
    score, then pos. Rows without an embedding are left out, vectors of length zero score 0, null participants are one.
    """
    asked = _asked(queries)
    found = _merged(_products(docs, asked, k, size).repartition("p", "item"))  # one shuffle for what follows
    by = Window.partitionBy("p", "item").orderBy(F.desc("score"), "pos")
    return _named(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), docs, queries, "rank")


def all_scores(docs: DataFrame, queries: DataFrame, size: tuple[int, int] = (DOCS, QUERIES)) -> DataFrame:
    """(participant_id, item_id, doc_id, pos, score, winning_query) of every document and item; as many rows as both have together multiplied."""
    return _named(_merged(_products(docs, _asked(queries), None, size)), docs, queries)
