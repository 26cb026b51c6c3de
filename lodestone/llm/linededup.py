"""Lines that many documents share, dropped by bitmaps.

Hashes of lines are dealt into ranges and sorted there by document and position. A task streams its
range once: a run of equal hashes is one line's occurrences, its first occurrence comes first, and how
many documents it is in decides whether its lines go. A range may begin or end inside a run, so of the
runs at its ends a few rows are settled afterwards, by hash. What leaves is not text but a compressed
bitmap for each document that loses lines; a document's text meets its bitmap once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, cut, map_rows, release

#: What is stripped from a line's ends, and what is lower-cased, to get its key.
BLANK, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A row of a task's output: its line goes; it is settled by hash; it is settled by hash, and its line is known to be in enough documents.
GOES, OPEN, MANY = 0, 1, 2


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def version(docs: DataFrame) -> Column:
    """Tells rows of a doc_id apart: a hash of the text and of whether the id is null."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h, k, d, v, pos): a row a line whose key has `least_chars` code points: 128 bits of hash, document, its version, position from 0."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    each = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), version(docs).alias("v"), lines).withColumn("line", key(F.col("line")))
    return each.where(F.length("line") >= least_chars).select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("k"), "d", "v", "pos")


def _stream(least_docs: int, keep_first: bool):
    """A task's work on its sorted range."""
    schema = arrow_schema("h long, k long, d long, v long, pos int, state int")

    def out(rows: np.ndarray, state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows[:4]), pa.array(rows[4].astype(np.int32)), pa.array(np.full(rows.shape[1], state, np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # the last run, as long as it is in fewer than least_docs documents
        going: tuple[int, int] | None = None  # the last run's hash once it is in more
        first = True  # the run in hand may have begun in the range before

        def border(rows: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
            if docs < least_docs:
                yield out(rows, OPEN)
            elif rows.shape[1]:
                yield out(rows[:, :1], MANY)
                yield out(rows[:, 1:], GOES)

        for b in batches:
            rows = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)])
            if going is not None:
                same = (rows[0] == going[0]) & (rows[1] == going[1])
                n = int(same.argmin()) if not same.all() else rows.shape[1]
                if n:
                    yield out(rows[:, :n], GOES)
                    rows = rows[:, n:]
                if rows.shape[1]:
                    going = None
            rows = np.concatenate((held, rows), axis=1)
            held = rows[:, :0]
            if not rows.shape[1]:
                continue
            new = np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(0)))
            doc = new | np.concatenate(([True], (rows[2:4, 1:] != rows[2:4, :-1]).any(0)))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], rows.shape[1])
            docs = np.add.reduceat(doc.astype(np.int64), starts)
            lo, hi = 0, len(starts) - 1  # runs lo..hi-1 are whole
            if first and hi > 0:
                yield from border(rows[:, : ends[0]], int(docs[0]))
                first, lo = False, 1
            if hi > lo:
                goes = np.repeat(docs[lo:hi] >= least_docs, ends[lo:hi] - starts[lo:hi])
                if keep_first:
                    goes &= ~new[starts[lo] : starts[hi]]
                if goes.any():
                    yield out(rows[:, starts[lo] : starts[hi]][:, goes], GOES)
            last = rows[:, starts[hi] :]
            if docs[hi] < least_docs:
                held = last.copy()
            else:  # it may go on in the next range or come from the one before, so its first row is settled by hash
                yield from border(last, int(docs[hi]))
                going, first = (int(last[0, 0]), int(last[1, 0])), False
        if held.shape[1]:
            yield out(held, OPEN)
        release()

    return run


def dropped_lines(docs: DataFrame, least_docs: int, least_chars: int, keep_first: bool) -> DataFrame:
    """(d, v, pos) of every line that goes."""
    order = ["h", "k", "d", "v", "pos"]
    placed = occurrences(docs, least_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    told = cut(placed.mapInArrow(_stream(least_docs, keep_first), "h long, k long, d long, v long, pos int, state int"))
    open_ = told.where(F.col("state") != GOES)  # of each range and end at most one row, or those of fewer than least_docs documents
    line = F.struct("d", "v", "pos")
    settled = open_.groupBy("h", "k").agg(F.min(line).alias("first"), (F.max("state").eqNullSafe(MANY) | (F.count_distinct(F.struct("d", "v")) >= least_docs)).alias("many"))
    late = open_.join(settled.where("many"), ["h", "k"])
    if keep_first:
        late = late.where(line != F.col("first"))
    return told.where(F.col("state") == GOES).select("d", "v", "pos").unionAll(late.select("d", "v", "pos"))


def pack(positions: list[int]) -> bytes:
    """A bitmap as zlib-compressed bytes: bit i of byte i // 8 is 0 where line i goes; lines beyond its end stay."""
    bits = np.ones(max(positions) // 8 * 8 + 8, bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(d, v, n_dropped, keep): a row a document that loses lines, with its compressed bitmap.

    Lines are what \\n divides. A line's key is the line without blanks at its ends, A-Z lower-cased;
    keys of at least `least_chars` code points that are in at least `least_docs` documents lose all
    lines, or all but the first in order of doc_id and position if keep_first. A document is a
    distinct pair of doc_id and text, so repeated rows count once and share a bitmap; a null id is an
    id, a null text an empty one; an empty table gives no rows. d is the id (0 for null), v version().
    Keys are told apart by 128 bits of hash. A document's positions meet in a row of their own size.
    """
    lists = dropped_lines(docs, least_docs, least_chars, keep_first).groupBy("d", "v").agg(F.collect_set("pos").alias("pos"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"d": b["d"], "v": b["v"], "n_dropped": list(map(len, b["pos"])), "keep": list(map(pack, b["pos"]))}

    return map_rows(lists, ["d", "v", "pos"], "d long, v long, n_dropped long, keep binary", rows, 1024)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of docs with the lines that stay, joined by \\n.

    One shuffle of the texts; rows without a bitmap keep their text.
    """
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), version(docs).alias("v")).join(bitmaps, ["d", "v"], "left")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n_lines, kept = [], []
            for text, bitmap in zip(b["text"], b["keep"]):
                n_lines.append(text.count("\n") + 1)
                if bitmap is not None:
                    lines = text.split("\n")
                    text = "\n".join(lines[i] for i in np.flatnonzero(unpack(bitmap, len(lines))))
                kept.append(text)
            yield {"doc_id": b["doc_id"], "n_lines": n_lines, "n_dropped": [n or 0 for n in b["n_dropped"]], "kept": kept}

    return map_rows(met, ["doc_id", "text", "n_dropped", "keep"], "doc_id long, n_lines long, n_dropped long, kept string", rows, 512)


def drop_shared_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of docs; what goes is as in keep_bitmaps(), other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, least_docs, least_chars, keep_first))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: Parameters: at least 10 documents, keys of at least one code point.
SQL = """
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM rows_),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
shared AS (SELECT k FROM (SELECT DISTINCT k, doc_id, text FROM keyed WHERE length(k) >= 1) GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s ON keyed.k = s.k GROUP BY r, doc_id
"""
