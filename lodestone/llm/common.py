"""What the operators of this subpackage share: shared storage, label splits, row-wise Python stages."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import cut, new_path, shared_dir

__all__ = ["Recent", "arrow_schema", "cut", "held_out", "letter_words", "in_order", "map_rows", "new_path", "release", "shared_dir", "slices"]


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that no model may learn from: crc32(doc_id as text) mod 3 is 1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased. Numerals that are no digits, as in `²` or `Ⅷ`, are no letters."""
    found = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows, and of at most `size` bytes of strings and lists unless one row has more."""
    each = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            each += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            each += 4 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(each), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives what a task no longer holds back to the system: an idle worker keeps its memory of words, not its buffers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]], width: int, size: int = 4 << 20) -> DataFrame:
    """Runs rows(batches) over Arrow batches of the named columns only.

    rows gets an iterator of column dictionaries (name -> list) and yields such dictionaries. `width`
    rows and `size` bytes of texts bound what a batch holds, and so what Python holds at a time.
    """
    names = [f.name for f in DataFrameSchema(schema)]
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[dict]:
            for b in batches:
                for part in slices(b, width, size):
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(columns)}

        for out in rows(plain()):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t.type) for n, t in zip(names, arrow)], schema=arrow)
        release()

    return df.select(*columns).mapInArrow(run, schema)


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `place`, its rows' places from 1 in a global order, and for each (new, old) of sums the sum of old up to the row.

    Rows are dealt to ranges of the order, so rows that are equal in its first columns spread by the
    others, and written once in it. Counts and sums of the ranges, a row a partition, give every
    range its start. Columns `place`, `_id` and `_range` of df must not exist.
    """
    low = (1 << 33) - 1  # what monotonically_increasing_id() counts within a partition
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    sums = sums or {}
    whole = placed.groupBy("_range").agg(F.count("*").alias("_place"), *(F.sum(old).alias(f"_{new}") for new, old in sums.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in ("place", *sums)))
    within = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("*", *(F.sum(old).over(within).alias(new) for new, old in sums.items())).join(F.broadcast(starts), "_range")
    place = F.col("_place") + F.col("_id").bitwiseAND(F.lit(low)) + 1
    return rows.select(*df.columns, place.alias("place"), *((F.col(new) + F.col(f"_{new}")).alias(new) for new in sums))


class Recent(dict):
    """A memory of `size` to 2 * size recently used entries, which notes what it was asked for in vain.

    When it is full, what it holds becomes the older half, from which an entry comes back when it is
    asked for; the half before is forgotten. `new` collects missing keys until learn() is given the
    values of all of them; until then they read as `blank`, and `asked` counts such reads.
    """

    def __init__(self, size: int, blank: object) -> None:
        super().__init__()
        self.size, self.blank, self.older, self.new, self.asked = size, blank, {}, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            self.new[key] = None
            self.asked += 1
            return self.blank
        self[key] = value
        return value

    def learn(self, keys: list, values: list) -> None:
        """Adds entries. What is read right after this is still there, however many entries that are."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        self.update(zip(keys, values))
        self.new = {}


def DataFrameSchema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(DataFrameSchema(ddl))
