"""Importance resampling of documents towards a target distribution of hashed n-grams.

A feature is a run of words, and its bucket the CRC-32 of the words joined by a space. No such string
is ever made: a word's CRC is computed once, and crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where
shifting by n zero bytes is the n-th power of a 32 x 32 matrix over GF(2). Counts by bucket in the
documents and in the target give each bucket a gain, a document's weight is the mean of its gains,
and weights with Gumbel noise are drawn from the top, which samples without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, cut, in_order, release, slices

#: Words up to so many bytes are hashed side by side and shifted by table; longer ones one by one.
TABLED = 64
#: What a batch holds: rows and bytes of texts.
ROWS, BYTES = 4096, 4 << 20

#: Bytes of words after lower-casing: digits, a-z, and all of characters beyond ASCII. 0 for all others.
_WORD = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """The effect of a byte on a CRC of 0, for the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices over GF(2), each the images of the 32 single bits."""
    out = np.zeros(32, np.uint32)
    for bit in range(32):
        out ^= np.where(b >> np.uint32(bit) & np.uint32(1), a[bit], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def shift_matrix(n: int) -> np.ndarray:
    """What n zero bytes do to a CRC, as a matrix: the n-th power of the one for a single byte."""
    if n == 0:
        return np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 1:
        bits = shift_matrix(0)
        return byte_table()[bits & 255] ^ bits >> np.uint32(8)
    half = shift_matrix(n // 2)
    both = times(half, half)
    return times(both, shift_matrix(1)) if n % 2 else both


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """[n, k, b]: the image of byte b at place k under shift_matrix(n), for n up to TABLED."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    b = np.arange(256, dtype=np.uint32)
    for n in range(TABLED + 1):
        m = shift_matrix(n)
        for k in range(4):
            for bit in range(8):
                out[n, k] ^= np.where(b >> np.uint32(bit) & np.uint32(1), m[8 * k + bit], np.uint32(0))
    return out


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes each."""
    t, n = shift_tables(), np.minimum(by, TABLED)
    out = t[n, 0, crc & 255] ^ t[n, 1, crc >> 8 & 255] ^ t[n, 2, crc >> 16 & 255] ^ t[n, 3, crc >> 24]
    for i in np.flatnonzero(by > TABLED):
        m = shift_matrix(int(by[i]))
        out[i] = np.bitwise_xor.reduce(m[(int(crc[i]) >> np.arange(32) & 1).astype(bool)], initial=0)
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRCs, lengths in bytes, number of words of each row) of an Arrow column of strings; null rows have none."""
    column = column.fill_null("").cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    low = _WORD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = low != 0
    before = np.concatenate(([False], inside[:-1]))
    before[ends[:-1][ends[:-1] < len(low)]] = False  # no word goes from one row into the next
    after = np.concatenate((inside[1:], [False]))
    after[ends[1:][ends[1:] > 0] - 1] = False
    first = np.flatnonzero(inside & ~before)
    size = np.flatnonzero(inside & ~after) + 1 - first
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    order = np.argsort(np.minimum(size, TABLED + 1).astype(np.uint8), kind="stable")[::-1]  # the longest first
    at, many, table = first[order], np.searchsorted(-size[order].clip(max=TABLED + 1), -np.arange(TABLED + 1), side="left"), byte_table()
    long, held = int(many[TABLED]), crc[order]
    for j in range(TABLED):
        n = int(many[j])  # words of more than j bytes
        if n == long:
            break
        part = held[long:n]
        held[long:n] = table[(part ^ low[at[long:n] + j]) & 255] ^ part >> np.uint32(8)
    crc[order] = held ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        crc[i] = zlib.crc32(low[first[i] : first[i] + size[i]].tobytes())
    return crc, size, np.diff(np.searchsorted(first, ends))


def runs(crc: np.ndarray, size: np.ndarray, per_row: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... `longest` words: (CRCs in order, number of them in each row)."""
    space = np.uint32(zlib.crc32(b" "))
    row = np.repeat(np.arange(len(per_row)), per_row)
    run, at = crc, np.arange(len(crc))
    for n in range(1, longest + 1):
        if n > 1:
            on = at + n - 1 < len(crc)
            on[on] = row[at[on]] == row[at[on] + n - 1]
            run, at = run[on], at[on]
            end = at + n - 1
            run = shifted(shifted(run, np.ones(len(run), np.int64)) ^ space, size[end]) ^ crc[end]
        yield run, np.maximum(per_row - n + 1, 0)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket's features occur in the column `text`. Tasks send a row a bucket; `buckets` sums come to the driver."""
    schema = "bucket int, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b, ROWS, BYTES):
                for crc, _ in runs(*words(part.column(0)), longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=arrow)
        release()

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a natural unit each: the logarithm of a bucket's share in the target to that in the corpus, one added to each count, floored."""
    n, S, T = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean of its features' gains, 0 without any."""
    schema = "doc_id long, n_words long, n_features long, weight long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, ROWS, BYTES):
                crc, size, per_row = words(part.column(1))
                n, total = np.zeros(len(per_row), np.int64), np.zeros(len(per_row), np.int64)
                for run_crc, each in runs(crc, size, per_row, longest):
                    sums = np.concatenate(([0], np.cumsum(gain[run_crc % np.uint32(len(gain))])))
                    ends = np.cumsum(each)
                    n += each
                    total += sums[ends] - sums[ends - each]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(per_row), pa.array(n), pa.array(total // np.maximum(n, 1))], schema=arrow)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def gumbel(seed: int, doc_id: Column) -> Column:
    """Noise of a document in thousandths, from the SHA-256 of `seed:doc_id`; a null id counts as an empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_sample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs; drawn ones have a rank from 1.

    docs (doc_id, text) and target (text) are read whole. Of the N rows with at least `least_words`
    words floor(percent * N / 100) are drawn, highest scores first, ties to the smaller doc_id, null
    ids last. Null texts have no words and weight 0; repeated rows are rows of their own, of equal
    weight and noise; other columns are ignored; an empty target has T = 0; empty docs give no rows.
    Every row is ranked in ranges of the order, so ties of any number spread over tasks.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = cut(weights(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    n = scored.where(F.col("n_words") >= least_words).count()
    out = F.col("n_words") < least_words  # these come after all that can be drawn
    ordered = in_order(scored, [out.asc(), F.desc("score"), F.asc_nulls_last("doc_id")])
    rank = F.when(F.col("place") <= percent * n // 100, F.col("place"))
    return ordered.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


#: Parameters: 10,000 buckets, runs of up to two words, 20 words, 25 percent, seed 7. Only one CRC for each distinct feature.
SQL = """
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
said AS (
  SELECT TRUE AS own, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT FALSE, row_number() OVER (), NULL, text FROM benchmark
),
parts AS (
  SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM said
),
each AS (
  SELECT own, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM parts
),
counted AS (SELECT own, r, f, count(*) AS n FROM each GROUP BY own, r, f),
names AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM names, tab
),
put AS (SELECT own, r, bucket, n FROM counted JOIN hashed USING (f)),
sums AS (SELECT bucket, sum(CASE WHEN own THEN n ELSE 0 END) AS s, sum(CASE WHEN own THEN 0 ELSE n END) AS t FROM put GROUP BY bucket),
whole AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM sums),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS g FROM sums, whole
),
mean AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM put JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT p.r, p.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(p.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM parts p LEFT JOIN mean m ON p.r = m.r WHERE p.own
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
