"""Token ids in flat binary files with 64-bit document offsets.

A shard is two files. `<name>.ids` holds nothing but unsigned little-endian ids, 16 bits each where
the vocabulary allows and 32 otherwise. `<name>.idx` holds a head of four 64-bit integers (format
number, bytes an id, documents, ids), then documents + 1 offsets, the documents' ids, and a byte for
each that tells whether its id is null. Shards follow each other in ascending order of doc_id; what
a shard's first token is counted as, its base, comes from the sums of the shards before it.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, cut, new_path, release, slices

FORMAT = 1
#: Encoded stretches a worker remembers, and bytes of ids it holds back before it writes them.
REMEMBERED, HELD_BYTES = 500_000, 8 << 20
#: Documents, and bytes of their texts, that are encoded together.
GROUP, GROUP_BYTES = 4096, 8 << 20
_STRETCH = re.compile(r"(?<=\S)(?= \S)")
#: White space other than space and line feed; texts with any are divided by the pattern.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """Ids of a byte-level tokenizers file as bytes; stretches between single spaces are encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)  # the fast one has no offsets
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(self.tok.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _joint(self, new: list[str]) -> dict[str, bytes]:
        """Ids of stretches. Those that start with their only space are encoded in long texts and told apart by it."""
        out: dict[str, bytes] = {}
        joint = [p for p in new if p[0] == " " and p.count(" ") == 1]
        groups = [joint[i : i + 256] for i in range(0, len(joint), 256)]
        for group, e in zip(groups, self.batch(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(group) and starts[0] == 0:
                width = self.dtype.itemsize
                data, at = ids.tobytes(), [*(starts * width).tolist(), len(ids) * width]
                out.update(zip(group, map(data.__getitem__, map(slice, at, at[1:]))))
        rest = [p for p in new if p not in out]
        out.update(zip(rest, self._bytes(rest)))
        return out

    def _plain(self, text: str) -> bool:
        """Whether every space stands between characters that aren't white space, and no special string occurs."""
        return not (
            not text or text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text
            or any(c in text for c in _OTHER) or any(s in text for s in self.special)
        )

    def _known(self, words: list[str]) -> list[bytes]:
        get = self.known.get
        found = list(map(get, words))
        new = [w for w, f in zip(words, found) if f is None]
        if new:
            data = self._joint(list(dict.fromkeys(new)))
            if len(self.known) < REMEMBERED:  # frequent words come first, so what is full is what's wanted
                self.known.update(data)
            found = [data[w] if f is None else f for w, f in zip(words, found)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes.

        Words of all plain texts are told apart by Arrow, so that only different ones are looked up, and
        NumPy lays their ids out. The others are divided by the pattern.
        """
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        out = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            t = texts[i]
            out[i] = self._bytes([t])[0] if not t or any(s in t for s in self.special) else b"".join(self._known([p for p in _STRETCH.split(t) if p]))
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        begins = lists.offsets.to_numpy()[:-1].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        data = self._known([" " + w for w in words])
        heads = self._known([words[c] for c in codes[begins]])
        codes[begins] = len(words) + np.arange(len(plain))  # a text's first word has no space in front
        data += heads
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.dtype.itemsize
        flat, starts = np.frombuffer(b"".join(data), self.dtype), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        bounds = (np.r_[(ends - each)[begins], ends[-1]] * self.dtype.itemsize).tolist()
        for i, x, y in zip(plain, bounds, bounds[1:]):
            out[i] = ids[x:y]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes docs (doc_id, text) as shards in ascending doc_id order; returns their list.

    (shard, path, n_docs, n_tokens), one row a non-empty shard. Documents are range-partitioned and
    sorted by Spark, so no task holds more than its buffer; equal ids are ordered by text. A task
    that runs again writes files of another name, and only the files of the attempt that Spark
    accepts are in the list. Null texts are empty documents; each document ends with end_id.
    """
    schema = arrow_schema("shard int, path string, n_docs long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        store, path = _store(name)
        ids, ends, out, held, size, total = [], [0], None, [], 0, 0
        for b in batches:
            for part in slices(b, GROUP, GROUP_BYTES):
                ids += part.column(0).to_pylist()
                for data in enc.encode([t or "" for t in part.column(1).to_pylist()]):
                    total += len(data) // enc.dtype.itemsize + 1
                    ends.append(total)
                    held += (data, end)
                    size += len(data)
                if size > HELD_BYTES:
                    out = out or store.open_output_stream(path + ".ids")
                    out.write(b"".join(held))
                    held, size = [], 0
        if not ids:
            return
        out = out or store.open_output_stream(path + ".ids")
        out.write(b"".join(held))
        out.close()
        with store.open_output_stream(path + ".idx") as idx:
            idx.write(np.array([FORMAT, enc.dtype.itemsize, len(ids), total], "<i8").tobytes())
            idx.write(np.array(ends, "<i8").tobytes())
            idx.write(np.array([i or 0 for i in ids], "<i8").tobytes())
            idx.write(np.array([i is None for i in ids], "u1").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [len(ids)], "n_tokens": [total]}, schema)
        del held, ends, ids
        release()

    _make(folder)
    placed = docs.select("doc_id", "text").repartitionByRange(F.asc("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return cut(placed.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"))


def _make(folder: str) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)


def open_shard(path: str) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """(ids, offsets, doc_ids) of a shard; ids are memory-mapped where the store is a file system."""
    store, at = _store(path)
    with store.open_input_file(at + ".idx") as f:
        raw = f.read()
    _, width, n, total = np.frombuffer(raw, "<i8", 4)
    ends = np.frombuffer(raw, "<i8", n + 1, 32)
    ids = np.frombuffer(raw, "<i8", n, 32 + 8 * (n + 1))
    null = np.frombuffer(raw, "u1", n, 32 + 8 * (2 * n + 1))
    dtype = "<u2" if width == 2 else "<u4"
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(at + ".ids", dtype, "r", shape=(int(total),))
    else:
        with store.open_input_file(at + ".ids") as f:
            data = np.frombuffer(f.read(), dtype)
    return data, ends, [None if z else int(i) for i, z in zip(ids, null)]


def read_documents(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, read back from the files.

    start counts the ids of all documents before it over all shards. The list of shards (one row a
    partition of the write) comes to the driver, which sums it to the shards' bases.
    """
    listed = sorted(shards.collect(), key=lambda r: r.shard)
    bases, total = [], 0
    for r in listed:
        bases.append((r.path, total))
        total += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                path, base = bases[k]
                data, ends, ids = open_shard(path)
                for at in range(0, len(ids), 4096):
                    some = range(at, min(at + 4096, len(ids)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": [ids[i] for i in some],
                        "start": [base + int(ends[i]) for i in some],
                        "n_tokens": [int(ends[i + 1] - ends[i]) for i in some],
                        "ids_crc32": [zlib.crc32(data[ends[i] : ends[i + 1]].astype("<u4").tobytes()) for i in some],
                    }, arrow)

    return spark.range(0, len(bases), 1, max(1, len(bases))).mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encodes docs into shards under `folder` (default: a new one in the shared folder) and reads them back."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    return read_documents(spark, write_shards(docs, tokenizer, folder, end_id))
