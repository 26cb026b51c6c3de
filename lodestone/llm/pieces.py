"""Encoding into pieces, best first: Viterbi forward, A-star backward.

The pieces that match in a text form a lattice; a segmentation is a path, its score the sum of its
pieces' scores. Forward Viterbi gives for every place the best score of any path up to it. The search
runs from the end: what a partial path has gathered plus that best score is exactly the best total it
can still reach, so complete paths leave the queue in order of their scores, best first, and nothing
that isn't on a path to one of the n best is expanded without need.

No piece crosses the start of a word (the mark stands only in front), so a text's lattice is a chain
of its words' lattices. The search is run once for each different word a worker meets; the n best of
a text follow from its words' n best by the same kind of queue over their losses.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.common import map_rows

REMEMBERED = 200_000
#: Documents, and bytes of their texts, whose words are looked up together, and documents whose results leave together.
GROUP, GROUP_BYTES, RESULTS = 2048, 8 << 20, 128
#: Words whose further segmentations a worker remembers.
OPENED = 5000
_WORDS = re.compile(r"▁+[^▁\n]*|[^▁\n]+|\n")
_LETTER = re.compile(r"[^\W\d_]")
MARK = "▁"
#: For marks in a text itself; no valid text has a lone surrogate.
STAND_IN = "\ud800"

#: Of a word: ids of the best segmentation as bytes, their number, its score, and the losses of the next ones.
Found = tuple[bytes, int, float, tuple[float, ...]]


class Lattice:
    """Pieces of a SentencePiece model file with their scores; bytes stand in for what has no piece."""

    def __init__(self, path: str, byte_penalty: float = 10.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.scores = {self.names[i]: (i, sp.get_score(i)) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        #: Sums of whole numbers are exact; others are compared to nine places.
        self.whole = all(float(s).is_integer() for _, s in self.scores.values())
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for single bytes")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max(map(len, self.scores))
        #: Every end of a piece: the piece's score and id, or None if it is only an end.
        self.tails: dict[str, tuple[float, tuple[int, ...]] | None] = {p[-k:]: None for p in self.scores for k in range(1, len(p))}
        self.tails.update((p, (s, (i,))) for p, (i, s) in self.scores.items())
        #: Marks that no piece holds right behind a letter: a text falls apart there, too. What counts as one by the pattern but
        #: stands before a mark in some piece, a raised two for one, is no letter here.
        before = {m: {x for p in self.scores for x, y in zip(p, p[1:]) if y == m and _LETTER.match(x)} for m in ".,;:!?"}
        self.marks = "".join(m for m, xs in before.items() if not any(map(str.isalpha, xs)))
        others = "".join(sorted(set().union(*(before[m] for m in self.marks))))
        self.behind = re.compile(rf"(?<=[^\W\d_{re.escape(others)}])([{re.escape(self.marks)}])") if self.marks else None
        #: What an id reads as; bytes over 127 only read together.
        self.texts = [chr(self.values[i]) if self.values.get(i, 128) < 128 else n.replace(MARK, " ") for i, n in enumerate(self.names)]
        self.joint = np.array([self.values.get(i, 0) >= 128 for i in range(size)])
        self.byte_score = min(s for _, s in self.scores.values()) - byte_penalty
        self.known: dict[str, Found] = {}
        self.opened: dict[tuple[str, int], list[bytes]] = {}

    def extend(self, word: str, shared: int, best: list[float], edges: list[list[tuple[int, float, tuple[int, ...]]]]) -> None:
        """Brings best (the best score of any path up to each place) and edges ((start, score, ids) that end there) to word.

        Up to place `shared` they stand for the word's beginning already: words in order share beginnings.
        """
        look, longest = self.tails.get, self.longest
        del best[shared + 1 :], edges[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            row, top = [], -1e300
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                hit = look(word[start:end], 0)
                if hit:
                    score, ids = hit
                    row.append((start, score, ids))
                    if best[start] + score > top:
                        top = best[start] + score
                elif hit == 0:  # no piece ends like this
                    break
            if word[end - 1] not in self.scores:
                raw = word[end - 1].encode()
                score = self.byte_score * len(raw)
                row.append((end - 1, score, tuple(self.bytes[b] for b in raw)))
                top = max(top, best[end - 1] + score)
            best.append(top)
            edges.append(row)

    def forward(self, word: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        best, edges = [0.0], [[]]
        self.extend(word, 0, best, edges)
        return best, edges

    @staticmethod
    def search(best: list[float], edges: list, whole: bool) -> Iterator[tuple[float, tuple[int, ...]]]:
        """All segmentations as (score, ids), best first; of equal ones the one that is complete first.

        Among equal bounds the path nearest to the start of the word goes on, so ties, which a long word
        of one letter has without number, are not all opened. Paths share their ends.
        """
        queue: list = [(-best[-1], len(best) - 1, 0, 0.0, None)]
        push, pop, number = heapq.heappush, heapq.heappop, 0
        while queue:
            _, end, _, got, tail = pop(queue)
            if not end:
                out: list[int] = []
                while tail is not None:
                    out += tail[0]
                    tail = tail[1]
                yield got, tuple(out)
                continue
            for start, score, ids in edges[end]:
                more = got + score
                number += 1
                bound = -more - best[start]
                push(queue, (bound if whole else round(bound, 9), start, number, more, (ids, tail)))

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return list(islice(self.search(*self.forward(word), self.whole), n))

    def split(self, text: str) -> list[str]:
        """Words with their marks. A mark in the text itself becomes STAND_IN."""
        if not text:
            return []
        marked = MARK + text.replace(MARK, STAND_IN).replace(" ", MARK)
        if "▁▁" in marked or "\n" in marked:
            return _WORDS.findall(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def _words(self, words: list[str], n: int) -> dict[str, Found]:
        """The n best of each word."""
        out = {}
        best, edges, last = [0.0], [[]], ""
        for word in sorted(words):
            if STAND_IN in word:
                out[word] = self._spelled(word, n)
                continue
            shared = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                shared += 1
            self.extend(word, shared, best, edges)
            last = word
            found = list(islice(self.search(best, edges, self.whole), n))
            top, ids = found[0]
            out[word] = array("I", ids).tobytes(), len(ids), top, tuple([top - s for s, _ in found[1:]])
        return out

    def _word(self, word: str, n: int) -> Found:
        return self._words([word], n)[word]

    def _spelled(self, word: str, n: int) -> Found:
        """A word with marks of its own: its parts' lattices in a chain, the marks in bytes."""
        chain = self._chain(word, n)
        choices = least_choices([(i, f[3]) for i, (_, f) in enumerate(chain) if f[3]], n)
        return b"".join(f[0] for _, f in chain), sum(f[1] for _, f in chain), sum(f[2] for _, f in chain), tuple([x for x, _ in choices[1:]])

    def _chain(self, word: str, n: int) -> list[tuple[str, Found]]:
        mark = np.array([self.bytes[b] for b in MARK.encode()], "<u4").tobytes()
        out: list[tuple[str, Found]] = []
        for k, part in enumerate(word.split(STAND_IN)):
            if k:
                out.append((STAND_IN, (mark, 3, 3 * self.byte_score, ())))
            if part:
                out.append((part, self._word(part, n)))
        return out

    def others(self, word: str, n: int) -> list[bytes]:
        """Ids of the segmentations of a word after the best, in the order of their losses."""
        out = self.opened.get((word, n))
        if out is None:
            if STAND_IN in word:
                out = self.nbest_ids(self._chain(word, n), n)[0][1:]
            else:
                out = [array("I", ids).tobytes() for _, ids in self.nbest(word, n)[1:]]
            if len(self.opened) >= OPENED:
                self.opened.clear()
            self.opened[word, n] = out
        return out

    def nbest_ids(self, chain: list[tuple[str, Found]], n: int) -> tuple[list[bytes], list[float]]:
        """Ids and scores of the n best of a chain of words."""
        total = sum(f[2] for _, f in chain)
        choices = least_choices([(k, f[3]) for k, (_, f) in enumerate(chain) if f[3]], n)
        starts = np.cumsum([0, *(f[1] for _, f in chain)]).tolist()
        best = b"".join(f[0] for _, f in chain)
        return [replaced(best, [(starts[k], chain[k][1][1], self.others(chain[k][0], n)[r - 1]) for k, r in c.items()]) for _, c in choices], [total - x for x, _ in choices]

    def _known(self, words: list[str], n: int) -> list[Found]:
        found = list(map(self.known.get, words))
        new = self._words([w for w, f in zip(words, found) if f is None], n)
        if len(self.known) < REMEMBERED:  # frequent words come first, so what is full is what's wanted
            self.known.update(new)
        return [new[w] if f is None else f for w, f in zip(words, found)]

    def _plain(self, t: str) -> bool:
        return bool(t) and t[0] not in self.marks + " " and t[-1] != " " and not ("  " in t or " \n" in t or "\n " in t or MARK in t or any(" " + m in t for m in self.marks))

    def encode(self, texts: list[str], n: int) -> list[tuple[bytes, int, list[float]]]:
        """For each text: ids of the best segmentation as 32-bit numbers, how many, and the n best scores."""
        return [(ids[0], len(ids[0]) // 4, scores) for ids, scores in self.encode_nbest(texts, n)]

    def encode_nbest(self, texts: list[str], n: int) -> list[tuple[list[bytes], list[float]]]:
        """For each text: ids of the n best segmentations as 32-bit numbers, best first, and their scores.

        Words of plain texts are told apart by Arrow, so that only different ones are looked up, and NumPy
        lays their ids out; the others are divided one by one.
        """
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        out: list = [None] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            ws = self.split(texts[i])
            found = dict(zip(dict.fromkeys(ws), self._known(list(dict.fromkeys(ws)), n)))
            out[i] = self.nbest_ids([(w, found[w]) for w in ws], n)
        if not plain:
            return out
        # a line feed, and a mark behind a letter, starts a word of its own, which has no mark of a word's start
        apart = [texts[i].replace("\n", " \n") for i in plain]
        if self.behind:
            apart = [self.behind.sub(r" \1", t) for t in apart]
        lists = pc.split_pattern(pa.array(apart, pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, bare = coded.indices.to_numpy(), self.marks + "\n"
        ws = [w if w and w[0] in bare else MARK + w for w in coded.dictionary.to_pylist()]
        found = self._known(ws, n)
        sizes = np.fromiter((f[1] for f in found), np.int64, len(found))
        scores = np.fromiter((f[2] for f in found), float, len(found))
        second = np.fromiter((f[3][0] if f[3] else np.inf for f in found), float, len(found))
        flat, starts = np.frombuffer(b"".join([f[0] for f in found]), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1])]
        totals, counts = np.add.reduceat(scores[codes], bounds[:-1]), np.add.reduceat(each, bounds[:-1])
        place = 0
        for i, a, b, total, count in zip(plain, bounds.tolist(), bounds[1:].tolist(), totals.tolist(), counts.tolist()):
            here = codes[a:b]
            few = range(len(here)) if len(here) < n else np.argpartition(second[here], n - 2)[: n - 1].tolist() if n > 1 else []
            choices = least_choices([(a + k, found[here[k]][3]) for k in few if found[here[k]][3]], n)
            best = ids[place : place + count].tobytes()
            out[i] = [replaced(best, [(int(ends[k] - each[k]) - place, int(each[k]), self.others(ws[codes[k]], n)[r - 1]) for k, r in c.items()]) for _, c in choices], [total - x for x, _ in choices]
            place += count
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids were made from: pieces joined, bytes read as UTF-8, marks as spaces."""
        if not self.joint[ids].any():
            return "".join(map(self.texts.__getitem__, ids.tolist()))[1:]
        out: list[str] = []
        raw = bytearray()
        for i in ids.tolist():
            if i in self.values:
                raw.append(self.values[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.names[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


def least_choices(losses: list[tuple[int, tuple[float, ...]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n least sums of one loss from each of the words (place, losses of its second, third, ... best), 0 being every word's first.

    Each with the words it takes another than the best of: place -> 1 for the second best, 2 for the
    third. Only the n - 1 words with the least second losses can matter.
    """
    sums: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    if n < 2:
        return sums
    for place, more in heapq.nsmallest(n - 1, losses, key=lambda x: x[1]):
        sums = heapq.nsmallest(n, [*sums, *((x + y, {**c, place: r}) for x, c in sums for r, y in enumerate(more, 1))], key=lambda x: x[0])
    return sums


def replaced(best: bytes, words: list[tuple[int, int, bytes]]) -> bytes:
    """Ids of a text with those of some words, (start, size, ids), replaced by others."""
    out, last = [], 0
    for start, size, ids in sorted(words):
        out += best[4 * last : 4 * start], ids
        last = start + size
    return b"".join([*out, best[4 * last :]])


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def encode_documents(docs: DataFrame, model: str, nbest: int = 3) -> DataFrame:
    """(doc_id, n_pieces, ids, scores, ids_crc32, round_trip, other_ids, nbest_crc32) for every row of docs.

    ids are the best segmentation's, scores the `nbest` best ones' in falling order (fewer, if there
    are no more), ids_crc32 the unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers,
    round_trip whether decoding ids gives the text back; other_ids are the ids of the segmentations
    after the best, in the order of scores, nbest_crc32 the CRC-32 of each, the best's first. Null texts are empty: no ids, one score of 0.
    Null ids and repeated rows stay; other columns are ignored; an empty table gives no rows. No
    shuffle.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        at = lattice(model)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            gc.disable()  # the memory of words has no cycles, and to search it for some costs more than the words
            try:
                found = at.encode_nbest(texts, nbest)
            finally:
                gc.enable()
            for k in range(0, len(texts), RESULTS):  # several lists of ids a text: fewer texts at once
                part = found[k : k + RESULTS]
                found[k : k + RESULTS] = [None] * len(part)
                ids = [[np.frombuffer(i, "<i4") for i in f[0]] for f in part]
                crcs = [list(map(zlib.crc32, f[0])) for f in part]
                yield {
                    "doc_id": b["doc_id"][k : k + RESULTS], "n_pieces": [len(i[0]) for i in ids], "ids": [i[0] for i in ids], "scores": [f[1] for f in part],
                    "ids_crc32": [c[0] for c in crcs], "round_trip": [at.decode(i[0]) == t for i, t in zip(ids, texts[k:])],
                    "other_ids": [i[1:] for i in ids], "nbest_crc32": crcs,
                }

    schema = "doc_id long, n_pieces long, ids array<int>, scores array<double>, ids_crc32 long, round_trip boolean, other_ids array<array<int>>, nbest_crc32 array<long>"
    return map_rows(docs, ["doc_id", "text"], schema, rows, GROUP, GROUP_BYTES)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        at = lattice(model)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [None if i is None else at.decode(np.array(i, "i4")) for i in b["ids"]]}

    return map_rows(encoded, ["doc_id", "ids"], "doc_id long, text string", rows, 128)
