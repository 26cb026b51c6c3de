"""Language identification by unigram pieces, with all segmentations of a word summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product
over its words. The probabilities are fitted by expectation-maximisation on a bounded sample.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, letter_words, map_rows

#: Words a worker remembers scores of, a strange letter's log-probability.
REMEMBERED, STRANGE = 1_000_000, -18.0
#: A sum below this is scaled up, so that those of long words don't vanish.
SMALL = 1e-150


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters, with or without the mark of a word's start; numbered."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(p for p in found if p == "▁" or p.removeprefix("▁").isalpha() and p == p.lower()))}


def each_span(same_length: list[str], vocab: dict[str, int], longest: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end in words of one length: (start, words that have a piece from there, the pieces' numbers)."""
    n = len(same_length[0])
    get = vocab.get
    for end in range(1, n + 1):
        row = []
        for start in range(max(0, end - longest), end):
            ids = np.fromiter((get(w[start:end], -1) for w in same_length), np.int64, len(same_length))
            has = np.flatnonzero(ids >= 0)
            if end - start == 1 or len(has):
                row.append((start, has, ids[has]))
        yield row


def spans(same_length: list[str], vocab: dict[str, int], longest: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    return list(each_span(same_length, vocab, longest))


def log_sums(lattice: Iterable, k: int, probs: np.ndarray, strange: float, longest: int) -> np.ndarray:
    """Logarithms of the sums over all segmentations of k words of any length: array (words, languages).

    Only the sums that a piece can still start from are held, and where they get small they are scaled
    up, for each word and language by itself.
    """
    held: deque[np.ndarray] = deque([np.ones((k, probs.shape[1]))], maxlen=longest)
    scale = np.zeros((k, probs.shape[1]))
    for end, row in enumerate(lattice, 1):
        here, first = np.zeros_like(scale), end - len(held)
        for start, has, ids in row:
            if end - start == 1 and len(has) < k:
                none = np.ones(k, bool)
                none[has] = False
                here[none] += held[start - first][none] * strange
            here[has] += held[start - first][has] * probs[ids]
        held.append(here)
        if here.min() < SMALL:
            by = np.where((here < SMALL) & (here > 0), here, 1.0)
            scale += np.log(by)
            for a in held:
                a /= by
    return np.log(held[-1]) + scale


def _ways(row: list, k: int, logs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For one end of k words: (start, words, log-probabilities of what lies between, piece numbers or nothing for strange letters)."""
    for start, has, ids in row:
        if len(has):
            yield start, has, logs[ids], ids
        if start == row[-1][0] and len(has) < k:  # the last start is a letter before the end
            none = np.ones(k, bool)
            none[has] = False
            none = np.flatnonzero(none)
            yield start, none, np.full(len(none), STRANGE), ids[:0]


def expected(lattice: list, weight: np.ndarray, logs: np.ndarray, seen: np.ndarray) -> None:
    """Adds to `seen` how often each piece is expected in words of one length, each counted `weight` times.

    Sums over segmentations are carried as logarithms, forward and backward, so words of any length count.
    """
    k, n = len(weight), len(lattice)
    a, b = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    a[0] = b[n] = 0.0
    for end, row in enumerate(lattice, 1):
        for start, has, log, _ in _ways(row, k, logs):
            a[end, has] = np.logaddexp(a[end, has], a[start, has] + log)
    for end in range(n, 0, -1):
        for start, has, log, ids in _ways(lattice[end - 1], k, logs):
            way = log + b[end, has]
            b[start, has] = np.logaddexp(b[start, has], way)
            if len(ids):
                np.add.at(seen, ids, weight[has] * np.exp(a[start, has] + way - a[n, has]))


def _fit(counts: Counter, vocab: dict[str, int], rounds: int) -> np.ndarray:
    """EM for one language: expected counts of pieces over all segmentations of the counted words."""
    longest = max(map(len, vocab))
    groups: dict[int, list[str]] = defaultdict(list)
    for w in counts:
        groups[len(w)].append(w)
    lattices = [(spans(ws, vocab, longest), np.array([counts[w] for w in ws], float)) for ws in groups.values()]
    prob = np.array([0.5 ** len(p) for p in vocab])
    prob /= prob.sum()
    for _ in range(rounds):
        seen = np.full(len(prob), 0.01)  # the prior leaves no piece without a chance
        for lattice, weight in lattices:
            expected(lattice, weight, np.log(prob), seen)
        prob = seen / seen.sum()
    return prob


def fit(docs: DataFrame, vocabulary: str, per_language: int = 200, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from at most `per_language` documents of each language.

    Learns from text and non-null lang of rows that are not held out, chosen by a hash of doc_id. The
    sample's ids are chosen without their texts; its words are counted where the texts are. Rows that
    are chosen by id and language come with all rows of that id and language, of which one is taken.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    sample = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        vocab = pieces(vocabulary)
        counts = Counter("▁" + w for t in rows["text"] for w in letter_words(t))
        prob = _fit(counts, vocab, rounds) if counts else np.full(len(vocab), 1 / len(vocab))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "prob": [prob]})

    fitted = sorted(sample.groupBy("lang").applyInPandas(learn, "lang string, prob array<double>").collect())
    return [r.lang for r in fitted], np.array([r.prob for r in fitted])


class Scorer:
    """Log-probabilities of words under each language, remembered by word."""

    def __init__(self, vocab: dict[str, int], probs: np.ndarray) -> None:
        self.vocab, self.longest = vocab, max(map(len, vocab))
        self.probs = np.ascontiguousarray(probs.T)
        self.table, self.at = np.zeros((0, len(probs))), {}

    def learn(self, new: list[str]) -> None:
        if len(self.at) > REMEMBERED:
            self.table, self.at = self.table[:0], {}
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(new):
            groups[len(w)].append(i)
        rows = np.zeros((len(new), self.probs.shape[1]))
        for at in groups.values():
            marked = ["▁" + new[i] for i in at]
            rows[at] = log_sums(each_span(marked, self.vocab, self.longest), len(at), self.probs, np.exp(STRANGE), self.longest)
        self.at.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.vstack([self.table, rows])

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log-probabilities of each text; None if it has no letter."""
        each = [letter_words(t) for t in texts]
        need = {w for ws in each for w in ws}
        new = [w for w in need if w not in self.at]
        if new:
            if len(self.at) > REMEMBERED:
                new = list(need)
            self.learn(new)
        return [self.table[list(map(self.at.__getitem__, ws))].sum(0) if ws else None for ws in each]


_scorers: dict[bytes, Scorer] = {}


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    lang_pred is the language under which the text is likeliest, all being equally likely before
    (ties: the first in order); score is its probability given the text. Null texts, texts without a
    letter, and every text if no language was learned, get `und` and 0. Other columns are ignored;
    an empty table gives no rows. No shuffle.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        key = hashlib.blake2b(probs.tobytes() + repr((langs, probs.shape, vocabulary)).encode()).digest()
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(pieces(vocabulary), probs) if langs else None
        scorer = _scorers[key]
        for b in batches:
            names, chances = [], []
            for total in scorer.scores(b["text"]) if scorer else [None] * len(b["text"]):
                if total is None:
                    names.append("und")
                    chances.append(0.0)
                    continue
                p = np.exp(total - total.max())
                names.append(langs[int(total.argmax())])
                chances.append(float(p.max() / p.sum()))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names, "score": chances}

    marked = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return map_rows(marked, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, lang_pred string, score double", rows, 512)


def identify(docs: DataFrame, vocabulary: str, per_language: int = 200, rounds: int = 2) -> DataFrame:
    """Fits on the rows of docs that are not held out and predicts every row."""
    return predict(docs, *fit(docs, vocabulary, per_language, rounds), vocabulary)
