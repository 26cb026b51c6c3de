"""Toxic passages by maximum-scoring segment search.

Every word of a text has a score, wherever it comes: the log-odds of documents with it being toxic, under a Dirichlet prior that
draws rare words to the corpus's own shares, less two standard errors; words without evidence
cost a little. One linear scan finds all maximal-scoring segments of a text. A segment's score is judged by
the extreme-value law for such maxima: in a text of n words, segments of score S or more turn up by
chance E = K n exp(-lambda S) times. What significant segments exceed chance by adds up over the text,
and a logistic curve fitted to labelled texts turns that into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, held_out, letter_words, map_rows, release, slices

#: Cost of a word without evidence; the prior's weight in documents, or fewer if there are fewer toxic ones; standard
#: errors taken off; K of the extreme-value law.
DRIFT, PRIOR, DOUBT, K = 0.2, 100.0, 2.0, 0.1
#: What fit() chooses the least score that is evidence from, by the loss on the texts it learns from.
LEAST = (0.0, 0.5, 1.0, 1.5)
NOTHING = -12.0
#: Lengths of beginnings; words whose scores a worker remembers.
STEMS, REMEMBERED = (4, 5, 6), 500_000


def features(word: str) -> list[str]:
    """The word, and its beginnings of a few lengths, which inflected words share."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


class WordScores(dict):
    """Scores of words, the best of their features' or 0 if that is under `least`, worked out when first asked for."""

    def __init__(self, weights: dict[str, float], least: float = 0.0) -> None:
        super().__init__()
        self.weights, self.least = weights, least

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        score = max(self.weights.get(f, 0.0) for f in features(word))
        self[word] = score = score if score >= self.least else 0.0
        return score


@dataclass
class Segment:
    """Words start..end (exclusive) of a text, their score, and how often chance gives as much."""

    start: int
    end: int
    score: float
    expected: float = math.nan


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[Segment]:
    """All maximal-scoring segments of a text whose words at `places` have positive scores and all others cost drift.

    Each place becomes a segment, and is joined to the nearest earlier one that starts lower while that
    raises the total. A segment knows the nearest earlier one that starts lower than itself, and what lies
    between them is never looked at again: linear in the number of places.
    """
    # per segment: start, end, sum before it, sum up to its end, the nearest earlier one with a lower sum before it
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for at, s in zip(places, scores):
        total -= drift * (at - last)
        start, before, total, last = at, total, total + s, at + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, _, before, _, lower = found[j]
            del found[j:]
            j = lower
        found.append((start, last, before, total, j))
    return [Segment(a, b, up - low) for a, b, low, up, _ in found]


@dataclass
class Model:
    """weights: positive scores of features, those from `least` on count; rate: lambda of the extreme-value law; slope, shift of the curve."""

    weights: dict[str, float]
    rate: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    least: float = 0.0

    def known(self) -> WordScores:
        return WordScores(self.weights, self.least)

    def segments(self, ws: list[str], scores: WordScores) -> list[Segment]:
        return self.judged(ws, [scores[w] for w in ws])

    def judged(self, ws: list[str], each: list[float]) -> list[Segment]:
        places = [i for i, x in enumerate(each) if x]
        out = maximal_segments(places, [each[i] for i in places])
        for s in out:
            s.expected = K * len(ws) * math.exp(-self.rate * s.score)
        return out

    @staticmethod
    def excess(found: list[Segment]) -> float:
        """Sum over segments that chance gives less than once of -ln E; the best -ln E if there is none."""
        logs = [-math.log(max(s.expected, 1e-300)) for s in found]
        return sum(x for x in logs if x > 0) if any(x > 0 for x in logs) else max([NOTHING, *logs])

    def score(self, found: list[Segment]) -> float:
        z = self.slope * _level(self.excess(found)) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _level(excess):
    """Excess on a scale on which a long text's many passages don't outweigh everything."""
    return np.sign(excess) * np.log1p(np.abs(excess))


def weight(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-odds ratio of document counts under a Dirichlet prior, less DOUBT standard errors; 0 where that is negative."""
    toxic, clean = np.maximum(toxic, 0.0), np.maximum(clean, 0.0)
    mass = max(min(PRIOR, n_toxic), 1.0)
    prior = np.maximum(mass * (toxic + clean) / max(n_toxic + n_clean, 1.0), 1e-9)
    odds = np.log((toxic + prior) / (n_toxic + mass - toxic - prior)) - np.log((clean + prior) / (n_clean + mass - clean - prior))
    sure = odds - DOUBT * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.maximum(sure, 0.0)


def _rate(weights: np.ndarray, share: np.ndarray) -> float:
    """lambda with sum p exp(lambda s) = 1 over the words of clean texts; at most 2."""
    rest = max(0.0, 1 - share.sum())
    low, high = 1e-3, 2.0
    value = lambda x: (share * np.exp(np.minimum(x * weights, 700))).sum() + rest * math.exp(-x * DRIFT) - 1
    if value(high) <= 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) <= 0 else (low, mid)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    scale = max(float(np.abs(x).max()), 1.0) if len(x) else 1.0
    x = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> Model | None:
    """A model from at most `per_class` labelled documents of each class, chosen by a hash of doc_id.

    Held-out rows are never used. Words count once a document, for lambda as often as clean ones use them; only those in three or more of the
    sample's documents (two, if the sample has fewer than 300 toxic ones) reach the driver. Each
    labelled text is scored for the curve as if its own words had not been counted, and by the loss of
    these scores the least score that is evidence is chosen. Without labels of both classes there is no
    model.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = cut(known.where("toxic = 1").orderBy(*by_hash).limit(per_class).unionAll(known.where("toxic = 0").orderBy(*by_hash).limit(per_class)))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            each, uses = {0: Counter(), 1: Counter()}, Counter()
            for t, y in zip(b["text"], b["toxic"]):
                found = letter_words(t)
                each[y].update({f for w in set(found) for f in features(w)})
                each[y][""] += len(found)  # no word: how long texts are
                if not y:
                    for w, n in Counter(found).items():
                        for f in features(w):
                            uses[f] += n
            ws = list(each[0].keys() | each[1].keys())
            yield {"word": ws, "toxic": [each[1][w] for w in ws], "clean": [each[0][w] for w in ws], "uses": [uses[w] for w in ws]}

    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    least = 3 if n1 >= 300 else 2
    counts = map_rows(sample, ["text", "toxic"], "word string, toxic long, clean long, uses long", count, 256)
    table = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("uses").alias("uses")).where((F.col("toxic") >= 1) & (F.col("toxic") + F.col("clean") >= least)).toPandas()
    length = table.loc[table["word"] == "", "clean"].sum()
    table = table[table["word"] != ""].sort_values("word")
    t, c, uses = (table[x].to_numpy(float) for x in ("toxic", "clean", "uses"))
    w = weight(t, c, n1, n0)
    weights, less_toxic, less_clean = ({x: float(v) for x, v in zip(table["word"], vs) if v > 0} for vs in (w, weight(t - 1, c, n1 - 1, n0), weight(t, c - 1, n1, n0 - 1)))
    share = uses / max(length, 1.0)
    models = [Model(weights, _rate(w[on], share[on]), least=x) for x in LEAST for on in [(w > 0) & (w >= x)]]

    def rate(batches: Iterator[dict]) -> Iterator[dict]:
        less = (WordScores(less_clean), WordScores(less_toxic))
        for b in batches:
            each = []
            for text, y in zip(b["text"], b["toxic"]):
                ws = letter_words(text)
                scores = [less[y][w] for w in ws]
                each.append([m.excess(m.judged(ws, [x if x >= m.least else 0.0 for x in scores])) for m in models])
            yield {"x": each, "y": [float(y) for y in b["toxic"]]}

    seen = map_rows(sample, ["text", "toxic"], "x array<double>, y double", rate, 256).toPandas()
    x, y = _level(np.array(seen["x"].tolist())), seen["y"].to_numpy()
    losses = []
    for k, m in enumerate(models):
        order = np.lexsort((y, x[:, k]))  # sums don't depend on the order that rows come in
        m.slope, m.shift = _logistic(x[order, k], y[order])
        z = np.clip(m.slope * x[order, k] + m.shift, -500, 500)
        losses.append(float(np.logaddexp(0, np.where(y[order] > 0, -z, z)).sum()))
    return models[int(np.argmin(losses))]


def predict(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_segments, n_toxic_words) for every row of docs.

    score is the probability of label 1; null and empty texts have no segment and get the score of
    such texts, as do all texts if there is no model (then 0). n_segments and n_toxic_words describe
    the significant passages. Null ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows. No shuffle.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        known = model.known() if model else {}
        for b in batches:
            scores, passages, size = [], [], []
            for text in b["text"]:
                ws = letter_words(text) if model else []
                found = model.segments(ws, known) if model else []
                scores.append(model.score(found) if model else 0.0)
                found = [s for s in found if s.expected < 1]
                passages.append(len(found))
                size.append(sum(s.end - s.start for s in found))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores], "n_segments": passages, "n_toxic_words": size}

    marked = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return map_rows(marked, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, score double, predicted int, n_segments long, n_toxic_words long", rows, 512)


def detect(docs: DataFrame, labels: DataFrame, per_class: int = 6000, threshold: float = 0.7) -> DataFrame:
    """Fits on labelled rows of docs that are not held out and scores every row."""
    return predict(docs, fit(docs, labels, per_class), threshold)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """Rows of docs whose score is under threshold; all columns stay, and all rows if there is no model. No shuffle."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for whole in batches:
            for b in slices(whole, 512, 4 << 20):
                good = [model.score(model.segments(letter_words(t.as_py()), known)) < threshold for t in b.column("text")]
                yield b.filter(pa.array(good, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
