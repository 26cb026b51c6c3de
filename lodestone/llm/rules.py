"""Quality rules learned as a decision list.

Statistics of whole texts come from Spark expressions. From labelled rows, sequential covering
learns an ordered list of rules for bad documents: a rule is a conjunction of thresholds on
statistics, grown on two thirds of the rows by information gain and pruned on the other third, and
what it covers is taken out before the next one is sought. The list becomes one nested conditional
expression of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Fixed value: the white space that parts words.
SPACE = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _shifted(words: Column, by: int) -> Column:
    return F.slice(words, by + 1, F.greatest(F.size(words) - by, F.lit(0)))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs -> doc_id, the columns in `keep`, and statistics of the whole text; null texts have no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words (words in 3-word windows that occur twice or more in the text,
    each word once, first windows included); and for rules n_lines, n_capitals (A-Z), n_marks (`!?`),
    n_distinct.

    Repeated windows are found by sorting each text's window hashes beside their places, and only in
    texts whose windows aren't all different; so a text costs n log n whatever repeats in it. All of
    it stays within a row: no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", *keep, text.alias("t"), F.translate(text, SPACE, " " * len(SPACE)).alias("flat"))
    a = a.withColumn("words", F.filter(F.split("flat", " "), lambda w: w != ""))
    a = a.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(F.translate(x, SPACE, " " * len(SPACE)))) > 0))
    # three words of one hash each; the hash of the three is the window's
    a = a.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    a = a.withColumn("windows", F.when(F.size("hashes") > 2, F.slice(
        F.zip_with(F.zip_with("hashes", _shifted(F.col("hashes"), 1), lambda x, y: F.xxhash64(x, y)), _shifted(F.col("hashes"), 2), lambda xy, z: F.xxhash64(xy, z)),
        1, F.greatest(F.size("hashes") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    a = a.withColumn("ordered", F.when(repeated, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.zip_with(
        F.zip_with(F.concat(none, F.slice("ordered", 1, F.greatest(F.size("ordered") - 1, F.lit(0)))), "ordered", lambda p, x: F.when(p["h"] == x["h"], x["i"])),
        F.concat(_shifted(F.col("ordered"), 1), none),
        lambda found, nxt: F.struct(found.alias("i"), nxt["h"].alias("next")),
    )
    # a place is kept if its window equals the one before or the one after in the sorted order
    kept = F.zip_with(beside, "ordered", lambda b, x: F.coalesce(b["i"], F.when(b["next"] == x["h"], x["i"])))
    a = a.withColumn("places", F.when(F.size("ordered") > 0, F.array_sort(F.filter(kept, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with("places", _shifted(F.col("places"), 1), lambda i, j: F.coalesce(F.least(j - i, F.lit(3)), F.lit(3)))
    count = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    out = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("t", SPACE, "")),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.aggregate(gaps, F.lit(0), lambda s, g: s + g),
        "n_lines": F.size("lines"),
        "n_capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": count("!?"),
        "n_distinct": F.size(F.array_distinct("hashes")),
    }
    return a.select("doc_id", *keep, *(c.cast("long").alias(n) for n, c in out.items()))


def features() -> dict[str, Column]:
    """Ratios that rules may test; 0 where a text has no words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_words": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / chars,
        "marks_a_word": F.col("n_marks") / words,
        "distinct_words": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); `precision` on the rows it was pruned on."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (x[f] <= t if op == "<=" else x[f] > t for f, op, t in self.tests))

    def column(self, of: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, (of[f] <= t if op == "<=" else of[f] > t for f, op, t in self.tests))

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests)


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, covered: np.ndarray, cuts: int) -> tuple[float, tuple[str, str, float] | None]:
    """The test with the greatest gain: bad rows kept times the rise of the log share of bad ones."""
    p0, n0 = (bad & covered).sum(), (~bad & covered).sum()
    base, best = np.log2((p0 + 1) / (p0 + n0 + 2)), (1e-9, None)
    for f, v in x.items():
        values = np.unique(v[covered])
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > cuts:
            middles = np.unique(middles[np.linspace(0, len(middles) - 1, cuts).astype(int)])
        vs, order = v[covered], np.argsort(v[covered], kind="stable")
        hits = np.concatenate([[0], np.cumsum(bad[covered][order])])
        at = np.searchsorted(vs[order], middles, side="right")
        for op, p, n in (("<=", hits[at], at - hits[at]), (">", p0 - hits[at], n0 - (at - hits[at]))):
            gain = p * (np.log2((p + 1) / (p + n + 2)) - base)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, op, float(middles[k])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, least: int = 5, cuts: int = 256, seed: int = 42) -> list[Rule]:
    """Sequential covering. A rule is accepted if it covers at least `least` bad rows and is right at `precision`."""
    rules: list[Rule] = []
    n = len(bad)
    part = np.random.default_rng(seed).permutation(n) % 3
    left = np.ones(n, bool)
    while len(rules) < max_rules and (bad & left).sum() >= least:
        grow, prune = left & (part < 2), left & (part == 2)
        tests: list[tuple[str, str, float]] = []
        covered = grow.copy()
        while len(tests) < max_tests and (~bad & covered).any():
            _, test = _best_test(x, bad, covered, cuts)
            if test is None:
                break
            tests.append(test)
            covered &= Rule((test,), 0.0).covers(x)
        if not tests:
            break

        def worth(k: int) -> float:
            c = Rule(tuple(tests[:k]), 0.0).covers(x) & prune
            p, q = (bad & c).sum(), (~bad & c).sum()
            return (p - q) / (p + q) if p + q else -1.0

        keep = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))  # the shortest of the best
        cover = Rule(tuple(tests[:keep]), 0.0).covers(x) & left
        right = (bad & cover).sum() / max(cover.sum(), 1)
        if (bad & cover).sum() < least or right < precision:
            break
        rules.append(Rule(tuple(tests[:keep]), float(right)))
        left &= ~cover
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule of the list covers: WHEN rule 1 THEN false WHEN ... ELSE true."""
    of, case = features(), None
    for r in rules:
        case = F.when(r.column(of), False) if case is None else case.when(r.column(of), False)
    return F.lit(True) if case is None else case.otherwise(True)


def _labelled(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """rows of at most `sample` labelled documents, chosen by a hash of doc_id from the labels alone, with their quality."""
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return rows.join(F.broadcast(chosen), "doc_id")


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[Rule]:
    """Rules from at most `sample` labelled rows of statistics; what comes to the driver are that many rows of numbers."""
    return _learned(_labelled(stats, labels, sample), **options)


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[Rule]:
    """fit() for documents whose statistics aren't known yet: only the sample's are worked out."""
    return _learned(statistics(_labelled(docs.select("doc_id", "text"), labels, sample), "quality"), **options)


def _learned(labelled: DataFrame, **options) -> list[Rule]:
    rows = labelled.select("doc_id", "quality", *(c.alias(n) for n, c in features().items())).toPandas()
    rows = rows.sort_values(["doc_id", *features()]).reset_index(drop=True)
    return learn({n: rows[n].to_numpy(float) for n in features()}, (rows["quality"] == 0).to_numpy(), **options)


def base_failed() -> Column:
    """Too short, or mostly repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    kept is false if base_failed, else what the learned list says. Without usable labels the list is
    empty. Null texts have no words and so fail; null ids and repeated rows stay; other columns are
    ignored; an empty table gives no rows. The statistics are written once to the shared folder,
    since both learning and judging read them.
    """
    stats = cut(statistics(docs))
    return apply(stats, fit(stats, labels, sample, **options))


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")
    )
