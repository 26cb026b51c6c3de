"""Evidence policies, TF-IDF with its fallbacks, the second parser, families and report wording against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import policies, quality, reports, retrieval

PRIORITY = {"supports": 0, "against": 0, "ambiguous": 1, "none": 2}


def test_policies_brute_force(spark):
    rnd = random.Random(3)
    keys = [(p, i) for p in range(6) for i in range(1, 4)]
    ranked = [(p, i, r, f"w{r}", r / 10, f"t{p}.{i}.{r}") for p, i in keys if (p, i) != (5, 3) for r in range(1, rnd.randrange(2, 6))]
    judged = {(p, i, d): rnd.choice(["supports", "against", "ambiguous", "none"]) for p, i, _, d, _, _ in ranked if rnd.random() < 0.8}
    sets = {k: rnd.choice(["none", "supports"]) for k in keys[:9]}
    base = spark.createDataFrame([(*k, "extra") for k in keys], "participant_id long, item_id int, transcript string")
    rows = spark.createDataFrame(ranked, "participant_id long, item_id int, rank int, doc_id string, score double, text string")
    j = spark.createDataFrame([(*k, s) for k, s in judged.items()], "participant_id long, item_id int, doc_id string, status string")
    s = spark.createDataFrame([(*k, v) for k, v in sets.items()], "participant_id long, item_id int, status string")
    t = spark.createDataFrame([(p, f"all of {p}") for p in range(5)], "participant_id long, text string")
    got = policies.evidence_policies(base, rows, j, s, t)
    want, counts = {}, Counter()
    for k in keys:
        mine = [(r, d, sc, x, judged.get((*k, d), "none")) for p, i, r, d, sc, x in ranked if (p, i) == k]
        kept = [m for m in sorted(mine) if m[4] != "none"]
        fell = sets.get(k) == "none" or not kept
        lists = {"filter": kept, "informative_first": sorted(kept, key=lambda m: PRIORITY[m[4]]), "fallback": [(1, "__transcript__", 1.0, f"all of {k[0]}" if k[0] < 5 else "", "")] if fell else kept}
        for policy, rows_ in lists.items():
            want[(*k, policy)] = ([m[1] for m in rows_], [m[2] for m in rows_], " [WINDOW_SEP] ".join(m[3] for m in rows_), fell and policy == "fallback")
            counts[policy, "changed"] += not (fell and policy == "fallback") and len(rows_) != len(mine)
            counts[policy, "emptied"] += not rows_
            counts[policy, "fell_back"] += fell and policy == "fallback"
    assert {(r.participant_id, r.item_id, r.policy): (r.ids, r.scores, r["pack"], r.fell_back) for r in got.collect()} == want
    for r in policies.policy_counts(got).collect():
        assert (r.n, r.changed, r.emptied, r.fell_back) == (len(keys), *(counts[r.policy, c] for c in ("changed", "emptied", "fell_back")))
    assert policies.evidence_policies(base.limit(0), rows, j, s, t).count() == 0


def plain_tfidf(texts, query, k, stop):
    """[(doc number, score or None)] of one participant: vectors of words and pairs fitted on the query and its documents."""
    live = [(i, t) for i, t in enumerate(texts) if t and t.strip()]
    if not live or not query.strip():
        return [(i, None) for i, _ in live[:k]]
    words = lambda t: [w for w in tokens(t) if len(w) > 1 and w not in stop]
    valid = [(i, t) for i, t in live if tokens(t)]
    if not valid:
        return [(i, None) for i, _ in live[:k]]
    grams = lambda t: (w := words(t)) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    docs = [Counter(grams(query))] + [Counter(grams(t)) for _, t in valid]
    df = Counter(g for d in docs for g in d)
    if not df:
        return [(i, None) for i, _ in valid[:k]]
    vec = [{g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in d.items()} for d in docs]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    score = lambda n: round(sum(x * vec[0].get(g, 0) for g, x in vec[n].items()) / (norm[0] * norm[n]), 9) if norm[0] and norm[n] else 0.0
    return sorted(((i, score(n)) for n, (i, _) in enumerate(valid, 1)), key=lambda x: (-x[1], -x[0]))[:k]


def tokens(t):
    import re

    return re.sub(r"[^a-z0-9\s']+", " ", t.lower()).split()


@pytest.mark.parametrize("own", [True, False])
def test_tfidf_with_fallbacks(spark, own):
    stop = T.STOPWORDS if own else retrieval.english_stopwords(spark)
    assert own or (len(stop) > 150 and {"the", "because", "yourself"} <= set(stop))
    rnd = random.Random(4)
    people = {
        "a": [" ".join(rnd.choices(["sleep", "the", "night", "is", "tired", "eat", "x", "of"], k=rnd.randrange(1, 7))) for _ in range(9)] + ["", None, "  "],
        "stop": ["the of", "is", "to be", "", "a"], "marks": ["!!", "...", " - "], "blank": ["", None], "one": ["sleep"],
    }
    queries = {1: "sleep at night", 2: "the of", 3: "  ", 4: "zebra", 5: "tired tired eat"}
    rows = [(p, f"{p}{i}", i, t) for p, ts in people.items() for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "participant_id string, doc_id string, pos long, text string").withColumn("tokens", T.tokens(F.col("text")))
    asked = spark.createDataFrame(list(queries.items()), "item_id int, text string").withColumn("tokens", T.tokens(F.col("text")))
    got = {}
    for r in retrieval.tfidf_top(docs, asked, 4, stop).collect():
        got.setdefault((r.participant_id, r.item_id), []).append((r["rank"], r.doc_id, r.score, r.fallback))
    want = {}
    for p, ts in people.items():
        for q, t in queries.items():
            found = plain_tfidf(ts, t, 4, set(stop))
            if found:
                want[p, q] = [(n, f"{p}{i}", s, s is None) for n, (i, s) in enumerate(found, 1)]
    assert set(got) == set(want)
    for k, rows_ in want.items():
        mine = sorted(got[k])
        assert [(n, d, f) for n, d, _, f in mine] == [(n, d, f) for n, d, _, f in rows_], k
        assert all(a[2] == b[2] or abs(a[2] - b[2]) < 1e-8 for a, b in zip(mine, rows_))


def test_set_judgments(spark):
    cases = {
        '{"status": "supports", "severity_hint": 2, "reason": "' + "r" * 200 + '"}': ("supports", 2, "r" * 200),
        '{"status": " None ", "severity_hint": "2"}': ("none", None, ""),
        '{"status": "against", "severity_hint": true, "reason": "x"}': ("against", 1, "x"),
        '{"status": "against", "severity_hint": 7}': ("against", None, ""),
        '{"status": "ambiguous", "severity_hint": -0.5}': ("ambiguous", 0, ""),
        "status = Against, severity_hint: 3": ("against", None, "[unparsed reason]"),
        '{"status": "odd"} status: none': ("none", None, "[unparsed reason]"),
        "": (None, None, "[unparseable output]"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", T.salvage_set_judgment(F.col("raw")).alias("x")).select("raw", "x.*")
    assert {r.raw: (r.status, r.severity_hint, r.reason) for r in df.collect()} == cases


def test_families_prefer_longer_beginnings(spark):
    names = {"a/b": "long", "a/": "short", "x": "other x"}
    df = spark.createDataFrame([("a/b1",), ("a/c",), ("xa/b",), ("z",)], "run string").select("run", T.experiment_family(F.col("run"), names, "rest").alias("f"))
    assert {r.run: r.f for r in df.collect()} == {"a/b1": "long", "a/c": "short", "xa/b": "other x", "z": "rest"}


def test_reports_are_worded_by_templates(spark):
    rows = [(1, 2, "B", 3, 0.9, "supports", 0, "so it is"), (1, 1, "A", None, 0.5, None, 2, None), (1, 3, "C", 1, 0.45, "ambiguous", None, None), (2, 1, "A", 0, 0.2, "against", 3, "")]
    df = spark.createDataFrame(rows, "participant_id long, item_id int, name string, prediction int, p_max double, status string, self_score int, snippet string")
    short = {k: f"{k}" for k in reports.TEMPLATES} | {"scored": "{name}={prediction} {confidence} {clause}", "unscored": "{name}?", "followup": "see {names}", "contradiction": "{name}!", "head": "{participant_id} {total} {band} {self_total}"}
    got = {r.participant_id: r.report.split("\n") for r in reports.rendered(df, short).collect()}
    assert got[1] == ["1 4 minimal 2", "high", "B=3 high supports", "lower", "C=1 moderate ambiguous_bare", "missing", "A?", "contradictions", "B!", "not_discussed", "interview_only", "see A, B", "end"]
    assert got[2] == ["2 0 minimal 3", "high", "none", "lower", "A=0 low against", "contradictions", "A!", "see A", "end"]
    assert all("{" not in r.report for r in reports.rendered(df).collect())


def test_rows_are_coerced_and_none_is_dropped(spark):
    rows = [(" a ", "3.0", "2", " x\n", "TRAIN", 1), ("\t", "9", "0", "", "test", 1), (None, None, None, None, None, 1), ("b", "1", "1.5", "y", "dev", 1), ("b", "1e20", "NaN", "y", "dev ", 1), ("b", "1", "1", "y", "dev", 1), ("b", "1", "1", "y", "dev", 1)]
    df = spark.createDataFrame(rows, "participant_id string, item_id string, label string, text string, split string, problems int")
    got = [tuple(r) for r in quality.coerced_items(df, splits=("train", "dev")).collect()]
    assert got[0] == ("a", 3, 2, "x", "train", [])
    assert got[1] == (None, 9, 0, None, "test", ["null_participant", "item_domain", "blank_text", "unknown_split"])
    assert got[2] == (None, None, None, None, None, ["null_participant", "item_domain", "label_domain", "blank_text", "unknown_split"])
    assert got[3] == ("b", 1, None, "y", "dev", ["label_domain"])
    assert got[4][1:3] == (None, None) and got[5] == got[6] == ("b", 1, 1, "y", "dev", [])
    numbers = spark.createDataFrame([(7, 2, 3.0, "t")], "participant_id long, item_id int, label double, text string")
    assert tuple(quality.coerced_items(numbers).first()) == ("7", 2, 3, "t", None, [])
    assert quality.coerced_items(df.limit(0)).count() == 0


def test_reports_of_examples(spark):
    df = spark.createDataFrame([("s", 2, "b", "two\nlines"), ("s", 1, None, None), ("s", 3, "c", "z"), (None, 1, "d\ne", "w")], "part string, n int, name string, said string")
    got = {r.part: r.report for r in reports.qualitative(df, "part", ["n"], ["name", "n"], "said", "Part", 2).collect()}
    assert got["s"] == "## Part s\n\n2 of 3 rows\n\n### 1\n\n**name** -, **n** 1\n\n> \n\n### 2\n\n**name** b, **n** 2\n\n> two\n> lines"
    assert got[None].startswith("## Part -\n\n1 of 1 rows\n\n### 1\n\n**name** d e, **n** 1\n\n> w")
    assert reports.qualitative(df.limit(0), "part", ["n"], ["name"], "said", "Part", 2).count() == 0
