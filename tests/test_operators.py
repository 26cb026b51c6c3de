"""Hand-worked fixtures and randomised comparisons with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import text as T
from lodestone.operators import fusion, inference, judgments, metrics, quality, retrieval, sequences
from lodestone.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def numbers(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_gap_windows_fixture(spark):
    times = [(0, 5), (10, 15), (90, 95), (80, 85), (86, 90)]
    rows = spark.createDataFrame([("p", i, float(a), float(b), f"t{i}") for i, (a, b) in enumerate(times)], "participant_id string, pos int, start_time double, end_time double, text string")
    w = sequences.context_windows(sequences.turns(rows), size=3).orderBy("center_turn_index").collect()
    assert [[int(t[-4:]) for t in r.turn_ids] for r in w] == [[0, 1], [0, 1], [2], [3, 4], [3, 4]]


def test_windows_against_loop(spark):
    rnd, rows, want = random.Random(5), [], {}
    for p in range(40):
        t, turns = 0.0, []
        for i in range(rnd.randrange(1, 12)):
            t += rnd.choice([1, 5, 70, -3])
            turns.append((t, t + 1))
        rows += [(str(p), i, a, b, "x") for i, (a, b) in enumerate(turns)]
        ok = [b[0] >= a[0] and b[0] - a[1] <= 60 for a, b in zip(turns, turns[1:])]
        for i in range(len(turns)):
            lo, hi = i, i
            while i - lo < 2 and lo and ok[lo - 1]:
                lo -= 1
            while hi - i < 2 and hi + 1 < len(turns) and ok[hi]:
                hi += 1
            want[p, i] = hi - lo + 1
    df = spark.createDataFrame(rows, "participant_id string, pos int, start_time double, end_time double, text string")
    got = sequences.context_windows(sequences.turns(df), size=5).collect()
    assert {(int(r.participant_id), r.center_turn_index): r.n_turns for r in got} == want


def test_window_parameters():
    for size, gap in ((2, 60), (0, 60), (3, float("inf")), (3, -1)):
        with pytest.raises(ValueError):
            sequences.check_window_parameters(size, gap)


@pytest.mark.parametrize("counts,budget,kept", [([4, 5, 1], 10, 2), ([20, 1], 10, 1)])
def test_word_budget(spark, counts, budget, kept):
    df = spark.createDataFrame([("k", i + 1, n) for i, n in enumerate(counts)], "k string, rank int, n_words int")
    assert sequences.word_budget(df, ["k"], budget).count() == kept


def test_token_budget_has_no_exception(spark):
    df = spark.createDataFrame([("k", 1, 20), ("k", 2, 1)], "k string, rank int, n_tokens int")
    assert sequences.token_budget(df, ["k"], F.lit(10)).count() == 0


def test_bm25_fixture(spark):
    docs = [["cannot", "fall", "asleep"], ["went", "grocery", "store", "yesterday"], ["asleep", "asleep", "late"]]
    d = spark.createDataFrame([("p", str(i), i, t) for i, t in enumerate(docs)], "participant_id string, doc_id string, pos int, tokens array<string>")
    for query, want in ((["asleep", "fall"], {"0": 1.519197, "2": 0.693732}), (["asleep", "asleep", "fall"], {"0": 2.011347, "2": 1.387465})):
        q = spark.createDataFrame([(1, query)], "item_id int, tokens array<string>")
        got = {r.doc_id: round(r.score, 6) for r in retrieval.bm25_scores(d, q).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_zero_policies(spark):
    d = spark.createDataFrame([("p", str(i), i, [str(i)], ["a"]) for i in range(3)], "participant_id string, doc_id string, pos int, turn_ids array<string>, tokens array<string>")
    q = spark.createDataFrame([(1, ["zz"])], "item_id int, tokens array<string>")
    for policy, n in (("fallback", 2), ("empty", 0), ("positive", 0)):
        got = retrieval.bm25_top(d, q, retrieval.Ranking(k=2, zero_policy=policy)).collect()
        assert len(got) == n and all(r.zero_score_fallback for r in got)


@pytest.mark.parametrize("alpha,want", [(0.5, {"w1": 0.5, "w2": 0.75, "w3": 0.277778}), (0.25, {"w1": 0.25, "w2": 0.875, "w3": 0.416667})])
def test_hybrid_fixture(spark, alpha, want):
    schema = "participant_id string, item_id int, doc_id string, score double, rank int"
    a = spark.createDataFrame([("p", 1, "w1", 4.0, 1), ("p", 1, "w2", 2.0, 2)], schema)
    b = spark.createDataFrame([("p", 1, "w2", 0.9, 1), ("p", 1, "w3", 0.5, 2)], schema)
    assert {r.doc_id: round(r.score, 6) for r in retrieval.hybrid(a, b, alpha).collect()} == pytest.approx(want)


def test_diversity_against_loop(spark):
    rnd = random.Random(1)
    cases = [[("abcdefgh"[i], sorted(rnd.sample(range(6), rnd.randrange(1, 5)))) for i in range(rnd.randrange(1, 8))] for _ in range(150)]
    df = spark.createDataFrame([(n, [(i, [str(t) for t in ts]) for i, ts in c]) for n, c in enumerate(cases)], "n int, c array<struct<id:string,turn_ids:array<string>>>")
    got = {r.n: [x.id for x in r.s] for r in df.select("n", A.choose_diverse(F.col("c"), 3).alias("s")).collect()}
    for n, c in enumerate(cases):
        taken, rest = [], []
        for i, ts in c:
            near = any(len(set(ts) & set(u)) / min(len(ts), len(u)) > 0.5 for _, u in taken)
            (taken if len(taken) < 3 and not near else rest).append((i, ts))
        assert got[n] == [i for i, _ in (taken + rest)[:3]]


def test_diversity_fixture(spark):
    ranked = F.array(*(F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, ts)).alias("turn_ids")) for i, ts in (("A", "123"), ("B", "234"), ("C", "78"))))
    r = one(spark, two=A.choose_diverse(ranked, 2), three=A.choose_diverse(ranked, 3))
    assert [x.id for x in r.two] == ["A", "C"] and [x.id for x in r.three] == ["A", "C", "B"]


def test_metrics_fixture(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 2, 3, 3], [0, 1, 1, 0, 3, 2])), "label int, prediction int")
    m = metrics.item_metrics(metrics.cells(df)).first()
    want = {"accuracy": 0.5, "macro_f1": 0.458333, "qwk": 0.647059, "mae": 0.666667, "far_off_rate": 1 / 6, "severe_recall": 0.5, "false_severe_rate": 0.0}
    assert {k: m[k] for k in want} == pytest.approx(want, abs=1e-6)


def test_one_class_kappa_is_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    assert metrics.item_metrics(metrics.cells(df)).first().qwk == 0.0


def test_bands(spark):
    totals = [4, 5, 9, 10, 14, 15, 19, 20]
    df = spark.createDataFrame([(t,) for t in totals], "t int").select("t", metrics.band(F.col("t")).alias("a"), metrics.band(F.col("t"), "digitize").alias("b")).orderBy("t").collect()
    assert [r.a for r in df] == [0, 1, 1, 2, 2, 3, 3, 4] and [r.b for r in df] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_chain_fixture(spark):
    r = one(spark, p=A.conditional_chain(numbers([2, 0.5, -1])), y=A.chain_prediction(numbers([2, 0.5, -1])))
    assert r.p == pytest.approx([0.119203, 0.332537, 0.400810, 0.147450], abs=1e-6) and r.y == 2


def test_cascade_keeps_to_the_top_two(spark):
    llm, enc = numbers([0.4, 0.4, 0.2, 0]), numbers([0.1, 0.2, 0.6, 0.1])
    r = one(spark, a=fusion.cascade(llm, enc, F.lit(True)), b=fusion.cascade(llm, enc, F.lit(False)), g=fusion.gate("vote", llm, F.lit(0.0), 0.8, 0.5))
    assert (r.a, r.b, r.g) == (1, 0, True)


def test_ordinal_decode_rounds_half_to_even(spark):
    r = one(spark, a=A.ordinal_decode(numbers([0.5, 0.5, 0, 0])), b=A.ordinal_decode(numbers([0, 0.5, 0.5, 0])))
    assert (r.a, r.b) == (0, 2)


def test_status_votes(spark):
    rows = [("a", "supports", 2), ("a", "none", 0), ("a", "supports", 3), ("b", "supports", 1), ("b", "none", 0), ("c", None, None)]
    got = {r.k: r for r in judgments.vote_status(spark.createDataFrame(rows, "k string, status string, severity_hint int"), ["k"]).collect()}
    assert got["a"].status == "supports" and got["a"].agreement == pytest.approx(2 / 3) and got["a"].severity_hint == 2
    assert got["b"].status == "ambiguous" and got["b"].severity_hint is None and "c" not in got


def test_reciprocal_ranks(spark):
    rows = [("x", r, "none") for r in (1, 2)] + [("y", 1, "none"), ("y", 2, "supports"), ("y", 3, "against"), ("z", 1, "supports")]
    m = judgments.window_rates(spark.createDataFrame([("c", *r) for r in rows], "c string, g string, rank int, status string"), ["c"], ["g"]).first()
    assert m.mrr == pytest.approx(0.5) and m.informative_at_1 == pytest.approx(1 / 3) and m.informative_at_3 == pytest.approx(2 / 3)


def test_regions(spark):
    df = spark.createDataFrame([("g", i + 1, [str(c)], c) for i, c in enumerate([3, 9, 25, 40])], "g string, rank int, turn_ids array<string>, center_turn_index int")
    r = judgments.redundancy(df, ["g"], 4).first()
    assert (r.regions, r.span, r.mean_jaccard) == (3, 37, 0.0)


def test_overlaps(spark):
    a, b = F.array(*map(F.lit, "123")), F.array(*map(F.lit, "34"))
    r = one(spark, o=A.overlap(a, b), j=A.jaccard(a, b))
    assert (r.o, r.j) == (0.5, 0.25)


@pytest.mark.parametrize("raw,status,hint", [
    ('Sure! {"status": "supports", "severity_hint": 2, "reason": "cut', "supports", 2), ('{"status": "none", "severity_hint": 9}', "none", None), ("", None, None), (None, None, None),
])
def test_salvage(spark, raw, status, hint):
    j = one(spark, j=T.salvage_judgment(F.lit(raw).cast("string"))).j
    assert (j.status, j.severity_hint) == (status, hint)


def test_text_helpers(spark):
    r = one(
        spark, clean=T.clean_transcript(F.lit("a [x] b\t(y) c\r\nd")), blank=T.clean_transcript(F.lit(None).cast("string")), id=T.participant_id(F.lit(" 300.0 ")),
        ex=T.numbered_excerpts(F.lit('["one", " ", "two [TURN_SEP] b"]')), plain=T.numbered_excerpts(F.lit("no list")), bad=T.json_list(F.lit("{")), head=T.head_tail(F.array(*map(F.lit, "abcdef")), 3),
    )
    assert r.clean == "a b c d" and r.blank == "" and r.id == "300" and r.ex == "Excerpt 1: one\nExcerpt 3: two ; b" and r.plain == "no list" and r.bad == [] and r.head == ["a", "e", "f"]


def test_published_confusion_arithmetic(spark):
    """Balanced toy matrix: doubling every cell changes no metric."""
    rows = [(0, 0), (0, 1), (1, 1), (2, 3), (3, 3), (2, 2)]
    schema = "label int, prediction int"
    a = metrics.item_metrics(metrics.cells(spark.createDataFrame(rows, schema))).drop("n").first()
    b = metrics.item_metrics(metrics.cells(spark.createDataFrame(rows * 2, schema))).drop("n").first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_draws_look_random(spark):
    df = spark.range(219).withColumnRenamed("id", "participant_id")
    n = inference.draws(df, "participant_id", 200).groupBy("replicate").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).agg(F.avg("n"), F.min("w"), F.max("w")).first()
    assert n[1] == n[2] == 219 and abs(n[0] - 219 * (1 - (1 - 1 / 219) ** 219)) < 3


def test_guards(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert quality.without_columns(df, ["text"]).columns == ["id"]
    with pytest.raises(ValueError):
        quality.without_columns(df, ["TEXT"])
    with pytest.raises(ValueError):
        quality.require(df, ["label"])
    with pytest.raises(ValueError):
        retrieval.Ranking(k=0)
    assert quality.first_column(df, ["Text", "text"]) == "text"
    assert quality.unchanged(df, df.limit(0)).count() == 1


def test_length_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 9, 3, 7])], "id int, n_tokens int").coalesce(1)
    got = sequences.length_batches(df, cap=10, largest=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.n_tokens)
    assert sum(map(len, by.values())) == 5 and all(len(b) == 1 or max(b) * len(b) <= 10 for b in by.values())


def test_sources(spark, tmp_path):
    (tmp_path / "7_Transcript.csv").write_text("Start_Time,End_Time,Text,Confidence\n0,1,hello,0.9\n1,2,you,0.8\n")
    t = tables.transcripts(spark, str(tmp_path / "*_Transcript.csv")).orderBy("pos").collect()
    assert [(r.participant_id, r.pos, r.Text) for r in t] == [("7", 0, "hello"), ("7", 1, "you")]
    (tmp_path / "bank.json").write_text('{"p": [{"x": 1}, {"x": 2}], "q": []}')
    assert [(r.participant_id, r.pos, r.x) for r in tables.json_bank(spark, str(tmp_path / "bank.json"), "x:int").collect()] == [("p", 0, 1), ("p", 1, 2)]
    df = spark.range(5).withColumnRenamed("id", "k")
    out = str(tmp_path / "log")
    assert tables.append_missing(df.where("k < 3"), out, ["k"]) == 3 and tables.append_missing(df, out, ["k"]) == 2 and tables.append_missing(df, out, ["k"]) == 0
    tables.write_texts(df.select("k", F.lit("t").alias("text")), str(tmp_path / "texts"), "k", "text")
    assert len(list((tmp_path / "texts").glob("k=*"))) == 5
    assert tables.optional(spark, str(tmp_path / "none"), df).count() == 0
    tables.write_frozen(df, str(tmp_path / "frozen"))
    with pytest.raises(Exception, match="already exists"):
        tables.write_frozen(df, str(tmp_path / "frozen"))
    assert [r.status for r in tables.artifact_status(spark, [str(tmp_path / "frozen"), str(tmp_path / "no")]).collect()] == ["present", "MISSING"]


def test_stream_of_sessions(spark, tmp_path):
    from lodestone.streaming import sessions

    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 1.0D), (1, timestamp'2024-01-01 00:10:00', 2.0D), (1, timestamp'2024-01-01 05:00:00', 4.0D), (1, timestamp'2024-01-03 00:00:00', 8.0D) AS t(user_id, ts, value)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sessions.run_once(sessions.gap_sessions(stream, "user_id", "ts", "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.n, r.value_sum) for r in got][:2] == [(2, 3.0), (1, 4.0)]


def test_md5_starts_are_those_of_hashlib():
    import hashlib

    from lodestone.operators import inference

    for seed, replicate, n in ((42, 17, 1), (42, 1999, 11), (7, 3, 999), (7, 0, 10_001), (42, 12, 23_456)):
        want = [0] * n
        for j in range(n):
            want[int(hashlib.md5(f"{seed}:{replicate}:{j}".encode()).hexdigest()[:8], 16) % n] += 1
        assert inference.counted_draws(seed, replicate, n).tolist() == want


def test_replicate_totals_weigh_each_cluster_by_its_draws(spark, monkeypatch):
    """Blocks of few places, totals that some replicates lack, and a cluster without a label."""
    from lodestone.operators import inference, metrics

    monkeypatch.setattr(inference, "PLACES", 16)
    rnd = random.Random(5)
    rows = [(c * 2, rnd.randrange(4), rnd.randrange(4), rnd.randrange(4)) for c in range(70) for _ in range(3)] + [(500, None, 1, 2)]
    df = spark.createDataFrame(rows, "c long, label int, a int, b int")
    got = {(r.replicate, r.run): r.total_qwk for r in inference.replicate_totals(df, "c", ["a", "b"], 300).collect()}
    sums = df.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("label", "a", "b")))
    w = inference.draws(df, "c", 300).where("replicate < 20").join(sums, "c").where("label IS NOT NULL")
    assert len(got) == 600
    for run in ("a", "b"):
        rows = w.select("replicate", F.col("label").alias("true_total"), F.col(run).alias("pred_total"), "weight")
        for r in metrics.position_kappa(rows, ["replicate"], weight="weight").collect():
            assert got[r.replicate, run] == pytest.approx(r.total_qwk)


def test_missing_audit_of_many_rows(spark):
    """Counts of four classes whose product passes 64 bits."""
    from lodestone.operators import summaries

    some = spark.range(8 * 70_000).select(F.expr("CAST(id % 2 + 1 AS INT)").alias("fold"), F.lit(1).alias("item_id"), F.expr("CAST(id div 2 % 4 AS INT)").alias("label"), F.lit("supports").alias("status"))
    assert [(r.rows, r.left_3, r.warn_class) for r in summaries.missing_audit(some).collect()] == [(280_000, 70_000, False)] * 2


def test_counted_terms_count_words_and_neighbours(spark):
    from collections import Counter

    texts = ["a b a b a", "", None, "b", "b a", "c c c"]
    df = spark.createDataFrame([(i, t.split() if t is not None else None) for i, t in enumerate(texts)], "d long, w array<string>")
    got = {}
    for r in retrieval.counted_terms(df, ["d"], F.col("w"), 2).collect():
        got.setdefault(r.d, Counter())[r.t] = r.tf
    hashes = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        assert sorted(got.get(i, {}).values()) == sorted(want.values())
        hashes[i] = set(got.get(i, {}))
    assert hashes[3] < hashes[4] and hashes[4] <= hashes[0] and not hashes[5] & hashes[0]
    assert len(hashes[0] - hashes[4]) == 1  # a b and b a are two pairs
