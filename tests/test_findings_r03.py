"""Steps that findings of round 3 named: what they cost is read off their plans, what they give is held to plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.arrays import tempered
from lodestone.llm import simhash
from lodestone.operators import inference, metrics, retrieval
from lodestone.plans import catalog, distributed
from lodestone.streaming import windows


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calibration_bins_move_no_filter_below_the_confidence(spark):
    rows = spark.createDataFrame([(0.0, 1), (0.1, 1), (0.15, 0), (0.95, 1), (1.0, 1), (1.2, 1), (None, 1)], "x double, ok int")
    df = rows.repartition(2).withColumn("conf", F.array_max(F.array(F.col("x"), F.col("x") / 2)))
    found = metrics.calibration_bins(df, "conf", F.col("ok") == 1)
    assert "Filter (" not in _plan(found)
    got = {r["bin"]: (r["n"], r["accuracy"], round(r["confidence"], 9)) for r in found.collect()}
    assert got == {0: (1, 1.0, 0.1), 1: (1, 0.0, 0.15), 9: (2, 1.0, 0.975)}


def test_tempered_makes_each_logarithm_once(spark):
    rows = spark.createDataFrame([([0.1, 0.2, 0.7], 0.5), ([0.0, 1.0], 2.0), ([], 1.0), (None, 1.0)], "p array<double>, t double").repartition(2)
    out = rows.select("p", "t", tempered(F.col("p"), F.col("t")).alias("q"))
    assert out._jdf.queryExecution().analyzed().toString().lower().count("ln(") == 1
    for p, t, q in out.collect():
        if p is None:
            assert q is None
            continue
        e = [math.exp(math.log(max(x, 1e-9)) / t) for x in p]
        assert len(q) == len(p) and all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(q, e))


def test_near_copies_come_from_the_trie_first(spark, monkeypatch):
    """Copies whose fingerprints are close are joined by the trie walk's pairs; the exact join adds those that it can't see."""
    words = [f"w{k}" for k in range(400)]
    near = [" ".join(words), " ".join(["new", *words[1:]]), " ".join([*words[:-1], "end"])]
    tail = " ".join([*words, *(f"x{k}" for k in range(90))])  # similarity 396 / 486, fingerprint far away
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near, tail, "something else altogether", "", None, near[0]])], "doc_id long, text string")
    walked, asked = simhash.fingerprint_pairs, []

    def watched(texts, *a, **k):
        out = walked(texts, *a, **k)
        asked.append((texts.count(), {(r.x, r.y) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "fingerprint_pairs", watched)
    kept = simhash.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]
    hashes = [r.h for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("h")).collect()]
    (n, pairs), = asked
    assert n == len(set(hashes))
    sets = [simhash.shingle_set(t, 5) for t in (*near, tail)]
    bits = [simhash.majority_bits(s) & (2**64 - 1) for s in sets]
    for i in range(3):
        if (bits[0] ^ bits[i + 1]).bit_count() <= 3 and bits[0] != bits[i + 1]:
            assert any(hashes[i + 1] in p for p in pairs)
    assert (bits[0] ^ bits[3]).bit_count() > 3 and not any(hashes[3] in p for p in pairs)
    assert pairs


def test_sent_sums_are_multiplied_several_replicates_at_once(spark):
    """Draws of some replicates meet the clusters' numbers in one product of doubles, as exact as draw by draw."""
    counted = inference.counted_draws
    rows = [(k, 3 * k + 1, k % 5) for k in range(301)]
    vectors = spark.createDataFrame(rows, "id long, a long, b long")
    got = {r.replicate: (r.a, r.b) for r in inference._replicated(vectors, "id", ["a", "b"], 11, 7).collect()}
    cells = np.array([r[1:] for r in rows])
    assert inference.TOGETHER > 1
    assert got == {r: tuple((counted(7, r, 301) @ cells).tolist()) for r in range(11)}


def test_replicates_leave_incomplete_rows_out_without_a_filter_before_the_counts(spark, monkeypatch):
    """A cluster without a complete row is none; the filter on that comes after the aggregate, not at the scan."""
    rows = [(1, 0, 0, 1), (1, 1, None, 1), (2, 1, 1, 1), (3, 0, None, 0), (4, 2, 2, 0), (4, None, 1, 1)]
    df = spark.createDataFrame(rows, "id long, label int, a int, b int").repartition(2)
    plans, written = [], inference.cut
    monkeypatch.setattr(inference, "cut", lambda x: plans.append(_plan(x)) or written(x))
    got = inference.replicate_metrics(df, "id", ["a", "b"], 9, 5)
    assert "Filter" not in plans[0][plans[0].index("Aggregate") :]
    plain = inference.replicate_metrics(df.dropna(subset=["a", "b"]), "id", ["a", "b"], 9, 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_summed_draws_are_what_draws_come_to_and_no_draw_is_a_row(spark, monkeypatch):
    rows = [(k // 2, 10**12 + k // 2) for k in range(90)]
    df = spark.createDataFrame(rows, "c long, v long").repartition(3)
    plain = inference.draws(df, "c", 40, 7).join(df.distinct(), "c").groupBy("replicate").agg(F.count("*").alias("clusters"), F.sum("weight").alias("draws"), F.sum(F.col("weight") * F.col("v")).alias("v"))
    want = sorted(tuple(r) for r in plain.collect())
    monkeypatch.setattr(inference, "PLACES", 16)
    monkeypatch.setattr(inference, "draws", None)
    assert want == sorted(tuple(r) for r in inference.draw_sums(df, "c", ["v"], 40, 7).collect())
    assert len(want) == 40 and inference.draw_sums(df.limit(0), "c", ["v"], 40, 7).count() == 0
    assert catalog.QUERIES["bootstrap_draws"](spark, "/root/testdata/sf0.001").count() == 2000


TEXTS = [("a", "d0", 0, "red fox red the fox red"), ("a", "d1", 1, "the"), ("a", "d2", 2, None), ("a", "d3", 3, "blue sky"), ("b", "d4", 0, ""), ("b", "d5", 1, "fox")]


def _corpus(spark):
    raw = spark.createDataFrame(TEXTS, "participant_id string, doc_id string, pos int, text string").repartition(2)
    docs = raw.select("participant_id", "doc_id", "pos", F.array("doc_id").alias("turn_ids"), T.tokens(F.col("text"), ["the"]).alias("tokens"))
    return docs, spark.createDataFrame([(1, ["red", "fox", "red"]), (2, ["zebra"])], "item_id int, tokens array<string>")


def test_postings_make_tokens_once(spark, monkeypatch):
    docs, queries = _corpus(spark)
    plans, written = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda x: plans.append(_plan(x)) or written(x))
    got = {r.doc_id: (r.dl, r.hits) for r in retrieval.postings(docs, queries).collect()}
    assert got == {"d0": (5, ["red", "fox", "red", "fox", "red"]), "d3": (2, []), "d5": (1, ["fox"])}
    kept = {r.doc_id: r.dl for r in retrieval.postings(docs, queries, keep_empty=True).collect()}
    assert kept == {"d0": 5, "d1": 0, "d2": 0, "d3": 2, "d4": 0, "d5": 1}
    assert [p.count("regexp_extract_all") for p in plans] == [1, 1]


def test_terms_are_counted_beside_their_document(spark):
    rows = spark.createDataFrame([(0, ["b", "a", "b", "b"]), (1, []), (2, None), (3, ["x"]), (4, ["a", None, None])], "k int, hits array<string>")
    got = list(map(tuple, rows.select("k", F.inline(retrieval.counted_hits("hits"))).collect()))
    got = sorted(got, key=str)
    assert got == [(0, "a", 1), (0, "b", 3), (3, "x", 1), (4, "a", 1), (4, None, 2)]
    docs, queries = _corpus(spark)
    post = retrieval.postings(docs, queries)
    assert "Aggregate [participant_id" in (plan := _plan(retrieval.bm25_scores(post, queries))) and "count(1) AS tf" not in plan
    got = {(r.participant_id, r.item_id, r.doc_id): r.score for r in retrieval.bm25_scores(post, queries).collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    part = lambda tf, dl, avg: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {("a", 1, "d0"): round(2 * idf * part(3, 5, 3.5) + idf * part(2, 5, 3.5), 9), ("b", 1, "d5"): round(math.log(1 + 0.5 / 1.5) * part(1, 1, 1), 9)}


def test_candidates_that_fill_up_read_written_scores(spark, monkeypatch):
    docs, queries = _corpus(spark)
    post = retrieval.postings(docs, queries)
    scores, written, cut = retrieval.bm25_scores(post, queries), [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda x: written.append(x.columns) or cut(x))
    found = retrieval.candidates(scores, post, queries, 2)
    assert written == [["participant_id", "item_id", "doc_id", "score"]] and "idf" not in _plan(found)
    got = sorted((r.participant_id, r.item_id, r.rank, r.doc_id, r.score > 0) for r in found.collect())
    assert got == [("a", 1, 1, "d0", True), ("a", 1, 2, "d3", False), ("a", 2, 1, "d0", False), ("a", 2, 2, "d3", False), ("b", 1, 1, "d5", True), ("b", 2, 1, "d5", False)]
    retrieval.candidates(scores, post, queries, 2, fill=False)
    assert len(written) == 1


def test_streamed_slices_grow_with_the_longest_conversation_by_its_logarithm():
    for n in (0, 1, 3, 7, 399, 100_000):
        parts = distributed.slices(n)
        assert [k for a, b in parts for k in range(a, b)][:n] == list(range(n)) and len(parts) <= 2 + max(n, 1).bit_length()


def test_stream_keys_of_a_bucket_are_one_state(spark, tmp_path):
    schema = "participant_id string, pos long, start_time double, end_time double, text string"
    names = [*(f"p{k}" for k in range(40)), None, "null"]
    for part in (range(2), range(2, 4)):
        rows = [(n, i, 10.0 * i, 10.0 * i + 5, f"t{i}") for n in names for i in part if n != "p7" or i < 2]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("~", 0, 1e7, 1e7, "")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windows.stream_windows(stream, "0 seconds", 3, buckets=4).writeStream.format("memory").queryName("bucketed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4
    got = sorted((str(r.participant_id), r.center_turn_index, r.n_turns, r.window_text.count("t")) for r in spark.table("bucketed").where("participant_id IS NULL OR participant_id <> '~'").collect())
    want = sorted((str(n), i, w, w) for n in names for k in [2 if n == "p7" else 4] for i in range(k) for w in [min(i, 1) + min(k - 1 - i, 1) + 1])
    assert got == want
