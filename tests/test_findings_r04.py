"""Steps that findings of round 4 named."""

import math
from collections import Counter

import duckdb
import numpy as np

from pyspark.sql import functions as F

from lodestone.operators import dense, reports, retrieval
from lodestone.plans import catalog, distributed


def test_reports_keep_the_order_of_rows_of_one_item(spark, tmp_path):
    """Copies of orders that share a key: two rows of one participant and item, in the order of the table as in SQL."""
    path = f"{tmp_path}/orders.parquet"
    some = "'/root/testdata/sf0.001/orders.parquet' WHERE o_orderkey < 64"
    duckdb.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + 63 * k AS o_orderkey) FROM range(40) r(k), (FROM {some}) o ORDER BY k, o_orderkey) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW orders AS FROM '{path}'")
    want = dict(con.sql(catalog.SQL["clinician_reports"]).fetchall())
    got = dict(map(tuple, distributed.clinician_reports(spark, str(tmp_path)).collect()))
    assert len(want) > 300 and got == want


def test_totals_that_are_not_there_are_named_as_in_sql(spark):
    rows = spark.createDataFrame([(None,), (0,), (4,), (5,), (20,)], "total int")
    assert [r[0] for r in rows.select(reports.band_name(rows.total)).collect()] == ["severe", "minimal", "minimal", "mild", "severe"]


def test_dense_search_lets_few_rows_leave_a_task(spark):
    """One block of queries, 80 of documents: what leaves grows with the tasks, not with the pairs of blocks."""
    rnd = np.random.default_rng(4)
    vectors = lambda n: [[float(x) for x in v] for v in rnd.integers(-2, 3, (n, 4))]
    docs = spark.createDataFrame([("a", f"d{i}", i, v) for i, v in enumerate(vectors(400))], "participant_id string, doc_id string, pos long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, str(i), 0, v) for i, v in enumerate(vectors(10))], "item_id int, query_key string, query_ord int, embedding array<double>")
    runs = 2 * spark.sparkContext.defaultParallelism
    assert 20 <= dense._products(docs, asked, 2, (5, 50)).count() <= runs * 10 * 2 < 80 * 10 * 2


def test_best_so_far_are_the_best_however_often_they_leave(monkeypatch):
    monkeypatch.setattr(dense, "PEOPLE", 5)
    rnd = np.random.default_rng(5)
    q, d = rnd.integers(-2, 3, (6, 3)).astype(float), rnd.integers(-2, 3, (700, 3)).astype(float)
    people = [None if x == 0 else f"p{x}" for x in rnd.integers(0, 8, 700)]
    one = dense._Asked(4, np.arange(6), np.zeros(6, np.int64), [str(i) for i in range(6)], q.ravel())
    units = dense._units(list(d))
    out = []
    for at in range(0, 700, 20):
        some = slice(at, at + 20)
        one.meet(people[some], np.arange(at, at + 20), [f"d{i}" for i in range(at, at + 20)], units[some])
        if at % 60 == 0:
            out += [r for b in one.leave() for r in b.to_pylist()]
        elif one.held:
            one.settle()
    out += [r for b in one.leave() for r in b.to_pylist()]
    scores = np.round(units @ one.q.T, dense.PLACES)
    for p in set(people):
        for i in range(6):
            want = sorted((-scores[j, i], j) for j in range(700) if people[j] == p)[:4]
            got = sorted((-r["s"], r["pos"]) for r in out if r["p"] == p and r["item"] == i)[:4]
            assert got == want


def test_norms_of_documents_come_from_buckets_of_terms(spark, monkeypatch):
    """A document's terms are one row, and squares of tf * idf are those of plain Python, over many buckets."""
    monkeypatch.setattr(retrieval, "BUCKET", 40)
    rnd = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    docs = [("ab"[i % 2], f"d{i}", [words[j] for j in rnd.integers(0, 30, rnd.integers(0, 25))]) for i in range(41)] + [("b", "many", ["w1"] * 300), (None, "none", ["w1"])]
    df = spark.createDataFrame(docs, "participant_id string, doc_id string, w array<string>").repartition(3)
    terms = retrieval.term_lists(df, ["participant_id", "doc_id"], F.col("w"), 2)
    assert terms.count() == len(docs)
    n = terms.groupBy("participant_id").agg((F.count("*") + 1).alias("n"))
    got = {r.doc_id: r.s for r in retrieval.square_norms(terms, n, terms.agg(F.sum("size")).head()[0]).groupBy("no").agg(F.sum("s").alias("s")).join(terms, "no").collect()}
    counts = {d: Counter(w + list(zip(w, w[1:]))) for p, d, w in docs if p is not None}
    people = {d: p for p, d, _ in docs}
    want = {}
    for d, c in counts.items():
        mine = [x for x in counts if people[x] == people[d]]
        idf = {t: math.log((2 + len(mine)) / (1 + sum(t in counts[x] for x in mine))) + 1 for t in c}
        if c:
            want[d] = sum((m * idf[t]) ** 2 for t, m in c.items())
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 * want[d] for d in want)


def test_ranked_texts_keep_their_tokens_without_a_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieval, "tfidf_top", lambda docs, *_: seen.append(docs) or docs.select(F.lit(0.0).alias("score")))
    distributed.tfidf_ranked(spark, "/root/testdata/sf0.001")
    assert {"text", "tokens"} <= set(seen[0].columns)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
