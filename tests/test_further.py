"""Operators that no SQL covers, against plain Python; sources, sinks and streams by round trips."""

import itertools
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import text as T
from lodestone.operators import fusion, inference, judgments, learning, metrics, ordering, quality, retrieval, sequences
from lodestone.plans import studies
from lodestone.plans.base import base
from lodestone.sources import scratch, tables
from lodestone.streaming import sessions

FOLDER = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-5, 5), rnd.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, n int")
    got = {r.x: r.total for r in ordering.running(df, "x", {"total": "n"}, descending, ranges=7).collect()}
    want = dict(zip((x for x, _ in sorted(rows, reverse=descending)), itertools.accumulate(n for _, n in sorted(rows, reverse=descending))))
    assert got == want
    assert ordering.running(df.limit(0), "x", {"total": "n"}).count() == 0


def test_range_of_is_a_binary_search(spark):
    bounds = sorted({random.Random(1).randrange(1000) for _ in range(77)})
    got = spark.range(1000).select("id", A.range_of(bounds, F.col("id")).alias("r"), A.range_of(bounds, F.lit(None).cast("long")).alias("none"), A.range_of([], F.col("id")).alias("empty")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) and r.none == 0 and r.empty == 0 for r in got)


def test_replicates_against_rows(spark):
    """Weighted cells give what resampled rows give."""
    rnd = random.Random(9)
    rows = [(p, i, rnd.randrange(4), rnd.randrange(4), rnd.randrange(4)) for p in range(17) for i in range(rnd.randrange(1, 6))]
    df = spark.createDataFrame(rows, "participant_id long, item_id int, label int, a int, b int")
    drawn = inference.draws(df, "participant_id", 5).collect()
    got = {(r.replicate, r.run): (r.accuracy, r.mae, r.n) for r in inference.replicate_metrics(df, "participant_id", ["a", "b"], 5).collect()}
    for rep in range(5):
        weight = {r.participant_id: r.weight for r in drawn if r.replicate == rep}
        assert sum(weight.values()) == 17
        for k, run in ((3, "a"), (4, "b")):
            many = [r for r in rows for _ in range(weight.get(r[0], 0))]
            assert got[rep, run] == pytest.approx((np.mean([r[2] == r[k] for r in many]), np.mean([abs(r[2] - r[k]) for r in many]), len(many)))
    totals = inference.replicate_totals(df, "participant_id", ["a", "b"], 5)
    assert totals.count() == 10 and all(-1 <= r.total_qwk <= 1 for r in totals.collect())


def test_evidence_dataset_against_loops(spark):
    raw, items = base(spark, FOLDER, "turns"), base(spark, FOLDER, "items")
    got = {(r.participant_id, r.item_id): (r.ids or [], r.n_windows) for r in studies.evidence_dataset(raw, items).collect()}
    windows = sequences.context_windows(sequences.turns(raw), size=3).collect()
    words = lambda t: [w for w in re.sub(r"[^a-z0-9\s']+", " ", t.lower()).split() if w not in T.STOPWORDS]
    by = {}
    for w in sorted(windows, key=lambda w: w.center_turn_index):
        by.setdefault(w.participant_id, []).append((w.context_window_id, w.turn_ids, words(w.window_text)))
    for p, docs in by.items():
        live = [d for d in docs if d[2]]
        avg, df = sum(len(d[2]) for d in live) / max(len(live), 1), Counter(t for d in live for t in set(d[2]))
        for item in items.collect():
            scored = []
            for k, (name, turns, tokens) in enumerate(live):
                tf, score = Counter(tokens), 0.0
                for t in words(item.glossary):
                    if tf[t]:
                        score += math.log(1 + (len(live) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens) / avg))
                scored.append((-round(score, 9), k, name, turns))
            ranked = sorted(scored)[:15]
            if not ranked or ranked[0][0] == 0:
                want = [r[2] for r in ranked[:3]]
            else:
                taken, rest = [], []
                for r in ranked:
                    near = any(len(set(r[3]) & set(x[3])) / min(len(r[3]), len(x[3])) > 0.5 for x in taken)
                    (rest if near or len(taken) == 3 else taken).append(r)
                want = [r[2] for r in (taken + rest)[:3]]
            assert got[p, item.item_id] == (want, len(want))


def test_stacked_predictions_are_out_of_fold(spark):
    rnd = random.Random(2)
    rows = []
    for p in range(150):
        for i in range(1, 9):
            y = rnd.randrange(4)
            rows.append((p, i, p % 5 + 1, y, [0.7 if c == y else 0.1 for c in range(4)], [0.25] * 4))
    df = spark.createDataFrame(rows, "participant_id long, item_id int, fold int, label int, llm array<double>, encoder array<double>")
    got = learning.stacked(df).collect()
    assert len(got) == len(rows) and all(r.prediction == r.label for r in got) and all(abs(sum(r.stacked) - 1) < 1e-6 for r in got)


def test_folds_are_even(spark):
    p = base(spark, FOLDER, "preds")
    folds = learning.stratified_group_folds(p, "participant_id")
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    shares = p.join(folds.withColumnRenamed("fold", "f"), "participant_id").groupBy("f", "label").count().collect()
    by_label = {}
    for r in shares:
        by_label.setdefault(r.label, []).append(r["count"])
    assert all(max(v) - min(v) <= 0.25 * max(v) for v in by_label.values())


def test_key_over_its_budget_keeps_its_statistics(spark):
    df = spark.createDataFrame([("a", 1, 20), ("a", 2, 1), ("b", 1, 4), ("b", 2, 5), ("b", 3, 9)], "k string, rank int, n_tokens int")
    got = {r.k: tuple(r)[1:] for r in sequences.token_budget_stats(df, ["k"], F.lit(10)).collect()}
    assert got == {"a": (10, 0, 0, 10, 20), "b": (10, 2, 10, 0, 9)}


def test_prefixes(spark):
    df = spark.createDataFrame([("k", i + 1, n) for i, n in enumerate([200, 100, 60, 5])], "k string, rank int, n_words int")
    assert [sequences.prefix(df, ["k"], kind).count() for kind in ("top3", "top5", "budget")] == [3, 4, 2]


def test_replies(spark):
    raw = 'x {"scores": [{"id": 2, "label": "3", "reasoning": "why"}, {"id": 9, "label": 1}, 7]} y'
    assert [(s.item_id, s.label, s.reasoning) for s in one(spark, s=T.transcript_scores(F.lit(raw), 3)).s] == [(1, None, ""), (2, 3, "why"), (3, None, "")]
    assert [s.label for s in one(spark, s=T.transcript_scores(F.lit(None).cast("string"), 2)).s] == [None, None]
    assert one(spark, t=T.term_lists(F.lit("no object"))).t is None


def test_prompts_and_examples(spark):
    shots = F.array(F.struct(F.lit("q1").alias("user"), F.lit("a1").alias("answer")))
    r = one(
        spark, chat=T.chat_prompt(F.lit("s"), F.lit("u")), none=T.few_shot_prompt(F.lit("s"), F.lit(None).cast("array<struct<user:string,answer:string>>"), F.lit("u")),
        few=T.few_shot_prompt(F.lit("s"), shots, F.lit("u")), ex=T.masked_example(F.lit("a b c"), F.lit("d e"), 4), hits=T.substring_hits(F.lit("No Sleep at all"), F.array(F.lit("sleep"), F.lit("food"))),
        marked=T.highlighted(F.lit("a<b A.b"), F.array(F.lit("a"), F.lit("a.b"))),
    )
    assert r.chat == r.none == "[INST] <<SYS>>\ns\n<</SYS>>\n\nu [/INST]" and r.few.count("[INST]") == 2 and "q1 [/INST] a1 </s>" in r.few
    assert len(r.ex.input_ids) == 4 and r.ex.labels[:3] == [-100] * 3 and r.ex.labels[3] == r.ex.input_ids[3] and r.hits == ["sleep"]
    assert r.marked == "<mark>a</mark>&lt;b <mark>A.b</mark>"
    rows = spark.createDataFrame([(0, [1, 2, 3], [-100, 2, 3]), (0, [4], [4]), (1, [5], [5])], "batch int, input_ids array<bigint>, labels array<bigint>")
    got = sorted((x.batch, x.input_ids, x.labels, x.attention_mask) for x in sequences.padded_batches(rows, "batch").collect())
    assert got == [(0, [1, 2, 3], [-100, 2, 3], [1, 1, 1]), (0, [4, 0, 0], [4, -100, -100], [1, 0, 0]), (1, [5], [5], [1])]


def test_plug_ins_and_small_functions(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], 2, 1, "a"), (2, [0.0, 0.0], 1, None, "b")], "k int, p array<double>, label int, prediction int, g string")
    assert [r.s for r in learning.scored_by(df, lambda it: (b.assign(s=b["k"] * 2.0) for b in it), "s").orderBy("k").collect()] == [2.0, 4.0]
    assert fusion.renormalise(df.where("k = 1")).first().p == [0.25, 0.75]
    c = metrics.with_coverage(df).first()
    assert (c.n, c.n_total, c.coverage) == (1, 2, 0.5)
    assert one(spark, a=judgments.map_agreement(F.lit('{"x": 3, "y": 1}')), b=judgments.map_agreement(F.lit("{}")))[0] == 0.75
    odd = quality.all_of(quality.violations(df, F.col("k"), {"no_prediction": F.col("prediction").isNull()}), quality.repeated(df.unionAll(df.where("k = 1")), ["k"], "repeated"))
    assert sorted(map(tuple, odd.collect())) == [("no_prediction", "2"), ("repeated", "1")]
    assert quality.columns_like(df, ["PRED", "lab"]) == ["label", "prediction"]
    with pytest.raises(ValueError):
        quality.columns_like(df, ["score"])
    with pytest.raises(ValueError):
        retrieval.retrieve("none", df, df)
    with pytest.raises(ValueError):
        fusion.missing_policy(df, "keep")


def test_more_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "é|x"), (2, None)], "k int, t string")
    for name in ("b", "a"):
        (tmp_path / "deep" / name).mkdir(parents=True)
        (tmp_path / "deep" / name / "labels.csv").write_text("k,t\n1,x\n")
    assert tables.discovered(spark, str(tmp_path), "labels.csv").endswith("deep/a/labels.csv")
    with pytest.raises(FileNotFoundError):
        tables.discovered(spark, str(tmp_path), "nothing.csv")
    assert tables.parquet_or_csv(spark, str(tmp_path / "deep/a/labels.parquet")).collect()[0].t == "x"
    tables.write_csv(df, str(tmp_path / "csv"))
    tables.write_json(df, str(tmp_path / "json"))
    assert tables.json_records(spark, str(tmp_path / "json"), df.schema, lines=True).count() == 2
    (tmp_path / "list.json").write_text('[{"k": 5}, {"k": 6}]')
    assert [r.k for r in tables.json_records(spark, str(tmp_path / "list.json"), "k int").collect()] == [5, 6]
    tables.write_views(df, {str(tmp_path / "v1"): ["k"], str(tmp_path / "v2"): ["t", "k"]})
    whole = tables.shards(spark, [str(tmp_path / "v1"), str(tmp_path / "v2")])
    assert whole.count() == 4 and set(whole.columns) == {"k", "t"}
    assert tables.shards(spark, [str(tmp_path / "csv")], "csv", header=True).count() == 2
    assert json.loads(tables.json_document(df)) == [{"k": 1, "t": "é|x"}, {"k": 2, "t": None}]
    with pytest.raises(ValueError):
        tables.json_document(df, most=1)
    assert [r.line for r in tables.markdown_lines(df, "k").orderBy("place").collect()] == ["| k | t |", "|-|-|", "| 1 | é\\|x |", "| 2 |  |"]
    assert tables.manifest(spark, str(tmp_path / "list.json")).first().length == 20


def test_scratch_tables_can_be_removed(spark):
    from pathlib import Path

    kept = scratch.cut(spark.range(3))
    path = Path(re.sub("^file:", "", kept.inputFiles()[0])).parent
    assert kept.count() == 3 and path.exists()
    assert scratch.discard(spark) >= 1 and not path.exists()


def test_stream_without_repeats(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:01:00'), (2, timestamp'2024-01-01 00:02:00') AS t(k, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        sessions.run_once(sessions.first_only(stream, ["k"], "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_first_available_folder(spark, tmp_path):
    for folder, name, text in (("raw", "1.csv", "a"), ("processed", "1.csv", "b"), ("processed", "2.csv", "c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"t\n{text}\n")
    rows, missing = tables.first_available(spark, [str(tmp_path / "raw"), str(tmp_path / "processed")], ["1.csv", "2.csv", "3.csv"], "t string")
    assert sorted((r.file, r.t) for r in rows.collect()) == [("1.csv", "a"), ("2.csv", "c")] and [r.file for r in missing.collect()] == ["3.csv"]
