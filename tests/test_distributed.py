"""Folds, order statistics and sketches against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, folds, inference, metrics, selection, sequences, sketches, training
from lodestone.sources import commits
from lodestone.streaming import sessions, windows


def uneven(seed, groups=500, classes=4):
    """Groups of 1 to 60 rows that lean to a class of their own."""
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        lean = rnd.randrange(classes)
        rows += [(g, rnd.choices(range(classes), [6 if c == lean else 1 + 3 * (c == 0) for c in range(classes)])[0]) for _ in range(rnd.choice([1, 2, 3, 5, 8, 20, 60]))]
    return rows


def counts_of(rows, classes=4):
    n = defaultdict(lambda: [0] * classes)
    for g, y in rows:
        n[g][y] += 1
    return dict(n)


def spread_of(assigned, counts, k, classes=4):
    """Mean over classes of the deviation of the folds' class shares."""
    has = np.zeros((k, classes))
    for g, f in assigned.items():
        has[f] += counts[g]
    return float(np.mean(np.std(has / has.sum(0), axis=0)))


def one_by_one(counts, k, classes=4):
    """The rule that is to be met or beaten: each group, by falling deviation of its counts, to the fold that leaves the least mean deviation of shares."""
    total = np.sum(list(counts.values()), axis=0)
    has, out = np.zeros((k, classes)), {}
    for g in sorted(counts, key=lambda g: -np.std(counts[g])):
        best = None
        for f in range(k):
            has[f] += counts[g]
            score = (round(float(np.mean(np.std(has / total, axis=0))), 12), has[f].sum(), f)
            has[f] -= counts[g]
            best = min(best, score) if best else score
        out[g] = best[-1]
        has[best[-1]] += counts[g]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_of_uneven_groups_are_as_even_as_the_greedy_rules(spark, seed):
    rows = uneven(seed)
    df = spark.createDataFrame(rows, "g long, label int")
    got = {r.g: r.fold - 1 for r in folds.balanced_group_folds(df, "g").collect()}
    counts = counts_of(rows)
    assert set(got) == set(counts) and set(got.values()) == set(range(5))
    assert spread_of(got, counts, 5) <= spread_of(one_by_one(counts, 5), counts, 5) + 1e-3
    dealt = {g: i % 5 for i, g in enumerate(sorted(counts))}
    assert spread_of(got, counts, 5) < 0.25 * spread_of(dealt, counts, 5)


def test_copies_counted_at_once_are_what_one_by_one_gives():
    rnd = random.Random(6)
    for _ in range(60):
        k, kinds = rnd.randrange(2, 6), [([rnd.randrange(6) for _ in range(3)], rnd.choice([1, 2, 7, 40, 333])) for _ in range(6)]
        totals = [sum(v[c] * n for v, n in kinds) for c in range(3)]
        fast, slow = [[0] * 4 for _ in range(k)], [[0] * 4 for _ in range(k)]
        for v, n in kinds:
            given = folds.deal(v, n, fast, totals)
            one = [0] * k
            for _ in range(n):
                for f, x in enumerate(folds.deal(v, 1, slow, totals)):
                    one[f] += x
            assert given == one and fast == slow


def test_folds_with_coarse_kinds_and_odd_groups(spark):
    rows = [(g, y) for g, y in uneven(9, 300)] + [(None, 1)] * 3 + [(900, None), (901, 77), (902, -1)]
    df = spark.createDataFrame(rows, "g long, label int")
    for limit in (10_000, 256):
        got = folds.balanced_group_folds(df, "g", k=3, limit=limit)
        assert Counter(r.g for r in got.collect()) == Counter({g for g, _ in rows})
        spreads = [r.spread for r in folds.fold_shares(df.join(got, df.g.eqNullSafe(got.g)).drop(got.g)).collect()]
        assert len(spreads) == 4 and max(spreads) < 0.05
    assert folds.balanced_group_folds(df.limit(0), "g").count() == 0
    with pytest.raises(ValueError):
        folds.balanced_group_folds(df, "g", k=1)


def test_most_groups_of_one_kind(spark):
    df = spark.range(30_000).select(F.col("id").alias("g"), F.lit(2).alias("label"))
    got = Counter(r.fold for r in folds.balanced_group_folds(df, "g").collect())
    assert got == {f: 6000 for f in range(1, 6)}


def interpolated(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    a = math.floor(h)
    return v[a] + (v[min(a + 1, len(v) - 1)] - v[a]) * (h - a) if h > a else v[a]


@pytest.mark.parametrize("few", [1, 5, 10_000])
def test_quantiles_by_selection(spark, few):
    rnd = random.Random(few)
    made = {
        "ties": [7.0] * 400 + [6.5] + [8.0] * 3, "wide": [10.0 ** rnd.uniform(-200, 200) * rnd.choice([-1, 1]) for _ in range(500)], "one": [3.25], "two": [1.0, 2.0],
        "even": [float(i) for i in range(1000)], "hot": [0.0] * 3000 + [float(rnd.randrange(50)) for _ in range(100)], None: [-1.0, 5.0, 5.0],
    }
    rows = [(g, v) for g, vs in made.items() for v in vs] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.p): r.x for r in selection.quantiles(df, "v", probs, ["g"], few=few).collect()}
    assert set(got) == set(itertools.product(made, probs))
    for (g, p), x in got.items():
        assert x == pytest.approx(interpolated(made[g], p), rel=1e-12, abs=1e-300)
    whole = selection.wide_quantiles(df, "v", {"a": 0.5}, few=few).first().a
    assert whole == pytest.approx(interpolated([v for vs in made.values() for v in vs], 0.5))


def test_order_values_in_passes(spark):
    """Several passes of few cuts over a column with a third of one value."""
    rnd = random.Random(5)
    values = [rnd.randrange(1_000_000) for _ in range(4000)] + [123] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ks = [1, 2, 123, 2500, 5999, 6000, 6001, 0]
    ranks = spark.createDataFrame([(k,) for k in ks], "k long")
    got = {r.k: r.x for r in selection.order_values(df, "v", ranks, few=20, cuts=8).collect()}
    assert got == {k: float(sorted(values)[k - 1]) for k in ks if 1 <= k <= 6000}
    assert selection.order_values(df.limit(0), "v", ranks).count() == 0


def test_split_of_few_groups(spark):
    for n in range(3, 12):
        got = Counter(r.split for r in sequences.group_split(spark.range(n), "id").collect())
        assert set(got) == {"train", "validation", "test"} and sum(got.values()) == n
    with pytest.raises(ValueError):
        sequences.group_split(spark.range(2), "id")
    with pytest.raises(ValueError):
        sequences.group_split(spark.range(9), "id", 0.9, 0.1)


def test_sketches_hold_their_errors_after_merging(spark):
    df = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("a"), F.pmod("id", F.lit(5)).alias("b"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20_000)).alias("who"), F.rand(3).alias("x"))
    df = df.unionByName(df.limit(1).select(F.lit(99).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast("long").alias("who"), F.lit(None).cast("double").alias("x")))
    sets = [["a", "b"], ["a"], []]
    states = sketches.partial_states(df, ["a", "b"], "who", "x")
    twice = sketches.merged_states(states.unionByName(states), sets, ["a", "b"])  # what is seen twice is distinct once
    exact = {(r.a, r.b): r for r in sketches.exact_groups(df, sets, ["a", "b"], "who").collect()}
    probs = [0.1, 0.5, 0.9]
    for r in sketches.estimates(twice, probs).collect():
        want = exact[r.a, r.b]
        assert r.n == 2 * want.n
        assert abs(r.distinct - want.distinct) <= max(1, sketches.distinct_error(12, 4.0) * want.distinct)
        assert (r.quantiles is None) == (r.a == 99)
        if r.a is None:
            assert all(abs(x - p) < 2 * sketches.rank_error(200) for x, p in zip(r.quantiles, probs))


# dense retrieval


def plain_nearest(docs, queries, k):
    best = {}
    for p, d, pos, e in docs:
        for item, key, order, q in queries:
            if e is None or q is None:
                continue
            a, b = np.array(e, float), np.array(q, float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(a @ b / n) if n else 0.0, 9) + 0.0
            have = best.get((p, item, d))
            if have is None or (s, -order) > (have[0], -have[1]):
                best[p, item, d] = (s, order, key, pos)
    lists = defaultdict(list)
    for (p, item, d), (s, _, key, pos) in best.items():
        lists[p, item].append((-s, pos, d, key))
    return {(p, item, i + 1): (d, -s, key) for (p, item), rows in lists.items() for i, (s, pos, d, key) in enumerate(sorted(rows)[:k])}


@pytest.mark.parametrize("size", [(4096, 2048), (7, 3), (1, 1)])
def test_nearest_by_blocks(spark, size):
    rnd = random.Random(8)
    vec = lambda: [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]  # noqa: E731  many ties
    docs = [(rnd.choice(["a", "b", None]), f"d{i}", i, vec()) for i in range(60)] + [("a", "none", 900, None), ("a", "zero", 901, [0.0] * 4)]
    queries = [(i // 3, f"q{i}", i, vec()) for i in range(12)] + [(9, "qn", 0, None)]
    d = spark.createDataFrame(docs, "participant_id string, doc_id string, pos long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "item_id int, query_key string, query_ord int, embedding array<double>")
    got = {(r.participant_id, r.item_id, r["rank"]): (r.doc_id, r.score + 0.0, r.winning_query) for r in dense.nearest(d, q, 5, size).collect()}
    assert got == plain_nearest(docs, queries, 5)
    every = dense.all_scores(d, q, size)
    assert every.count() == 61 * 4
    assert dense.nearest(d, q.limit(0), 5).count() == 0 and dense.nearest(d.limit(0), q, 5).count() == 0


# learning


def plain_fit(x, y, weight, l2, classes):
    """Newton's method with the full Hessian, on standardised columns."""
    a = np.column_stack([x, np.ones(len(x))])
    d, w = a.shape[1], np.zeros(a.shape[1] * classes)
    penalty = np.tile(np.append(np.full(d - 1, l2), 0), classes)
    for _ in range(60):
        z = a @ w.reshape(classes, d).T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(classes)[y]) * weight[:, None]).T @ a
        h = np.zeros((classes * d, classes * d))
        for n in range(len(x)):
            h += weight[n] * np.kron(np.diag(p[n]) - np.outer(p[n], p[n]), np.outer(a[n], a[n]))
        w = w - np.linalg.lstsq(h + np.diag(penalty), g.ravel() + penalty * w, rcond=1e-12)[0]
    return w.reshape(classes, d)


def test_all_folds_at_once_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = (x[:, 0] + rng.normal(size=400) * 0.2 > 0).astype(int) + (x[:, 1] > 14)
    fold = np.arange(400) % 4 + 1
    df = spark.createDataFrame([(int(f), int(c), *map(float, v), 1.0) for f, c, v in zip(fold, y, x)], "fold int, label int, a double, b double, c double, flat double").repartition(5)
    models = training.fit_folds(df, ["a", "b", "c", "flat"], 3)
    assert set(models) == {1, 2, 3, 4}
    for held, model in models.items():
        at = fold != held
        z = np.column_stack([(x[at] - x[at].mean(0)) / x[at].std(0), np.zeros(at.sum())])
        each = np.bincount(y[at], minlength=3)
        want = plain_fit(z, y[at], (at.sum() / (3 * each))[y[at]], 1.0, 3)
        assert np.allclose(model.mean[:3], x[at].mean(0)) and np.allclose(model.deviation[:3], x[at].std(0))
        assert np.allclose(model.w, want, atol=1e-6)
    got = training.out_of_fold(df, ["a", "b", "c", "flat"], 3).collect()
    assert len(got) == 400 and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got)
    for r in got[:50]:  # by the model that hasn't seen the row
        p = models[r.fold].probabilities(np.array([[r.a, r.b, r.c, r.flat]]))[0]
        assert r.prediction == int(p.argmax()) and np.allclose(p, r.probabilities)
    assert sum(r.prediction == r.label for r in got) > np.bincount(y).max() + 40  # better than the largest class alone


def test_learning_with_odd_rows(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 0.5), (2, 1, None), (2, None, 1.0), (2, 7, 1.0), (None, 1, 2.0), (2, 1, 2.5)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "fold int, label int, a double, prediction int")
    got = training.out_of_fold(df, ["a"], 2).collect()
    assert len(got) == len(rows) and [r.prediction is None for r in got] == [r.a is None or r.fold is None for r in got]
    one = training.out_of_fold(df.where("fold = 1"), ["a"], 2).collect()  # nothing to learn from
    assert [r.prediction for r in one] == [None, None]
    assert training.out_of_fold(df.limit(0), ["a"], 2).count() == 0


# ordinal loss


def plain_loss(rows, gamma, weights):
    total = mass = 0.0
    for (z, y), w in zip(rows, weights):
        for k in range(3):
            if y >= k:
                p = 1 / (1 + math.exp(-z[k])) if y > k else 1 / (1 + math.exp(z[k]))
                total += w * (1 - p) ** gamma * -math.log(p)
                mass += w
    return total / max(mass, 1.0)


@pytest.mark.parametrize("gamma", [0.0, 0.5, 2.0])
def test_focal_loss_and_its_gradient_by_differences(spark, gamma):
    rnd = random.Random(11)
    rows = [([rnd.uniform(-4, 4) for _ in range(3)], rnd.randrange(4)) for _ in range(40)]
    weights = [rnd.uniform(0.2, 3) for _ in rows]
    df = spark.createDataFrame([(i, z, y, w, i % 2) for i, ((z, y), w) in enumerate(zip(rows, weights))], "i int, z array<double>, label int, w double, g int")
    assert metrics.corn_loss(df, "z", weight="w", gamma=gamma).first().loss == pytest.approx(plain_loss(rows, gamma, weights))
    got = {r.i: r.gradient for r in metrics.corn_gradient(df, "z", weight="w", gamma=gamma).collect()}
    step = 1e-5
    for i in range(0, 40, 7):
        for k in range(3):
            moved = []
            for s in (step, -step):
                z = list(rows[i][0])
                z[k] += s
                moved.append(plain_loss([*rows[:i], (z, rows[i][1]), *rows[i + 1 :]], gamma, weights))
            assert got[i][k] == pytest.approx((moved[0] - moved[1]) / (2 * step), abs=1e-7)
    by = {r.g: r.loss for r in metrics.corn_loss(df, "z", weight="w", by=["g"], gamma=gamma).collect()}
    assert by[1] == pytest.approx(plain_loss(rows[1::2], gamma, weights[1::2]))


def test_far_logits_stay_finite(spark):
    df = spark.createDataFrame([([800.0, -800.0, 0.0], 0), ([-800.0, 1.0, 2.0], 3), (None, 2), ([1.0, 1.0, 1.0], None), ([1.0, 1.0, 1.0], -1)], "z array<double>, label int")
    for gamma in (0.0, 2.0):
        assert 0 < metrics.corn_loss(df, "z", gamma=gamma).first().loss < 1000
        assert all(x is None or math.isfinite(x) for r in metrics.corn_gradient(df, "z", gamma=gamma).collect() for x in r.gradient)
    w = {r.label: r.weight for r in metrics.effective_weights(df).collect()}
    assert set(w) == {0, 2, 3} and sum(w.values()) == pytest.approx(3)


# bootstrap


def test_poisson_weights():
    points = np.random.default_rng(2).integers(0, inference.PRIME, 3000)
    w = inference.poisson_weights(points, np.arange(1500), 42)
    assert abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005 and w.max() < 13
    assert (np.bincount(w.ravel(), minlength=4)[:4] / w.size == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.002))
    assert np.abs(np.corrcoef(w[:60])[np.triu_indices(60, 1)]).max() < 0.1 and np.abs(np.corrcoef(w[:, :60].T)[np.triu_indices(60, 1)]).max() < 0.15
    assert (w != inference.poisson_weights(points, np.arange(1500), 43)).mean() > 0.5


def test_poisson_intervals_are_near_those_of_draws(spark):
    rnd = random.Random(1)
    rows = [(c, rnd.randrange(4), 0, 0) for c in range(400) for _ in range(8)]
    rows = [(c, y, y if rnd.random() < 0.6 else rnd.randrange(4), y if rnd.random() < 0.55 else rnd.randrange(4)) for c, y, _, _ in rows]
    df = spark.createDataFrame(rows, "c long, label int, a int, b int")
    found = {}
    for how in ("draws", "poisson"):
        reps = inference.replicate_metrics(df, "c", ["a", "b"], replicates=800, resampling=how)
        assert reps.count() == 1600
        found[how] = {(r.run, r.metric): r for r in inference.intervals(reps, ["accuracy", "qwk"]).collect()}
    for k, x in found["draws"].items():
        y = found["poisson"][k]
        width = x.ci_hi - x.ci_lo
        assert abs(x.mean - y.mean) < 0.1 * width and abs(x.ci_lo - y.ci_lo) < 0.2 * width and abs(x.ci_hi - y.ci_hi) < 0.2 * width


# appends that happen once


def test_replayed_batches_are_appended_once(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/t", spark.range(10).select("id", (F.col("id") * 2).alias("x"))
    assert commits.committed(spark, path, "id long, x long").count() == 0 and commits.records(spark, path).count() == 0
    assert commits.append_once(df, path, "a", 0) == 10
    assert commits.append_once(df, path, "a", 0) is None

    def dies(*_):
        raise RuntimeError("killed between write and commit")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", dies)
        with pytest.raises(RuntimeError):
            commits.append_once(df.select((F.col("id") + 100).alias("id"), "x"), path, "a", 1)
    assert commits.committed(spark, path, "id long, x long").count() == 10  # the files are there, the batch isn't
    assert commits.append_once(df.select((F.col("id") + 200).alias("id"), "x").limit(3), path, "a", 1) == 3
    got = commits.committed(spark, path, "id long, x long")
    assert sorted(r.id for r in got.collect()) == [*range(10), 200, 201, 202]
    assert commits.append_missing_once(spark.range(5, 15).select("id", F.col("id").alias("x")), path, ["id"], "b", 0) == 5
    assert commits.append_once(df.limit(0), path, "b", 1) == 0
    assert sorted((r.run, r.batch, r["rows"]) for r in commits.records(spark, path).collect()) == [("a", 0, 10), ("a", 1, 3), ("b", 0, 5), ("b", 1, 0)]
    with pytest.raises(ValueError):
        commits.append_once(df.withColumn("run", F.lit(1)), path, "c", 0)
    with pytest.raises(ValueError):
        commits.append_once(df, path, "a/b", 0)


def test_streams_survive_death_before_and_after_the_commit(spark, tmp_path, monkeypatch):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    commit = commits.commit

    def before(*a):
        if a[3] == 1:
            raise RuntimeError("dies before the commit of batch 1")
        commit(*a)

    def after(*a):
        commit(*a)
        if a[3] == 2:
            raise RuntimeError("dies after the commit of batch 2")

    for dying in (before, after):
        with monkeypatch.context() as m:
            m.setattr(commits, "commit", dying)
            with pytest.raises(Exception):
                commits.stream_once(read(), path, "s", f"{tmp_path}/check")
    commits.stream_once(read(), path, "s", f"{tmp_path}/check")
    got = sorted(r.id for r in commits.committed(spark, path, "id long").collect())
    assert got == list(range(40))


# windows over streams


@pytest.mark.parametrize("size", [1, 3, 5, 7])
def test_windows_of_streams_are_those_of_tables(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = []
    for p in ("a", "b", "c", "d e"):
        t = 0.0
        for pos in range(rnd.randrange(1, 25)):
            t = max(0.0, t + rnd.choice([1, 1, 5, 30, 59, 61, 200, -3]))
            rows.append((p, pos, t, t + rnd.choice([0.5, 2.0]), rnd.choice(["x  y", " z", "", None])))
    schema = "participant_id string, pos long, start_time double, end_time double, text string"
    whole = spark.createDataFrame([(*r[:4], r[4] or "") for r in rows], schema)
    want = sequences.context_windows(sequences.turns(whole), size=size).select(*windows.WINDOW.replace("array<string>", "x").split(", ")[0].split()[:1], "context_window_id", "center_turn_id", "center_turn_index", "turn_ids", "start_time", "end_time", "n_turns", "window_text")
    for k in range(0, 25, 4):
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("~", 0, 1e7, 1e7, "")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sessions.run_once(windows.stream_windows(stream, "10000 seconds", size), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema(windows.WINDOW).parquet(f"{tmp_path}/out").where("participant_id <> '~'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_held_turns_are_bounded():
    held = windows.Held(3, 60.0)
    seen = []
    for i in range(500):
        seen += held.add(float(i), i + 0.5, f"t{i}")
        assert len(held.turns) <= 7
    seen += held.flush()
    assert [i for i, _ in seen] == list(range(500)) and all(len(ts) == min(i, 3) + min(499 - i, 3) + 1 for i, ts in seen)


def test_draws_are_the_same_either_way(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(c * 3, rnd.randrange(4), rnd.randrange(4)) for c in range(60) for _ in range(5)]
    df = spark.createDataFrame(rows, "c long, label int, a int")
    found = []
    for most in (inference.SENT_BYTES, 0):
        monkeypatch.setattr(inference, "SENT_BYTES", most)
        found.append(sorted(map(tuple, inference.replicate_metrics(df, "c", ["a"], replicates=70).select("replicate", "n", "accuracy", "qwk").collect())))
    assert found[0] == found[1] and len(found[0]) == 70
    w = {(r.replicate, r.c): r.weight for r in inference.draws(df, "c", 70).collect()}
    hits = {c: sum(y == p for k, y, p in rows if k == c) for c in {r[0] for r in rows}}
    for rep, n, accuracy, _ in found[0][:10]:
        assert n == 300 and accuracy == pytest.approx(sum(x * hits[c] for (b, c), x in w.items() if b == rep) / 300)
    assert inference.replicate_metrics(df.limit(0), "c", ["a"], replicates=5).count() == 0
