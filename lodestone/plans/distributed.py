"""Registered queries of operators that need more than one pass or a mechanism of their own, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import folds, inference, metrics, policies, quality, reports, retrieval, sketches, summaries, training
from lodestone.operators.selection import wide_quantiles
from lodestone.plans.base import base, with_bases
from lodestone.plans.catalog import IDF_PLUS, QUERIES, SQL, SQL_DRAWS, SQL_SUMMARY, SQL_TOKENS, SQL_WINDOWS, _docs, _items, _sql_bm25, query, rounded, sql_boot
from lodestone.sources import commits
from lodestone.sources.scratch import cut, new_path
from lodestone.sources.tables import sql, table
from lodestone.streaming import sessions, windows

# ---------------------------------------------------------------- folds

#: Uneven groups: orders of a customer, labelled by priority.
_RATED = "rated AS (SELECT o_custkey AS customer, CAST((o_orderkey * 7 + CAST(floor(o_totalprice) AS BIGINT)) % 4 AS INT) AS label FROM orders)"
#: The greedy rule one group at a time: 5 folds of 4 class counts, rows and groups in one list of 30 numbers.
_DEALT = f"""{_RATED},
g AS (SELECT customer, [count(*) FILTER (label = 0), count(*) FILTER (label = 1), count(*) FILTER (label = 2), count(*) FILTER (label = 3)] AS v FROM rated GROUP BY customer),
t AS (SELECT [sum(v[1]), sum(v[2]), sum(v[3]), sum(v[4])]::DOUBLE[] AS t FROM g),
steps AS (SELECT v, row_number() OVER (ORDER BY list_max(v) - list_min(v) DESC, v) AS i FROM g),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT[]) AS v, CAST(-1 AS BIGINT) AS f, list_transform(range(0, 30), lambda x: CAST(0 AS BIGINT)) AS s
  UNION ALL
  SELECT p.i, p.v, p.best, list_transform(w.s, lambda x, j: x + CASE WHEN (j - 1) // 6 <> p.best THEN 0 WHEN (j - 1) % 6 < 4 THEN p.v[(j - 1) % 6 + 1] WHEN (j - 1) % 6 = 4 THEN list_sum(p.v) ELSE 1 END)
  FROM walk w, LATERAL (SELECT steps.i, steps.v, CAST(list_sort(list_transform(range(0, 5), lambda f: [w.s[f * 6 + 1] * steps.v[1] / (t[1] * t[1]) + w.s[f * 6 + 2] * steps.v[2] / (t[2] * t[2]) + w.s[f * 6 + 3] * steps.v[3] / (t[3] * t[3]) + w.s[f * 6 + 4] * steps.v[4] / (t[4] * t[4]), w.s[f * 6 + 5], w.s[f * 6 + 6], f]))[1][4] AS BIGINT) AS best FROM steps, t WHERE steps.i = w.i + 1) p),
given AS (SELECT v, f, count(*) AS n FROM walk WHERE f >= 0 GROUP BY v, f),
ends AS (SELECT v, f, sum(n) OVER (PARTITION BY v ORDER BY f) AS upto FROM given),
placed AS (SELECT customer, v, row_number() OVER (PARTITION BY v ORDER BY md5('42|' || customer), customer) AS own FROM g)"""


@query(f"WITH RECURSIVE {_DEALT} SELECT p.customer, CAST(min(e.f) + 1 AS INT) AS fold FROM placed p JOIN ends e ON p.v = e.v AND e.upto >= p.own GROUP BY p.customer")
def balanced_folds(spark, d):
    return folds.balanced_group_folds(_rated(spark, d), "customer")


def _rated(spark, d):
    label = (F.col("o_orderkey") * 7 + F.floor("o_totalprice")) % 4
    return table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), label.cast("int").alias("label"))


@query("""WITH p AS (SELECT participant_id, label FROM preds), n AS (SELECT label, count(*) AS rows_ FROM p GROUP BY label) SELECT label, rows_, TRUE AS even FROM n""")
def fold_balance(spark, d):
    """Rows of each class, and whether the folds' shares of it differ by less than one group's part and a thousandth."""
    p = base(spark, d, "preds").select("participant_id", "label")
    f = p.join(folds.balanced_group_folds(p, "participant_id"), "participant_id")
    n = p.groupBy("label").agg(F.count("*").alias("rows_"))
    return folds.fold_shares(f).join(n, "label").select("label", "rows_", (F.col("spread") <= 8 / F.col("rows_") + 0.001).alias("even"))


# ---------------------------------------------------------------- order statistics and sketches


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def selected_quantiles(spark, d):
    """Brackets of at most 200 rows, so that passes of cutting and counting are taken at any size."""
    e = table(spark, d, "events").select("event_type", "value")
    return rounded(wide_quantiles(e, "value", {"p01": 0.01, "p50": 0.5, "p999": 0.999}, ["event_type"], few=200).join(e.groupBy("event_type").agg(F.count("value").alias("n")), "event_type"))


_SETS = [["event_type", "day"], ["event_type"], ["day"], []]


@query("""SELECT event_type, CAST(ts AS DATE) AS day, CAST(GROUPING(event_type, CAST(ts AS DATE)) AS BIGINT) AS grouping_id, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_within, TRUE AS median_within
FROM events GROUP BY GROUPING SETS ((event_type, CAST(ts AS DATE)), (event_type), (CAST(ts AS DATE)), ())""")
def sketched_groups(spark, d):
    """Sketches by kind and day, written, then merged over four groupings; beside them exact counts and whether the stated errors hold."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    keys = ["event_type", "day"]
    states = cut(sketches.partial_states(e, keys, "user_id", "value"))
    found = sketches.estimates(sketches.merged_states(states, _SETS, keys), [0.5]).withColumn("x", F.get("quantiles", F.lit(0)))
    exact = sketches.exact_groups(e, _SETS, keys, "user_id")
    met = exact.select(*keys, "grouping_id", F.col("n"), F.col("distinct").alias("users")).join(
        found.select(*(F.col(c).alias(f"_{c}") for c in [*keys, "grouping_id", "n"]), "distinct", "x"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "grouping_id", "n"]]
    )
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), sketches.distinct_error(12, 4.0) * F.col("users"))
    null = {"event_type": F.lit(None).cast("string"), "day": F.lit(None).cast("date")}
    groups = F.array(*(F.struct(*((F.col(c) if c in s else null[c]).alias(c) for c in keys)) for s in _SETS))
    each = e.select("value", F.explode(groups).alias("g")).select("g.*", "value")
    ranks = sketches.shares_below(each, keys, "value", met.select(*keys, "x"))
    both = met.join(ranks.select(*(F.col(c).alias(f"r_{c}") for c in keys), "least", "most"), [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys])
    off = 2 * sketches.rank_error(200)
    held = (F.col("least") <= 0.5 + off) & (F.col("most") >= 0.5 - off)
    return both.select(*keys, F.col("grouping_id").cast("long").alias("grouping_id"), "n", "users", near.alias("users_within"), held.alias("median_within"))


# ---------------------------------------------------------------- learning and resampling

_LOGITS = [f"l{c} * 4 - 1" for c in range(3)]


def _focal_terms(gamma: float) -> str:
    """(fold, w, k, loss, slope) a row a conditional task, written out with logarithms."""
    one = lambda k: f"""SELECT participant_id, item_id, fold, w, {k} AS k, power(1 - p, {gamma}) * -ln(p) AS loss, side * ({gamma} * power(1 - p, {gamma}) * p * ln(p) - power(1 - p, {gamma} + 1)) AS slope FROM (
  SELECT *, 1 / (1 + exp(-side * z)) AS p FROM (SELECT participant_id, item_id, fold, w, {_LOGITS[k]} AS z, CASE WHEN label > {k} THEN 1 ELSE -1 END AS side FROM weighed WHERE label >= {k}))"""  # noqa: E731
    return " UNION ALL ".join(one(k) for k in range(3))


_WEIGHED = """n AS (SELECT fold, label, count(*) AS n FROM preds GROUP BY ALL), r AS (SELECT fold, label, 0.001 / (1 - power(0.999, n)) AS r FROM n),
e AS (SELECT fold, label, r / avg(r) OVER (PARTITION BY fold) AS w FROM r), weighed AS (SELECT preds.*, w FROM preds JOIN e USING (fold, label))"""


@query(f"""WITH {_WEIGHED}, plain AS ({_focal_terms(0.0)}), focal AS ({_focal_terms(2.0)}),
a AS (SELECT fold, avg(loss) AS loss, sum(w * loss) / sum(w) AS balanced FROM plain GROUP BY fold), b AS (SELECT fold, avg(loss) AS focal, sum(w * loss) / sum(w) AS balanced_focal FROM focal GROUP BY fold)
SELECT fold, round(loss, 6) AS loss, round(balanced, 6) AS balanced, round(focal, 6) AS focal, round(balanced_focal, 6) AS balanced_focal FROM a JOIN b USING (fold)""")
def focal_losses(spark, d):
    p = _weighed(spark, d)
    out = None
    for name, weight, gamma in (("loss", None, 0.0), ("balanced", "w", 0.0), ("focal", None, 2.0), ("balanced_focal", "w", 2.0)):
        part = metrics.corn_loss(p, "z", weight=weight, by=["fold"], gamma=gamma).withColumnRenamed("loss", name)
        out = part if out is None else out.join(part, "fold")
    return rounded(out)


def _weighed(spark, d):
    p = base(spark, d, "preds").withColumn("z", F.array(*(F.expr(x) for x in _LOGITS)))
    return cut(p.join(metrics.effective_weights(p, ["fold"]).withColumnRenamed("weight", "w"), ["fold", "label"]).select("participant_id", "item_id", "fold", "label", "z", "w"))


@query(f"""WITH {_WEIGHED}, focal AS ({_focal_terms(2.0)}), mass AS (SELECT fold, sum(w) AS m FROM focal GROUP BY fold)
SELECT participant_id, item_id, round(coalesce(sum(w * slope / m) FILTER (k = 0), 0) * 1e4, 6) AS g0, round(coalesce(sum(w * slope / m) FILTER (k = 1), 0) * 1e4, 6) AS g1, round(coalesce(sum(w * slope / m) FILTER (k = 2), 0) * 1e4, 6) AS g2 FROM focal JOIN mass USING (fold) GROUP BY ALL""")
def focal_gradients(spark, d):
    g = metrics.corn_gradient(_weighed(spark, d), "z", weight="w", by=["fold"], gamma=2.0)
    return rounded(g.select("participant_id", "item_id", *((F.get("gradient", F.lit(k)) * 1e4).alias(f"g{k}") for k in range(3))))


@query()
def encoder_out_of_fold(spark, d):
    """An encoder's head: vectors to their label's remainder by 4, five folds fitted at once. Learned, so there is no SQL."""
    e = table(spark, d, "embeddings")
    size = 64
    x = e.select("vec_id", (F.col("vec_id") % 5 + 1).cast("int").alias("fold"), (F.col("label") % 4).cast("int").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(size)))
    return training.out_of_fold(x, [f"x{i}" for i in range(size)], 4).select("vec_id", "fold", "label", "prediction")


_POISSON = f"""
clusters AS (SELECT participant_id, (CAST('0x' || substr(md5(CAST(participant_id AS VARCHAR)), 1, 8) AS BIGINT) % {inference.PRIME} + 42 * 48271) % {inference.PRIME} AS a FROM (SELECT DISTINCT participant_id FROM preds)),
x1 AS (SELECT participant_id, b, a, (a * a + b * 69621 + 1) % {inference.PRIME} AS x FROM clusters, range(2000) r(b)),
x2 AS (SELECT participant_id, b, (x * x + a) % {inference.PRIME} AS x FROM x1),
x3 AS (SELECT participant_id, b AS replicate, (x * x + b) % {inference.PRIME} / {inference.PRIME}.0::DOUBLE AS u FROM x2),
weights AS (SELECT participant_id, replicate, {' + '.join(f'CAST(u >= {c!r}::DOUBLE AS INT)' for c in inference.POISSON)} AS weight FROM x3 WHERE u >= {inference.POISSON[0]!r}::DOUBLE)"""
_POISSON_BOOT = sql_boot().replace(SQL_DRAWS, _POISSON)


@query(f"""WITH {_POISSON_BOOT}, long AS (UNPIVOT (SELECT replicate, run, accuracy, macro_f1, qwk FROM metrics) ON accuracy, macro_f1, qwk INTO NAME metric VALUE value)
SELECT run, metric, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.025), 5) AS ci_lo, round(quantile_cont(value, 0.975), 5) AS ci_hi FROM long GROUP BY run, metric""")
def poisson_intervals(spark, d):
    reps = inference.replicate_metrics(base(spark, d, "preds"), "participant_id", ["encoder_pred", "llm_pred"], resampling="poisson")
    return rounded(inference.intervals(rounded(reps), ["accuracy", "macro_f1", "qwk"]), 5)


@query(f"""WITH {_POISSON_BOOT}, long AS (UNPIVOT (SELECT replicate, run, accuracy, macro_f1, qwk FROM metrics) ON accuracy, macro_f1, qwk INTO NAME metric VALUE value),
dd AS (SELECT replicate, metric, max(value) FILTER (run = 'llm_pred') - max(value) FILTER (run = 'encoder_pred') AS d FROM long GROUP BY ALL)
{SQL_SUMMARY}""")
def poisson_deltas(spark, d):
    reps = inference.replicate_metrics(base(spark, d, "preds"), "participant_id", ["encoder_pred", "llm_pred"], resampling="poisson")
    return rounded(inference.paired_deltas(rounded(reps), "encoder_pred", "llm_pred", ["accuracy", "macro_f1", "qwk"]), 5)


# ---------------------------------------------------------------- sinks and streams


@query("SELECT o_orderkey, o_custkey, o_orderkey % 3 AS batch FROM orders")
def committed_batches(spark, d):
    """Orders appended in three batches, each sent twice, and one more time as a whole with only what is missing."""
    path = new_path(spark, "appended")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    for batch in (0, 1, 1, 2, 0, 2):
        commits.append_once(o.where(F.col("o_orderkey") % 3 == batch), path, "orders", batch)
    commits.append_missing_once(o, path, ["o_orderkey"], "again", 0)
    return commits.committed(spark, path, "o_orderkey long, o_custkey long").select("o_orderkey", "o_custkey", "batch")


def slices(n: int) -> list[tuple[int, int]]:
    """Places 0 to n - 1 in turn: 0 to 2, 3 to 5, then twice as many each, so that one long conversation doesn't make a micro-batch every three turns."""
    out, k = [], 0
    while k < n:
        out.append((k, max(k + 3, 2 * k)))
        k = out[-1][1]
    return out


@query(f"WITH {SQL_WINDOWS} SELECT participant_id, window_id AS context_window_id, array_to_string(turn_ids, ',') AS turn_ids, md5(window_text) AS text_md5 FROM windows")
def streamed_windows(spark, d):
    """Conversations as a stream of files, three turns of every conversation each and from the seventh turn on twice as many a file; then one far later turn, which lets the watermark pass all sessions."""
    path, out, state = (new_path(spark, k) for k in ("turns", "windows", "state"))
    columns = ["participant_id", "pos", "start_time", "end_time", "text"]
    t = base(spark, d, "turns").select(*columns)
    last = t.agg(F.max("pos")).first()[0] or 0
    for first, end in slices(last + 1):
        t.where((F.col("pos") >= first) & (F.col("pos") < end)).coalesce(1).write.mode("append").parquet(path)
    late = t.agg(F.max("end_time").alias("e")).select(F.lit("~").alias("participant_id"), F.lit(0).alias("pos"), (F.col("e") + 1e6).alias("start_time"), (F.col("e") + 1e6).alias("end_time"), F.lit("").alias("text"))
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    sessions.run_once(windows.stream_windows(stream, "0 seconds", size=3), out, state)
    found = spark.read.schema(windows.WINDOW).parquet(out).where("participant_id <> '~'")
    return found.select("participant_id", "context_window_id", F.array_join("turn_ids", ",").alias("turn_ids"), F.md5("window_text").alias("text_md5"))


# ---------------------------------------------------------------- policies, parsers, families, reports

_RANKED = """ranked AS (SELECT participant_id, item_id, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY window_no, rank, agreement) AS rank, 'w' || window_no || '.' || row_number() OVER (PARTITION BY participant_id, item_id ORDER BY window_no, rank, agreement) AS doc_id, CAST(rank AS DOUBLE) / 10 AS score, 'text ' || window_no || '.' || rank AS text, status FROM judged),
keys AS (SELECT DISTINCT participant_id, item_id FROM judged UNION SELECT DISTINCT participant_id, CAST(99 AS INT) FROM judged),
sets AS (SELECT participant_id, item_id, 'none' AS status FROM keys WHERE (participant_id + item_id) % 5 = 0),
kept AS (SELECT * FROM ranked WHERE coalesce(status, 'none') <> 'none'),
lists AS (SELECT k.participant_id, k.item_id, coalesce(list(r.doc_id ORDER BY r.rank) FILTER (r.doc_id IS NOT NULL), []) AS f, coalesce(list(r.text ORDER BY r.rank) FILTER (r.doc_id IS NOT NULL), []) AS ft,
  coalesce(list(r.doc_id ORDER BY CASE WHEN r.status = 'ambiguous' THEN 1 ELSE 0 END, r.rank) FILTER (r.doc_id IS NOT NULL), []) AS i, coalesce(list(r.text ORDER BY CASE WHEN r.status = 'ambiguous' THEN 1 ELSE 0 END, r.rank) FILTER (r.doc_id IS NOT NULL), []) AS it
  FROM keys k LEFT JOIN kept r USING (participant_id, item_id) GROUP BY k.participant_id, k.item_id),
fell AS (SELECT l.*, len(f) = 0 OR s.status IS NOT NULL AS fell, n FROM lists l LEFT JOIN sets s USING (participant_id, item_id) LEFT JOIN (SELECT participant_id, item_id, count(*) AS n FROM ranked GROUP BY ALL) c USING (participant_id, item_id)),
policies AS (SELECT participant_id, item_id, 'filter' AS policy, f AS ids, ft AS texts, coalesce(n, 0) AS n_ranked, FALSE AS fell_back FROM fell
  UNION ALL SELECT participant_id, item_id, 'informative_first', i, it, coalesce(n, 0), FALSE FROM fell
  UNION ALL SELECT participant_id, item_id, 'fallback', CASE WHEN fell THEN ['__transcript__'] ELSE f END, CASE WHEN fell THEN ['whole ' || participant_id] ELSE ft END, coalesce(n, 0), fell FROM fell)"""


def _policies(spark, d):
    j = base(spark, d, "judged")
    name = F.concat(F.col("window_no").cast("string"), F.lit("."), F.col("rank").cast("string"))
    place = F.row_number().over(Window.partitionBy("participant_id", "item_id").orderBy("window_no", "rank", "agreement"))
    rows = cut(j.select("participant_id", "item_id", place.alias("place"), F.concat_ws(".", F.concat(F.lit("w"), F.col("window_no").cast("string")), place.cast("string")).alias("doc_id"), (F.col("rank") / 10).alias("score"), F.concat(F.lit("text "), name).alias("text"), "status"))
    people = rows.select("participant_id").distinct()
    keys = rows.select("participant_id", "item_id").distinct().unionAll(people.select("participant_id", F.lit(99)))
    sets = keys.where("(participant_id + item_id) % 5 = 0").withColumn("status", F.lit("none"))
    transcripts = people.select("participant_id", F.concat(F.lit("whole "), F.col("participant_id").cast("string")).alias("text"))
    judged = rows.where("status IS NOT NULL").select("participant_id", "item_id", "doc_id", "status")
    return policies.evidence_policies(keys, rows.withColumnRenamed("place", "rank").drop("status"), judged, sets, transcripts)


@query(f"WITH {_RANKED} SELECT participant_id, item_id, policy, array_to_string(ids, ',') AS ids, md5(array_to_string(texts, ' [WINDOW_SEP] ')) AS pack_md5, n_ranked, fell_back FROM policies")
def evidence_policies(spark, d):
    return _policies(spark, d).select("participant_id", "item_id", "policy", F.array_join("ids", ",").alias("ids"), F.md5("pack").alias("pack_md5"), "n_ranked", "fell_back")


@query(f"WITH {_RANKED} SELECT policy, count(*) AS n, count(*) FILTER (NOT fell_back AND len(ids) <> n_ranked) AS changed, count(*) FILTER (len(ids) = 0) AS emptied, count(*) FILTER (fell_back) AS fell_back FROM policies GROUP BY policy")
def evidence_policy_counts(spark, d):
    return policies.policy_counts(_policies(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <= 3 THEN ['supports', 'none', 'against', 'ambiguous'][o_orderkey % 7 + 1] WHEN o_orderkey % 7 = 4 THEN 'against' END AS status,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderkey % 6 <= 3 THEN o_orderkey % 6 END WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INT) AS severity_hint,
  CASE WHEN o_orderkey % 7 = 0 THEN repeat('long ', 40) || o_orderkey WHEN o_orderkey % 7 = 1 THEN 'r' WHEN o_orderkey % 7 <= 3 THEN '' WHEN o_orderkey % 7 = 4 THEN '[unparsed reason]' ELSE '[unparseable output]' END AS reason FROM orders""")
def salvage_set_judgments(spark, d):
    i = F.col("o_orderkey")
    text = i.cast("string")
    raw = (
        F.when(i % 7 == 0, F.concat(F.lit('Well: {"status": " Supports ", "severity_hint": '), (i % 6).cast("string"), F.lit(', "reason": "'), F.repeat(F.lit("long "), F.lit(40)), text, F.lit('"}!')))
        .when(i % 7 == 1, '{"status": "none", "severity_hint": "2", "reason": "r"}')  # a text is no number
        .when(i % 7 == 2, '{"status": "against", "severity_hint": true}')
        .when(i % 7 == 3, '{"status": "ambiguous", "severity_hint": 2.9}')
        .when(i % 7 == 4, '{"status": "AGAINST", "severity_hint": 3, "reason": "cut off')
        .when(i % 7 == 5, "nothing here").otherwise('{"status": "maybe"}')
    )
    return table(spark, d, "orders").select("o_orderkey", T.salvage_set_judgment(raw).alias("x")).select("o_orderkey", "x.*")


_RUN = "CASE o_orderkey % 9 WHEN 0 THEN 'cv/seedconf_' WHEN 1 THEN 'cv/ctxm_' WHEN 2 THEN 'cv/ctx_' WHEN 3 THEN 'cv/bm25base_' WHEN 4 THEN 'cv/' WHEN 5 THEN 'sweep_' WHEN 6 THEN 'seeds_' ELSE 'run_' END || o_orderkey"
_SET = "'out/' || CASE o_orderkey % 4 WHEN 0 THEN 'items_full_bm25.csv' WHEN 1 THEN 'windows_w3.csv' WHEN 2 THEN 'windows_w5.csv' ELSE 'plain.csv' END"
_COL = "CASE o_orderkey % 5 WHEN 0 THEN 'retrieved_utterances' WHEN 1 THEN 'bm25_pack' WHEN 2 THEN 'hybrid_pack' WHEN 3 THEN 'baseline_utterances' ELSE 'transcript_text' END"


@query(f"""WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS k, {_SET} AS dataset, {_COL} AS col, CASE WHEN o_custkey % 2 = 0 THEN 'x/mental-base' ELSE 'x/base' END AS model, CASE o_custkey % 3 WHEN 0 THEN 'CORN head' WHEN 1 THEN 'weighted CE' ELSE 'CE' END AS loss FROM orders)
SELECT o_orderkey, ['Multi-seed confirmation (CORN×Hybrid, 5 seeds)', 'MentalBERT context-window matrix', 'BERT context-window matrix', 'Unified BM25 baseline (BERT vs MentalBERT)', 'Original CV (TF-IDF baseline)', 'MentalBERT LR×epoch sweep', 'Multi-seed weighted-CE (TF-IDF)', 'Single split (val/test)', 'Single split (val/test)'][k + 1] AS family,
  CASE WHEN model LIKE '%mental%' THEN 'MentalBERT' ELSE 'BERT' END AS model, CASE loss WHEN 'CORN head' THEN 'CORN' WHEN 'weighted CE' THEN 'weighted CE' ELSE 'plain CE' END AS loss,
  CASE col WHEN 'retrieved_utterances' THEN CASE WHEN dataset LIKE '%full_bm25%' THEN 'BM25 utt' ELSE 'TF-IDF utt' END WHEN 'baseline_utterances' THEN 'Plain (no-retrieval utt)' WHEN 'bm25_pack' THEN 'BM25 ' || CASE WHEN dataset LIKE '%w3%' THEN 'W3' ELSE 'W5' END
    WHEN 'hybrid_pack' THEN 'Hybrid ' || CASE WHEN dataset LIKE '%w3%' THEN 'W3' ELSE 'W5' END ELSE 'other' END AS evidence FROM r""")
def experiment_catalog(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_RUN).alias("run"), F.expr(_SET).alias("dataset"), F.expr(_COL).alias("col"))
    model, loss = F.when(F.col("o_custkey") % 2 == 0, "x/mental-base").otherwise("x/base"), F.when(F.col("o_custkey") % 3 == 0, "CORN head").when(F.col("o_custkey") % 3 == 1, "weighted CE").otherwise("CE")
    method = T.retrieval_method(F.col("dataset"), F.col("col"))
    return o.select("o_orderkey", T.experiment_family(F.col("run")).alias("family"), T.named_by(model, T.MODELS, T.OTHER_MODEL).alias("model"), T.named_by(loss, T.LOSSES, T.OTHER_LOSS).alias("loss"), T.evidence_kind(method, F.col("dataset")).alias("evidence"))


_BAND = "CASE WHEN {0} <= 4 THEN 'minimal' WHEN {0} <= 9 THEN 'mild' WHEN {0} <= 14 THEN 'moderate' WHEN {0} <= 19 THEN 'moderately severe' ELSE 'severe' END"


@query(f"""WITH p AS (SELECT participant_id, item_id, 'Item ' || item_id AS name, CASE WHEN difficult_frac < 0.9 THEN llm_pred END AS y, greatest(l0, l1, l2, l3) AS p_max, status, CASE WHEN self_score >= 0 THEN self_score END AS own, CASE WHEN item_id % 2 = 0 THEN 'words ' || item_id END AS snippet FROM preds),
f AS (SELECT *, CASE WHEN p_max >= 0.6 THEN 'high' WHEN p_max >= 0.4 THEN 'moderate' ELSE 'low' END AS confidence, coalesce(abs(y - own) >= 2 OR (status = 'against' AND own >= 1), FALSE) AS clash, coalesce(status = 'none' AND own >= 1, FALSE) AS quiet, coalesce(status = 'supports' AND own = 0, FALSE) AS only_, coalesce(y = 3 AND p_max >= 0.6, FALSE) AS sure FROM p),
l AS (SELECT *, CASE WHEN y IS NULL THEN '- ' || name || ': not enough evidence for a score.' ELSE '- ' || name || ': predicted ' || y || ' of 3, ' || confidence || ' confidence (' || printf('%.2f', p_max) || '). ' ||
  CASE WHEN status = 'supports' AND snippet IS NOT NULL THEN 'Said: "' || snippet || '".' WHEN status = 'against' THEN 'What was said speaks against this score; please check it.' WHEN status = 'ambiguous' THEN 'What was said can be read either way' || coalesce(': "' || snippet || '".', '.')
    ELSE 'Nothing was said about it; the score is inferred and should be checked.' END END AS line, CASE WHEN y IS NULL THEN 'm' WHEN confidence = 'high' THEN 'h' ELSE 'l' END AS section FROM f),
g AS (SELECT participant_id, 'Participant ' || participant_id || ': predicted total ' || coalesce(CAST(sum(y) AS VARCHAR), '') || ' (' || coalesce({_BAND.format('sum(y)')}, '') || '). Self-reported total ' || coalesce(CAST(sum(own) AS VARCHAR), '') || ' (' || coalesce({_BAND.format('sum(own)')}, '') || ').' AS head,
  string_agg(line, chr(10) ORDER BY item_id) FILTER (section = 'h') AS h, string_agg(line, chr(10) ORDER BY item_id) FILTER (section = 'l') AS l, string_agg(line, chr(10) ORDER BY item_id) FILTER (section = 'm') AS m,
  string_agg('- ' || name || ': self-reported ' || coalesce(CAST(own AS VARCHAR), '') || ', evidence ' || status || '.', chr(10) ORDER BY item_id) FILTER (clash) AS c, string_agg(name, ', ' ORDER BY item_id) FILTER (quiet) AS q, string_agg(name, ', ' ORDER BY item_id) FILTER (only_) AS o, string_agg(name, ', ' ORDER BY item_id) FILTER (clash OR quiet OR only_ OR sure) AS w FROM l GROUP BY participant_id)
SELECT participant_id, head || chr(10) || 'High confidence:' || chr(10) || coalesce(h, '- none') || chr(10) || 'Lower confidence, to be read with care:' || chr(10) || coalesce(l, '- none') || coalesce(chr(10) || 'Without a score:' || chr(10) || m, '') || coalesce(chr(10) || 'Answers that don''t agree:' || chr(10) || c, '')
  || coalesce(chr(10) || 'Reported, but not talked about: ' || q || '.', '') || coalesce(chr(10) || 'Talked about, but not reported: ' || o || '.', '') || coalesce(chr(10) || 'To be followed up: ' || w || '.', '') || chr(10) || 'These are predictions for a reader to check, not findings.' AS report FROM g""")
def clinician_reports(spark, d):
    p = base(spark, d, "preds", placed=True)
    rows = p.select(
        "place", "participant_id", "item_id", F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("name"), F.when(F.col("difficult_frac") < 0.9, F.col("llm_pred")).alias("prediction"), F.array_max("llm").alias("p_max"), "status",
        F.when(F.col("self_score") >= 0, F.col("self_score")).alias("self_score"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("words "), F.col("item_id").cast("string"))).alias("snippet"),
    )
    return reports.rendered(rows)


_TFIDF = SQL["tfidf_top"]
_TFIDF = _TFIDF[: _TFIDF.rindex("SELECT participant_id, item_id, row_number()")].rstrip().replace("AS w FROM utterances)", f"AS w FROM utterances WHERE len({SQL_TOKENS}) > 0)", 1)


def tfidf_ranked(spark, d):
    """The eight items, a blank one and one of stopwords only; ties and documents that share nothing by falling position."""
    docs = base(spark, d, "utterances").withColumn("tokens", T.tokens(F.col("text"), T.STOPWORDS))
    items = base(spark, d, "items").select("item_id", F.col("glossary").alias("text")).unionAll(spark.range(1).selectExpr("9", "' '")).unionAll(spark.range(1).selectExpr("10", "'the and'"))
    asked = items.withColumn("tokens", T.tokens(F.col("text")))
    return rounded(retrieval.tfidf_top(docs, asked, 5, T.STOPWORDS))


QUERIES["tfidf_ranked"] = tfidf_ranked
SQL["tfidf_ranked"] = f"""{_TFIDF},
live AS (SELECT participant_id, doc_id, pos, len({SQL_TOKENS}) > 0 AS has FROM utterances WHERE trim(coalesce(text, '')) <> ''),
every AS (SELECT l.participant_id, i.item_id, l.doc_id, l.pos, round(coalesce(c.score, 0), 9) AS s FROM live l, (SELECT item_id FROM items UNION ALL SELECT 10) i LEFT JOIN c ON c.participant_id = l.participant_id AND c.item_id = i.item_id AND c.doc_id = l.doc_id WHERE l.has)
SELECT participant_id, item_id, CAST(row_number() OVER (PARTITION BY participant_id, item_id ORDER BY s DESC, pos DESC) AS INT) AS rank, doc_id, round(s, 6) AS score, FALSE AS fallback FROM every QUALIFY rank <= 5
UNION ALL SELECT participant_id, 9, CAST(row_number() OVER (PARTITION BY participant_id ORDER BY pos) AS INT) AS rank, doc_id, NULL, TRUE FROM live QUALIFY rank <= 5"""


@query(f"WITH {_sql_bm25(IDF_PLUS, True)}, r AS (SELECT participant_id, item_id, doc_id, score, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY score DESC, pos) AS rank FROM scores JOIN live USING (participant_id, doc_id) WHERE score > 0) SELECT participant_id, item_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 100")
def bm25_candidates(spark, d):
    """The hundred best of each key, over a corpus that keeps documents without a token."""
    got = retrieval.bm25_top(_docs(spark, d), _items(spark, d), retrieval.Ranking(k=100, zero_policy="positive"), keep_empty=True)
    return rounded(got.select("participant_id", "item_id", "rank", "doc_id", "score"))


@query("""SELECT 'lost' AS side, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 500 = 0 UNION ALL SELECT 'added', o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 500 = 0
UNION ALL SELECT 'added', o_orderkey, o_custkey FROM orders WHERE o_orderkey % 700 = 1""")
def input_changes(spark, d):
    """Orders against a copy in which some differ and some come twice."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    other = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).unionAll(o.where("o_orderkey % 700 = 1"))
    return quality.unchanged(o, other)


_HITS = f"""t AS (SELECT source AS participant_id, doc_id, length(text) AS chars, {SQL_TOKENS} AS words FROM documents),
w AS (SELECT t.*, i.item_id, len(list_filter(regexp_split_to_array(i.glossary, ' '), lambda x: list_contains(words, x))) AS hits FROM t, items i)"""


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY hits DESC, doc_id) AS rank FROM w), k AS (SELECT * FROM r WHERE rank <= 5),
p AS (SELECT participant_id, item_id, count(*) AS n_windows, max(hits) AS top, sum(hits) AS hits, sum(chars) AS chars FROM k GROUP BY ALL)
SELECT item_id, round(avg(CAST(top > 0 AS INT)), 6) AS hit_rate, round(avg(hits), 6) AS mean_hits, round(avg(top), 6) AS mean_top, round(avg(n_windows), 6) AS mean_windows, round(sum(chars) / sum(n_windows), 6) AS mean_chars FROM p GROUP BY item_id""")
def item_window_stats(spark, d):
    """Five documents of each source by keyword hits, and what an item's share of them is like."""
    items = base(spark, d, "items").select("item_id", F.split("glossary", " ").alias("words"))
    docs = table(spark, d, "documents").select(F.col("source").alias("participant_id"), "doc_id", T.tokens(F.col("text")).alias("tokens"), F.length("text").alias("chars"))
    hits = F.size(F.filter("words", lambda x: F.array_contains("tokens", x)))
    met = docs.join(F.broadcast(items)).select("participant_id", "item_id", "doc_id", "chars", hits.alias("hits"))  # eight items
    return rounded(summaries.window_stats(met, ["participant_id", "item_id"], "item_id", "hits", "chars", "doc_id", 5))


# ---------------------------------------------------------------- the whole way from turns to packs

#: BM25 over context windows, then the greedy choice of three that overlap by at most half, one candidate a step.
SQL["evidence_dataset"] = with_bases(f"""WITH RECURSIVE {SQL_WINDOWS.strip()},
wdocs AS (SELECT participant_id, window_id AS doc_id, i AS pos, window_text AS text, turn_ids FROM windows),
{_sql_bm25(IDF_PLUS).strip().replace('FROM utterances', 'FROM wdocs')},
every AS (SELECT l.participant_id, i.item_id, l.doc_id, l.pos, coalesce(s.score, 0) AS score FROM live l CROSS JOIN (SELECT item_id FROM items) i LEFT JOIN scores s ON s.participant_id = l.participant_id AND s.item_id = i.item_id AND s.doc_id = l.doc_id),
cand AS (SELECT e.*, d.turn_ids, d.text, row_number() OVER (PARTITION BY e.participant_id, e.item_id ORDER BY score DESC, e.pos) AS r, max(score) OVER (PARTITION BY e.participant_id, e.item_id) AS top FROM every e JOIN wdocs d ON d.participant_id = e.participant_id AND d.doc_id = e.doc_id QUALIFY r <= 15),
walk AS (
  SELECT participant_id, item_id, 0 AS r, CAST([] AS VARCHAR[][]) AS taken, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS rest FROM cand GROUP BY ALL
  UNION ALL
  SELECT w.participant_id, w.item_id, CAST(c.r AS INT), CASE WHEN ok THEN list_append(w.taken, c.turn_ids) ELSE w.taken END, CASE WHEN ok THEN list_append(w.chosen, c.r) ELSE w.chosen END, CASE WHEN ok THEN w.rest ELSE list_append(w.rest, c.r) END
  FROM walk w JOIN cand c ON c.participant_id = w.participant_id AND c.item_id = w.item_id AND c.r = w.r + 1,
  LATERAL (SELECT len(w.taken) < 3 AND (c.top = 0 OR len(list_filter(w.taken, lambda t: len(list_intersect(t, c.turn_ids)) > 0.5 * least(len(t), len(c.turn_ids)))) = 0) AS ok)),
done AS (SELECT participant_id, item_id, list_concat(chosen, rest)[1:3] AS picks FROM walk QUALIFY row_number() OVER (PARTITION BY participant_id, item_id ORDER BY r DESC) = 1),
picked AS (SELECT participant_id, item_id, unnest(picks) AS r, unnest(range(1, len(picks) + 1)) AS place FROM done),
packs AS (SELECT p.participant_id, p.item_id, list(c.doc_id ORDER BY place) AS ids, list(c.score ORDER BY place) AS scores, string_agg(c.text, ' [WINDOW_SEP] ' ORDER BY place) AS pack, count(*) AS n FROM picked p JOIN cand c ON c.participant_id = p.participant_id AND c.item_id = p.item_id AND c.r = p.r GROUP BY ALL)
SELECT k.participant_id, k.item_id, ids, scores, coalesce(pack, '') AS pack, CAST(coalesce(n, 0) AS INT) AS n_windows FROM (SELECT DISTINCT w.participant_id, i.item_id FROM windows w, items i) k LEFT JOIN packs USING (participant_id, item_id)""")


# ---------------------------------------------------------------- loading, and reports of examples

_MESSY = """messy AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '  ' ELSE ' p' || o_custkey || ' ' END AS participant_id, CASE o_orderkey % 7 WHEN 0 THEN '3.0' WHEN 1 THEN '2.5' WHEN 2 THEN 'two' ELSE ' ' || o_orderkey % 10 END AS item_id,
  CASE o_orderkey % 5 WHEN 0 THEN '1e0' WHEN 1 THEN '-1' WHEN 2 THEN NULL ELSE CAST(o_orderkey % 4 AS STRING) END AS label, CASE o_orderkey % 11 WHEN 0 THEN ' ' ELSE ' said ' END AS text, CASE o_orderkey % 6 WHEN 0 THEN 'Train ' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'TEST' END AS split FROM orders)"""


@query(f"""WITH {_MESSY}, t AS (SELECT o_orderkey, nullif(trim(participant_id), '') AS participant_id, TRY_CAST(trim(item_id) AS DOUBLE) AS i, TRY_CAST(trim(label) AS DOUBLE) AS l, nullif(trim(text), '') AS text, lower(trim(split)) AS split FROM messy),
c AS (SELECT o_orderkey, participant_id, CASE WHEN i = floor(i) THEN CAST(i AS INT) END AS item_id, CASE WHEN l = floor(l) THEN CAST(l AS INT) END AS label, text, split FROM t)
SELECT participant_id, item_id, label, text, split, concat_ws(',', CASE WHEN participant_id IS NULL THEN 'null_participant' END, CASE WHEN NOT coalesce(item_id BETWEEN 1 AND 8, FALSE) THEN 'item_domain' END, CASE WHEN NOT coalesce(label BETWEEN 0 AND 3, FALSE) THEN 'label_domain' END,
  CASE WHEN text IS NULL THEN 'blank_text' END, CASE WHEN NOT coalesce(split IN ('train', 'test'), FALSE) THEN 'unknown_split' END) AS problems, count(*) AS n FROM c GROUP BY ALL""")
def loaded_items(spark, d):
    """Orders as a messy data set, read into typed rows, counted by what they have become."""
    df = quality.coerced_items(sql(spark, d, f"WITH {_MESSY} SELECT * FROM messy"), splits=("train", "test"))
    return df.withColumn("problems", F.array_join("problems", ",")).groupBy("participant_id", "item_id", "label", "text", "split", "problems").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT status, participant_id, item_id, llm_pred, label, self_score, row_number() OVER (PARTITION BY status ORDER BY abs(llm_pred - label) DESC, participant_id, item_id) AS r, count(*) OVER (PARTITION BY status) AS n FROM preds)
SELECT status, '## Status ' || status || chr(10) || chr(10) || least(any_value(n), 3) || ' of ' || any_value(n) || ' rows' || chr(10) || chr(10) || string_agg('### ' || r || chr(10) || chr(10) || '**participant_id** ' || participant_id || ', **item_id** ' || item_id || ', **llm_pred** ' || llm_pred || ', **own** ' || coalesce(CAST(CASE WHEN self_score >= 0 THEN self_score END AS VARCHAR), '-')
  || chr(10) || chr(10) || '> predicted ' || llm_pred || chr(10) || '> labelled ' || label, chr(10) || chr(10) ORDER BY r) AS report FROM r WHERE r <= 3 GROUP BY status""")
def qualitative_examples(spark, d):
    """The three worst predictions of each evidence status, as Markdown."""
    p = base(spark, d, "preds").withColumn("off", F.abs(F.col("llm_pred") - F.col("label"))).withColumn("own", F.when(F.col("self_score") >= 0, F.col("self_score")))
    said = F.concat(F.lit("predicted "), F.col("llm_pred").cast("string"), F.lit("\n"), F.lit("labelled "), F.col("label").cast("string"))
    return reports.qualitative(p.withColumn("said", said), "status", [F.desc("off"), "participant_id", "item_id"], ["participant_id", "item_id", "llm_pred", "own"], "said", "Status", 3)
