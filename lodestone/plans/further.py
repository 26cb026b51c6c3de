"""Further registered queries: query payloads, full rankings, expansion variants, policies, checks between runs, run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import text as T
from lodestone.operators import dense, fusion, lexicon, metrics, quality, reports, retrieval, sequences, summaries
from lodestone.plans import studies
from lodestone.plans.base import base
from lodestone.plans.catalog import IDF_PLUS, SQL_FULL, SQL_SEMANTIC, SQL_STOP, SQL_TWO, _docs, _items, _sql_bm25, item_vectors, query, rounded, sql_metrics
from lodestone.sources.tables import table

# ---------------------------------------------------------------- queries asked of an item

KINDS_SQL = "k(config, kind) AS (VALUES ('L0_CORE', 'item'), ('L1_CORE_LAY', 'item'), ('L1_CORE_LAY', 'lay'), ('L2_CORE_CLINICAL', 'item'), ('L2_CORE_CLINICAL', 'clinical'), ('L3_FULL', 'item'), ('L3_FULL', 'lay'), ('L3_FULL', 'clinical'))"


@query(f"WITH {KINDS_SQL} SELECT config, item_id, id, kind, pole, text FROM asked_of JOIN k USING (kind)")
def active_queries(spark, d):
    return lexicon.active_queries(base(spark, d, "asked_of"))


@query(f"""WITH {KINDS_SQL}, n AS (SELECT config, item_id, string_agg(id || ':' || pole, ',' ORDER BY id, pole) AS ids FROM asked_of JOIN k USING (kind) GROUP BY ALL),
u AS (SELECT item_id, string_agg(DISTINCT term, ',' ORDER BY term) AS used FROM asked_of JOIN (SELECT item_id, term FROM terms WHERE decision = 'keep') USING (item_id) WHERE kind = 'clinical' AND contains(lower(text), lower(term)) GROUP BY item_id)
SELECT a.item_id, string_agg(DISTINCT pole, ',' ORDER BY pole) AS poles, count(DISTINCT pole) > 1 AS bipolar, CAST(count(*) AS INT) AS n_queries,
  (SELECT ids FROM n WHERE n.item_id = a.item_id AND config = 'L0_CORE') AS l0, (SELECT ids FROM n WHERE n.item_id = a.item_id AND config = 'L3_FULL') AS l3, coalesce((SELECT used FROM u WHERE u.item_id = a.item_id), '') AS used
FROM asked_of a GROUP BY a.item_id""")
def semantic_query_payloads(spark, d):
    kept = base(spark, d, "terms").where("decision = 'keep'").select("item_id", "term")
    schema = "poles array<string>, bipolar boolean, n_queries int, active_by_config struct<L0_CORE: array<string>, L3_FULL: array<string>>, queries array<struct<clinical_terms_used: array<string>>>"
    p = lexicon.query_payload(base(spark, d, "asked_of"), kept).select("item_id", F.from_json("payload", schema).alias("p"))
    used = F.array_sort(F.array_distinct(F.flatten(F.transform("p.queries", lambda q: F.coalesce(q["clinical_terms_used"], F.array().cast("array<string>"))))))
    return p.select("item_id", F.array_join("p.poles", ",").alias("poles"), "p.bipolar", "p.n_queries", F.array_join("p.active_by_config.L0_CORE", ",").alias("l0"), F.array_join("p.active_by_config.L3_FULL", ",").alias("l3"), F.array_join(used, ",").alias("used"))


# ---------------------------------------------------------------- rankings

CONFIG_ITEMS = "two AS (SELECT item_id, 'bare' AS config, glossary FROM items UNION ALL SELECT item_id, 'expanded', glossary || ' the license terms' FROM items)"


def _configs(spark, d) -> DataFrame:
    items = base(spark, d, "items")
    both = items.select("item_id", F.lit("bare").alias("config"), "glossary").unionAll(items.select("item_id", F.lit("expanded").alias("config"), F.concat("glossary", F.lit(" the license terms")).alias("glossary")))
    return both.select("item_id", "config", T.tokens(F.col("glossary"), T.STOPWORDS).alias("tokens"))


def _sql_configs() -> str:
    """BM25 scores of both configurations: item_id stands for item and configuration together."""
    text = _sql_bm25(IDF_PLUS).replace("FROM items", "FROM coded")
    return f"{CONFIG_ITEMS}, coded AS (SELECT item_id * 10 + CASE config WHEN 'bare' THEN 0 ELSE 1 END AS item_id, glossary FROM two), {text}"


@query(f"""WITH {_sql_configs()},
b AS (SELECT participant_id, item_id, 'bm25' AS retriever, doc_id, score, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY score DESC, pos) AS rank FROM scores JOIN live USING (participant_id, doc_id)),
qv AS (SELECT vec_id // 40 * 10 + vec_id // 20 % 2 AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 20 = 0 AND vec_id // 40 BETWEEN 1 AND 8),
dv AS (SELECT participant_id, doc_id, pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM doc_vectors JOIN live USING (participant_id, doc_id, pos)),
s AS (SELECT participant_id, item_id, 'semantic' AS retriever, doc_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 9) AS score, pos FROM dv, qv),
sr AS (SELECT participant_id, item_id, retriever, doc_id, score, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY score DESC, pos) AS rank FROM s)
SELECT participant_id, CAST(item_id // 10 AS INT) AS item_id, CASE item_id % 10 WHEN 0 THEN 'bare' ELSE 'expanded' END AS config, retriever, rank, doc_id, round(score, 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM sr) WHERE rank <= 20""")
def full_rankings(spark, d):
    """An item's configurations have a vector each: every twentieth one, two an item."""
    docs, asked = _docs(spark, d), _configs(spark, d)
    vectors = table(spark, d, "embeddings").where("vec_id % 20 = 0 AND vec_id div 40 BETWEEN 1 AND 8").select(F.expr("CAST(vec_id div 20 AS INT)").alias("item_id"), "embedding")
    near = dense.nearest(base(spark, d, "doc_vectors").join(docs.where(F.size("tokens") > 0).select("participant_id", "doc_id"), ["participant_id", "doc_id"]), vectors, 20)
    config = F.when(F.col("item_id") % 2 == 0, "bare").otherwise("expanded")
    semantic = near.select("participant_id", F.floor(F.col("item_id") / 2).cast("int").alias("item_id"), config.alias("config"), "doc_id", "score")
    return rounded(retrieval.full_rankings(docs, asked, semantic))


@query(f"""WITH {_sql_configs()},
r AS (SELECT participant_id, item_id, doc_id, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY score DESC, pos) AS rank FROM scores JOIN live USING (participant_id, doc_id)),
l AS (SELECT participant_id, item_id, string_agg(doc_id, ',' ORDER BY rank) AS ids, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL),
k AS (SELECT p.participant_id, i.item_id FROM (SELECT DISTINCT participant_id FROM live) p, items i)
SELECT k.participant_id, k.item_id, coalesce(a.ids, '') AS ids_bare, CAST(coalesce(a.n, 0) AS INT) AS n_bare, coalesce(b.ids, '') AS ids_expanded, CAST(coalesce(b.n, 0) AS INT) AS n_expanded
FROM k LEFT JOIN l a ON a.participant_id = k.participant_id AND a.item_id = k.item_id * 10 LEFT JOIN l b ON b.participant_id = k.participant_id AND b.item_id = k.item_id * 10 + 1""")
def expansion_variants(spark, d):
    items, asked = _items(spark, d), _configs(spark, d)
    docs = retrieval.postings(_docs(spark, d), asked)
    variants = {c: asked.where(F.col("config") == c).drop("config") for c in ("bare", "expanded")}
    keys = docs.select("participant_id").distinct().join(items.select("item_id"))
    v = retrieval.expansion_variants(docs, variants, keys)
    return v.select("participant_id", "item_id", *(F.array_join(F.coalesce(f"ids_{c}", F.array().cast("array<string>")), ",").alias(f"ids_{c}") for c in variants), "n_bare", "n_expanded")


@query(f"""WITH {SQL_FULL}, {SQL_SEMANTIC}, b AS (SELECT participant_id, item_id, doc_id, pos, score AS b, coalesce(semantic, 0) AS s FROM every LEFT JOIN sem USING (participant_id, item_id, doc_id, pos)),
n AS (SELECT *, CASE WHEN max(b) OVER w - min(b) OVER w > 1e-12 THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END AS nb, CASE WHEN max(s) OVER w - min(s) OVER w > 1e-12 THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0 END AS ns FROM b WINDOW w AS (PARTITION BY participant_id, item_id)),
f AS (SELECT *, round(0.7 * ns + 0.3 * nb, 9) AS f FROM n)
SELECT participant_id, item_id, doc_id, round(f, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY participant_id, item_id ORDER BY f DESC, pos) <= 5""")
def hybrid_prototype(spark, d):
    """Every document takes part; one without a vector, or without a term, counts as 0 on that side."""
    docs, items = _docs(spark, d), _items(spark, d)
    post = retrieval.postings(docs, items)
    live = post.select("participant_id", "doc_id", "pos")
    near = dense.all_scores(base(spark, d, "doc_vectors").join(live, ["participant_id", "doc_id", "pos"]), item_vectors(spark, d)).select("participant_id", "item_id", "doc_id", "score")
    rest = live.join(F.broadcast(items.select("item_id"))).join(near, ["participant_id", "item_id", "doc_id"], "left").fillna(0.0, ["score"])  # eight items
    b = retrieval.bm25_scores(post, items).join(live, ["participant_id", "doc_id"])
    return rounded(retrieval.hybrid_prototype(b, rest, alpha=0.7).select("participant_id", "item_id", "doc_id", "score"))


@query(f"""WITH {SQL_FULL}, t AS (SELECT source AS participant_id, CAST(doc_id AS VARCHAR) AS doc_id, text, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
r AS (SELECT r.*, t.w, t.text, sum(t.w + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r.participant_id, r.item_id ORDER BY rank) AS used FROM ranked r JOIN t USING (participant_id, doc_id) WHERE rank <= 5),
k AS (SELECT p.participant_id, i.item_id FROM (SELECT DISTINCT participant_id FROM live) p, items i),
g AS (SELECT participant_id, item_id, string_agg(doc_id, ',' ORDER BY rank) AS ids, md5(string_agg(trim(text), ' [WINDOW_SEP] ' ORDER BY rank)) AS pack_md5, CAST(count(*) AS INT) AS n_windows FROM r WHERE used <= 350 OR rank = 1 GROUP BY ALL)
SELECT participant_id, item_id, ids, pack_md5, n_windows FROM k LEFT JOIN g USING (participant_id, item_id)""")
def hybrid_columns(spark, d):
    docs, items = _docs(spark, d), _items(spark, d)
    post = retrieval.postings(docs, items)
    ranked = retrieval.candidates(retrieval.bm25_scores(post, items), post, items, 5).select(*retrieval.KEY, "rank", "doc_id", "score")
    texts = base(spark, d, "utterances").select("participant_id", "doc_id", F.trim("text").alias("text"))
    keys = post.select("participant_id").distinct().join(items.select("item_id"))
    out = retrieval.hybrid_columns(keys, ranked, texts)
    return out.select("participant_id", "item_id", F.array_join("ids", ",").alias("ids"), F.md5("pack").alias("pack_md5"), "n_windows")


@query(f"WITH {SQL_FULL} SELECT 'bm25' AS method, participant_id, item_id, count(*) AS n, round(sum(score), 4) AS score_sum FROM ranked WHERE rank <= 5 AND score > 0 GROUP BY ALL")
def dispatched_retrieval(spark, d):
    r = retrieval.retrieve("bm25", _docs(spark, d), _items(spark, d)).where("score > 0")
    return rounded(r.groupBy("participant_id", "item_id").agg(F.lit("bm25").alias("method"), F.count("*").alias("n"), F.sum("score").alias("score_sum")), 4)


# ---------------------------------------------------------------- texts

@query("""SELECT participant_id, md5(string_agg(trim(text), chr(10) ORDER BY pos, trim(text)) FILTER (trim(coalesce(text, '')) <> '')) AS transcript_md5 FROM turns GROUP BY participant_id""")
def transcript_texts(spark, d):
    return sequences.transcript_text(base(spark, d, "turns")).select("participant_id", F.md5("transcript").alias("transcript_md5"))


@query("""WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(array_to_string(w[1:59], ' ')) AS pair_md5, CAST(least(len(w), 59) AS INT) AS n_kept FROM w""")
def model_inputs(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.model_input(F.lit("no interest"), F.col("text"), 64).alias("x"))
    return t.select("doc_id", F.md5("x.text_pair").alias("pair_md5"), F.size(F.filter(F.split("x.text_pair", " "), lambda w: w != "")).alias("n_kept"))


@query("""SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(license of|license|the)', '<mark>\\1</mark>', 'gi')) AS marked_md5 FROM documents""")
def highlighted_terms(spark, d):
    terms = F.array(*map(F.lit, ("the", "license", "license of")))
    return table(spark, d, "documents").select("doc_id", F.md5(T.highlighted(F.col("text"), terms)).alias("marked_md5"))


REPLY = """CASE o_orderkey % 6
  WHEN 0 THEN 'So: {"scores": [{"id": 1, "label": ' || (o_orderkey // 6) % 6 || ', "reasoning": "a"}, {"id": "2", "label": "about 2", "reasoning": "b"}, {"label": 3}]}'
  WHEN 1 THEN '{"1": ' || (o_orderkey // 6) % 4 || ', "2": {"label": 1, "reasoning": "c"}, "note": "x"}'
  WHEN 2 THEN '{"scores": []}' WHEN 3 THEN 'nothing to read' WHEN 4 THEN '{"1": "none", "2": 7}' ELSE '{"scores": [{"id": 1, "label": 0}, {"id": 1, "label": 2}]}' END"""


def _replies(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.expr(REPLY.replace("//", "div")).alias("raw"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS kind, (o_orderkey // 6) AS v FROM orders)
SELECT o_orderkey, CAST(CASE kind WHEN 0 THEN CASE WHEN v % 6 <= 3 THEN v % 6 END WHEN 1 THEN v % 4 WHEN 5 THEN 2 END AS INT) AS label_1, CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 END AS INT) AS label_2,
  CASE kind WHEN 0 THEN 'a' ELSE '' END AS reasoning_1, CASE kind WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE '' END AS reasoning_2 FROM k""")
def salvage_transcript_scores(spark, d):
    r = _replies(spark, d).select("o_orderkey", T.transcript_scores(F.col("raw"), 2).alias("s"))
    return r.select("o_orderkey", *(F.get("s", F.lit(i - 1))[f].alias(f"{f}_{i}") for f in ("label", "reasoning") for i in (1, 2)))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'low mood,p' || o_orderkey WHEN 1 THEN '' END AS lay, CASE o_orderkey % 4 WHEN 0 THEN 'anergia' WHEN 1 THEN 'x' END AS clinical FROM orders""")
def salvage_term_lists(spark, d):
    raw = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN 'Here: {"lay": [" Low Mood", "P' || o_orderkey || '", " "], "clinical": ["ANERGIA"]} ok' WHEN 1 THEN '{"clinical": ["X"]}' WHEN 2 THEN 'no list' ELSE '{"lay": [' END""")
    t = table(spark, d, "orders").select("o_orderkey", T.term_lists(raw).alias("t"))
    return t.select("o_orderkey", F.array_join("t.lay", ",").alias("lay"), F.array_join("t.clinical", ",").alias("clinical"))


# ---------------------------------------------------------------- checks

@query("""SELECT 'invalid_a' AS check, CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_orderkey % 100 + 2 AS VARCHAR) AS key FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'invalid_b', CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_orderkey % 100 + 2 AS VARCHAR) FROM orders WHERE o_orderkey % 89 = 0""")
def invalid_numbers(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 100).alias("pos"), F.when(k % 97 == 0, "n/a").otherwise("1.5e3").alias("a"), F.when(k % 89 == 0, None).otherwise("7").alias("b"))
    return quality.numeric(rows, ["a", "b"], "o_orderkey")


@query("SELECT 'empty_participant' AS check, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT 'blank_participant', ' ' FROM customer WHERE c_custkey = 5")
def validate_utterances(spark, d):
    k = F.col("c_custkey")
    one = table(spark, d, "customer").select(F.when(k == 5, " ").otherwise(k.cast("string")).alias("participant_id"), F.when(k % 11 == 0, "[laughs] (pause) ").otherwise("yes [x] so").alias("text"))
    return quality.utterance_bank(one.unionAll(one.where("text LIKE 'yes%'").withColumn("text", F.lit("  "))))


@query("""WITH i AS (SELECT p_partkey + 1 AS item_id FROM part), n AS (SELECT count(*) AS n FROM part)
SELECT 'missing_id' AS check, CAST(item_id AS VARCHAR) AS key FROM i WHERE item_id % 40 = 8 UNION ALL SELECT 'unknown_id', CAST(item_id + n AS VARCHAR) FROM i, n WHERE item_id % 40 = 8
UNION ALL SELECT 'blank_glossary', CAST(item_id AS VARCHAR) FROM i WHERE item_id % 25 = 3 AND item_id % 40 <> 8 UNION ALL SELECT 'blank_glossary', CAST(item_id + n AS VARCHAR) FROM i, n WHERE item_id % 25 = 3 AND item_id % 40 = 8
UNION ALL SELECT 'repeated_id', CAST(item_id AS VARCHAR) FROM i WHERE item_id % 90 = 1 AND item_id % 40 <> 8""")
def validate_dimension(spark, d):
    """Parts as a dimension with ids that are shifted out of it, blank texts and repeated rows."""
    items = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("item_id"), F.col("p_name").alias("glossary"))
    n = items.count()
    changed = items.select(F.when(F.col("item_id") % 40 == 8, F.col("item_id") + n).otherwise(F.col("item_id")).cast("int").alias("item_id"), F.when(F.col("item_id") % 25 == 3, " ").otherwise(F.col("glossary")).alias("glossary"))
    return quality.dimension(changed.unionAll(changed.where("item_id % 90 = 1")), n, ["glossary"])


@query("""WITH m AS (SELECT count(DISTINCT fold) AS folds, count(*) AS rows FROM preds WHERE status <> 'ambiguous'), w AS (SELECT count(DISTINCT fold) AS all_folds, count(*) AS all_rows FROM preds)
SELECT folds, rows, all_folds, all_rows, folds = all_folds AND rows >= 0.95 * all_rows AS complete FROM m, w""")
def run_coverage(spark, d):
    p = base(spark, d, "preds")
    return quality.coverage(p.where("status <> 'ambiguous'"), p, retrieval.KEY)


@query("SELECT participant_id, item_id, label AS label_a, CAST(CASE WHEN participant_id % 13 = 0 THEN NULL ELSE (label + 1) % 4 END AS INT) AS label_b FROM preds WHERE participant_id % 13 = 0 OR (participant_id % 17 = 0 AND item_id = 3)")
def label_disagreements(spark, d):
    p = base(spark, d, "preds")
    pid = F.col("participant_id")
    other = F.when(pid % 13 == 0, F.lit(None)).when((pid % 17 == 0) & (F.col("item_id") == 3), (F.col("label") + 1) % 4).otherwise(F.col("label"))
    return quality.label_disagreements(p, p.withColumn("label", other.cast("int")), retrieval.KEY)


@query("SELECT participant_id, item_id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.participant_id = p.participant_id AND j.item_id = p.item_id AND j.status IS NOT NULL)")
def unmatched_status(spark, d):
    return quality.unmatched(base(spark, d, "preds").select(*retrieval.KEY), base(spark, d, "judged"), retrieval.KEY, "status")


@query("""SELECT 'length_mismatch' AS check, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 50 = 1 UNION ALL SELECT 'repeated_id', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 2
UNION ALL SELECT 'invalid_lists', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 3 UNION ALL SELECT 'repeated_key', '7'""")
def validate_scored_records(spark, d):
    m = F.col("o_orderkey") % 50
    ids = F.when(m == 2, F.array(F.lit("w1"), F.lit("w1"))).when(m == 3, F.lit(None)).otherwise(F.array(F.lit("w1"), F.lit("w2")))
    scores = F.when(m == 1, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.25)))
    r = table(spark, d, "orders").select("o_orderkey", ids.alias("ids"), scores.alias("scores"))
    return quality.scored_records(r.unionAll(r.where("o_orderkey = 7")), ["o_orderkey"], "ids", "scores")


@query("SELECT 'left_only' AS side, o_custkey FROM orders WHERE o_custkey % 9 = 0 GROUP BY o_custkey UNION ALL SELECT 'right_only', o_custkey FROM orders WHERE o_custkey % 10 = 0 AND o_custkey % 9 > 0 GROUP BY o_custkey")
def record_key_differences(spark, d):
    o = table(spark, d, "orders").select("o_custkey")
    c = F.col("o_custkey")
    return quality.key_differences(o.where((c % 9 == 0) | (c % 10 > 0)), o.where(c % 9 > 0), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def chosen_participants(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000")
    return table(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- budgets and selections

@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rank, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
u AS (SELECT *, sum(n + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY rank) AS used FROM r)
SELECT l_orderkey, 40 AS budget, count(*) FILTER (used <= 40) AS n_windows, CAST(coalesce(max(used) FILTER (used <= 40), 0) AS BIGINT) AS total_tokens, CAST(40 - coalesce(max(used) FILTER (used <= 40), 0) AS BIGINT) AS unused_capacity, coalesce(arg_min(n, rank) FILTER (used > 40), 0) AS excluded_next_len FROM u GROUP BY l_orderkey""")
def token_budget_stats(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    r = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(by).alias("rank"), F.col("l_quantity").cast("long").alias("n_tokens"))
    return sequences.token_budget_stats(r, ["l_orderkey"], F.lit(40), sep_tokens=2)


@query("""WITH h AS (SELECT *, md5('42|' || item_id || '|' || participant_id) AS h FROM preds), a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN label >= 2 THEN 0 ELSE 1 END, h, participant_id) = 1 AND label >= 2 AS lead FROM h),
p AS (SELECT item_id, participant_id, label, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN lead THEN 0 ELSE 1 END, h, participant_id) AS pick FROM a)
SELECT * FROM p WHERE pick <= 3""")
def severe_then_random(spark, d):
    return sequences.severe_then_random(base(spark, d, "preds"), ["item_id"], "participant_id", 3, F.col("label") >= 2).select("item_id", "participant_id", "label", "pick")


@query("""WITH r AS (SELECT item_id, participant_id, row_number() OVER (PARTITION BY item_id ORDER BY greatest(l0, l1, l2, l3) DESC, participant_id) AS r, greatest(l0, l1, l2, l3) AS s FROM preds)
SELECT item_id, participant_id FROM r ORDER BY r, s DESC, participant_id LIMIT 10""")
def showcase_examples(spark, d):
    p = base(spark, d, "preds").withColumn("s", F.array_max("llm"))
    return reports.showcase(p, "s", "item_id", "participant_id", 10).select("item_id", "participant_id")


# ---------------------------------------------------------------- policies, frames, statuses

@query("""WITH g AS (SELECT fold, count(*) AS n, count(*) FILTER (status = 'none') AS k FROM preds GROUP BY fold)
SELECT fold, policy, n AS n_train, CAST(CASE policy WHEN 'zero' THEN 0 ELSE k END AS BIGINT) AS n_no_evidence, CAST(CASE policy WHEN 'zero' THEN n ELSE n - k END AS BIGINT) AS n_train_effective FROM g, (VALUES ('zero'), ('mask'), ('drop')) v(policy)""")
def missing_policy_stats(spark, d):
    return fusion.missing_policy_stats(base(spark, d, "preds"), by=["fold"])


@query("""SELECT 'zero' AS policy, label, count(*) AS n FROM preds GROUP BY ALL UNION ALL SELECT 'drop', label, count(*) FROM preds WHERE status <> 'none' GROUP BY ALL
UNION ALL SELECT 'mask', CASE WHEN status = 'none' THEN -1 ELSE label END, count(*) FROM preds GROUP BY ALL""")
def missing_policies(spark, d):
    out = None
    for policy in ("zero", "mask", "drop"):
        one = fusion.missing_policy(base(spark, d, "preds"), policy).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(policy).alias("policy"), "label", "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT participant_id, p.item_id, 'item ' || CAST(p.item_id AS VARCHAR) AS item_name, fold, label, llm_pred AS prediction, CAST(llm_pred = 3 AS INT)::DOUBLE AS p3 FROM preds p")
def model_frames(spark, d):
    names = base(spark, d, "items").select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("item_name"))
    f = fusion.model_frame(base(spark, d, "preds"), F.col("llm_pred"), names)
    return f.select("participant_id", "item_id", "item_name", "fold", "label", "prediction", F.get("probs", F.lit(3)).alias("p3"))


@query("SELECT participant_id, item_id, coalesce(status, 'none') AS evidence_status FROM judged WHERE config = 'L1' AND retriever = 'bm25' AND prefix = 'top5'")
def selected_status(spark, d):
    j = base(spark, d, "judged")
    odd = F.col("window_no") % 2 == 1
    return fusion.selected_status([j.where(odd), j.where(~odd)], "L1", "bm25", "top5")


@query("SELECT participant_id, item_id, label, encoder_pred AS encoder, llm_pred AS llm FROM preds WHERE status <> 'ambiguous' AND item_id <> 4")
def aligned_runs(spark, d):
    p = base(spark, d, "preds")
    runs = {"encoder": p.where("status <> 'ambiguous'").withColumn("prediction", F.col("encoder_pred")), "llm": p.where("item_id <> 4").withColumn("prediction", F.col("llm_pred"))}
    return fusion.aligned(runs, retrieval.KEY)


@query(f"""WITH {SQL_TWO} SELECT a.qwk > b.qwk AND a.macro_f1 >= b.macro_f1 - 0.005 AND a.mae <= b.mae + 0.02 AND coalesce(a.severe_recall >= b.severe_recall - 1e-9, TRUE) AND a.false_severe_rate <= b.false_severe_rate + 0.015 AS accepted, a.item_id
FROM metrics a JOIN metrics b ON a.item_id = b.item_id AND a.run = 'llm' AND b.run = 'encoder'""")
def accepted_items(spark, d):
    long = base(spark, d, "preds").unpivot(["item_id", "label"], ["encoder_pred", "llm_pred"], "run", "prediction")
    m = rounded(metrics.item_metrics(metrics.cells(long, ["run", "item_id"]), ["run", "item_id"]))
    side = lambda r: m.where(F.col("run") == r).select("item_id", F.struct("qwk", "macro_f1", "mae", "severe_recall", "false_severe_rate").alias(r))
    both = side("llm_pred").join(side("encoder_pred"), "item_id")
    return both.select("item_id", fusion.accepted(F.col("llm_pred"), F.col("encoder_pred")).alias("accepted"))


# ---------------------------------------------------------------- losses and vectors

@query("""WITH z AS (SELECT fold, label, l0 * 4 - 1 AS a, l1 * 4 - 1 AS b, l2 * 4 - 1 AS c, 1 + label / 2.0 AS w FROM preds),
t AS (SELECT fold, w, CASE WHEN label > 0 THEN ln(1 + exp(-a)) ELSE ln(1 + exp(a)) END AS l FROM z UNION ALL SELECT fold, w, CASE WHEN label > 1 THEN ln(1 + exp(-b)) ELSE ln(1 + exp(b)) END FROM z WHERE label >= 1
  UNION ALL SELECT fold, w, CASE WHEN label > 2 THEN ln(1 + exp(-c)) ELSE ln(1 + exp(c)) END FROM z WHERE label >= 2)
SELECT fold, round(avg(l), 6) AS loss, round(sum(w * l) / sum(w), 6) AS weighted_loss FROM t GROUP BY fold""")
def conditional_loss(spark, d):
    p = base(spark, d, "preds").withColumns({"z": F.array(*(F.col(f"l{c}") * 4 - 1 for c in range(3))), "w": 1 + F.col("label") / 2.0})
    return rounded(metrics.corn_loss(p, "z", by=["fold"]).join(metrics.corn_loss(p, "z", weight="w", by=["fold"]).withColumnRenamed("loss", "weighted_loss"), "fold"))


@query("""WITH m AS (SELECT participant_id, avg(l0) FILTER (item_id <= 5) AS a, avg(l1) FILTER (item_id <= 5) AS b, avg(l2) FILTER (item_id <= 5) AS c FROM preds GROUP BY 1)
SELECT participant_id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y, round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM m""")
def pooled_vectors(spark, d):
    row = F.struct("item_id", F.array("l0", "l1", "l2").alias("v"), (F.col("item_id") <= 5).cast("int").alias("m"))
    g = base(spark, d, "preds").groupBy("participant_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
    v = g.select("participant_id", A.mean_pool(F.transform("x", lambda r: r["v"]), F.transform("x", lambda r: r["m"]), 3).alias("v"))
    return rounded(v.select("participant_id", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate("xyz"))))


# ---------------------------------------------------------------- run tables

RUNS = "runs(run, dataset, evidence_column) AS (VALUES ('encoder_pred', 'out/items_full_bm25.csv', 'retrieved_utterances'), ('llm_pred', 'out/windows.csv', 'hybrid_pack_top5'), ('later', 'out/plain.csv', 'retrieved_utterances'), ('whole', 'x', 'transcript_text'))"
LONG = "SELECT participant_id, fold, label AS y, encoder_pred AS p, 'encoder_pred' AS run FROM preds UNION ALL SELECT participant_id, fold, label, llm_pred, 'llm_pred' FROM preds"
METHOD = "CASE run WHEN 'encoder_pred' THEN 'BM25 (utterance retrieval)' WHEN 'llm_pred' THEN 'Hybrid: BM25 + semantic (participant-side context windows)' WHEN 'later' THEN 'TF-IDF (utterance retrieval)' ELSE 'full transcript (no retrieval)' END"


def _manifest(spark, d) -> DataFrame:
    long = base(spark, d, "preds").unpivot(["participant_id", "fold", "label"], ["encoder_pred", "llm_pred"], "run", "prediction")
    runs = spark.createDataFrame([("encoder_pred", "out/items_full_bm25.csv", "retrieved_utterances"), ("llm_pred", "out/windows.csv", "hybrid_pack_top5"), ("later", "out/plain.csv", "retrieved_utterances"), ("whole", "x", "transcript_text")], "run string, dataset string, evidence_column string")
    return rounded(studies.run_manifest(long, runs))


@query(f"""WITH {RUNS}, long AS ({LONG}), {sql_metrics('long', 'run')}, s AS (SELECT run, count(*) AS rows, count(DISTINCT participant_id) AS participants, count(DISTINCT fold) AS folds FROM long GROUP BY run)
SELECT run, dataset, evidence_column, {METHOD} AS method, rows, participants, folds, accuracy, macro_f1, qwk, mae FROM runs LEFT JOIN s USING (run) LEFT JOIN metrics USING (run)""")
def run_manifest(spark, d):
    return _manifest(spark, d)


@query(f"""WITH long AS ({LONG}), {sql_metrics('long', 'run')}, u AS (UNPIVOT (SELECT run, accuracy, macro_f1, qwk, mae FROM metrics) ON accuracy, macro_f1, qwk, mae INTO NAME metric VALUE value)
SELECT run, metric, value, rank() OVER w AS rank, rank() OVER w = 1 AS best FROM u WINDOW w AS (PARTITION BY metric ORDER BY CASE WHEN metric = 'mae' THEN value ELSE -value END)""")
def results_summary(spark, d):
    return studies.results_summary(_manifest(spark, d))


@query(f"WITH {SQL_TWO.replace('SELECT item_id,', 'SELECT fold AS item_id,')}, w AS (SELECT a.item_id, a.qwk AS a, b.qwk AS b FROM metrics a JOIN metrics b ON a.item_id = b.item_id AND a.run = 'encoder' AND b.run = 'llm') SELECT count(*) AS seeds, round(avg(a), 5) AS mean_a, round(stddev_samp(a), 5) AS sd_a, round(avg(b), 5) AS mean_b, round(stddev_samp(b), 5) AS sd_b, count(*) FILTER (b > a) AS wins, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 5) AS t FROM w")
def seed_rollup(spark, d):
    long = base(spark, d, "preds").unpivot(["fold", "label"], ["encoder_pred", "llm_pred"], "run", "prediction")
    m = rounded(metrics.item_metrics(metrics.cells(long, ["run", "fold"]), ["run", "fold"]))
    return rounded(summaries.seed_rollup(m, "run", "fold", "qwk", "encoder_pred", "llm_pred"), 5)


RATE = "avg(CAST(coalesce(status, 'none') IN ('supports', 'against') AS INT))"


@query(f"""WITH r AS (SELECT item_id, {RATE} FILTER (config = 'L0') AS a, {RATE} FILTER (config = 'L1') AS b FROM judged GROUP BY item_id)
SELECT item_id, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM r UNION ALL SELECT NULL, round(avg(a), 6), round(avg(b), 6), round(avg(b - a), 6) FROM r""")
def evidence_rate_deltas(spark, d):
    good = F.coalesce(F.col("status").isin("supports", "against"), F.lit(False)).cast("double")
    of = lambda c: base(spark, d, "judged").where(F.col("config") == c).groupBy("item_id").agg(F.avg(good).alias("rate"))
    return rounded(summaries.rate_deltas(of("L0"), of("L1"), "item_id", "rate"))


@query("SELECT config, retriever, round(avg(agreement) FILTER (prefix = 'top3'), 6) AS top3, round(avg(agreement) FILTER (prefix = 'top5'), 6) AS top5, round(avg(agreement) FILTER (prefix = 'budget'), 6) AS budget FROM judged GROUP BY ALL")
def prefix_pivot(spark, d):
    return rounded(summaries.pivoted(base(spark, d, "judged"), ["config", "retriever"], "prefix", ["top3", "top5", "budget"], "agreement"))


@query("""SELECT participant_id, CAST(sum(label) AS BIGINT) AS true_total, CAST(sum(llm_pred) AS BIGINT) AS pred_total, CAST(CASE WHEN sum(llm_pred) <= 4 THEN 0 WHEN sum(llm_pred) <= 9 THEN 1 WHEN sum(llm_pred) <= 14 THEN 2 WHEN sum(llm_pred) <= 19 THEN 3 ELSE 4 END AS INT) AS pred_band FROM preds GROUP BY 1""")
def headline_rows(spark, d):
    p = base(spark, d, "preds").withColumns({"prediction": F.col("llm_pred"), "p_max": F.array_max("llm"), "evidence": F.lit("a"), "self_score": F.col("label")})
    return metrics.headline(reports.records(p), {"true_total": "total.true_total", "pred_total": "total.pred_total", "pred_band": "total.pred_band"}, ["participant_id"])


@query(f"SELECT DISTINCT item_id, term FROM terms WHERE decision = 'keep' AND relation <> 'related_nonspecific' AND lower(term) NOT IN ({SQL_STOP})")
def kept_terms(spark, d):
    return lexicon.kept_terms(base(spark, d, "terms")).where(~F.lower("term").isin(T.STOPWORDS)).select("item_id", "term").distinct()


# ---------------------------------------------------------------- checks of banks and outputs, reports of failures

@query("""SELECT 'changed_text' AS check, participant_id || '|' || pos AS key FROM turns WHERE pos = 1 UNION ALL SELECT 'missing_turn', participant_id || '|' || pos FROM turns WHERE pos = 2 UNION ALL SELECT 'confidence_range', participant_id || '|' || pos FROM turns WHERE pos = 0""")
def validate_turn_texts(spark, d):
    raw = base(spark, d, "turns")
    bank = raw.where("pos <> 2").withColumn("confidence", F.when(F.col("pos") == 0, 1.5).otherwise(0.9)).withColumn("text", F.when(F.col("pos") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return quality.turn_texts(bank, raw, ["participant_id", "pos"], ["text", "speaker"])


@query("SELECT 'unknown_split' AS check, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 301 = 0 UNION ALL SELECT 'empty_split', 'test'")
def validate_splits(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(k.alias("participant_id"), F.when(k % 301 == 0, "dev2").when(k % 2 == 0, "train").otherwise("validation").alias("split"))
    return quality.split_domain(s, ["train", "validation", "test"])


@query(f"""WITH {SQL_FULL}, r AS (SELECT participant_id, item_id, doc_id, rank + CASE WHEN rank = 5 THEN 1 ELSE 0 END AS rank FROM ranked WHERE rank <= 5)
SELECT 'rank_over_k' AS check, participant_id || '|' || item_id || '|' || doc_id AS key FROM r WHERE rank > 5 UNION ALL SELECT 'rank_gap', participant_id || '|' || item_id FROM r GROUP BY participant_id, item_id HAVING max(rank) > count(*)
UNION ALL SELECT 'foreign_document', participant_id || '|' || item_id || '|x' || doc_id FROM r WHERE rank = 1""")
def validate_retrieval(spark, d):
    docs, items = _docs(spark, d), _items(spark, d)
    post = retrieval.postings(docs, items)
    r = retrieval.candidates(retrieval.bm25_scores(post, items), post, items, 5).select(*retrieval.KEY, "doc_id", "rank")
    known = post.select("participant_id", "doc_id")
    bent = r.withColumn("doc_id", F.when(F.col("rank") == 1, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("doc_id"))).withColumn("rank", F.when(F.col("rank") == 5, 6).otherwise(F.col("rank")))
    return quality.retrieval_outputs(bent, known, retrieval.KEY, 5)


@query("SELECT count(*) FILTER (o_custkey % 9 = 0 AND o_custkey % 10 <> 0) AS left_only, 0::BIGINT AS right_only, count(*) FILTER (o_custkey % 9 = 0 AND o_custkey % 10 <> 0) = 0 AS \"equal\" FROM (SELECT DISTINCT o_custkey FROM orders)")
def compared_sets(spark, d):
    o = table(spark, d, "orders").select("o_custkey")
    return quality.same_sets(o, o.where("NOT (o_custkey % 9 = 0 AND o_custkey % 10 <> 0)"), "o_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row FROM orders")
def row_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("place"))
    return sequences.row_index(o, "place").select("o_orderkey", "row")


@query(f"""WITH {SQL_FULL}, r AS (SELECT participant_id, item_id, doc_id, score, rank FROM ranked WHERE rank <= 10 AND score > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY participant_id, item_id ORDER BY round(score / (1.0 + rank % 3), 9) DESC, rank) AS k FROM r), p AS (SELECT participant_id, item_id, string_agg(doc_id, ' [WINDOW_SEP] ' ORDER BY k) AS pack FROM n WHERE k <= 3 GROUP BY ALL)
SELECT a.participant_id, i.item_id, coalesce(p.pack, 'before') AS pack, p.pack IS NOT NULL AS changed FROM (SELECT DISTINCT participant_id FROM live) a CROSS JOIN (SELECT item_id FROM items) i LEFT JOIN p ON p.participant_id = a.participant_id AND p.item_id = i.item_id""")
def reranked_packs(spark, d):
    docs, items = _docs(spark, d), _items(spark, d)
    post = retrieval.postings(docs, items)
    ranked = retrieval.bm25_top(post, items, retrieval.Ranking(k=10, zero_policy="positive"))
    top = rounded(retrieval.reranked(ranked, studies.overlap_scorer, 3), 9).withColumn("text", F.col("doc_id"))
    keys = post.select("participant_id").distinct().join(items.select("item_id")).withColumn("pack", F.lit("before"))
    return retrieval.reranked_or_kept(keys, top).select("participant_id", "item_id", "pack", "changed")


@query(f"""WITH {SQL_FULL} SELECT participant_id, item_id, '[' || string_agg('"' || doc_id || '"', ',' ORDER BY rank) || ']' AS ids_json FROM ranked WHERE rank <= 5 AND score > 0 GROUP BY ALL""")
def serialised_ids(spark, d):
    r = retrieval.retrieve("bm25", _docs(spark, d), _items(spark, d)).where("score > 0")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return r.groupBy("participant_id", "item_id").agg(F.to_json(ids).alias("ids_json"))


@query("""WITH d AS (SELECT label, greatest(e0, e1, e2, e3) < 0.5 AS away FROM preds)
SELECT label, count(*) FILTER (away) AS deferred, count(*) FILTER (NOT away) AS kept, round(count(*) FILTER (away) / (SELECT count(*) FILTER (away) FROM d), 6) AS deferred_share FROM d GROUP BY label""")
def deferred_classes(spark, d):
    return rounded(metrics.deferred_mix(base(spark, d, "preds").withColumn("conf", F.array_max("encoder")), "conf", 0.5))


@query(f"""WITH {SQL_TWO}, long AS (UNPIVOT (SELECT run, item_id, accuracy, mae, qwk FROM metrics) ON accuracy, mae, qwk INTO NAME metric VALUE v),
beside AS (SELECT a.metric, round(b.v - a.v, 6) AS delta FROM long a JOIN long b ON a.item_id = b.item_id AND a.metric = b.metric AND a.run = 'encoder' AND b.run = 'llm')
SELECT metric, count(*) FILTER (CASE WHEN metric = 'mae' THEN delta < 0 ELSE delta > 0 END) AS wins, count(*) FILTER (CASE WHEN metric = 'mae' THEN delta > 0 ELSE delta < 0 END) AS losses, count(*) FILTER (delta = 0) AS ties, round(avg(delta), 5) AS mean_delta FROM beside GROUP BY metric""")
def run_wins(spark, d):
    p = base(spark, d, "preds")
    m = {n: rounded(metrics.item_metrics(metrics.cells(p.withColumn("prediction", F.col(f"{n}_pred")), ["item_id"]), ["item_id"])) for n in ("encoder", "llm")}
    deltas = metrics.run_deltas(m["encoder"], m["llm"], ["item_id"], ["accuracy", "mae", "qwk"])
    return rounded(metrics.wins(rounded(deltas), ["mae"]), 5)


@query(f"""WITH rows_ AS (SELECT *, label AS y, encoder_pred AS p FROM preds), {sql_metrics('rows_', 'item_id')},
w AS (SELECT item_id, n, qwk FROM metrics ORDER BY qwk, item_id LIMIT 3)
SELECT 'weakest_items' AS section, CAST(item_id AS VARCHAR) AS key, n, round(qwk, 6) AS value FROM w UNION ALL SELECT 'by_status', status, count(*), round(avg(CAST(label = encoder_pred AS INT)), 6) FROM preds GROUP BY status
UNION ALL SELECT 'severe_misses', CAST(item_id AS VARCHAR), count(*), round(avg(CAST(label >= 2 AND encoder_pred = 0 AS INT)), 6) FROM preds GROUP BY item_id UNION ALL SELECT 'false_alarms', CAST(item_id AS VARCHAR), count(*), round(avg(CAST(label = 0 AND encoder_pred >= 2 AS INT)), 6) FROM preds GROUP BY item_id""")
def failure_report(spark, d):
    return rounded(metrics.failure_report(base(spark, d, "preds").withColumn("prediction", F.col("encoder_pred"))))
