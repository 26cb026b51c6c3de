"""Validation as queries: each check returns the rows that violate it, as (check, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_transcript


def violations(df: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """(check, key) for every row and check that holds for it; one pass, one row a violation."""
    hits = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return df.select(F.explode(hits).alias("check"), key.cast("string").alias("key"))


def repeated(df: DataFrame, keys: list[str], check: str, most: int = 1) -> DataFrame:
    """Groups of more than `most` rows."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).count().where(F.col("count") > most).select(F.lit(check).alias("check"), text.alias("key"))


def item_dataset(df: DataFrame, items: int = 8, labels: int = 3) -> DataFrame:
    """Nulls, domains, blanks, more than `items` rows a participant, repeated keys."""
    key = F.concat_ws("|", F.col("participant_id").cast("string"), F.col("item_id").cast("string"))
    label = F.col("label").try_cast("double")
    rows = violations(df, key, {
        "null_participant": F.col("participant_id").isNull(),
        "item_domain": ~F.coalesce(F.col("item_id").between(1, items), F.lit(False)),
        "label_domain": ~F.coalesce((label == F.floor(label)) & label.between(0, labels), F.lit(False)),
        "blank_text": F.trim(F.coalesce("text", F.lit(""))) == "",
    })
    return rows.unionAll(repeated(df, ["participant_id"], "too_many_items", items)).unionAll(repeated(df, ["participant_id", "item_id"], "repeated_key"))


def coerced_items(df: DataFrame, items: int = 8, labels: int = 3, splits: tuple[str, ...] = ()) -> DataFrame:
    """df, its columns of any type, as typed rows: participant_id string, item_id int, label int, text string, split string, and `problems`.

    Names and texts lose outer white space, blank names and texts are null, numbers may be written as
    texts or with a fraction of zero, splits are lower-cased (null where df has none). problems lists what item_dataset() would
    say of the row by itself, and `unknown_split` for a split that isn't one of splits, if any are given; what
    can't be coerced is null and a problem. No row is dropped: good ones have no problem.
    """
    text = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", ""))
    filled = lambda c: F.when(text(c) != "", text(c))

    def whole(c: str) -> Column:
        n = text(c).try_cast("double")
        return F.when(n == F.floor(n), n.try_cast("int"))

    split = F.lower(filled("split")) if "split" in df.columns else F.lit(None).cast("string")
    out = df.select(filled("participant_id").alias("participant_id"), whole("item_id").alias("item_id"), whole("label").alias("label"), filled("text").alias("text"), split.alias("split"))
    checks = {
        "null_participant": F.col("participant_id").isNull(),
        "item_domain": ~F.coalesce(F.col("item_id").between(1, items), F.lit(False)),
        "label_domain": ~F.coalesce(F.col("label").between(0, labels), F.lit(False)),
        "blank_text": F.col("text").isNull(),
    }
    if splits:
        checks["unknown_split"] = ~F.coalesce(F.col("split").isin(*splits), F.lit(False))
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return out.withColumn("problems", found)


def near(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within a relative or absolute tolerance; two nulls are equal."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance)), a.isNull() & b.isNull())


def turn_bank(bank: DataFrame, raw: DataFrame) -> DataFrame:
    """Coverage, contiguous indexes, id format, times and confidences, texts against the raw rows; time running back is `inversion`."""
    by = Window.partitionBy("participant_id").orderBy("turn_index")
    seen = bank.withColumn("_n", F.row_number().over(by) - 1).withColumn("_before", F.lag("start_time").over(by))
    rows = violations(seen, F.col("turn_id"), {
        "index_gap": F.col("_n") != F.col("turn_index"),
        "id_format": F.col("turn_id") != F.format_string("%s_t%04d", F.col("participant_id").cast("string"), F.col("turn_index")),
        "time_order": F.col("start_time") > F.col("end_time"),
        "inversion": F.col("start_time") < F.col("_before"),
    })
    a, b = bank.alias("a"), raw.alias("b")
    met = a.join(b, (F.col("a.participant_id") == F.col("b.participant_id")) & (F.col("a.pos") == F.col("b.pos")), "full_outer")
    cover = violations(met, F.concat_ws("|", F.coalesce("a.participant_id", "b.participant_id").cast("string"), F.coalesce("a.pos", "b.pos").cast("string")), {
        "missing_turn": F.col("a.pos").isNull(),
        "extra_turn": F.col("b.pos").isNull(),
        "time_changed": ~near(F.col("a.start_time"), F.col("b.start_time")) & F.col("a.pos").isNotNull() & F.col("b.pos").isNotNull(),
    })
    return rows.unionAll(cover).unionAll(repeated(bank, ["turn_id"], "repeated_id"))


def window_bank(windows: DataFrame, expected: DataFrame) -> DataFrame:
    """Windows compared null-safe, field by field, with windows made anew."""
    fields = ["center_turn_id", "turn_ids", "n_turns", "window_text"]
    a, b = windows.alias("a"), expected.alias("b")
    met = a.join(b, F.col("a.context_window_id") == F.col("b.context_window_id"), "full_outer")
    both = F.col("a.context_window_id").isNotNull() & F.col("b.context_window_id").isNotNull()
    checks = {"missing_window": F.col("a.context_window_id").isNull(), "extra_window": F.col("b.context_window_id").isNull()}
    checks |= {f"differs_{f}": both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields}
    checks |= {f"differs_{f}": both & ~near(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in ("start_time", "end_time")}
    return violations(met, F.coalesce("a.context_window_id", "b.context_window_id"), checks)


def leakage(splits: DataFrame, key: str = "participant_id") -> DataFrame:
    """Keys in more than one split, with the splits."""
    return splits.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def split_overlaps(splits: DataFrame, key: str = "participant_id") -> DataFrame:
    """How many keys each pair of splits shares; one pass over each key's few splits."""
    sets = splits.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("split_a"), y.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost or added, with repeats: (side, ...)."""
    lost = before.exceptAll(after).withColumn("side", F.lit("lost"))
    return lost.unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def incomplete(df: DataFrame, key: str, rows: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != rows)


def without_columns(df: DataFrame, denied: list[str]) -> DataFrame:
    """df without text-bearing columns; an error if one is left under another case."""
    out = df.drop(*(c for c in df.columns if c in denied))
    left = [c for c in out.columns if c.lower() in {d.lower() for d in denied}]
    if left:
        raise ValueError(f"columns that must not leave: {left}")
    return out


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def first_column(df: DataFrame, names: list[str], needed: bool = True) -> str | None:
    """The first of names that df has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and needed:
        raise ValueError(f"none of {names} in {df.columns}")
    return found


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys in one only."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit("left_only").alias("side"), key).unionAll(
        b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit("right_only").alias("side"), key)
    )


def turn_texts(bank: DataFrame, raw: DataFrame, key: list[str], texts: list[str], confidence: str = "confidence") -> DataFrame:
    """Turns whose texts aren't those of the raw rows, whose confidence is not within 0..1, or that only one side has."""
    a, b = bank.alias("a"), raw.alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    both = F.col(f"a.{key[0]}").isNotNull() & F.col(f"b.{key[0]}").isNotNull()
    checks = {"missing_turn": F.col(f"a.{key[0]}").isNull(), "extra_turn": F.col(f"b.{key[0]}").isNull()}
    checks |= {f"changed_{t}": both & ~F.col(f"a.{t}").eqNullSafe(F.col(f"b.{t}")) for t in texts}
    if confidence in bank.columns:
        checks["confidence_range"] = ~F.coalesce(F.col(f"a.{confidence}").between(0, 1), F.lit(True))
    return violations(met, F.concat_ws("|", *(F.coalesce(f"a.{k}", f"b.{k}").cast("string") for k in key)), checks)


def split_domain(splits: DataFrame, names: list[str], key: str = "participant_id") -> DataFrame:
    """Rows of a split that isn't one of the names, and names that no row has."""
    want = splits.sparkSession.createDataFrame([(n,) for n in names], "split string")
    lacking = want.join(splits.select("split").distinct(), "split", "left_anti").select(F.lit("empty_split").alias("check"), F.col("split").alias("key"))
    return violations(splits, F.col(key), {"unknown_split": ~F.coalesce(F.col("split").isin(names), F.lit(False))}).unionAll(lacking)


def retrieval_outputs(ranked: DataFrame, docs: DataFrame, keys: list[str], k: int, budget: int | None = None, words: str = "n_words") -> DataFrame:
    """Ranked rows of documents that aren't the participant's, ranks beyond k or with gaps, repeated documents, packs over a budget of words."""
    own = docs.select("participant_id", "doc_id").distinct().withColumn("_own", F.lit(True))
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in keys))
    met = ranked.join(own, ["participant_id", "doc_id"], "left")
    rows = violations(met, F.concat_ws("|", key, F.col("doc_id").cast("string")), {"foreign_document": F.col("_own").isNull(), "rank_over_k": F.col("rank") > k})
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("rank").alias("_top"), F.count_distinct("doc_id").alias("_docs"), *([F.sum(words).alias("_words")] if budget else []))
    checks = {"rank_gap": F.col("_top") != F.col("_n"), "repeated_document": F.col("_docs") < F.col("_n")}
    if budget:
        checks["over_budget"] = (F.col("_words") + F.col("_n") - 1 > budget) & (F.col("_n") > 1)
    return rows.unionAll(violations(sizes, key, checks))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only one side has, and whether the sets are equal."""
    d = set_differences(a, b, key)
    return d.agg(F.count_if(F.col("side") == "left_only").alias("left_only"), F.count_if(F.col("side") == "right_only").alias("right_only")).withColumn("equal", F.col("left_only") + F.col("right_only") == 0)


def numeric(df: DataFrame, columns: list[str], key: str, pos: str = "pos") -> DataFrame:
    """Values that are no numbers, nulls too: (check, key), the key with the row's line in a file that has a head (pos + 2)."""
    line = F.concat_ws("|", F.col(key).cast("string"), (F.col(pos) + 2).cast("string"))
    return violations(df, line, {f"invalid_{c}": F.col(c).cast("string").try_cast("double").isNull() for c in columns})


def utterance_bank(bank: DataFrame, key: str = "participant_id", text: str = "text") -> DataFrame:
    """Blank participants, and participants who have nothing left when their utterances are cleaned."""
    left = F.count_if(clean_transcript(F.col(text)) != "")
    g = bank.groupBy(key).agg(left.alias("_left"))
    return violations(g, F.col(key), {"blank_participant": F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", "empty_participant": F.col("_left") == 0})


def dimension(items: DataFrame, size: int, texts: list[str]) -> DataFrame:
    """Ids other than 1..size, ids that lack or repeat, blank texts of a dimension of a few rows."""
    want = items.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("_id"))
    met = items.join(want, F.col("item_id") == F.col("_id"), "full_outer")
    key = F.coalesce("item_id", "_id")
    checks = {"missing_id": F.col("item_id").isNull() & F.col("_id").isNotNull(), "unknown_id": F.col("_id").isNull()}
    checks |= {f"blank_{c}": F.col("item_id").isNotNull() & (F.trim(F.coalesce(c, F.lit(""))) == "") for c in texts}
    return violations(met, key, checks).unionAll(repeated(items, ["item_id"], "repeated_id"))


def coverage(run: DataFrame, whole: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    """One row: whether a run has every fold of the whole and at least `least` of its rows, so that the two may be compared."""
    met = run.select(*keys).distinct().join(whole.select(*keys, "fold"), keys)
    a = met.agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("rows"))
    b = whole.agg(F.count_distinct("fold").alias("all_folds"), F.count("*").alias("all_rows"))
    both = a.join(F.broadcast(b))  # one row each
    return both.withColumn("complete", (F.col("folds") == F.col("all_folds")) & (F.col("rows") >= least * F.col("all_rows")))


def label_disagreements(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Keys of both whose labels differ, null-safe; runs may be compared if there are none."""
    both = a.select(*keys, F.col(label).alias("label_a")).join(b.select(*keys, F.col(label).alias("label_b")), keys)
    return both.where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def unmatched(base: DataFrame, other: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of base that find no value of `column` in other: a lookup that must not miss."""
    return base.join(other.where(F.col(column).isNotNull()).select(*keys).distinct(), keys, "left_anti")


def scored_records(records: DataFrame, keys: list[str], ids: str, scores: str) -> DataFrame:
    """Records whose id and score lists are null, differ in length or repeat an id, and keys that come twice."""
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    rows = violations(records, key, {
        "invalid_lists": F.col(ids).isNull() | F.col(scores).isNull(),
        "length_mismatch": F.size(ids) != F.size(scores),
        "repeated_id": F.size(F.array_distinct(ids)) < F.size(ids),
    })
    return rows.unionAll(repeated(records, keys, "repeated_key"))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys...): keys that only one of two record tables has."""
    one = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys), keys, "left_anti").select(F.lit(side).alias("side"), *keys)
    return one(a, b, "left_only").unionAll(one(b, a, "right_only"))


def columns_like(df: DataFrame, parts: list[str], needed: bool = True) -> list[str]:
    """Columns whose names contain any of the parts, whatever their case; an error if a needed part is in none."""
    low = {c: c.lower() for c in df.columns}
    lacking = [p for p in parts if not any(p.lower() in x for x in low.values())]
    if needed and lacking:
        raise ValueError(f"no column like {lacking}")
    return [c for c, x in low.items() if any(p.lower() in x for p in parts)]


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, checks)
