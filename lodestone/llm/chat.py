"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and of the whole
example only that reply is trainable. What follows the last reply becomes a last example without a
target, so that no turn is lost. An example is

    <s> (<|role|>\\ntext</s>)*

Inside roles and texts, the escape character and whatever could be read as one of the template's or
of other common templates' control strings are written with a backslash, which unescape() takes away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a template or a tokenizer may take for a mark.
CONTROL = ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, example, formatted, loss_start, loss_end).

    loss_start and loss_end bound the trainable code points of `formatted`, from 0; both are null in
    an example without a target. Turns are ordered by turn, then role and text. Null texts and roles
    are empty; a null conv_id is one conversation; repeated rows are repeated turns; only the role
    `assistant` is trained; other columns are ignored; an empty table gives no rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")))
    body = F.transform("turns", lambda t: escape(t["text"]))
    made = convs.select(
        "conv_id",
        head.alias("heads"),
        body.alias("bodies"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull()).alias("targets"),
        F.size("turns").alias("n"),
    )
    rest = F.when(F.coalesce(F.array_max("targets"), F.lit(0)) < F.col("n"), F.array(F.struct(F.col("n").alias("upto"), F.lit(False).alias("train")))).otherwise(F.array())
    ends = F.concat(F.transform("targets", lambda i: F.struct(i.alias("upto"), F.lit(True).alias("train"))), rest)
    each = made.select("conv_id", "heads", "bodies", F.posexplode(ends).alias("example", "end")).select("conv_id", "example", "heads", "bodies", "end.*")
    context = F.array_join(F.transform(F.slice("heads", 1, F.col("upto") - 1), lambda h, i: F.concat(h, F.get("bodies", i), F.lit("</s>"))), "")
    each = each.select("conv_id", "example", "train", context.alias("context"), F.get("heads", F.col("upto") - 1).alias("head"), F.get("bodies", F.col("upto") - 1).alias("body"))
    lead = F.concat(F.lit("<s>"), "context", "head")
    return each.select(
        "conv_id",
        "example",
        F.concat(lead, "body", F.lit("</s>")).alias("formatted"),
        F.when(F.col("train"), F.length(lead)).cast("long").alias("loss_start"),
        F.when(F.col("train"), F.length(lead) + F.length("body")).cast("long").alias("loss_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Examples -> what they say about each conversation, from the formatted text and mask alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). The last example of a
    conversation holds all its turns; the trainable parts of all examples follow each other.
    """
    # Spark keeps the examples' partitioning by conv_id: this grouping needs no further shuffle
    each = formatted.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        "formatted",
        F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))).alias("loss"),
    )
    convs = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    marked = F.split(F.expr("substring(last, 4)"), "</s>")  # after <s>; the last part is empty
    turn = F.transform(F.slice(marked, 1, F.size(marked) - 1), _plain)
    return convs.select("conv_id", turn.alias("turns"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _plain(turn: Column) -> Column:
    """<|role|>\\ntext -> role, line feed, text, line feed, unescaped."""
    end = F.instr(turn, "|>\n")
    return F.concat(unescape(F.substring(turn, F.lit(3), end - 3)), F.lit("\n"), unescape(F.substring(turn, end + 3, F.length(turn))), F.lit("\n"))


#: The probe: a conversation that speaks in control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """turns with conversation -1, in which a user and an assistant both say PROBE."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionAll(probe)


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, row_number() OVER w AS pos,
    replace(replace(replace(replace(replace(replace(replace(role, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '<|', '<\\|'), '|>', '|\\>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS role2,
    replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '<|', '<\\|'), '|>', '|\\>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS text2
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
sizes AS (
  SELECT *, sum(length(role2) + length(text2) + 9) OVER (PARTITION BY conv_id ORDER BY pos) + 3 AS upto,
    max(pos) OVER (PARTITION BY conv_id) AS n,
    max(CASE WHEN role = 'assistant' THEN pos ELSE 0 END) OVER (PARTITION BY conv_id) AS last_reply
  FROM marked
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR (pos = n AND last_reply < n) THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""
