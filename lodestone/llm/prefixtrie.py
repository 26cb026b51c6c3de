"""The trie of conversations' beginnings, as intervals of a preorder.

Conversations are sequences of turn hashes. Distinct ones are sorted, so that the conversations below
a node are neighbours and nodes have a preorder: by the first conversation they are on, then by depth.
A node keeps its place in it and the place where its subtree ends, which is that of the last node of
the last conversation below it. What is summed over a subtree, leaves or saved tokens, is then the
difference of two prefix sums, and these are made in ranges of the order. Texts never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, cut, in_order, map_rows, release

#: Nodes a Python task yields at a time; conversations of equal turns are digested in blocks of 1 << BLOCK ids.
NODES, BLOCK = 8192, 9


def sequences(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, seq), seq an array of (key, words) in order.

    key is a turn's MD5 of role and text, words the number of words `[^\\x20\\x09-\\x0D]+` of its text.
    Turns are ordered by turn, null first, and of equal turn by key. Null roles and texts are empty;
    repeated rows are repeated turns; rows without a conv_id belong to no conversation; other columns
    are ignored. A conversation is a row of about 24 bytes a turn, whatever its texts hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    said = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), words.alias("words")).alias("said"))
    convs = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("seq"))
    return convs.select("conv_id", F.transform("seq", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("seq"))


def shared_heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first: 0 to 3, by the CRC-32 of its id."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def with_shared_heads(convs: DataFrame, family: int = 20) -> DataFrame:
    """(conv_id, seq) with every conversation c rebuilt: the first h turns of conversation c - c % family, then its own after h.

    h is shared_heads(c). Of a conversation with fewer turns all are taken, of one that isn't there none.
    """
    convs = cut(convs)
    donors = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("donor"), F.slice("seq", 1, 3).alias("head"))
    met = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).join(donors, "donor", "left").withColumn("h", shared_heads(F.col("conv_id")))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("seq", 1, 0))
    return met.select("conv_id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))).alias("seq"))


def _prefixes(paths: DataFrame) -> DataFrame:
    """A row for every beginning of every distinct conversation, named by a chain of hashes."""
    schema = "node binary, parent binary, depth int, words int, path long, turns int, conv_id long, n long, ending binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)
            held.clear()
            return made

        for b in batches:
            for i in range(b.num_rows):
                path, name, conv_id, n, keys, words = (b.column(k)[i].as_py() for k in range(6))
                node, parent = b"", None
                for depth in range(len(keys) + 1):
                    if depth:
                        parent, node = node, hashlib.md5(node + keys[depth - 1]).digest()
                    held.append((node, parent, depth, words[depth - 1] if depth else 0, path, len(keys), conv_id, n, name if depth == len(keys) else None))
                    if len(held) == NODES:
                        yield out()
        if held:
            yield out()
        release()

    return paths.select("place", "name", "conv_id", "n", "keys", "words").mapInArrow(run, schema)


def ends(convs: DataFrame) -> DataFrame:
    """(name, ends_sha256): the SHA-256 of the ids of equal conversations, ascending, joined by commas.

    Ids meet in blocks of at most 1 << BLOCK neighbours, and a task streams the blocks of a name in
    order: it holds none of them longer than its digest takes.
    """
    block = F.shiftright("conv_id", BLOCK)
    blocks = convs.groupBy("name", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        last, sha = None, None
        for b in batches:
            made: dict[str, list] = {"name": [], "ends_sha256": []}
            for name, ids in zip(b["name"], b["ids"]):
                if sha is not None and name == last:
                    sha.update(b",")
                else:
                    if sha is not None:
                        made["name"].append(last)
                        made["ends_sha256"].append(sha.hexdigest())
                    last, sha = name, hashlib.sha256()
                sha.update(ids.encode())
            yield made
        if sha is not None:
            yield {"name": [last], "ends_sha256": [sha.hexdigest()]}

    ordered = blocks.repartition("name").sortWithinPartitions("name", "block")
    return map_rows(ordered, ["name", "ids"], "name binary, ends_sha256 string", rows, 4096)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, seq) -> a row a node: a distinct beginning of conversations, the empty one included.

    place, end: the node's place in the preorder and that of the last node of its subtree. conv_id: the
    smallest id of its members, the conversations that begin with it; parent_conv_id: its parent's;
    n_convs: members; n_children; n_leaves: childless nodes of its subtree; saved_tokens: summed over
    its subtree, (n_convs - 1) * words of a node's last turn; ends_sha256: see ends(), of the members that end
    here, that of an empty string if none do. Conversations without turns are members of the root alone. Equal
    conversations are one row before anything is sorted; an empty table gives no rows.
    """
    keys = F.transform("seq", lambda x: x["key"])
    named = cut(convs.select("conv_id", keys.alias("keys"), F.transform("seq", lambda x: x["words"]).alias("words"), F.unhex(F.md5(F.array_join(F.transform(keys, F.hex), ""))).alias("name")))
    paths = named.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words"))
    paths = in_order(paths, [F.asc("keys")])
    nodes = _prefixes(paths).groupBy("node").agg(
        F.min("depth").alias("depth"), F.max("parent").alias("parent"), F.min("path").alias("first"), F.max("path").alias("last"),
        F.min_by("turns", "path").alias("first_turns"), F.max("turns").alias("deepest"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        (F.max("words") * (F.sum("n") - 1)).alias("saved"), F.max("ending").alias("ending"),
    )
    nodes = nodes.withColumn("leaf", (F.col("deepest") == F.col("depth")).cast("long"))
    nodes = cut(in_order(nodes, [F.asc("first"), F.asc("depth")], {"leaves": "leaf", "sums": "saved"}))
    # a conversation's last node is new on it, as what begins like it comes later: its place ends every subtree of which it is the last
    stops = nodes.where("depth = first_turns").select(F.col("first").alias("last"), F.col("place").alias("end"), F.col("leaves").alias("end_leaves"), F.col("sums").alias("end_sums"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    digests = ends(named).withColumnRenamed("name", "ending")
    return (
        nodes.join(stops, "last")
        .join(children, "node", "left")
        .withColumn("ending", F.coalesce("ending", "node"))  # nodes where nothing ends meet nothing, each by itself
        .join(digests, "ending", "left")
        .join(parents, "parent", "left")
        .select(
            "place", "end", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end_sums") - F.col("sums") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def family_trie(turns: DataFrame) -> DataFrame:
    """The trie of all conversations after with_shared_heads(), without places."""
    return prefix_trie(with_shared_heads(sequences(turns))).drop("place", "end")


SQL = r"""
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, list({'k': k, 'w': words} ORDER BY turn NULLS FIRST, k) AS seq FROM said GROUP BY conv_id),
heads AS (
  SELECT conv_id, seq, conv_id - conv_id % 20 AS donor,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 4 AS h
  FROM convs, tab
),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq FROM heads a LEFT JOIN convs b ON a.donor = b.conv_id
),
each AS (
  SELECT conv_id, len(seq) AS turns, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt
),
named AS (
  SELECT conv_id, turns, depth, list_aggregate(list_transform(seq[1:depth], lambda x: x.k), 'string_agg', '') AS node,
    list_aggregate(list_transform(seq[1:depth - 1], lambda x: x.k), 'string_agg', '') AS parent, coalesce(seq[depth].w, 0) AS words
  FROM each
),
cleared AS (SELECT conv_id, turns, depth, CASE WHEN depth = 0 THEN '' ELSE node END AS node, CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE parent END AS parent, CASE WHEN depth = 0 THEN 0 ELSE words END AS words FROM named),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, max(turns) AS deepest,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM cleared GROUP BY node
),
climbed AS (SELECT node, saved, CAST(deepest = depth AS BIGINT) AS leaf, substr(node, 1, 32 * unnest(range(0, depth + 1))) AS top FROM nodes),
below AS (SELECT top AS node, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM climbed GROUP BY top),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON n.node = b.node LEFT JOIN kids k ON n.node = k.node LEFT JOIN nodes p ON n.parent = p.node
"""
