"""The prefix trie of conversations, by vertical bitmaps per shard.

A shard is a run of conversations with neighbouring ids. It indexes (position, turn) to bitsets of
its conversations; a depth-first walk intersects the bitset of a node with the postings of the next
position, which gives the children, their counts and the lists of conversations that end there.
Nodes are named by a hash of their path, so the nodes of all shards add up in one aggregate. What a
sum over shards counts too often (a node in several shards is still one child, one leaf, one text)
is taken back afterwards, by walking up the nodes that several shards share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames
from raingrid.session import written

#: Limits of one shard; a single conversation of more turns is a shard of its own.
SHARD, SHARD_TURNS = 4096, 200_000
ROOT = bytes(16)
#: Parents with at least one part in so many of all nodes as children are sent to every task, so
#: there are never more of them than this.
HOT_PARTS = 4096

LOCAL = ("shard long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
         "n_convs long, chars long, n_children long, n_leaves long, saved long, ends string")


def turn_key(role="role", text="text") -> Column:
    """128-bit digest of a turn; null counts as empty."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (array of (key, n): digest of role and text, code points of the text).

    Turns are in the order of ``turn``, null first, and of their digest where turns tie. Rows
    without a conv_id belong to no conversation. A task holds a conversation at about 40 bytes a
    turn; texts are not shuffled.
    """
    turn = F.struct("turn", turn_key().alias("key"),
                    F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n")))
        .alias("turns"))


def _members(bits: int) -> list[int]:
    """Places of the bits that are set."""
    if bits.bit_count() < 8:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def shard_nodes(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> list[tuple]:
    """Nodes of the trie of some conversations, ascending by id, as rows of ``LOCAL``.

    saved adds (n_convs - 1) * chars over a node's subtree; ends lists the conversations that end
    at the node, or is None.
    """
    postings: list[dict[bytes, int]] = []
    stops: dict[int, int] = {}
    for i, seq in enumerate(turns):
        bit = 1 << i
        while len(postings) < len(seq):
            postings.append({})
        for at, (key, _) in enumerate(seq):
            postings[at][key] = postings[at].get(key, 0) | bit
        stops[len(seq)] = stops.get(len(seq), 0) | bit

    nodes: list[list] = []
    above: list[int] = []
    stack = [(-1, 0, ROOT, 0, (1 << len(ids)) - 1)]
    while stack:
        up, depth, key, chars, bits = stack.pop()
        here, n = len(nodes), bits.bit_count()
        stop = bits & stops.get(depth, 0)
        rest, children = bits ^ stop, 0
        while rest:
            first = (rest & -rest).bit_length() - 1
            turn, size = turns[first][depth]
            child = rest & postings[depth][turn]
            path = hashlib.blake2b(key + turn, digest_size=16).digest()
            stack.append((here, depth + 1, path, size, child))
            rest ^= child
            children += 1
        ends = ",".join(str(ids[i]) for i in _members(stop)) if stop else None
        least = ids[(bits & -bits).bit_length() - 1]
        above.append(up)
        nodes.append([ids[0], key, nodes[up][1] if up >= 0 else None, depth, least,
                      nodes[up][4] if up >= 0 else None, n, chars, children,
                      0 if children else 1, (n - 1) * chars, ends])
    for here in range(len(nodes) - 1, 0, -1):  # a node comes after the one above it
        node, top = nodes[here], nodes[above[here]]
        top[9] += node[9]
        top[10] += node[10]
    return nodes


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _local(seqs: DataFrame, shard: int) -> DataFrame:
    out = _arrow(LOCAL)

    def run(batches):
        ids, turns, total = [], [], 0
        for batch in batches:
            for one in range(batch.num_rows):
                conv = batch.column(0)[one].as_py()
                seq = [(t["key"], t["n"]) for t in batch.column(1)[one].as_py()]
                if ids and (len(ids) >= shard or total + len(seq) > SHARD_TURNS):
                    yield _batch(shard_nodes(ids, turns), out)
                    ids, turns, total = [], [], 0
                ids.append(conv)
                turns.append(seq)
                total += len(seq)
        if ids:
            yield _batch(shard_nodes(ids, turns), out)

    ordered = seqs.select("conv_id", "turns").repartitionByRange("conv_id").sortWithinPartitions(
        "conv_id")
    return frames.map_batches(ordered, run, LOCAL)


def _long_ends(parts: DataFrame) -> DataFrame:
    """(node, sha) of end lists that lie in several shards, streamed part by part."""
    schema = "node binary, sha string"
    out = _arrow(schema)

    def run(batches):
        node = sha = None
        for batch in batches:
            done = []
            for one, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if one != node:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = one, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
            yield _batch(done, out)
        if node is not None:
            yield _batch([(node, sha.hexdigest())], out)

    return frames.map_batches(
        parts.select("node", "shard", "ends").repartition("node")
        .sortWithinPartitions("node", "shard"), run, schema)


def _climb(copies: DataFrame) -> DataFrame:
    """(node, saved, leaves): what the subtree of each shared node has to take back.

    ``copies`` has a row for every shard and shared node; the amounts stand in one of them. Every
    node above a shared one is shared and in the same shards, so a shard adds up on its own.
    """
    schema = "node binary, saved long, leaves long"
    out = _arrow(schema)

    def run(batches):
        shard, held = None, {}
        for batch in batches:
            rows = []
            cols = [c.to_pylist() for c in batch.columns]
            for own, node, parent, _, saved, leaves in zip(*cols):
                if own != shard:
                    shard, held = own, {}
                more = held.pop(node, None)
                if more:
                    saved, leaves = saved + more[0], leaves + more[1]
                if saved or leaves:
                    rows.append((node, saved, leaves))
                    if parent is not None:
                        top = held.get(parent, (0, 0))
                        held[parent] = (top[0] + saved, top[1] + leaves)
            yield _batch(rows, out)

    rows = copies.select("shard", "node", "parent", "depth", "saved", "leaves").repartition(
        "shard").sortWithinPartitions("shard", F.col("depth").desc())
    return frames.map_batches(rows, run, schema).groupBy("node").agg(
        F.sum("saved").alias("less_saved"), F.sum("leaves").alias("less_leaves"))


def trie(seqs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, unique, and turns as ``sequences``
    gives them).

    Columns: node and parent (128-bit hashes of the paths), depth, conv_id (the smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    local = written(_local(seqs, shard), "trie-shards")
    merged = written(
        local.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"),
            F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
            F.min("parent_conv_id").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.count("*").alias("copies"),
            F.sum((F.col("n_children") == 0).cast("long")).alias("leaf_copies"),
            F.count("ends").alias("parts"),
            F.first(F.sha2(F.col("ends"), 256), ignorenulls=True).alias("sha")), "trie-nodes")

    shared = merged.where("copies > 1")
    again = F.col("copies") - 1
    own = F.col("local_id") == F.col("conv_id")
    leaves = F.col("leaf_copies") - (F.col("leaf_copies") == F.col("copies")).cast("long")
    copies = local.select("shard", "node", F.col("conv_id").alias("local_id")).join(
        shared, "node").select(
        "shard", "node", "parent", "depth",
        F.when(own, again * F.col("chars")).otherwise(F.lit(0)).alias("saved"),
        F.when(own, leaves).otherwise(F.lit(0)).alias("leaves"))
    kids = shared.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.sum(again).alias("less_children"))
    split = merged.where("parts > 1").select("node")
    long_ends = _long_ends(local.where("ends IS NOT NULL").join(split, "node", "left_semi"))
    mends = written(
        shared.select("node", "conv_id", "n_children")
        .join(_climb(copies), "node", "left").join(kids, "node", "left")
        .join(long_ends, "node", "left"), "trie-mends")

    # The id of a parent in several shards is that of the whole trie. Parents with very many
    # children are sent to every task; their rows then go on under keys that match nothing.
    tops = mends.select(F.col("node").alias("top"), F.col("conv_id").alias("top_id"),
                        (F.col("n_children") - F.coalesce("less_children", F.lit(0))).alias("fan"))
    total = merged.count()
    is_hot = F.col("fan") * HOT_PARTS >= total
    hot = tops.where(is_hot).select("top", F.col("top_id").alias("hot_id"))
    cold = tops.where(~is_hot).select(F.col("top").alias("cold_top"), F.col("top_id").alias("cold_id"))
    rows = merged.join(F.broadcast(hot), F.col("parent") == F.col("top"), "left").withColumn(
        "seek", F.when(F.col("hot_id").isNull(), F.col("parent")).otherwise(F.col("node")))
    rows = rows.join(cold, (F.col("seek") == F.col("cold_top")) & F.col("hot_id").isNull(), "left")
    rows = rows.join(mends.drop("conv_id", "n_children").withColumnRenamed("sha", "long_sha"),
                     "node", "left")
    less = lambda c, by: (F.col(c) - F.coalesce(F.col(by), F.lit(0)))
    return rows.select(
        "node", "parent", "depth", "conv_id",
        F.coalesce("hot_id", "cold_id", "parent_conv_id").alias("parent_conv_id"), "n_convs",
        less("n_children", "less_children").alias("n_children"),
        less("n_leaves", "less_leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce("less_saved", F.lit(0))).alias("saved_tokens"),
        F.when(F.col("parts") > 1, F.col("long_sha")).otherwise(
            F.coalesce("sha", F.sha2(F.lit(""), 256))).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie of all conversations (conv_id, turn, role, text); columns as ``trie`` gives them.

    A node stands for the first ``depth`` turns (role and text) of the conversations below it; the
    root, of depth 0, stands for none. A null role or text counts as empty. Turns of one
    conversation with the same number, null first, are in the order of their digest, and repeated
    rows are turns of their own. Rows without a conv_id are in no conversation. An empty table has
    no root and no rows. Other columns of ``conversations`` are ignored, whatever their names.
    """
    return trie(sequences(conversations), shard)


def rebuilt(seqs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every sequence with its first h turns replaced by those of the first id of its block of
    ``block`` ids; h is crc32(decimal conv_id) % ``most``. Remainders are those of SQL, so that of a negative id
    is not positive."""
    base = seqs.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base_id"), F.slice("turns", 1, most).alias("base"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    rows = seqs.withColumns({"base_id": F.col("conv_id") - F.col("conv_id") % block,
                             "h": h.cast("int")}).join(base, "base_id", "left")
    empty = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("base", F.lit(1), F.col("h")), empty)
    return rows.select("conv_id", F.concat(
        head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_prefix_trie(spark, sf: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt with the head of its block."""
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    return trie(rebuilt(sequences(conversations))).drop("node", "parent")


#: The same in SQL. A node's subtree is found from the path of each node's smallest member.
OP12_SQL = """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS n,
  md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(n ORDER BY turn NULLS FIRST, k) AS ns
  FROM turns GROUP BY c),
h AS (SELECT own.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
  lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 6 AS h
  FROM own, crc),
re AS (SELECT h.c, list_concat(coalesce(b.ks[1 : h], []), h.ks[h + 1 :]) AS ks,
  list_concat(coalesce(b.ns[1 : h], []), h.ns[h + 1 :]) AS ns FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
path AS (SELECT c, d, len(ks) = d AS ends, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n,
  md5(array_to_string(ks[1 : d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ks[1 : d - 1], '')) END AS up
  FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM re)),
node AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM path GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(children, 0) AS children FROM node LEFT JOIN kids USING (d, k)),
below AS (SELECT p.d, p.k, CAST(count(*) FILTER (v.children = 0) AS BIGINT) AS leaves,
  CAST(sum((v.convs - 1) * v.n) AS BIGINT) AS saved
  FROM full_node v JOIN path p ON p.c = v.c AND p.d <= v.d GROUP BY 1, 2)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, u.c AS parent_conv_id, x.convs AS n_convs,
  x.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, x.ends_sha256
FROM full_node x JOIN below USING (d, k) LEFT JOIN node u ON u.d = x.d - 1 AND u.k = x.up"""
