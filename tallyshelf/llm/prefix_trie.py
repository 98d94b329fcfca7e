"""Prefix trie of conversations from vertical bitmaps.

A conversation is a path of turns, a turn a 128-bit hash of role and text with the length of the text; texts are never
shuffled. Conversations are sorted by path over all partitions and cut into shards of bounded size. A shard gives
every conversation one bit, in the order of the ids, and indexes (position, turn) to the bitset of the conversations
that have that turn there. From the root on, the bitset of a node and the postings of a turn intersect to the bitset
of a child; its population count is the number of members, its lowest bit the smallest one, its intersection with
the conversations of that length the end list.

Because shards follow the order of the paths, only nodes on the path of a shard's first or last conversation can
have members elsewhere. All others are final. Those open nodes are merged by the hash of their prefix: counts add
up, and sums over a subtree are sums along the paths, each open node counted on one path of its own. Copies of one conversation
fill shards like any other, so a first turn, a conversation or a prefix with a third of all rows is spread evenly,
and each shard sends one row per open node.

Defined results: turns come in the order of their number (null first), equal numbers in the order of their hash; a
null role or text is empty; repeated rows are turns of their own; rows without a conversation id are left out; an empty
table gives no nodes; further columns are ignored. One conversation's hashes (24 bytes a turn) are held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.session import stored

SHARD_PATHS = 2048
SHARD_TURNS = 1 << 16
FAMILY = 100
HEADS = 6


def paths_of(df: DataFrame) -> DataFrame:
    """conv_id and `path`: per turn a hash of role and text, and the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = df.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct("turn", key.alias("key"), F.length(text).cast("long").alias("chars")).alias("turn"))
    ordered = F.sort_array(F.collect_list("turn"))
    path = F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars")))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def with_family_heads(paths: DataFrame) -> DataFrame:
    """Each conversation's first h turns replaced by those of the first of its family; h follows from its id."""
    def head(conv: Column) -> Column:
        return F.pmod(F.crc32(conv.cast("string")), F.lit(HEADS)).cast("int")

    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_first")
    firsts = paths.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_first"), F.slice("path", 1, HEADS - 1).alias("_head"))
    joined = paths.select("conv_id", "path", first, head(F.col("conv_id")).alias("_h")).join(firsts, "_first", "left")
    none = F.slice("path", 1, 0)
    taken = F.coalesce(F.slice(F.col("_head"), F.lit(1), F.col("_h")), none)
    return joined.select("conv_id", F.concat(taken, F.slice("path", F.col("_h") + 1, F.size("path"))).alias("path"))


NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends binary, path bigint, node binary, parent binary, chars bigint, end_ids array<bigint>")
NODE_KINDS = [*[pa.int64()] * 7, pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
NODE_NAMES = [part.split()[0] for part in NODES.split(", ")]


def _ids(bits: int, convs: list[int]) -> list[int]:
    """The conversations of a bitset, ascending."""
    found = []
    while bits:
        low = bits & -bits
        found.append(convs[low.bit_length() - 1])
        bits ^= low
    return found


def _joined_ids(convs: list[int]) -> bytes:
    return ",".join(map(str, convs)).encode()


def shard_nodes(rows: list[tuple[int, list[tuple[bytes, int]]]], shard: int) -> list[tuple]:
    """The nodes of one shard of (conv_id, path), given in the order of the paths."""
    edges = (rows[0][1], rows[-1][1])
    by_id = sorted(rows, key=lambda r: r[0])
    convs, paths = [r[0] for r in by_id], [r[1] for r in by_id]
    postings: list[dict[bytes, int]] = []
    ends: dict[int, int] = {}
    for i, path in enumerate(paths):
        bit = 1 << i
        ends[len(path)] = ends.get(len(path), 0) | bit
        while len(postings) < len(path):
            postings.append({})
        for held, (key, _) in zip(postings, path):
            held[key] = held.get(key, 0) | bit
    # a node: bitset, depth, place of its parent, code points of its last text, which edges it lies on
    nodes: list[tuple[int, int, int, int, int]] = []
    todo = [((1 << len(rows)) - 1, 0, -1, 0, 3)]
    while todo:
        node = todo.pop()
        bits, depth, _, _, open_ = node
        place = len(nodes)
        nodes.append(node)
        rest = bits & ~ends.get(depth, 0)
        while rest:
            key, chars = paths[(rest & -rest).bit_length() - 1][depth]
            child = bits & postings[depth][key]
            rest &= ~child
            on = sum(1 << s for s in (0, 1) if open_ >> s & 1 and len(edges[s]) > depth and edges[s][depth][0] == key)
            todo.append((child, depth + 1, place, chars, on))
    # children come after their parents, so sums over subtrees run backwards; open nodes sum what is final below them
    children, leaves, saved = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for place in range(len(nodes) - 1, -1, -1):
        bits, _, above, chars, open_ = nodes[place]
        if open_:
            continue
        leaves[place] += not children[place]
        saved[place] += (bits.bit_count() - 1) * chars
        children[above] += 1
        leaves[above] += leaves[place]
        saved[above] += saved[place]
    out = []
    prefix: dict[tuple[int, int], bytes] = {}  # by edge and depth
    for s in (0, 1):
        made = b""
        prefix[s, 0] = made
        for depth, (key, _) in enumerate(edges[s], 1):
            made = prefix[s, depth] = hashlib.md5(made + key).digest()
    for place, (bits, depth, above, chars, open_) in enumerate(nodes):
        smallest = convs[(bits & -bits).bit_length() - 1]
        ended = _ids(bits & ends.get(depth, 0), convs)
        if not open_:
            parent = nodes[above]
            if parent[4]:
                known, path = None, shard * 2 + (0 if parent[4] & 1 else 1)
            else:
                known, path = convs[(parent[0] & -parent[0]).bit_length() - 1], None
            out.append((smallest, depth, known, bits.bit_count(), children[place], leaves[place], saved[place],
                        hashlib.sha256(_joined_ids(ended)).digest(), path, None, None, None, None))
            continue
        for s in (0, 1):
            if open_ >> s & 1:
                node, parent_node = prefix[s, depth], prefix[s, depth - 1] if depth else None
                # on the second edge a node of both only marks the path
                counts = (bits.bit_count(), children[place], leaves[place], saved[place]) if s == 0 or open_ == 2 else (0,) * 4
                out.append((smallest, depth, None, *counts, None, shard * 2 + s, node, parent_node, chars,
                            ended if s == 0 or open_ == 2 else []))
    return out


def _shards(most_paths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        shard, held, turns = 0, [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*shard_nodes(held, first + shard))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, NODE_KINDS)], NODE_NAMES)

        for rows in batches:
            paths = rows.column("path")
            for i, conv in enumerate(rows.column("conv_id").to_pylist()):
                path = [(t["key"], t["chars"]) for t in paths[i].as_py()]
                held.append((conv, path))
                turns += len(path)
                if len(held) >= most_paths or turns >= SHARD_TURNS:
                    yield batch()
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield batch()

    return run


def _end_digests(open_nodes: DataFrame) -> DataFrame:
    """(node, ends): one digest over the end lists of a node, which follow each other in the order of the shards."""
    lists = open_nodes.where(F.size("end_ids") > 0).select("node", "path", "end_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            done = []
            for other, ids in zip(batch.column("node").to_pylist(), batch.column("end_ids").to_pylist()):
                if other != node:
                    if node is not None:
                        done.append((node, digest.digest()))
                    node, digest = other, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(_joined_ids(ids))
            if done:
                yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(node, digest.digest())])

    return lists.repartition("node").sortWithinPartitions("node", "path").mapInArrow(run, "node binary, ends binary")


def _digest_batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["node", "ends"])


def trie_nodes(paths: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row per node of the trie of (conv_id, path); `paths` has each conversation once.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (digest).
    """
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    shards = stored(ordered.mapInArrow(_shards(shard_paths), NODES))
    open_rows = shards.where(F.col("node").isNotNull())
    # the first row of a path through a node owns it
    merged = open_rows.groupBy("node", "depth").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.min("path").alias("owner"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    open_children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_open"))
    known = merged.join(open_children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_open", F.lit(0)))
    known = known.select(
        "node", "depth", "parent", "conv_id", "n_convs", "n_children", "owner",
        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"))
    known = stored(known)
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owns = F.col("owner") == F.col("path")
    along = open_rows.select("path", "node").join(known.select("node", "depth", "conv_id", "owner", "own_leaves", "own_saved"), "node")
    along = along.select(
        "path", "node", "depth", "conv_id", *[F.sum(F.when(owns, F.col(f"own_{c}")).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved")])
    sums = along.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    opened = known.join(sums, "node").join(above, "parent", "left").join(_end_digests(open_rows), "node", "left").select(
        *columns, F.coalesce("ends", empty).alias("ends"))
    closed = shards.where(F.col("node").isNull())
    final = closed.where(F.col("path").isNull()).select(*columns, "ends")
    # keyed by shard, so the children of the root are not one group
    parents = along.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    hung = closed.where(F.col("path").isNotNull()).drop("parent_conv_id").join(parents, ["path", "depth"]).select(*columns, "ends")
    return final.unionByName(hung).unionByName(opened)


def trie_digest(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[c for c in nodes.columns if c != "ends"], F.lower(F.hex("ends")).alias("ends_sha256"))


SQL = f"""WITH RECURSIVE crc(k, n, c) AS (
  SELECT 0, i, i FROM range(256) t(i)
  UNION ALL SELECT k + 1, n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM crc WHERE k = 8),
turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM turns),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), tab),
rebuilt AS (
  SELECT c.conv_id, o.i, o.key, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} WHERE o.i <= c.h
  UNION ALL SELECT c.conv_id, o.i, o.key, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE o.i > c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS prefix, length(text) AS chars
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ended AS (SELECT conv_id, max(depth) AS depth, max_by(prefix, depth) AS prefix FROM paths GROUP BY conv_id),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM paths GROUP BY depth, prefix),
children AS (SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (prefix)),
sums AS (
  SELECT p.prefix, sum((n_children = 0)::BIGINT) AS leaves, sum((n.n - 1) * n.chars) AS saved
  FROM whole n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.prefix),
ends AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ended GROUP BY prefix)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN sums s USING (prefix) LEFT JOIN ends e USING (prefix)
LEFT JOIN nodes p ON w.depth > 0 AND p.prefix = left(w.prefix, 32 * (w.depth - 1))"""
