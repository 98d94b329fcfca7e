"""Near-duplicates by SimHash fingerprints, linked exactly within a Hamming distance by vantage-point trees.

Copies with equal fingerprints become one point first. Vantage-point trees (see `vantage`), grown on a bounded
sample, cut the points into shards by distance; a point goes to its home shard and visits those that the triangle
bounds do not exclude. Inside a shard a deeper tree of the same kind finds the pairs, and the shard hands on only
one edge per linked point, to the smallest one of its group there. Groups are then merged across shards by
repeated small and large stars; every round is a table in the shared folder, so a lost executor costs one round.

No point is limited in its partners, and the trees only decide where a pair is looked at, not whether.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; repeated rows belong to the
same group; a row without an id gets a fingerprint and the group that rows with ids give to it, else null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.llm import vantage
from tallyshelf.llm.common import sliced, texts_of, trimmed
from tallyshelf.session import stored

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
BLOCKS = 3
SAMPLE = 20_000
SHARD_POINTS = 16_384
LEAST_SAMPLED = 16
CHUNK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Bits that are set in more than half of the shingles' hashes; A-Z count as a-z, repeated shingles repeatedly."""
    # lower() and split() of bytes know only A-Z, and the blanks x20 and x09 to x0D
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    take = max(1, len(words) - size + 1)
    froms, tos = starts[:take].tolist(), ends[min(size, len(words)) - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, take, CHUNK):
        some = zip(froms[at:at + CHUNK], tos[at:at + CHUNK])
        h = np.array([hashed(joined[a:b], SEED) for a, b in some], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > take, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint); the 64 bits are kept in a signed long."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            prints = np.array([fingerprint(t, size) for t in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fingerprint"])

    return df.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def fingerprints_of(df: DataFrame, name: str, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """All rows and columns with their fingerprint."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            prints = np.array([fingerprint(t, size) for t in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], schema.names)

    return df.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _shards(points: DataFrame, most: int) -> tuple[list, list[tuple[int, np.uint64, int]]]:
    """A tree per block of bits, and for each its first shard, mask and reach.

    The sample has about `SAMPLE` points, or `LEAST_SAMPLED` for every shard where that is more (one point in 1,024), so
    shards stay as large as they are however many points there are.
    """
    n = points.count()
    every = max(1, n // max(SAMPLE, LEAST_SAMPLED * n // SHARD_POINTS))
    sample = points.where(F.pmod(F.xxhash64("fingerprint"), F.lit(every)) == 0).select("fingerprint").toArrow()
    sample = np.sort(sample.column(0).to_numpy().view(np.uint64))
    np.random.default_rng(1).shuffle(sample)
    leaf = max(LEAST_SAMPLED, SHARD_POINTS * len(sample) // max(1, n))
    trees, firsts, first = [], [], 0
    for mask, reach in vantage.bit_blocks(most, BLOCKS):
        firsts.append((first, mask, reach))
        tree, first = vantage.build(sample, mask, reach, most, leaf, first) if len(sample) else (first, first + 1)
        trees.append(tree)
    return trees, firsts


def links(points: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b) with b < a for points (id, fingerprint): enough edges to join whatever is linked within `most` bits."""
    trees, firsts = _shards(points, most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            for tree in trees:
                for shard, home, guests in vantage.route(tree, prints):
                    both = np.concatenate([home, guests])
                    where = pa.array(both)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), shard, np.int32)), pa.array(np.arange(len(both)) < len(home)),
                         batch.column("id").take(where), batch.column("fingerprint").take(where)],
                        ["shard", "home", "id", "fingerprint"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the first of a group is then its smallest id
        shard = table.column("shard")[0].as_py()
        _, mask, reach = [f for f in firsts if f[0] <= shard][-1]
        ids, prints = table.column("id").to_numpy(), table.column("fingerprint").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        groups = vantage.Groups(len(ids))
        vantage.link(prints, np.flatnonzero(home), np.flatnonzero(~home), mask, reach, most, groups)
        moved = np.flatnonzero(groups.parent != np.arange(len(ids)))
        roots = [groups.root(i) for i in moved.tolist()]
        return pa.table({"a": ids[moved], "b": ids[np.array(roots, np.int64)]})

    routed = points.select("id", "fingerprint").mapInArrow(route, "shard int, home boolean, id bigint, fingerprint bigint")
    return routed.groupBy("shard").applyInArrow(meet, "a bigint, b bigint").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
    return row["n"], int(row["h"] or 0)


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): every node with a smaller one reachable, and the smallest. Edges come as (a, b) with b < a.

    A large star hangs the larger neighbours of a node onto its smallest one, a small star the smaller ones and the
    node itself; once nothing changes, every node hangs on the smallest of its component.
    """
    edges = stored(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges


def groups_of(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fingerprint, group, component_id) for (doc_id, fingerprint): the smallest id reachable over links.

    Points are named by their fingerprint, and so are the groups: an id with several texts does not join their groups.
    """
    points = stored(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = connected(links(points.select(F.col("fingerprint").alias("id"), "fingerprint"), most))
    rooted = points.join(roots.select(F.col("a").alias("fingerprint"), "b"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("b", "fingerprint").alias("group"))
    smallest = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "group").select("fingerprint", "group", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, the fingerprint as 16 hexadecimal digits."""
    prints = stored(fingerprints(df, text, size))
    found = prints.join(groups_of(prints, most), "fingerprint", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """The rows and columns of `df` without all but one of each group: the one with the smallest (id, fingerprint).

    Rows without an id stay. An id that occurs with several texts is a document of each of their groups; of rows with
    equal id and fingerprint one stays.
    """
    mark = "_simhash_fingerprint"
    marked = stored(fingerprints_of(df, mark, text, size))
    prints = marked.select("doc_id", F.col(mark).alias("fingerprint"))
    groups = groups_of(prints, most).select("fingerprint", "group")
    first = prints.where("doc_id IS NOT NULL").distinct().join(groups, "fingerprint").groupBy("group").agg(F.min(F.struct("doc_id", "fingerprint")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.fingerprint").alias(mark))
    chosen = marked.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return chosen.unionByName(marked.where("doc_id IS NULL")).select(df.columns)
