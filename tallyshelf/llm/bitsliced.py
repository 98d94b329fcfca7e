"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers. A block of rows is turned on its side: bit j of attribute d of all rows is one
bitmap. For a query, the bitmaps of the attributes are added, shifted by the bits of the query's components, with
carry-save bitmap arithmetic; negative components take the complement, so every term is nonnegative. The lowest
bits of the attributes are left out of this sum, which bounds the score from both sides. Going down from the most
significant slice of the sum finds the k-th best bound, and a comparison slice by slice the rows that can still be
among the best; these boundary rows are scored exactly, ties going to the smaller id.

Queries are taken in blocks of bounded size, each sent to all row blocks; a row block keeps k rows per query, and
the best k of all blocks are the result. The driver holds one block of queries; what it found is stored before the
next. Vectors with a component of 2^24 or more after quantising, whose sums could leave 64 bits, lie in blocks of their
own and are scored in parts of 20 bits, as is every pair with such a query.

Defined results: rows without an id, null vectors, and vectors with null or non-finite components take no part; a
component or a score that no long can hold fails the query; vectors are only compared with those of the same length; a row never answers
a query with its own id; repeated rows each count; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.session import stored

ROW_BLOCK = 8192
QUERY_BLOCK = 4096
DROPPED_BITS = 3
NARROW = 1 << 24  # sums of products of smaller numbers fit 64 bits, for vectors of up to 2^14 components
LIMB = 20


def quantised(df: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the usable vectors."""
    def usable(x):
        return x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # NaN is above infinity

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, usable))
    return rows.select(F.col(key).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def add_all(numbers: np.ndarray) -> np.ndarray:
    """The sum over the first axis of bit-sliced numbers, shaped (count, slices, words), lowest slice first."""
    extra = max(1, int(len(numbers)).bit_length())
    stack = np.concatenate([numbers, np.zeros((len(numbers), extra, numbers.shape[2]), np.uint64)], axis=1)
    while len(stack) > 2:
        k = len(stack) // 3
        a, b, c = stack[:k], stack[k:2 * k], stack[2 * k:3 * k]
        half = a ^ b
        carry = np.zeros_like(a)
        carry[:, 1:] = ((a & b) | (half & c))[:, :-1]
        stack = np.concatenate([half ^ c, carry, stack[3 * k:]])
    return stack[0] if len(stack) == 1 else add_two(stack[0], stack[1])


def add_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, carry = np.empty_like(a), np.zeros(a.shape[1], np.uint64)
    for i in range(len(a)):
        half = a[i] ^ b[i]
        out[i] = half ^ carry
        carry = (a[i] & b[i]) | (half & carry)
    return out


def ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def kth_best(slices: np.ndarray, rows: np.ndarray, k: int) -> int:
    """The k-th largest number among the rows of a bitmap that holds k or more, most significant slice first."""
    sure, tied, value = 0, rows, 0
    for j in range(len(slices) - 1, -1, -1):
        with_bit = tied & slices[j]
        n = ones(with_bit)
        if sure + n >= k:
            tied, value = with_bit, value | (1 << j)
        else:
            sure, tied = sure + n, tied & ~slices[j]
    return value


def at_least(slices: np.ndarray, rows: np.ndarray, bound: int) -> np.ndarray:
    """The rows of a bitmap whose number is `bound` or more."""
    if bound <= 0:
        return rows
    if bound >= 1 << len(slices):
        return np.zeros_like(rows)
    above, tied = np.zeros_like(rows), rows
    for j in range(len(slices) - 1, -1, -1):
        if bound >> j & 1:
            tied = tied & slices[j]
        else:
            above = above | (tied & slices[j])
            tied = tied & ~slices[j]
    return above | tied


class BitSlicedIndex:
    """The slices of a block of integer vectors of one length, rows ordered by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dropped: int = DROPPED_BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low = int(self.vectors.min()) if vectors.size else 0
        coarse = (self.vectors - self.low) >> dropped
        self.dropped, self.bits = dropped, max(1, int(coarse.max()).bit_length() if vectors.size else 1)
        words = -(-len(ids) // 64)
        padded = np.zeros((vectors.shape[1], words * 64), np.int64)
        padded[:, :len(ids)] = coarse.T
        self.slices = np.stack(
            [np.packbits((padded >> j & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for j in range(self.bits)], 1)
        every = np.zeros(words * 64, np.uint8)
        every[:len(ids)] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    def coarse_sum(self, query: np.ndarray) -> np.ndarray:
        """Slices of the sum of |q_d| * (value, or its complement where q_d < 0), without the dropped bits."""
        size = np.abs(query)
        terms = np.where((query < 0)[:, None, None], ~self.slices, self.slices)
        parts = [(j, add_all(terms[(size >> j & 1) == 1])) for j in range(int(size.max()).bit_length()) if (size >> j & 1).any()]
        width = max(j + len(p) for j, p in parts)
        shifted = np.zeros((len(parts), width, terms.shape[2]), np.uint64)
        for i, (j, p) in enumerate(parts):
            shifted[i, j:j + len(p)] = p
        return add_all(shifted)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id `own`, by score, then id."""
        rows = self.every
        a, b = np.searchsorted(self.ids, [own, own + 1])
        if b > a:
            rows = rows.copy()
            for i in range(a, b):
                rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        n = ones(rows)
        if n > k and query.any():
            sums = self.coarse_sum(query)
            # the dropped bits add at most this much to a sum, in its own units
            slack = -(-int(np.abs(query).sum()) * ((1 << self.dropped) - 1) >> self.dropped)
            rows = at_least(sums, rows, kth_best(sums, rows, k) - abs(slack))
        found = positions(rows)
        scores = self.vectors[found] @ query
        top = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[top]], scores[top]


def narrow(vector: np.ndarray) -> bool:
    return not len(vector) or (int(vector.max()) < NARROW and int(vector.min()) > -NARROW)


def limbs(numbers: np.ndarray) -> list[np.ndarray]:
    """Numbers of 64 bits as parts of LIMB bits, lowest first; the last one carries the sign."""
    parts = [(numbers >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(3)]
    return [*parts, numbers >> (LIMB * 3)]


def wide_best(own: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the index finds, from exact sums of products of parts; raises if one of the best scores is no long."""
    scores = np.zeros(len(ids), object)
    for i, q in enumerate(limbs(query)):
        for j, v in enumerate(limbs(vectors)):
            if q.any() and v.any():
                scores += (v @ q).astype(object) * (1 << (LIMB * (i + j)))
    there = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != own]
    best = sorted(there)[:k]
    if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in best):
        raise OverflowError(f"a score of query {own} is too large for 64 bits")
    return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows of one vector length, all narrow or all wide, of bounded size."""
    held: dict[tuple[int, bool], list] = {}
    for batch in batches:
        for key, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
            vector = v.values.to_numpy(zero_copy_only=False).astype(np.int64)
            some = held.setdefault((len(vector), narrow(vector)), [])
            some.append((key, vector))
            if len(some) == ROW_BLOCK:
                yield np.array([i for i, _ in some], np.int64), np.stack([x for _, x in some])
                some.clear()
    for some in held.values():
        if some:
            yield np.array([i for i, _ in some], np.int64), np.stack([x for _, x in some])


def _answers(rows: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches):
            few = narrow(vectors.ravel())
            index = BitSlicedIndex(ids, vectors) if few else None
            out = [[], [], []]
            for own, query in queries:
                if len(query) == vectors.shape[1]:
                    query = np.array(query, np.int64)
                    found, scores = index.best(own, query, k) if few and narrow(query) else wide_best(own, query, ids, vectors, k)
                    out[0].append(np.full(len(found), own))
                    out[1].append(found)
                    out[2].append(scores)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (vec_id, v): the k best rows of every query."""
    rows = stored(rows.repartition("vec_id"))
    queries = stored(queries.select("vec_id", "v"))
    parts = -(-queries.count() // QUERY_BLOCK)
    found = rows.sparkSession.createDataFrame([], FOUND)
    for part in range(parts):
        # about QUERY_BLOCK queries at a time, whatever their number
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).collect()
        found = found.union(stored(_answers(rows, [(r["vec_id"], r["v"]) for r in some], k)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """WITH e AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
