"""A random forest over many rows, grown from histograms of binned rows and returned as a Spark ML model.

The trees are those of Spark ML: bins between quantiles, variance, all features at each split, every row weighed anew for
each tree by a Poisson draw of mean 1. The rows are binned once; rows with equal bins are one cell, and a tree needs of a
cell no more than its drawn weight and sum of labels. One pass over the rows draws them, takes the cells down the trees
grown so far and counts the histograms of the next level; only these are shuffled, and only splits reach the driver.

Draws follow the seed, the tree and the place of a row in the stored cells, so every pass sees the same ones and nothing
of the size of rows times trees is kept. They are made for every row; of rows that are equal in bins and label, more than
UNITS are drawn at once, as a Poisson draw of their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from tallyshelf.session import staging_dir, stored

# Points of a summary of a feature's values. Ranks are off by some 1/SUMMARY per merged level, of which there are a few; a
# feature with fewer values is summed up exactly.
SUMMARY = 2048
MERGED = 8  # summaries that are merged into one of the next level
BATCH_ROWS = 500_000
BUCKET_ROWS = 500_000
BUCKETS = 64  # at least
SPILL_LABELS = 4096  # of one cell of a batch; more labels go to the next bucket, so no cell fills a task
BLOCK_DRAWS = 1_000_000
UNITS = 16
FEW = 64  # cells of at most so many rows are added up by number of rows
OPEN = 255  # stands for draws that 16 bits leave open
HISTOGRAM_BYTES = 64 << 20  # of the nodes that a task grows in one pass
SLAB = 64  # nodes whose partial histograms are added up in one call
ROUNDING = 1e-12  # a gain below this share of the squared labels is none

SUMMARY_SCHEMA = "feature int, points binary, weights binary"
PART_SCHEMA = "bucket int, cells binary, labels binary, counts binary"
BLOCK_SCHEMA = "bucket int, block int, bins binary, lengths binary, labels binary, counts binary"
SUMS_SCHEMA = "tree int, low int, place long, sums binary"
SPLITS_SCHEMA = "tree int, low int, features binary, cuts binary"


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The distribution function of a Poisson draw of mean 1, and the draw that 16 bits name, OPEN where more decide."""
    masses = np.exp(-1.0) / np.cumprod([1.0, *range(1, 24)])
    upto = np.cumsum(masses)
    low, high = np.arange(1 << 16) / (1 << 16), np.arange(1, (1 << 16) + 1) / (1 << 16)
    first, last = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high, side="left")
    return upto, np.where(first == last, first, OPEN).astype(np.uint8)


UPTO, DRAWS = _steps()


# ---------------------------------------------------------------- bins


def _matrices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[np.ndarray]:
    """Columns of at least so many rows, as one array; the label is the last."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        n += batch.num_rows
        if n >= rows:
            yield np.concatenate(held, axis=1)
            held, n = [], 0
    if n:
        yield np.concatenate(held, axis=1)


def _merged(summaries: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    points, at = np.unique(np.concatenate([s[0] for s in summaries]), return_inverse=True)
    return points, np.bincount(at, weights=np.concatenate([s[1] for s in summaries]))


def _thinned(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most SUMMARY of the points, each with the weight of those that it stands for."""
    if len(points) <= SUMMARY:
        return points, weights
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, SUMMARY + 1) / SUMMARY))
    return points[at], np.diff(upto[at], prepend=0.0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    levels: list[list[list]] = []  # per feature and level, the summaries not merged yet
    for matrix in _matrices(batches):
        if not np.isfinite(matrix).all():
            raise ValueError("features and target must not be missing, NaN or infinite")
        levels = levels or [[[]] for _ in matrix[:-1]]
        for values, own in zip(matrix[:-1], levels, strict=True):
            points, weights = np.unique(values, return_counts=True)
            own[0].append(_thinned(points, weights.astype(float)))
            for i, waiting in enumerate(own):
                if len(waiting) == MERGED:
                    if i + 1 == len(own):
                        own.append([])
                    own[i + 1].append(_thinned(*_merged(waiting)))
                    waiting.clear()
    for feature, own in enumerate(levels):
        points, weights = _thinned(*_merged([s for waiting in own for s in waiting]))
        yield pa.RecordBatch.from_pydict({"feature": pa.array([feature], pa.int32()), "points": [points.tobytes()], "weights": [weights.tobytes()]})


def thresholds(points: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """The middle between all neighbours, or where the rows are closest to equal shares, as Spark ML places them."""
    middles = points[:-1] / 2 + points[1:] / 2
    if len(points) <= max_bins:
        return middles
    upto, stride, found = np.cumsum(weights), weights.sum() / max_bins, []
    wanted = stride
    for i, middle in enumerate(middles):
        if abs(upto[i] - wanted) < abs(upto[i + 1] - wanted):
            found.append(middle)
            wanted += stride
    return np.array(found)


def _edges(rows: DataFrame, max_bins: int) -> list[np.ndarray]:
    """The thresholds of every feature, from summaries of all rows."""

    def merge(table: pa.Table) -> pa.Table:
        columns = [[np.frombuffer(x, float) for x in table[c].to_pylist()] for c in ("points", "weights")]
        points, weights = _merged(list(zip(*columns, strict=True)))
        return pa.table({"feature": table["feature"][:1], "edges": [thresholds(points, weights, max_bins).tobytes()]})

    merged = rows.mapInArrow(_summaries, SUMMARY_SCHEMA).groupBy("feature").applyInArrow(merge, "feature int, edges binary")
    return [np.frombuffer(r["edges"], float) for r in merged.orderBy("feature").collect()]


# ---------------------------------------------------------------- cells


def _layout(sizes: Sequence[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """The 64-bit words of a cell, and (word, shift, mask) of each feature's bin."""
    word, shift, places = 0, 0, []
    for size in sizes:
        bits = (size - 1).bit_length()
        if shift + bits > 64:
            word, shift = word + 1, 0
        places.append((word, shift, (1 << bits) - 1))
        shift += bits
    return word + 1, places


def _ordered(cells: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by cell and label, equal ones added up; and where each cell begins."""
    order = np.lexsort((labels, *cells[::-1]))
    cells, labels, counts = cells[:, order], labels[order], counts[order]
    other = (cells[:, 1:] != cells[:, :-1]).any(axis=0)
    at = np.concatenate([[0], 1 + np.flatnonzero(other | (labels[1:] != labels[:-1]))])
    begins = np.searchsorted(at, np.concatenate([[0], 1 + np.flatnonzero(other)]))
    return cells[:, at], labels[at], np.add.reduceat(counts, at), begins


def _parts(edges: Sequence[np.ndarray], buckets: int) -> Callable:
    words, places = _layout([len(e) + 1 for e in edges])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix in _matrices(batches):
            cells = np.zeros((words, matrix.shape[1]), np.uint64)
            for values, own, (word, shift, _) in zip(matrix[:-1], edges, places, strict=True):
                cells[word] |= np.searchsorted(own, values).astype(np.uint64) << np.uint64(shift)
            cells, labels, counts, begins = _ordered(cells, matrix[-1] + 0.0, np.ones(matrix.shape[1], np.int64))
            mixed = np.zeros(len(labels), np.uint64)
            for word in cells:
                mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            later = (np.arange(len(labels)) - np.repeat(begins, np.diff(begins, append=len(labels)))) // SPILL_LABELS
            bucket = (mixed % np.uint64(buckets)).astype(np.int64)
            bucket = (bucket + later) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            for i, chosen in enumerate(np.split(order, ends[:-1])):
                if len(chosen):
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([i], pa.int32()), "cells": [np.ascontiguousarray(cells[:, chosen]).tobytes()],
                        "labels": [labels[chosen].tobytes()], "counts": [counts[chosen].tobytes()],
                    })

    return split


def _blocks(edges: Sequence[np.ndarray]) -> Callable:
    words, places = _layout([len(e) + 1 for e in edges])
    kind = _bin_type(edges)

    def join(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(x, np.uint64).reshape(words, -1) for x in table["cells"].to_pylist()], axis=1)
        labels = np.concatenate([np.frombuffer(x, float) for x in table["labels"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        cells, labels, counts, begins = _ordered(cells, labels, counts)
        drawn = np.cumsum(np.where(counts <= UNITS, counts, 1))
        # a cell that crosses an edge of blocks is a cell of both
        edge = np.searchsorted(drawn, np.arange(BLOCK_DRAWS, drawn[-1] + BLOCK_DRAWS, BLOCK_DRAWS), side="right")
        out, low = [], 0
        for high in np.unique(np.append(edge[:-1], len(labels))):
            inside = np.unique(np.append(low, begins[(begins > low) & (begins < high)]))
            bins = np.stack([((cells[w, inside] >> np.uint64(s)) & np.uint64(m)).astype(kind) for w, s, m in places])
            lengths = np.diff(inside, append=high).astype(np.int32)
            out.append((bins.tobytes(), lengths.tobytes(), labels[low:high].tobytes(), counts[low:high].tobytes()))
            low = high
        names = ("bins", "lengths", "labels", "counts")
        found = {c: pa.array([o[i] for o in out], pa.binary()) for i, c in enumerate(names)}
        first = {"bucket": pa.array([table["bucket"][0].as_py()] * len(out), pa.int32()), "block": pa.array(range(len(out)), pa.int32())}
        return pa.table(first | found)

    return join


def _bin_type(edges: Sequence[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges)) < 256 else np.uint16 if max(map(len, edges)) < 65536 else np.uint32


class _Block:
    """The rows of some cells, and their draws.

    Cells are sorted by their rows. Those of equally few lie together, first row of each, then second row of each and so on,
    so that adding them up adds whole arrays.
    """

    def __init__(self, row: dict, features: int, kind: type):
        self.place = (row["bucket"], row["block"])
        lengths, labels, counts = (np.frombuffer(row[c], t) for c, t in (("lengths", np.int32), ("labels", float), ("counts", np.int64)))
        cell = np.repeat(np.arange(len(lengths)), lengths)
        many = counts > UNITS
        times = np.where(many, 0, counts)
        rows = np.bincount(cell, weights=times, minlength=len(lengths)).astype(np.int64)
        order = np.argsort(rows, kind="stable")
        self.cells = len(order)
        self.bins = np.frombuffer(row["bins"], kind).reshape(features, -1)[:, order]
        self.wide = self.bins.astype(np.int64)
        places = np.empty_like(order)
        places[order] = np.arange(len(order))
        self.many, self.many_labels, self.numbers = places[cell[many]], labels[many], counts[many]
        begins = np.cumsum(rows) - rows
        sizes, firsts, numbers = np.unique(rows[order], return_index=True, return_counts=True)
        at, chosen, self.groups, self.long = 0, [], [], None
        for size, first, number in zip(*(x.tolist() for x in (sizes, firsts, numbers)), strict=True):
            if size > FEW:
                inside = order[first:]
                self.long = (at, first, np.cumsum(rows[inside]) - rows[inside])
                chosen.append(np.repeat(begins[inside] - self.long[2], rows[inside]) + np.arange(rows[inside].sum()))
                break
            if size:
                chosen.append((begins[order[first:first + number]] + np.arange(size)[:, None]).reshape(-1))
                self.groups.append((at, first, size, number))
                at += size * number
        self.labels = np.repeat(labels, times)[np.concatenate(chosen)] if chosen else np.zeros(0)

    def _added(self, values: Callable[[int, int], np.ndarray], powers: int) -> list[np.ndarray]:
        """Of each cell the sums of the values of its rows, of values times label, and so on."""
        sums = [np.zeros(self.cells) for _ in range(powers)]
        for at, first, size, number in self.groups:
            now, labels = values(at, at + size * number), self.labels[at:at + size * number]
            for i, to in enumerate(sums):
                if i:
                    now *= labels
                now.reshape(size, number).sum(axis=0, out=to[first:first + number])
        if self.long:
            at, first, begins = self.long
            now = values(at, len(self.labels))
            for i, to in enumerate(sums):
                if i:
                    now *= self.labels[at:]
                to[first:] = np.add.reduceat(now, begins)
        return sums

    def sums(self, seed: int, tree: int, squares: bool = False) -> list[np.ndarray]:
        """Of each cell the drawn weight and sum of labels, and of their squares if asked."""
        bits = np.random.SFC64(np.random.SeedSequence((seed % (1 << 64), tree, *self.place)))
        draws = np.random.Generator(bits)
        n = len(self.labels)
        low = bits.random_raw(-(-n // 4)).view(np.uint16)[:n]
        units = DRAWS.take(low)
        open_ = np.flatnonzero(units == OPEN)
        units[open_] = np.searchsorted(UPTO, (low[open_] + draws.random(len(open_))) / (1 << 16), side="right")
        sums = self._added(lambda low, high: units[low:high].astype(float), 3 if squares else 2)
        if len(self.many):
            weights = draws.poisson(self.numbers).astype(float)
            for to in sums:
                to += np.bincount(self.many, weights=weights, minlength=self.cells)
                weights *= self.many_labels
        return sums


# ---------------------------------------------------------------- trees


class _Tree:
    """Nodes by number: the root is 0, children follow their parent in pairs, a level lies together."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left = (np.array([x], np.int64) for x in (-1, 0, 0))
        self.first = 0  # of the level that grows

    @property
    def growing(self) -> int:
        return len(self.left) - self.first

    def split(self, features: np.ndarray, cuts: np.ndarray) -> None:
        """Gives the growing nodes their splits, -1 for none, and makes their children the growing ones."""
        self.feature[self.first:], self.cut[self.first:] = features, cuts
        parents = self.first + np.flatnonzero(features >= 0)
        self.first = len(self.left)
        self.left[parents] = self.first + 2 * np.arange(len(parents))
        more = 2 * len(parents)
        self.feature, self.cut, self.left = (np.concatenate([a, np.full(more, x)]) for a, x in ((self.feature, -1), (self.cut, 0), (self.left, 0)))

    def route(self, bins: np.ndarray, drop: bool) -> tuple[np.ndarray, np.ndarray]:
        """The cells and the nodes where they end, without those that end before the growing level if asked."""
        n = bins.shape[1]
        flat, cells, nodes = bins.reshape(-1), np.arange(n), np.zeros(n, np.int64)
        feature, cut = self.feature * n, self.cut
        while True:
            left = self.left[nodes]
            if drop:
                keep = (left > 0) | (nodes >= self.first)
                if not keep.all():
                    cells, nodes, left = cells[keep], nodes[keep], left[keep]
            if not left.any():
                return cells, nodes
            # a leaf has no feature, and what is read for it is not used
            down = left + (flat[feature[nodes] + cells] > cut[nodes])
            nodes = down if drop else np.where(left > 0, down, nodes)


def _jobs(sizes: Sequence[int], room: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (tree, low, high) that cover the nodes of all trees, each of at most so many nodes."""
    job, left = [], room
    for tree, size in enumerate(sizes):
        low = 0
        while low < size:
            high = min(size, low + left)
            job.append((tree, low, high))
            left -= high - low
            low = high
            if not left:
                yield job
                job, left = [], room
    if job:
        yield job


def _partial(place: int, tree: int, low: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, sums.shape[1], SLAB):
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array([tree], pa.int32()), "low": pa.array([low + i], pa.int32()), "place": pa.array([place], pa.int64()),
            "sums": [np.ascontiguousarray(sums[:, i:i + SLAB]).tobytes()],
        })


def _pass(edges: Sequence[np.ndarray], trees: Sequence[_Tree], seed: int, job: Sequence[tuple[int, int, int]], leaves: bool) -> Callable:
    """Adds up the histograms of the growing nodes, or the statistics of the nodes where rows end."""
    sizes = [len(e) + 1 for e in edges]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    kind = _bin_type(edges)
    grown = {tree: trees[tree] for tree, _, _ in job}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, place = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1).to_pylist()[0], len(sizes), kind)
                if found is None:
                    found = [np.zeros((3, high - low, 1) if leaves else (2, high - low, starts[-1])) for _, low, high in job]
                    place = block.place[0] << 32 | block.place[1]
                for (tree, low, high), total in zip(job, found, strict=True):
                    own = grown[tree]
                    sums = block.sums(seed, tree, squares=leaves)
                    cells, nodes = own.route(block.bins, drop=not leaves)
                    nodes = nodes - (low if leaves else own.first + low)
                    if low or high < (len(own.left) if leaves else own.growing):
                        inside = (nodes >= 0) & (nodes < high - low)
                        cells, nodes = cells[inside], nodes[inside]
                    whole = len(cells) == block.cells
                    if not whole:
                        sums = [s[cells] for s in sums]
                    if leaves:
                        for s, to in zip(sums, total[:, :, 0], strict=True):
                            to += np.bincount(nodes, weights=s, minlength=high - low)
                        continue
                    for f, size in enumerate(sizes):
                        if size == 1:
                            continue
                        at = nodes * size + (block.wide[f] if whole else block.bins[f].take(cells))
                        for s, to in zip(sums, total, strict=True):
                            to[:, starts[f]:starts[f + 1]] += np.bincount(at, weights=s, minlength=(high - low) * size).reshape(-1, size)
        for (tree, low, _), total in zip(job, found or [], strict=False):
            yield from _partial(place, tree, low, total)

    return add


def _added(table: pa.Table, kinds: int, width: int) -> np.ndarray:
    """The partial sums in the order of their places, so that rounding does not follow who came first."""
    order = np.argsort(table["place"].to_numpy())
    total = 0.0
    for i in order:
        total = total + np.frombuffer(table["sums"][int(i)].as_buffer(), float).reshape(kinds, -1, width)
    return total


def best_splits(weights: np.ndarray, labels: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) after which each node is split best, the first of equal ones; feature -1 where nothing is gained."""
    gains, owners, cuts, start = [], [], [], 0
    for f, size in enumerate(sizes):
        w, s = (np.cumsum(a[:, start:start + size], axis=1) for a in (weights, labels))
        start += size
        left, right = w[:, :-1], w[:, -1:] - w[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = s[:, -1:] ** 2 / w[:, -1:]
            gain = s[:, :-1] ** 2 / left + (s[:, -1:] - s[:, :-1]) ** 2 / right - whole
        gains.append(np.where((left >= 1) & (right >= 1) & (gain > ROUNDING * whole), gain, -1.0))
        owners.append(np.full(size - 1, f))
        cuts.append(np.arange(size - 1))
    gain = np.concatenate(gains, axis=1)
    best = gain.argmax(axis=1)
    feature = np.where(gain[np.arange(len(best)), best] > 0, np.concatenate(owners)[best], -1)
    return feature, np.concatenate(cuts)[best]


def _grow(blocks: DataFrame, edges: Sequence[np.ndarray], trees: Sequence[_Tree], seed: int) -> None:
    """One more level of every tree."""
    sizes = [len(e) + 1 for e in edges]
    width = sum(sizes)

    def split(table: pa.Table) -> pa.Table:
        features, cuts = best_splits(*_added(table, 2, width), sizes)
        key = {c: table[c][:1] for c in ("tree", "low")}
        return pa.table(key | {"features": [features.astype(np.int64).tobytes()], "cuts": [cuts.astype(np.int64).tobytes()]})

    found: list[dict[int, tuple]] = [{} for _ in trees]
    for job in _jobs([t.growing for t in trees], max(1, HISTOGRAM_BYTES // (16 * width))):
        partial = blocks.mapInArrow(_pass(edges, trees, seed, job, leaves=False), SUMS_SCHEMA)
        for r in partial.groupBy("tree", "low").applyInArrow(split, SPLITS_SCHEMA).collect():
            found[r["tree"]][r["low"]] = [np.frombuffer(r[c], np.int64) for c in ("features", "cuts")]
    for tree, own in zip(trees, found, strict=True):
        if own:
            tree.split(*(np.concatenate([own[low][i] for low in sorted(own)]) for i in (0, 1)))


def _statistics(blocks: DataFrame, edges: Sequence[np.ndarray], trees: Sequence[_Tree], seed: int) -> list[np.ndarray]:
    """The drawn weight, sum of labels and of their squares in every node of every tree."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({c: table[c][:1] for c in ("tree", "low", "place")} | {"sums": [_added(table, 3, 1).tobytes()]})

    totals = [np.zeros((3, len(t.left))) for t in trees]
    for job in _jobs([len(t.left) for t in trees], max(1, HISTOGRAM_BYTES // 24)):
        partial = blocks.mapInArrow(_pass(edges, trees, seed, job, leaves=True), SUMS_SCHEMA)
        for r in partial.groupBy("tree", "low").applyInArrow(add, SUMS_SCHEMA).collect():
            sums = np.frombuffer(r["sums"], float).reshape(3, -1)
            totals[r["tree"]][:, r["low"]:r["low"] + sums.shape[1]] = sums
    for tree, total in zip(trees, totals, strict=True):
        for node in np.flatnonzero(tree.left)[::-1]:
            total[:, node] += total[:, tree.left[node]] + total[:, tree.left[node] + 1]
    return totals


def _nodes(number: int, tree: _Tree, total: np.ndarray, edges: Sequence[np.ndarray]) -> pa.Table:
    """The nodes as Spark ML stores them; leaves of one parent that predict the same are one, as there."""
    weight, label, square = total
    prediction = label / weight
    impurity = np.maximum(square / weight - prediction * prediction, 0.0)
    left = tree.left.copy()
    for node in np.flatnonzero(left)[::-1]:
        a = left[node]
        if not left[a] and not left[a + 1] and prediction[a] == prediction[a + 1]:
            left[node] = 0
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for node in np.flatnonzero(left):  # children come after their parents
        kept[left[node]:left[node] + 2] = kept[node]
    at, new = np.flatnonzero(kept), np.cumsum(kept) - 1
    inner = left[at] > 0
    a, b = np.where(inner, left[at], 0), np.where(inner, left[at] + 1, 0)
    gain = impurity[at] - (weight[a] * impurity[a] + weight[b] * impurity[b]) / weight[at]
    places = np.cumsum([0, *map(len, edges)])
    cuts = np.concatenate([*edges, [0.0]])[(places[tree.feature[at]] + tree.cut[at])[inner]]
    i32, n = pa.int32(), len(at)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), i32), pa.array(values))
    split = {
        "featureIndex": pa.array(np.where(inner, tree.feature[at], -1), i32), "leftCategoriesOrThreshold": lists(np.cumsum(inner), cuts),
        "numCategories": pa.array(np.full(n, -1), i32),
    }
    data = {
        "id": pa.array(np.arange(n), i32), "prediction": pa.array(prediction[at]), "impurity": pa.array(impurity[at]),
        "impurityStats": lists(3 * np.arange(1, n + 1), total[:, at].T.reshape(-1)), "rawCount": pa.array(np.rint(weight[at]).astype(np.int64)),
        "gain": pa.array(np.where(inner, gain, -1.0)), "leftChild": pa.array(np.where(inner, new[a], -1), i32),
        "rightChild": pa.array(np.where(inner, new[b], -1), i32), "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    return pa.table({"treeID": pa.array(np.full(n, number), i32), "nodeData": pa.StructArray.from_arrays(list(data.values()), list(data))})


def _as_model(spark: SparkSession, estimator: RandomForestRegressor, nodes: pa.Table, features: int) -> RandomForestRegressionModel:
    """A Spark ML model with these nodes: the stored form of one with the same parameters, and read back."""
    one = spark.createDataFrame([(Vectors.dense([0.0] * features), 0.0)], [estimator.getFeaturesCol(), estimator.getLabelCol()])
    path = staging_dir(spark)
    estimator.fit(one).write().save(path)
    spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


def fit(rows: DataFrame, n: int, estimator: RandomForestRegressor) -> RandomForestRegressionModel:
    """The forest of the estimator's trees, depth, bins and seed over n rows of numeric features and, last, the label."""
    spark, seed = rows.sparkSession, estimator.getSeed()
    edges = _edges(rows, estimator.getMaxBins())
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    parts = rows.mapInArrow(_parts(edges, buckets), PART_SCHEMA)
    blocks = parts.groupBy("bucket").applyInArrow(_blocks(edges), BLOCK_SCHEMA)
    # in files enough for all cores
    blocks = stored(blocks.repartition(max(buckets // 4, 2 * spark.sparkContext.defaultParallelism)))
    trees = [_Tree() for _ in range(estimator.getNumTrees())]
    if any(len(e) for e in edges):
        for _ in range(estimator.getMaxDepth()):
            _grow(blocks, edges, trees, seed)
    totals = _statistics(blocks, edges, trees, seed)
    nodes = pa.concat_tables([_nodes(i, tree, total, edges) for i, (tree, total) in enumerate(zip(trees, totals, strict=True))])
    return _as_model(spark, estimator, nodes, len(edges))
