"""Periodic runs of words in texts, found as maximal pairs.

A run is a stretch of consecutive words that repeats itself with a smallest period q at least four times and cannot
be extended. Its first word and the word q later begin a maximal pair: both go on alike for all but q words of the
run, differ in the word to their left and in the word after. The other way round, a maximal pair at a distance d
that agrees on 3d words or more is a run of its own length plus d, so nothing has to be extended or tried.

The words of a slice of texts become numbers, different ones in every text. Their suffixes are sorted by refinement,
common prefixes follow from the ranks of the rounds, and the tree of LCP intervals is walked bottom-up: every
interval has its positions in order, each in the class of the word to its left. When two children meet, each
position of the smaller is paired with its neighbours in the larger one if their classes differ. Neighbours are
enough: occurrences of a text of L words within L / 3 of each other lie evenly spaced, all but the first have the same
word to the left, all but the last the same word after, and where more than two lie so the deeper interval has
already given the run. A run can also appear as a pair at a multiple of its period; the smallest distance is kept.

Defined results: a null text has no words; texts without runs have an empty list and all their words; repeated rows
and rows without an id are texts of their own; an empty table gives an empty result; of further columns those asked
for pass through. A text is handled whole in one task, in memory proportional to its words.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.llm.common import sliced

LEAST_LENGTH = 6
LEAST_REPEATS = 4
BATCH_BYTES = 2 << 20
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def numbered(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, each text with its own and an end mark, and where the texts begin."""
    parts, begins, used, at = [], [0], 0, 0
    for words in texts:
        table: dict[bytes, int] = {}
        ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
        parts += [ids + used, np.array([used + len(table)])]
        used += len(table) + 1
        at += len(words) + 1
        begins.append(at)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(begins, np.int64)


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, and the ranks by the first 1, 2, 4, ... symbols until all differ."""
    n = len(symbols)
    bits = max(1, n.bit_length())
    order = np.argsort(symbols, kind="stable")
    fresh = np.append(True, symbols[order[1:]] != symbols[order[:-1]])[:n]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, done = [place.astype(np.int32)], 1
    at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(at):
        # only what shares its rank with others is sorted again, by the rank of what follows the compared part;
        # an end mark is alone, so that part always ends within the text
        positions = order[at]
        groups, after = place[positions], place[positions + done]
        if 3 * bits <= 63:
            by = np.sort((groups << 2 * bits) | (after << bits) | np.arange(len(at))) & ((1 << bits) - 1)
        else:
            by = np.lexsort((after, groups))
        positions, groups, after = positions[by], groups[by], after[by]
        order[at] = positions
        new = np.append(True, (groups[1:] != groups[:-1]) | (after[1:] != after[:-1]))
        place[positions] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        done *= 2
        levels.append(place.astype(np.int32))
    return order, levels


def shared_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in the order, doubled steps downward."""
    left, right = order[:-1], order[1:]
    shared = np.zeros(len(left), np.int64)
    some = np.arange(len(left))
    if len(levels) > 1:
        some = some[levels[0][left] == levels[0][right]]
    for k in range(len(levels) - 1, -1, -1):
        done = shared[some]
        same = levels[k][left[some] + done] == levels[k][right[some] + done]
        shared[some[same]] += 1 << k
    return np.append(0, shared)[:len(order)]


def _joined(larger: list[int], smaller: list[int], depth: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """Two children of one interval become one list; their maximal pairs of a fitting distance go to `found`."""
    if len(larger) < len(smaller):
        larger, smaller = smaller, larger
    reach = depth // (LEAST_REPEATS - 1)
    for p in smaller:
        at = bisect_left(larger, p)
        if at:
            q = larger[at - 1]
            if p - q <= reach and left[p] != left[q]:
                found.append((q, p, depth))
        if at < len(larger):
            q = larger[at]
            if q - p <= reach and left[p] != left[q]:
                found.append((p, q, depth))
    if len(smaller) < 8:
        for p in smaller:
            insort(larger, p)
    else:
        larger += smaller
        larger.sort()
    return larger


def interval_pairs(positions: list[int], shared: list[int], least: int, left: list[int]) -> list[tuple[int, int, int]]:
    """(first, second, common length) from one part of the suffix order, walked as a tree of LCP intervals.

    `shared[k]` belongs to the positions k - 1 and k; intervals of less than `least` words are not built.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    ends = len(positions)
    for k, p in enumerate(positions):
        depth = shared[k + 1] if k + 1 < ends else 0
        held = [p]
        while stack and stack[-1][0] > depth:
            above, waiting = stack.pop()
            held = _joined(waiting, held, above, left, found)
        if depth < least:
            stack.clear()
        elif stack and stack[-1][0] == depth:
            stack[-1] = (depth, _joined(stack[-1][1], held, depth, left, found))
        else:
            stack.append((depth, held))
    return found


def maximal_runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; every end mark in `symbols` is unique."""
    # a run with period q has a pair that agrees on its length less q words, and on (repeats - 1) * q at least
    least = min(max(least_length - q, (LEAST_REPEATS - 1) * q) for q in range(1, least_length + 1))
    if len(symbols) < least_length:
        return np.zeros((0, 3), np.int64)
    order, levels = suffix_ranks(symbols)
    shared = shared_prefixes(order, levels)
    # parts of the order whose neighbours share enough; a part in which no two positions are near has no run
    part = np.cumsum(shared < least)
    sizes = np.bincount(part)
    several = sizes[part] > 1
    at, part = np.flatnonzero(several), part[several]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    positions, deep = order[at], shared[at]
    by = np.lexsort((positions, part))
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    gaps = np.append(len(symbols), np.diff(positions[by]))
    gaps[heads] = len(symbols)
    deep = np.where(np.isin(np.arange(len(at)), heads), 0, deep)
    near = np.minimum.reduceat(gaps, heads) * (LEAST_REPEATS - 1) <= np.maximum.reduceat(deep, heads)
    ends = np.append(heads[1:], len(at))
    # the class of a position is the word to its left; what begins a text has a class of its own
    left = np.append(-1, symbols[:-1]).tolist()
    found: list[tuple[int, int, int]] = []
    for a, b in zip(heads[near].tolist(), ends[near].tolist()):
        found += interval_pairs(positions[a:b].tolist(), deep[a:b].tolist(), least, left)
    if not found:
        return np.zeros((0, 3), np.int64)
    first, second, common = np.array(found, np.int64).T
    period = second - first
    length = common + period
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    kept = np.append(True, (first[1:] != first[:-1]) | (length[1:] != length[:-1])) & (length >= least_length)
    rows = np.stack([first[kept], length[kept], period[kept]], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The runs of all texts one after the other, how many each text has, and the texts without what repeats."""
    symbols, begins = numbered(texts)
    runs = maximal_runs(symbols)
    owner = np.searchsorted(begins, runs[:, 0], "right") - 1
    steps = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(steps[:-1]) > 0
    counts = np.bincount(owner, minlength=len(texts))
    collapsed = []
    for i, words in enumerate(texts):
        if counts[i]:
            gone = dropped[begins[i]:begins[i + 1]].tolist()
            words = [w for w, g in zip(words, gone) if not g]
        collapsed.append(b" ".join(words))
    runs = runs.copy()
    runs[:, 0] -= begins[owner]
    return runs, counts, collapsed


def find_runs(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, `runs` by start and period, and `collapsed`: the words that no run repeats, joined by spaces."""
    keep = list(keep)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    pairs = [(f"_{i}", c) for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", BATCH_BYTES):
            texts = [(t or b"").split() for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            runs, counts, collapsed = runs_of(texts)
            cells = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), cells)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(a) for a, _ in pairs], lists, pa.array(collapsed, pa.binary()).cast(pa.string())], schema.names)

    return df.select(*[F.col(c).alias(a) for a, c in pairs], F.col(text).alias("_text")).mapInArrow(run, schema)


def planted(df: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its id, goes on periodically from some word on (see the query)."""
    check = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(check / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.transform(
            F.array(F.struct(words.alias("words"), n.alias("n"), a.alias("a"), p.alias("p"))),
            lambda t: F.array_join(F.transform(
                F.sequence(F.lit(0).cast("long"), t["n"] - 1),
                lambda i: F.get(t["words"], F.when(i < t["a"], i).otherwise(t["a"] + (i - t["a"]) % t["p"]).cast("int"))), " "))[0]

    trimmed = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    with_words = F.transform(F.array(trimmed), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return df.withColumn("text", F.when(check % 10 == 0, with_words).otherwise(F.col("text")))


def run_digest(found: DataFrame) -> DataFrame:
    """One row per text: its number of runs, the longest one, and check values of all runs and of what is left."""
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best_of = found.withColumns({"_best": best, "_lines": F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return best_of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
