"""Removal of repeated byte strings with suffix arrays, exactly, without comparing shard by shard.

Every string of `LENGTH` bytes contains an anchor: the leftmost of its k-byte pieces with the smallest hash. Equal
strings have equal anchors in equal places, so two strings can only be equal if their anchors are. That decides
what has to be looked at:

1. An anchor that occurs once lies in no repeated string.
2. An anchor's context is all bytes that a string around it can cover. Equal contexts at two places (compared by
   128 bits of hashes) make every string around the anchor repeated. Copies of whole texts, however many, end here
   as counts and are never gathered.
3. Contexts that occur once, but whose anchor occurs elsewhere, are shared in part or not at all. They go, with
   one representative of each repeated context of the same anchor, to a shard that holds that anchor. The shard's
   suffix array (see `suffix`) finds the repeated strings among them.
4. A string around an anchor has `SIDE` bytes or more on one side of it. The contexts of an anchor that occurs more than
   `PART` times are therefore dealt by the bytes next to it, once by those to the left and once by those to the right:
   whoever shares a string meets in one of both groups. Groups of one are dropped, the others are whole in a shard.
   A group that itself has more than `PART` contexts is dealt once more, in `FINE` ranges of where a string can begin,
   by all bytes that the strings of a range have in common; of a context only the bytes of the range go on.
5. Only what then still is a group of more than `PART` is spread over several shards. Those hand on one
   fingerprint of every different string, and a merge looks each up among the other shards' by binary search.

Counts are aggregated before they are shuffled and joined back by key, so a hot anchor costs one partial count per
task. The anchors, the repeating ones, the contexts for the shards and what these find are stored in the shared folder.
Texts are shuffled by a key of their own, once to meet the judgement of their anchors and once to meet their runs.

Defined results: a null text is empty; texts shorter than the length keep everything; repeated rows repeat each
other and lose all bytes that a string covers; rows without an id take part like any other; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm import suffix
from tallyshelf.llm.common import sliced
from tallyshelf.session import stored

LENGTH = 200
PIECE = 64
PART = 4096
FINE = 4
OPEN_TOGETHER = 100_000  # fingerprints that are merged in one task
SHARD_BYTES = 1 << 18  # small arrays stay in a core's cache
CHUNK = 1 << 22
LOW = np.uint64((1 << 24) - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio, odd


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes from every position on."""
    words, n = suffix.packed(data), len(data) - PIECE + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, PIECE, suffix.WORD):
        h = (h ^ words[k:k + n]) * MULTIPLIER
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of `length` bytes."""
    width = length - PIECE + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, values = [], []
    for at in range(0, len(data) - length + 1, CHUNK):
        h = _hashes(data[at:at + CHUNK + length - 1])
        # the position in the low bits makes the leftmost win
        keys = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(keys) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max)
        padded[:len(keys)] = keys
        block = padded.reshape(rows, width)
        down = np.minimum.accumulate(block, axis=1).ravel()
        up = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(up[:len(keys) - width + 1], down[width - 1:len(keys)])
        # the smallest moves to the right only
        where = (least & LOW).astype(np.int64)
        where = where[np.append(True, where[1:] != where[:-1])]
        found.append(where + at)
        values.append(h[where])
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(values)[first]


def contexts(text: bytes, positions: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int], np.ndarray]:
    """Begin and end of every anchor's context, and 64 bits of its hash."""
    begins = np.maximum(positions - (length - PIECE), 0).tolist()
    ends = np.minimum(positions + length, len(text)).tolist()
    digest = xxhash.xxh3_64_intdigest
    return begins, ends, np.array([digest(text[a:b]) for a, b in zip(begins, ends)], np.uint64)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, rows, values, hashes, counts = batch.column("key").to_numpy(), [], [], [], []
            for i, text in enumerate(_bytes(batch)):
                positions, a = anchors(np.frombuffer(text, np.uint8), length)
                if len(positions):
                    c = contexts(text, positions, length)[2]
                    order = np.lexsort((c, a))
                    a, c = a[order], c[order]
                    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
                    values.append(a[new])
                    hashes.append(c[new])
                    counts.append(np.diff(np.append(new, len(a))))
                    rows.append(np.full(len(new), keys[i]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows)), pa.array(np.concatenate(values).view(np.int64)),
                     pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))],
                    ["key", "a", "c", "n"])

    return run


def _flags(rows: DataFrame) -> DataFrame:
    """(key, flags): for each text the anchors that repeat, with what to do about their contexts.

    The repeating anchors are stored, since two aggregates read them. An anchor whose contexts are all alike sends none.
    """
    totals = rows.groupBy("a").agg(F.sum("n").alias("total")).where("total > 1")
    repeated = stored(rows.join(totals, "a"))
    by_context = repeated.groupBy("a", "c").agg(F.sum("n").alias("copies"), F.min("key").alias("chosen"))
    copies, total = F.col("copies"), F.col("total")
    judged = repeated.join(by_context, ["a", "c"]).select(
        "key", "a", "c", (copies > 1).alias("all"),
        ((copies < total) & ((copies == 1) | (F.col("key") == F.col("chosen")))).alias("send"),
        (total > PART).alias("hot"))
    return judged.groupBy("key").agg(F.collect_list(F.struct("a", "c", "all", "send", "hot")).alias("flags"))


def _flag_map(flags: list[dict]) -> dict[tuple[int, int], dict]:
    """By the unsigned hashes of anchor and context."""
    mask = (1 << 64) - 1
    return {(f["a"] & mask, f["c"] & mask): f for f in flags}


SENT = ["a", "hot", "key", "begin", "end", "at", "bytes", "left", "right"]
SENT_SCHEMA = "a bigint, hot boolean, key bigint, begin bigint, end bigint, at int, bytes binary, left bigint, right bigint"


def _sent(length: int):
    """The contexts that a shard has to look at; those of hot anchors with hashes of the bytes on both sides.

    Rows without an anchor are runs of strings that counts have settled already: all around contexts that repeat.
    """
    side = -(-(length - PIECE) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, flags, out = batch.column("key").to_pylist(), batch.column("flags"), []
            for i, text in enumerate(_bytes(batch)):
                known = _flag_map(flags[i].as_py() or [])
                if not any(f["send"] or f["all"] for f in known.values()):
                    continue
                positions, a = anchors(np.frombuffer(text, np.uint8), length)
                begins, ends, c = contexts(text, positions, length)
                done, settled = set(), []
                for pair, at, begin, end in zip(zip(a.tolist(), c.tolist()), positions.tolist(), begins, ends):
                    flag = known.get(pair)
                    if flag and flag["all"]:
                        settled.append(at)
                    if flag and flag["send"] and pair not in done:
                        # a context that repeats is settled by counts everywhere: one occurrence stands for all in the text
                        if flag["all"]:
                            done.add(pair)
                        # none where the context ends earlier: no string has so many bytes there
                        left = _signed(text[at - side:at]) if flag["hot"] and at - side >= begin else None
                        right = _signed(text[at + PIECE:at + PIECE + side]) if flag["hot"] and at + PIECE + side <= end else None
                        out.append((flag["a"], flag["hot"], keys[i], begin, None, at - begin, text[begin:end], left, right))
                if settled:
                    at = np.array(settled)
                    first, last = np.maximum(at + PIECE - length, 0), np.minimum(at, len(text) - length)
                    new = np.flatnonzero(np.append(True, first[1:] > last[:-1] + 1))
                    for x, y in zip(first[new].tolist(), last[np.append(new[1:], len(at)) - 1].tolist()):
                        out.append((None, None, keys[i], x, y, None, None, None, None))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], SENT)

    return run


def _signed(data: bytes) -> int:
    """A hash as a signed number of 64 bits."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _ranges(large: DataFrame, length: int) -> DataFrame:
    """The rows of groups that share one side, dealt by ranges of the bytes that a string has to the left of its anchor.

    `low` and `high` bound them. The strings of a range have `low` bytes to the left and all but `high` of the others to the
    right in common, which is the new group; the row keeps the bytes that a string of the range can cover.
    """
    reach = length - PIECE
    half = reach // 2
    step = max(1, -(-half // FINE))
    first = F.when(F.col("on") == 0, reach - half).otherwise(0)
    rows = large.withColumn("low", F.explode(F.sequence(first, first + max(half - 1, 0), F.lit(step))))
    rows = rows.withColumn("high", F.least(F.col("low") + step, first + half))
    rows = rows.where(f"at >= low AND at + {PIECE + reach} - high <= length(bytes)").withColumn("cut", F.expr("greatest(at - high, 0)"))
    return rows.select(
        "a", F.expr(f"xxhash64('range', low, substring(bytes, at - low + 1, {PIECE + reach} + low - high))").alias("side"),
        "key", (F.col("begin") + F.col("cut")).alias("begin"), F.expr(f"substring(bytes, cut + 1, at + {PIECE + reach} - low - cut)").alias("bytes"))


def _dealt(sent: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, side, part, key, begin, bytes): the rows of the shards' groups, in several parts where a group is large."""
    columns = ["a", "side", "part", "key", "begin", "bytes"]
    none = F.lit(None).cast("int").alias("part")
    cold = sent.where("NOT hot").select("a", F.lit(None).cast("long").alias("side"), none, "key", "begin", "bytes")
    sides = F.array(F.xxhash64(F.lit("left"), "left"), F.xxhash64(F.lit("right"), "right"))
    there = F.array(F.col("left").isNotNull(), F.col("right").isNotNull())
    hot = sent.where("hot").select("*", F.posexplode(F.arrays_zip(sides.alias("side"), there.alias("there"))).alias("on", "_s"))
    hot = hot.where("_s.there").select("a", F.col("_s.side").alias("side"), "on", "key", "begin", "at", "bytes")
    count = lambda rows: rows.groupBy("a", "side").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    halves = hot.join(count(hot), ["a", "side"])
    ranges = _ranges(halves.where(F.col("size") > PART), length)
    parts = F.when(F.col("size") > PART, F.pmod(F.xxhash64("key", "begin"), F.ceil(F.col("size") / PART)))
    dealt = ranges.join(count(ranges), ["a", "side"]).withColumn("part", parts.cast("int"))
    whole = halves.where(F.col("size") <= PART).withColumn("part", none)
    return cold.unionByName(whole.select(columns)).unionByName(dealt.select(columns))


FOUND = ["key", "begin", "end", "first", "second", "open"]
FOUND_SCHEMA = "key bigint, begin bigint, end bigint, first bigint, second bigint, open boolean"


def _runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start) of the maximal runs among the given starts."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    return keys[at], starts[at], starts[np.append(at[1:], len(keys)) - 1] if len(at) else starts


def _shard(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Runs of repeated strings in one shard, and a fingerprint of each different string of a spread group."""
    data = np.frombuffer(b"".join(r[5] + b"\xff" for r in rows), np.uint8)
    sizes = np.array([len(r[5]) + 1 for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    start = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.array([r[4] for r in rows])[row]
    key = np.array([r[3] for r in rows], np.int64)
    texts, text = np.unique(key, return_inverse=True)
    # the place in the input: number of the text and start, so that neighbouring starts are neighbouring numbers
    place = text[row] << 40 | start
    positions, classes, several = suffix.repeated_starts(data, place, length)
    repeated = np.unique(place[positions[several]])
    new = np.append(True, np.diff(repeated) != 1)[:len(repeated)]
    first, last = repeated[new], repeated[np.append(new[1:], True)[:len(repeated)]]
    keys, begins, ends = texts[first >> 40], first & ((1 << 40) - 1), last & ((1 << 40) - 1)
    n = len(keys)
    out = [keys, begins, ends, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)]
    parts = np.array([r[2] is not None for r in rows])
    if parts.any():
        spread = parts[row[positions]]
        _, one = np.unique(classes[spread], return_index=True)
        some = positions[spread][one]
        raw = data.tobytes()
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p:p + length]) for p in some.tolist()), np.int64).reshape(-1, 2)
        more = [key[row[some]], start[some], start[some], prints[:, 0], prints[:, 1], np.ones(len(some), bool)]
        out = [np.concatenate(pair) for pair in zip(out, more)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], FOUND)


def _shards(length: int):
    """Rows come by group: whole groups are put together until a shard is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("a", "side", "part", "key", "begin", "bytes")]):
                # a spread group has shards of its own
                if held and row[:3] != last and (size >= SHARD_BYTES or row[2] is not None or last[2] is not None):
                    yield _shard(held, length)
                    held, size = [], 0
                held.append(row)
                last, size = row[:3], size + len(row[5])
        if held:
            yield _shard(held, length)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The strings of spread groups that another shard has too, as runs."""
    key, begin, first, second = (table.column(c).to_numpy() for c in ("key", "begin", "first", "second"))
    found = suffix.found_elsewhere(first, second, key, begin)
    keys, begins, ends = _runs(key[found], begin[found])
    return pa.table({"key": keys, "begin": begins, "end": ends})


def covered(size: int, begins, ends, length: int = LENGTH) -> np.ndarray:
    """Which bytes lie in a string that starts between one of `begins` and the matching one of `ends`."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, begins, 1)
    np.add.at(steps, np.asarray(ends, np.int64) + length, -1)
    return np.cumsum(steps[:size]) > 0


def _removed(length: int, keep: list[str], texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            runs, out = batch.column("runs"), []
            for i, text in enumerate(_bytes(batch)):
                found = runs[i].as_py() or []
                if found:
                    gone = covered(len(text), [r["begin"] for r in found], [r["end"] for r in found], length)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                else:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
            columns = list(zip(*out))
            last = pa.array(columns[4], pa.binary()) if texts else pa.array(columns[3], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], *[pa.array(x, pa.int64()) for x in columns[:3]], last],
                [*keep, "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"])

    return run


def remove_repeats(df: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or, with `texts`, the remaining bytes as `kept`."""
    # a key of its own for every text; rows with the same id and text are alike
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = stored(docs.select("key", "text").mapInArrow(_anchor_rows(length), "key bigint, a bigint, c bigint, n bigint"))
    # texts without a repeating anchor have no flags and send nothing
    flagged = docs.select("key", "text").join(_flags(rows), "key")
    sent = stored(flagged.mapInArrow(_sent(length), SENT_SCHEMA))
    by_group = _dealt(sent.where("a IS NOT NULL"), length).repartition("a", "side", "part").sortWithinPartitions("a", "side", "part")
    found = stored(by_group.mapInArrow(_shards(length), FOUND_SCHEMA))
    open_ = found.where("open")
    buckets = 1 + open_.count() // OPEN_TOGETHER
    merged = open_.groupBy(F.pmod("first", F.lit(buckets)).alias("bucket")).applyInArrow(_merge, "key bigint, begin bigint, end bigint")
    runs = found.where("NOT open").select("key", "begin", "end").unionByName(merged)
    runs = runs.unionByName(sent.where("a IS NULL").select("key", "begin", "end"))
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    kind = df.schema["doc_id"].dataType.simpleString()
    last = "kept binary" if texts else "kept_sha256 string"
    return docs.join(runs, "key", "left").mapInArrow(
        _removed(length, ["doc_id"], texts), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
