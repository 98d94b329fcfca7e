"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder works as the model defines it. A text becomes symbols of one character each, spaces as U+2581 and one
in front. An agenda holds every adjacent pair whose union is a piece, ordered by score and leftmost on ties;
merging the first pair replaces the pairs with its neighbours. What is not a piece at the end is spelled in byte
pieces.

If no piece has a space symbol after another character, no merge crosses the start of a run of space symbols, so
the runs between those points are encoded one by one and remembered in a bounded cache. New short runs of a batch go through their agendas together: runs of one length form a matrix whose rows are
agendas, and each step merges the best pair of every row. Long runs, and whole texts under other vocabularies,
have an agenda of their own in a heap.

Every run that enters the cache is compared with what the library makes of it, a batch at a time; the first
difference raises.

Defined results: a null text counts as empty (only the begin and end ids); repeated rows, rows without an id and
empty tables need no care; further columns pass through, and those called `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyshelf.llm.common import give_back, sliced, texts_of

SPACE = "▁"
CACHE_CHARS = 6 << 20  # of all runs remembered, with CACHE_RUNS and CACHE_IDS some 60 MB at most
CACHE_RUNS = 250_000
CACHE_IDS = 1 << 21
TOGETHER = 48  # characters of the longest runs that are learned together
NONE = (1 << 31) - 1
BATCH_BYTES = 2 << 20
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """A merge-type model with byte fallback, an identity normaliser and a space put in front."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        if any(lib.is_unused(i) for i in range(n)) or not any(lib.is_byte(i) for i in range(n)):
            raise ValueError("only models with byte pieces and without unused pieces are supported")
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.pieces = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.split = not any(a != SPACE and b == SPACE for p in self.pieces for a, b in zip(p, p[1:]))
        self.check = check
        self._forget()
        self._tables()

    def _forget(self) -> None:
        """The cache: a number for every known run, and its ids in one long array."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.begins, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.arena, self.used = np.zeros(1 << 18, np.int32), 0

    def _store(self, runs: list[str], ids: np.ndarray) -> None:
        """Remember runs with equally many ids, given as a matrix."""
        first, n = len(self.known), len(runs)
        while first + n > len(self.begins):
            self.begins, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begins, self.sizes))
        while self.used + ids.size > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.known.update(zip(runs, range(first, first + n)))
        self.chars += sum(map(len, runs))
        self.begins[first:first + n] = self.used + np.arange(n) * ids.shape[1]
        self.sizes[first:first + n] = ids.shape[1]
        self.arena[self.used:self.used + ids.size] = ids.ravel()
        self.used += ids.size

    def _gather(self, runs, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n known runs one after the other, and how many each has."""
        numbers = np.fromiter(map(self.known.__getitem__, runs), np.int64, n)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.arena[np.repeat(self.begins[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if n else 0)], sizes

    def _tables(self) -> None:
        """Symbols are the pieces and the characters in them; pairs map (left, right) to the rank of their union."""
        scores = {p: self.library.get_score(i) for p, i in self.pieces.items() if len(p) > 1}
        places = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in scores.items()}  # 0 for the best score, pieces of equal score share one
        one_byte = [chr(b) for b in range(128)]
        self.symbols = list(dict.fromkeys([*self.pieces, *(c for p in self.pieces for c in p), *one_byte]))
        number = {s: i for i, s in enumerate(self.symbols)}
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        pairs = sorted(
            (number[p[:k]] * len(number) + number[p[k:]], self.rank[p])
            for p in self.rank for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        # a character of one byte that is no piece is spelled by one byte piece
        spelled = {c: self.byte_ids[ord(c)] for c in one_byte} | self.pieces
        self.ids = np.array([spelled.get(s, -1) for s in self.symbols] + [-1], np.int32)
        of_rank: dict[int, list[int]] = {}
        for p, r in self.rank.items():
            of_rank.setdefault(r, []).append(number[p])
        # pieces that share a rank are told apart by their text
        self.union = np.array([some[0] if len(some) == 1 else -1 for _, some in sorted(of_rank.items())], np.int32)
        self.number = number

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the union of each pair of symbols; NONE where it is not a piece."""
        keys = np.where((left < 0) | (right < 0), -1, left * np.int64(len(self.symbols)) + right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def together(self, runs: list[str]) -> None:
        """Learn runs of one length. A row of `ranks` is the agenda of a run."""
        chars = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(len(runs), -1)
        symbols, rows = self.of_char[chars], np.arange(len(runs))
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while True:
            width = symbols.shape[1] - 1
            best = ranks.argmin(axis=1) if width else np.zeros(len(rows), np.int64)
            lowest = ranks[np.arange(len(rows)), best] if width else np.full(len(rows), NONE)
            ended = lowest == NONE
            if ended.any():
                self._spell(runs, rows[ended], symbols[ended])
                left = ~ended
                rows, symbols, ranks, best, lowest = rows[left], symbols[left], ranks[left], best[left], lowest[left]
            if not len(rows):
                return
            each = np.arange(len(rows))
            merged = self.union[lowest]
            for i in np.flatnonzero(merged < 0).tolist():
                pair = symbols[i, best[i]:best[i] + 2]
                merged[i] = self.number["".join(self.symbols[s] for s in pair)]
            # every row loses the right symbol of its best pair, and that pair's place on its agenda
            kept = np.ones(symbols.shape, bool)
            kept[each, best + 1] = False
            symbols = symbols[kept].reshape(len(rows), width)
            symbols[each, best] = merged
            kept = np.ones(ranks.shape, bool)
            kept[each, best] = False
            ranks = ranks[kept].reshape(len(rows), width - 1)
            for at, fits in ((best - 1, best > 0), (best, best < width - 1)):
                r, p = each[fits], at[fits]
                ranks[r, p] = self._ranks(symbols[r, p], symbols[r, p + 1])

    def _spell(self, runs: list[str], rows: np.ndarray, symbols: np.ndarray) -> None:
        ids = self.ids[symbols]
        plain = (ids >= 0).all(axis=1)
        self._store([runs[r] for r in rows[plain].tolist()], ids[plain])
        for row, found in zip(rows[~plain].tolist(), symbols[~plain].tolist()):
            spelled, at = [], 0
            for s in found:
                size = len(self.symbols[s]) if s >= 0 else 1
                spelled += self._piece_or_bytes(runs[row][at:at + size])
                at += size
            self._store([runs[row]], np.array([spelled], np.int32))

    def _piece_or_bytes(self, symbol: str) -> list[int]:
        i = self.pieces.get(symbol)
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "replace")] if i is None else [i]

    def alone(self, run: str) -> None:
        """Learn one run of any length; entries of the agenda whose symbols have changed since are skipped."""
        rank, size = self.rank, len(run)
        symbols: list[str] = list(run)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [(rank[run[i:i + 2]], i, i + 1, 2) for i in range(size - 1) if run[i:i + 2] in rank]
        heapq.heapify(agenda)

        def offer(left: int, right: int) -> None:
            union = symbols[left] + symbols[right]
            if union in rank:
                heapq.heappush(agenda, (rank[union], left, right, len(union)))

        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left], symbols[right] = symbols[left] + symbols[right], ""
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        self._store([run], np.array([[*chain.from_iterable(self._piece_or_bytes(s) for s in symbols if s)]], np.int32))

    def checked(self, runs: list[str]) -> None:
        """Raise if the library encodes one of the runs, each with its space symbol in front, in another way."""
        runs = [r for r in runs if len(r) > 1]  # the library makes nothing of an empty text
        others = self.library.encode([r[1:].replace(SPACE, " ") for r in runs], num_threads=1)
        own, sizes = self._gather(runs, len(runs))
        if [*map(len, others)] == sizes.tolist() and np.array_equal(own, np.fromiter(chain.from_iterable(others), np.int32, len(own))):
            return
        for run, at, size, other in zip(runs, np.cumsum(sizes) - sizes, sizes, others):
            if own[at:at + size].tolist() != other:
                raise ValueError(f"the library encodes {run[:100]!r} as {other[:50]}, the agenda as {own[at:at + size][:50]}")

    def learn(self, runs: set[str]) -> None:
        """Put new runs into the cache, checked."""
        by_length: dict[int, list[str]] = {}
        for run in runs:
            by_length.setdefault(len(run), []).append(run)
        for length, some in by_length.items():
            if length <= TOGETHER:
                self.together(some)
            else:
                for run in some:
                    self.alone(run)
            if self.check:
                self.checked(some)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, each between the begin and the end id, and where each text begins and the last ends."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        runs = [RUN.findall(t) if self.split else [t] * bool(t) for t in spaced]
        if len(self.known) > CACHE_RUNS or self.used > CACHE_IDS or self.chars > CACHE_CHARS:
            self._forget()
        self.learn(set().union(*runs).difference(self.known))
        counts = np.array([len(r) for r in runs])
        ids, sizes = self._gather(chain.from_iterable(runs), int(counts.sum()))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        offsets = np.append(0, ends + 2 * np.arange(1, len(texts) + 1))
        out, inner = np.empty(offsets[-1], np.int32), np.ones(offsets[-1], bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        out[offsets[:-1]], out[offsets[1:] - 1], out[inner] = self.bos, self.eos, ids
        return out, offsets

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        ids, offsets = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


_loaded: dict[tuple[str, bool], PieceModel] = {}


@contextmanager
def borrowed(path: str, check: bool = True) -> Iterator[PieceModel]:
    """The model of a worker process for one partition; workers are reused, so only the model stays, not what it learned."""
    if (path, check) not in _loaded:
        _loaded[path, check] = PieceModel(path, check)
    pieces = _loaded[path, check]
    try:
        yield pieces
    finally:
        pieces._forget()
        give_back()


@cache
def library(path: str):
    """The library's processor of a worker process; enough for decoding."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(df: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """The kept columns (all by default) and `ids array<int>`, begin and end ids included."""
    df = df.drop("ids")
    keep = df.columns if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(model, check) as pieces:
            for batch in sliced(batches, text, BATCH_BYTES):
                ids, offsets = pieces.encode_flat(texts_of(batch, text))
                ids = pa.ListArray.from_arrays(offsets.astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], [*keep, "ids"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and `decoded string`, as the library's decode gives it; null ids give ''."""
    df = df.drop("decoded")
    keep = df.columns if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = library(model).decode
        for part in _parts(batches):
            texts = [decode(i or []) for i in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])

    return df.mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def round_trip_digest(df: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """The columns of the contract: encoded, then decoded from those ids; `with_ids` adds the ids themselves.

    One Python worker does both, with one model: a second one after it would hold as much memory again.
    """
    schema = T.StructType([
        df.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(model) as pieces:
            decode = pieces.library.decode
            for batch in sliced(batches, "text", BATCH_BYTES):
                ids, offsets = pieces.encode_flat(texts_of(batch))
                own, texts = [], []
                for a, b in zip(offsets, offsets[1:]):
                    own.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(decode(ids[a:b].tolist()).encode("utf-8", "replace")).hexdigest())
                column = [pa.ListArray.from_arrays(offsets.astype(np.int32), ids)] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)),
                     pa.array(own, pa.string()), pa.array(texts, pa.string()), *column], schema.names)

    return df.select("doc_id", "text").mapInArrow(run, schema)
