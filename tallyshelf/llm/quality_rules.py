"""Quality rules: shape counts of each text, and a hashed n-gram log-likelihood ratio.

Single words and neighbouring pairs are hashed into a fixed number of buckets. Two multinomials over the buckets
are estimated, one from all documents and one from the trusted ones among them, both counted completely; each task
holds one small array. The trusted ids are stored and dealt by id with the documents, of which only the buckets go
along, packed into about a byte an n-gram: the texts are never shuffled. A text's score is the sum over its n-grams of
log(trusted / raw), divided by their number; it is kept if it passes the shape rules and scores at least the cut. The
cut comes from all trusted documents that pass the shape rules: it is the largest multiple of CELL below which at most
one in ONE_IN of them scores. For that, each is scored without its own n-grams in the trusted counts, since otherwise
it would score higher than an equally good document without a label. The scores are counted per cell by one aggregate;
their table is stored, so that no text is read again for the verdict.

Defined results: a null or empty text has no words, fails the shape rules and scores 0; repeated rows count as
often as they occur; a document is trusted if any of its label rows is; rows without an id are judged but never
trusted; an empty documents table gives an empty result; without a trusted document every score is 0, and
without one that passes the shape rules there is no cut, so these alone decide; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import sliced, texts_of
from tallyshelf.session import stored

BUCKETS = 1 << 14
SMOOTHING = 1.0
CELL = 1e-4
ONE_IN = 1000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 300_000


class Hashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    known[w] = h
            out[i] = h
        return out


def numbered(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Each word as the number of its first occurrence among the different words, and these."""
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return codes, list(number)


def repeated_words(codes: np.ndarray, different: int, window: int = 3) -> int:
    """How many words lie in a window that occurs twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    keys, size = codes[:n], different
    for k in range(1, window):
        if size * different >= 1 << 62:  # keep the keys small: number them anew
            _, keys = np.unique(keys, return_inverse=True)
            size = int(keys.max()) + 1
        keys, size = keys * different + codes[k:n + k], size * different
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(window):
        covered[twice + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


def ngram_buckets(codes: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of every word and of every pair of neighbours."""
    words = hashes[codes]
    with np.errstate(over="ignore"):
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] + (words[1:] >> np.uint64(31)))
        pairs ^= pairs >> np.uint64(29)
    return np.concatenate([words, pairs]) % np.uint64(buckets)


def bucket_steps(found: np.ndarray, buckets: int) -> bytes:
    """Sorted buckets as the steps between them, byte by byte of all steps.

    Most steps fit in their lowest byte; the zeros of the others are next to each other, so that the shuffle compresses them away.
    """
    steps = np.diff(np.sort(found.astype(np.min_scalar_type(buckets - 1))), prepend=0).astype(np.min_scalar_type(buckets - 1))
    return steps.view(np.uint8).reshape(len(steps), -1).T.tobytes()


def buckets_of(steps: bytes, buckets: int) -> np.ndarray:
    """The sorted buckets that `bucket_steps` wrote."""
    kind = np.min_scalar_type(buckets - 1)
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel(), dtype=np.int64)


def text_ngrams(df: DataFrame, text: str, keep: str, buckets: int = BUCKETS) -> DataFrame:
    """(keep, ngrams): the buckets of each text's n-grams, null for a text without words."""
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in sliced(batches, text):
            out = []
            for t in texts_of(batch, text):
                codes, different = numbered(WORD.findall(t))
                out.append(bucket_steps(ngram_buckets(codes, hashes.of(different), buckets), buckets) if len(codes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(out, pa.binary())], [keep, "ngrams"])

    return df.select(keep, text).mapInArrow(run, f"{keep} {kind}, ngrams binary")


def sum_ngrams(found: DataFrame, trusted: str = "trusted", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted): counts over all rows of `text_ngrams` and over those flagged as trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in sliced(batches, "ngrams"):
            parts: tuple[list, list] = ([], [])
            for steps, flag in zip(batch.column("ngrams").to_pylist(), batch.column(trusted).to_pylist()):
                if steps is not None:
                    parts[bool(flag)].append(buckets_of(steps, buckets))
            for flag, some in enumerate(parts):
                if some:
                    n = np.bincount(np.concatenate(some), minlength=buckets)
                    counts[0] += n
                    counts[1] += flag * n
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "raw", "trusted"])

    counted = found.select("ngrams", trusted).mapInArrow(run, "bucket bigint, raw bigint, trusted bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def count_ngrams(df: DataFrame, text: str = "text", trusted: str = "trusted", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted): counts over all rows and over the rows flagged as trusted."""
    return sum_ngrams(text_ngrams(df, text, trusted, buckets), trusted, buckets)


def bucket_counts(counts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The raw and the trusted count per bucket; the table has one row per bucket at most."""
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    return raw, trusted


def log_ratios(raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(trusted / raw) per bucket, smoothed."""
    if not trusted.sum():
        return np.zeros(len(raw))
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return share(trusted) - share(raw)


def untrusted_score(found: np.ndarray, raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> float:
    """The score of a trusted text with these n-grams if only the others were trusted."""
    others = np.maximum(trusted[found] - np.bincount(found, minlength=len(raw))[found], 0)
    share = np.log(others + smoothing).mean() - math.log(max(trusted.sum() - len(found), 0) + smoothing * len(raw))
    return float(share - np.log((raw[found] + smoothing) / (raw.sum() + smoothing * len(raw))).mean())


RESULT = ("doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, score double")


def judge(df: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = -math.inf,
          counts: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The counts, the score and the verdict of every document; with `counts`, also its `untrusted_score`."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in sliced(batches, text):
            rows = []
            for t in texts_of(batch, text):
                words = WORD.findall(t)
                codes, different = numbered(words)
                n = len(words)
                repeated = repeated_words(codes, len(different))
                found = ngram_buckets(codes, hashes.of(different), len(ratios)).astype(np.int64) if n else None
                score = float(ratios[found].mean()) if n else 0.0
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
                rows.append((n, sum(map(len, words)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeated, failed,
                             not failed and score >= threshold, score, untrusted_score(found, *counts) if n and counts else score))
            columns = list(zip(*rows))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, types)]][:len(names)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    names += ["untrusted_score"] if counts else []
    return df.select("doc_id", text).mapInArrow(run, RESULT.format(id=kind) + (", untrusted_score double" if counts else ""))


def cut(scores: DataFrame, score: str = "untrusted_score") -> float:
    """The largest multiple of CELL below which at most one in ONE_IN of the rows lies; there are few cells, however many rows."""
    cells = scores.groupBy(F.floor(F.col(score) / CELL).alias("cell")).agg(F.count("*").alias("n")).collect()
    left = sum(r["n"] for r in cells) // ONE_IN
    for cell, n in sorted((r["cell"], r["n"]) for r in cells):
        if n > left:
            return cell * CELL
        left -= n
    return -math.inf


def apply_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge all documents; those labelled with quality 1 are the trusted target."""
    good = stored(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    # the hint: one way for every size, so that the cost follows the input
    marked = text_ngrams(documents, "text", "doc_id").join(good.withColumn("trusted", F.lit(True)).hint("merge"), "doc_id", "left")
    counts = bucket_counts(sum_ngrams(marked))
    judged = stored(judge(documents, log_ratios(*counts), counts=counts))
    least = cut(judged.where(~F.col("base_failed")).join(good, "doc_id"))
    return judged.drop("untrusted_score").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
