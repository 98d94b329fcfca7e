"""Mixing documents to target weights with soft membership.

1. A classifier learned from a bounded sample of a labelled table gives every document the posterior probability
   of each domain (softmax regression over hashed words, corrected for the share of each domain among all labels).
2. Every document gets a nonnegative rate: how often it should be taken. The rates minimise
       1/2 * sum over domains of weight_d * (S_d - T_d)^2 + ridge/2 * sum over documents of share_i * (rate_i - 1)^2
   where S_d is the sum of rate_i * share_i * posterior_id, the expected tokens of domain d, share_i is the
   document's part of all tokens, and T are the wanted totals. weight_d is 1, or LEAST_SHARE / share_d for a domain
   with a smaller part of all tokens, so that the ridge moves no domain by more than about a hundredth of its own
   tokens, however rare it is. This is solved by projected-gradient steps on the rates, all of which start at 1. A step moves
   every rate along its preconditioned gradient and cuts it off at 0,
       rate_i <- max(0, rate_i + length * (1 - posterior_i . multipliers - rate_i)),
   where the few multipliers, one per domain, come from the domains' residuals and a small matrix summed over the
   documents that are free to move; that is Newton's direction among them, and at the minimum it moves nothing.
   Several lengths are tried in one pass over the stored posteriors, and the one with the least objective is taken. A document's
   rate follows from its posteriors and the few steps so far, so no rate is ever collected or stored between them.
   What the ridge leaves of a positive target is then taken up by shifting the target by it (the method of multipliers). A
   target of zero is not chased like that: posteriors are never exactly 0, so it could
   only be met by dropping documents that are almost surely of another domain. `Fit.missed` names the domains whose
   expected tokens are not within `tolerance` of a positive target, or above NEAR_ZERO of what they had for a target
   of zero; `mix` warns of them, and `fit_report` is a table of targets, totals reached and status.
3. `copies` turns a rate into a whole number: its integer part, plus one if the fraction exceeds a hash of the id.

Defined results: null or empty texts have no tokens, no influence on the fit, and the rate their posteriors imply;
repeated rows are documents of their own; rows without an id are rated, and rounded with the hash of null; an
empty documents table gives an empty result; a domain without labelled documents in the table has posterior 0 and
cannot gain tokens;
without any labels every posterior is uniform; further columns pass through, those named like an added one
(n_words, posteriors, rate, copies) are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.llm.common import sliced, texts_of
from tallyshelf.session import stored

BUCKETS = 1 << 18
BEGINNINGS = (4, 5)
FEATURES = 1500
LEAST_DOCUMENTS = 8
CHI_SQUARE = 30.0
DECAY = 1e-5
SAMPLE_PER_DOMAIN = 2500
ROUNDS = 200
STEPS = 30
RIDGE = 1e-3
LEAST_SHARE = 0.1  # rarer domains weigh as much as one with this share: 100 ridges
NEAR_ZERO = 0.02
CENTRES = 8
LENGTHS = 0.5 ** np.arange(8)
CACHE_WORDS = 300_000
EDGES = b".,;:!?()\"'"
DOMAINS = ("clean", "low", "toxic")


def label_domain() -> Column:
    """The domain of a row of `labels`: toxic before low quality, else clean; null without both marks."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


class WordHashes:
    """Buckets of words and of their beginnings, without case and outer punctuation, remembered up to a bound.

    With `telling`, a flag per bucket, only those buckets are returned.
    """

    def __init__(self, telling: np.ndarray | None = None):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.beginnings: dict[bytes, int] = {}
        self.telling = None if telling is None else frozenset(np.flatnonzero(telling).tolist())

    def _bucket(self, part: bytes) -> int:
        """The bucket, or -1 if it tells nothing."""
        bucket = xxhash.xxh3_64_intdigest(part) % BUCKETS
        return bucket if self.telling is None or bucket in self.telling else -1

    def _buckets(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(EDGES)
        found = [self._bucket(bare)]
        for n in BEGINNINGS:
            if len(bare) > n:
                part = bare[:n] + b"*"
                bucket = self.beginnings.get(part)
                if bucket is None:
                    bucket = self.beginnings[part] = self._bucket(part)
                found.append(bucket)
        return tuple(b for b in found if b >= 0)

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """The different buckets of a text, and its number of words."""
        # split() of bytes knows only the blanks x20 and x09 to x0D, lower() only A-Z
        words = text.encode("utf-8", "replace").lower().split()
        known = self.known
        if len(known) > CACHE_WORDS or len(self.beginnings) > CACHE_WORDS:
            known.clear()
            self.beginnings.clear()
        different = set(words)
        for w in different.difference(known):
            known[w] = self._buckets(w)
        found = set(chain.from_iterable(map(known.__getitem__, different)))
        # the share of different words tells repeated text from prose
        found.add(BUCKETS + min(9, 10 * len(different) // max(1, len(words))))
        return np.fromiter(found, np.int64, len(found)), len(words)


@dataclass(frozen=True)
class DomainModel:
    """`places` gives each bucket its row of `weights`; buckets without weight share the last row, which is 0."""

    domains: tuple[str, ...]
    places: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, buckets: np.ndarray) -> np.ndarray:
        raw = self.weights[self.places[buckets]].sum(0) + self.bias
        e = np.exp(raw - raw.max())
        return e / e.sum()


def _telling(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """The buckets that tell the domains apart best, by the chi-square statistic of presence."""
    size = BUCKETS + 10
    present = np.stack([np.bincount(columns[labels[rows] == d], minlength=size) for d in range(k)], 1).astype(float)
    share = np.bincount(labels, minlength=k) / len(labels)
    total = present.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = total[:, None] * share
        chi = np.where(expected > 0, (present - expected) ** 2 / expected, 0).sum(1) / np.maximum(1 - total / len(labels), 0.05)
    chi[total < LEAST_DOCUMENTS] = 0
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > CHI_SQUARE])


def learn(sample: list[np.ndarray], labels: np.ndarray, totals: np.ndarray, domains: tuple[str, ...]) -> DomainModel:
    """Softmax regression by full-batch Adagrad on the telling buckets; `totals` counts each domain among all labels."""
    k = len(domains)
    taken = np.bincount(labels, minlength=k) if len(labels) else np.zeros(k)
    bias, places, chosen = np.zeros(k), np.zeros(BUCKETS + 10, np.int32), np.zeros(0, np.int64)
    if len(labels):
        rows, columns = np.repeat(np.arange(len(sample)), list(map(len, sample))), np.concatenate(sample)
        chosen = _telling(rows, columns, labels, k)
    places[:] = len(chosen)
    places[chosen] = np.arange(len(chosen))
    weights = np.zeros((len(chosen) + 1, k))
    if len(labels):
        some = places[columns] < len(chosen)
        rows, columns = rows[some], places[columns[some]]
        goal = np.eye(k)[labels]
        seen, seen_bias = np.full(weights.shape, 1e-8), np.full(k, 1e-8)
        for _ in range(ROUNDS):
            raw = np.stack([np.bincount(rows, weights=weights[columns, d], minlength=len(sample)) for d in range(k)], 1) + bias
            e = np.exp(raw - raw.max(1, keepdims=True))
            error = (e / e.sum(1, keepdims=True) - goal) / len(sample)
            g = np.stack([np.bincount(columns, weights=error[rows, d], minlength=len(weights)) for d in range(k)], 1) + DECAY * weights
            seen += g * g
            weights -= 0.3 * g / np.sqrt(seen)
            gb = error.sum(0)
            seen_bias += gb * gb
            bias -= 0.3 * gb / np.sqrt(seen_bias)
        weights[-1] = 0
    with np.errstate(divide="ignore"):
        prior = np.where(taken > 0, np.log(totals) - np.log(np.maximum(taken, 1)), -np.inf) if taken.sum() else np.zeros(k)
    return DomainModel(domains, places, weights, bias + prior)


def fit_domains(documents: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS,
                per_domain: int = SAMPLE_PER_DOMAIN) -> DomainModel:
    """`labelled` has doc_id and domain; at most `per_domain` documents of each domain are read for learning."""
    known = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    # only labels of documents that are here: their shares are the prior, and a domain that is gone must get none
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain) for d in domains]
    sample = picked[0]
    for more in picked[1:]:
        sample = sample.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            found = [hashes.of(t)[0] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("domain"), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())],
                ["doc_id", "domain", "buckets"])

    kind = known.schema["doc_id"].dataType.simpleString()
    # bounded by per_domain rows for each domain
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInArrow(run, f"doc_id {kind}, domain string, buckets binary").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    labels = np.array([domains.index(r["domain"]) for r in rows], np.int64)
    features = [np.sort(np.frombuffer(r["buckets"], np.int32)).astype(np.int64) for r in rows]
    return learn(features, labels, np.array([counts.get(d, 0) for d in domains], float), domains)


def with_posteriors(df: DataFrame, model: DomainModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), `n_words` and `posteriors array<double>` in the order of the domains."""
    df = df.drop("n_words", "posteriors")
    keep = df.columns if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("posteriors", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(model.places < len(model.weights) - 1)
        for batch in sliced(batches, text):
            found = [hashes.of(t) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([n for _, n in found], pa.int64()),
                 pa.array([model.posteriors(b).tolist() for b, _ in found], pa.list_(pa.float64()))],
                [*keep, "n_words", "posteriors"])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Fit:
    """The steps (length, multipliers) from which any document's rate follows, and how far the targets are met."""

    steps: tuple[tuple[float, tuple[float, ...]], ...]
    expected: tuple[float, ...]
    target: tuple[float, ...]
    missed: tuple[str, ...] = ()

    def walk(self, posteriors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps, and which of them are free to move."""
        rate, free = np.ones(len(posteriors)), np.ones(len(posteriors), bool)
        # a step of full length forgets those before it
        full = max((i for i, (length, _) in enumerate(self.steps) if length == 1), default=0)
        for length, multipliers in self.steps[full:]:
            rate, free = _moved(rate, 1 - posteriors @ np.array(multipliers), length)
        return rate, free


def _moved(rate: np.ndarray, aim: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    moved = np.maximum(0.0, rate + length * (aim - rate))
    return moved, (moved > 0) | (aim > 0)


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("posteriors").flatten().to_numpy().reshape(-1, k)


def _totals(rated: DataFrame, terms, k: int) -> np.ndarray:
    """The sum over all rows of the vectors that `terms(n_words, posteriors)` gives as rows of a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = terms(batch.column("n_words").to_numpy().astype(float), _matrix(batch, k)).sum(0)
            held = found if held is None else held + found
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], ["i", "v"])

    sums = rated.select("n_words", "posteriors").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([v for _, v in sorted((r["i"], r["v"]) for r in sums.collect())])


def fit_rates(rated: DataFrame, weights: dict[str, float], held: str, domains: tuple[str, ...] = DOMAINS, steps: int = STEPS,
              ridge: float = RIDGE, tolerance: float = 1e-3) -> Fit:
    """Projected-gradient steps on the rates over stored posteriors, one pass over them per step.

    `weights` are the wanted proportions of the domains' tokens; the domain `held` keeps the total that it has.
    Every minimum is searched until a step improves nothing, `steps` steps at most; `tolerance` is relative to a target.
    """
    k = len(domains)
    goal = np.array([weights[d] / weights[held] for d in domains])
    sums = _totals(rated, lambda n, p: np.concatenate([n[:, None], n[:, None] * p], 1), k)
    if not len(sums) or sums[0] == 0:
        return Fit((), (0.0,) * k, tuple(goal.tolist()))
    total, now = sums[0], sums[1:] / sums[0]
    goal = goal * now[domains.index(held)]
    weight = np.maximum(1.0, LEAST_SHARE / np.where(now > 0, now, 1.0))
    pull = ridge / weight
    scale = np.maximum(np.maximum(now, goal), np.finfo(float).tiny)
    taken: list[tuple[float, tuple[float, ...]]] = []

    def tried(multipliers: np.ndarray, lengths) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """After a further step of each length: the ridge's sum, the domains' totals, those of the free rows at rate 1, their matrix."""
        so_far = Fit(tuple(taken), (), ())

        def terms(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            out, before, aim = [], so_far.walk(p)[0], 1 - p @ multipliers
            for length in lengths:
                rate, free = _moved(before, aim, length)
                out.append(np.concatenate([[n @ (rate - 1) ** 2], (n * rate) @ p, (n * free) @ p, (p.T @ ((n * free)[:, None] * p)).ravel()]))
            return np.concatenate(out)[None, :]

        parts = (_totals(rated, terms, k) / total).reshape(len(lengths), -1)
        return [(v[0], v[1:1 + k], v[1 + k:1 + 2 * k], v[1 + 2 * k:].reshape(k, k)) for v in parts]

    shift = np.zeros(k)
    state = tried(np.zeros(k), [1.0])[0]
    for _ in range(CENTRES):
        wanted = goal - pull * shift

        def worth(state, wanted=wanted) -> float:
            return float((weight * (state[1] - wanted) ** 2).sum() / 2 + ridge * state[0] / 2)

        for _ in range(steps):
            multipliers = np.linalg.solve(state[3] + np.diag(pull), state[2] - wanted)
            if (np.abs(state[1] - wanted - pull * multipliers) <= 1e-7 * scale).all():
                break
            results = tried(multipliers, LENGTHS)
            best = int(np.argmin([worth(r) for r in results]))
            if worth(results[best]) >= worth(state):  # as far as numbers of this precision go
                break
            state = results[best]
            taken.append((float(LENGTHS[best]), tuple(multipliers.tolist())))
        off = np.abs(state[1] - goal) > tolerance * goal
        open_ = off & (goal > 0) & (now > 0)
        if not open_.any():
            break
        shift = np.where(open_, multipliers, shift)
    found = state[1]
    missed = np.where(goal > 0, off, found > NEAR_ZERO * now)
    return Fit(tuple(taken), tuple(found.tolist()), tuple(goal.tolist()), tuple(d for d, m in zip(domains, missed) if m))


def fit_report(spark: SparkSession, fit: Fit, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """(domain, target, expected, status): parts of all tokens, and whether a target is reached."""
    rows = [(d, t, e, "missed" if d in fit.missed else "reached") for d, t, e in zip(domains, fit.target, fit.expected)]
    return spark.createDataFrame(rows, "domain string, target double, expected double, status string")


def with_rates(rated: DataFrame, fit: Fit) -> DataFrame:
    """The rows with their `rate`."""
    k = len(fit.target)
    schema = T.StructType([*rated.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = fit.walk(_matrix(batch, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], schema.names)

    return rated.mapInArrow(run, schema)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row whose mean over all ids is its rate; the same id always gets the same number."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("int")


def nearest_copies(rate: Column) -> Column:
    """The rate rounded to the nearest whole number, halves up: nothing is dropped by chance."""
    return F.floor(rate + 0.5).cast("int")


def mix_with_fit(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], held: str,
                 domains: tuple[str, ...] = DOMAINS, keep: list[str] | None = None) -> tuple[DataFrame, Fit]:
    """The kept columns with n_words, posteriors, rate and copies, and the fit that gave the rates."""
    model = fit_domains(documents, labelled, domains)
    rated = stored(with_posteriors(documents.drop("rate", "copies"), model, keep=keep))
    fitted = fit_rates(rated.select("n_words", "posteriors"), weights, held, domains)
    return with_rates(rated, fitted).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), fitted


def mix(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], held: str,
        domains: tuple[str, ...] = DOMAINS, keep: list[str] | None = None) -> DataFrame:
    """The table of :func:`mix_with_fit`, with a warning of targets that are not reached."""
    mixed, fitted = mix_with_fit(documents, labelled, weights, held, domains, keep)
    if fitted.missed:
        figures = ", ".join(f"{d} {s:.3g} for {t:.3g}" for d, s, t in zip(domains, fitted.expected, fitted.target) if d in fitted.missed)
        warnings.warn(f"targets not reached, in parts of all tokens: {figures}", stacklevel=2)
    return mixed
