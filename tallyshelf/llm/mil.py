"""Quality classifier by attention over passages (multiple-instance learning).

A text is a bag of passages of a fixed number of words, all of them, to its end. Each passage is encoded from the
shape of its words and from hashed word counts, and mapped to a hidden vector by a learned layer. Gated attention,
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted vector gives the score. Only the
labels of whole documents are needed; every layer is learned from them by back-propagation.

Training takes a bounded, documented sample (`SAMPLE_PER_CLASS` rows of each label, in the order of a hash of the
id). Scoring covers every row in one pass without a shuffle.

Defined results: a null or empty text is a bag of one empty passage and gets a score like any other; repeated
rows score alike; rows without an id are never held out and never trained on; labels other than 0 and 1 and rows
without a text to learn from are left out of training; with a class missing, every score is the share of label 1
among the sample (0.5 without any); an empty table gives an empty result; further columns pass through `classify`,
where a column called as the added one (`score` unless named) is replaced, and through `accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.llm.common import sliced, texts_of, trimmed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE_WORDS = 96
HASHED = 96
SHAPES = 12
WIDTH = SHAPES + HASHED
HIDDEN, GATE = 24, 12
SAMPLE_PER_CLASS = 3000
EPOCHS = 12
BATCH = 32
THRESHOLD = 0.3
CACHE_WORDS = 200_000


class PassageEncoder:
    """Features of every passage of a text; what belongs to a single word is remembered up to a bound."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, 8), np.float32)

    def _row(self, word: str) -> int:
        at = len(self.known)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        letters = sum(map(str.isalpha, word))
        self.rows[at] = (
            len(word), letters, sum(map(str.isupper, word)), sum(map(str.isdigit, word)),
            sum(c in "#*$%&|<>=~^_{}[]" for c in word), sum(c in ".,;:!?" for c in word), letters == 0,
            xxhash.xxh3_64_intdigest(word.lower().strip(".,;:!?").encode("utf-8", "replace")) % HASHED)
        self.known[word] = at
        return at

    def encode(self, text: str) -> np.ndarray:
        words = WORD.findall(text) or [""]
        if len(self.known) > CACHE_WORDS:
            self._reset()
        known, row = self.known, self._row
        codes = np.array([known[w] if w in known else row(w) for w in words])
        starts = np.arange(0, len(codes), PASSAGE_WORDS)
        sizes = np.diff(np.append(starts, len(codes))).astype(np.float32)
        of = np.arange(len(codes)) // PASSAGE_WORDS
        rows = self.rows[codes]
        sums = np.add.reduceat(rows[:, :7], starts, axis=0)
        chars = np.maximum(sums[:, 0], 1)
        out = np.zeros((len(starts), WIDTH), np.float32)
        out[:, 0] = sums[:, 0] / sizes / 8
        out[:, 1:6] = sums[:, 1:6] / chars[:, None]
        out[:, 6] = sums[:, 6] / sizes
        different = np.unique(of.astype(np.int64) << 32 | codes) >> 32
        out[:, 7] = np.bincount(different, minlength=len(starts)) / sizes
        same = np.zeros(len(codes), np.float32)
        same[1:] = codes[1:] == codes[:-1]
        out[:, 8] = np.add.reduceat(same, starts) / sizes
        pairs = np.unique(of[1:].astype(np.int64) << 42 | (codes[:-1] << 21 | codes[1:])) >> 42
        out[:, 9] = np.bincount(pairs, minlength=len(starts)) / sizes
        out[:, 10] = np.log1p(sizes) / np.log1p(PASSAGE_WORDS)
        out[:, 11] = np.log1p(len(words)) / 10
        hashed = np.bincount(of * HASHED + rows[:, 7].astype(np.int64), minlength=len(starts) * HASHED).reshape(-1, HASHED)
        out[:, SHAPES:] = np.sqrt(hashed / sizes[:, None])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Weights of the network; `constant` replaces it where there was nothing to learn."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def forward(self, passages: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags that lie one after the other, each beginning at one of `starts`."""
        w = self.weights
        x = (passages - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        gate, value = _sigmoid(h @ w["U"]), np.tanh(h @ w["V"])
        raw = (gate * value) @ w["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "gate": gate, "value": value, "bag": bag, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["p"].astype(np.float64)

    def gradients(self, passages: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, f = self.weights, self.forward(passages, starts)
        dp = (f["p"] - labels) / len(labels)
        dz = dp[:, None] * w["c"]
        h, bag, a = f["h"], f["bag"], f["a"]
        da = (dz[bag] * h).sum(1)
        draw = a * (da - np.add.reduceat(a * da, starts)[bag])
        dh = a[:, None] * dz[bag]
        both = draw[:, None] * w["w"]
        dgate = both * f["value"] * f["gate"] * (1 - f["gate"])
        dvalue = both * f["gate"] * (1 - f["value"] ** 2)
        dh += dgate @ w["U"].T + dvalue @ w["V"].T
        dx = dh * (1 - h ** 2)
        return {"W": f["x"].T @ dx, "b": dx.sum(0), "U": h.T @ dgate, "V": h.T @ dvalue,
                "w": (f["gate"] * f["value"]).T @ draw, "c": f["z"].T @ dp, "d": dp.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> AttentionModel:
    """Adam over the bags of a bounded sample."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "U": (HIDDEN, GATE), "V": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    weights = {k: (rng.normal(0, s[0] ** -0.5, s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    if len(set(labels.tolist())) < 2:
        return AttentionModel(weights, np.zeros(WIDTH), np.ones(WIDTH), float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags)
    model = AttentionModel(weights, every.mean(0), every.std(0) + 0.05)
    first, second, t = {k: 0.0 for k in weights}, {k: 0.0 for k in weights}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            chosen = [bags[i] for i in some]
            starts = np.cumsum([0, *map(len, chosen[:-1])])
            t += 1
            for k, g in model.gradients(np.concatenate(chosen), starts, labels[some]).items():
                g = g + 1e-4 * weights[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                weights[k] -= (0.004 * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_bags(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[np.ndarray], np.ndarray]:
    """Encoded passages and labels of the sample: at most `per_class` documents of each label."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("label"))
    key = F.xxhash64("doc_id")
    picked = [usable.where(F.col("label") == v).orderBy(key, "doc_id").limit(per_class) for v in (0, 1)]
    # bounded by 2 * per_class rows
    sample = F.broadcast(picked[0].unionByName(picked[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in sliced(batches):
            bags = [encoder.encode(t).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    kinds = {f.name: f.dataType.simpleString() for f in usable.schema.fields}
    chosen = documents.select("doc_id", "text").join(sample, "doc_id")
    rows = chosen.mapInArrow(run, f"doc_id {kinds['doc_id']}, label {kinds['label']}, bag binary").toArrow()
    rows = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("label").to_pylist(), rows.column("bag").to_pylist()))
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for _, _, b in rows]
    return bags, np.array([label for _, label, _ in rows], np.float32)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> AttentionModel:
    return train(*training_bags(documents, labels, per_class))


def classify(df: DataFrame, model: AttentionModel, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns (all by default) and the score."""
    df = df.drop(name)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in sliced(batches, text):
            scores = model.score([encoder.encode(t) for t in texts_of(batch, text)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores)], [*keep, name])

    return df.mapInArrow(run, schema)


def accepted(df: DataFrame, model: AttentionModel, at_least: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of `df` that score at least so much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in sliced(batches, text):
            scores = model.score([encoder.encode(t) for t in texts_of(batch, text)])
            yield batch.filter(pa.array(scores >= at_least))

    return df.mapInArrow(lambda batches: trimmed(run(batches)), df.schema)


def score_all(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the contract."""
    scored = classify(documents.select("doc_id", "text"), fit(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
