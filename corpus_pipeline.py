"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
under the shared folder and read again as the next one's docs, so a lost executor costs part of one stage. All
stages but the last return the columns they were given.

1. quality classifier: rows that score below the threshold go. Learned from the labels in `sf_dir`.
2. near-duplicates: the smallest id of each group of near copies stays; rows without an id stay.
3. secrets: each secret is replaced by its kind, no row goes; n_chars follows the text.
4. mixing: document rates that keep the tokens of clean text and bring those of low-quality and toxic text to zero;
   a row is repeated as often as its rate, rounded to the nearest whole number, says. No clean row goes by chance.
5. SentencePiece: the ids of every text and the check values of the round trip.

Null and empty texts pass through every stage as empty texts: the classifier scores them as such, they are near
copies of each other and of nothing else, hold no secret, and encode to the begin and end ids. An empty table gives
an empty result. Columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import mil, mixing, pieces, secrets, simhash
from tallyshelf.llm.catalog import piece_model
from tallyshelf.llm.common import Query
from tallyshelf.session import ship_package, stored
from tallyshelf.sources.star import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
WEIGHTS = {"clean": 1.0, "low": 0.0, "toxic": 0.0}
ADDED = ("n_words", "posteriors", "rate", "copies", "_copy")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mil.accepted(docs, mil.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    hidden = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return hidden
    kind = docs.schema["n_chars"].dataType
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix_to_target(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    # columns that the operator would replace are set aside under other names
    clashing = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    renamed = docs.withColumnsRenamed(clashing)
    mixed = mixing.mix(renamed, labelled, WEIGHTS, "clean").withColumn("copies", mixing.nearest_copies(F.col("rate")))
    repeated = mixed.withColumn("_copy", F.explode(F.expr("array_repeat(0, copies)")))
    return repeated.select(renamed.columns).withColumnsRenamed({new: old for old, new in clashing.items()})


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pieces.round_trip_digest(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing to target weights", mix_to_target),
    ("SentencePiece encoding and decoding", to_tokens),
]

# A learned classifier and a tokenizer cannot be said in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERY = Query(run, ORACLE_SQL)
