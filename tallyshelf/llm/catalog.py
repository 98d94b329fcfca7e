"""The registered queries of this subpackage, each over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import bitsliced, chat, mil, mixing, passages, periodic, pieces, pii, prefix_trie, quality_rules, secrets, simhash, url_templates
from tallyshelf.llm.common import Query, Run
from tallyshelf.sources.star import table

LLM_CATALOG: dict[str, Query] = {}
PIECE_MODEL = "piece_bpe_32k.model"
MIX_WEIGHTS = {"clean": 0.85, "low": 0.1, "toxic": 0.05}


def register(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        LLM_CATALOG[name] = Query(run, sql)
        return run

    return add


def piece_model() -> str:
    """Where the public vocabulary lies on this machine; executors need it at the same path."""
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@register("op1_pii", pii.sql())
def _pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, folder, "documents").select("doc_id", "text")))


@register("op2_secrets", secrets.sql())
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_digest(table(spark, folder, "documents"))


@register("op3_sentencepiece")
def _sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip_digest(table(spark, folder, "documents"), piece_model())


@register("op4_quality_rules")
def _quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op5_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@register("op6_suffix_array")
def _suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeats(table(spark, folder, "documents"))


@register("op7_topk", bitsliced.SQL)
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = bitsliced.quantised(table(spark, folder, "embeddings"))
    return bitsliced.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@register("op8_mixing")
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text"), labelled, MIX_WEIGHTS, "clean", keep=["doc_id"])
    posteriors = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_words", *posteriors, "rate", "copies")


@register("op9_quality_classifier")
def _quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return mil.score_all(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op10_chat", chat.sql())
def _chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)], rows.schema)
    return chat.read_back(chat.format_chat(rows.union(planted)))


@register("op11_url_filters", url_templates.sql())
def _url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, folder, "pages"))


@register("op12_prefix_trie", prefix_trie.SQL)
def _prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    paths = prefix_trie.with_family_heads(prefix_trie.paths_of(table(spark, folder, "conversations")))
    return prefix_trie.trie_digest(prefix_trie.trie_nodes(paths))


@register("op13_periodic_runs")
def _periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digest(periodic.find_runs(periodic.planted(table(spark, folder, "documents"))))
