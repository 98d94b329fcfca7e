"""The registered queries against their SQL, and the pipeline against its own rules."""

import glob
import os

import corpus_pipeline
import duckdb
import pytest
import sentencepiece
from check_oracles import compare
from helpers import documents, odd_rows, prose

from tallyshelf.llm import mil, simhash
from tallyshelf.llm.catalog import LLM_CATALOG, piece_model

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", LLM_CATALOG)
def test_query(spark, con, data, name):
    verdict, n, _ = compare(spark, con, name, data)
    assert verdict in ("match", "rows only") and n > 0


def test_stage_order():
    words = ["classifier", "SimHash", "secret", "mixing", "SentencePiece"]
    assert all(w in name for w, (name, _) in zip(words, corpus_pipeline.STAGES)) and len(corpus_pipeline.STAGES) == 5


def test_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = {r["doc_id"]: r["score"] for r in mil.classify(docs, mil.fit(docs, labels)).collect()}
    one = corpus_pipeline.keep_quality(spark, docs, data)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {i for i, s in scored.items() if s >= mil.THRESHOLD}
    two = corpus_pipeline.drop_near_copies(spark, docs, data)
    groups = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in two.collect()} == {r["component_id"] for r in groups} and two.count() == len({r["component_id"] for r in groups})
    three = corpus_pipeline.hide_secrets(spark, docs, data)
    assert three.columns == docs.columns and three.count() == docs.count()
    assert three.where("n_chars <> length(text)").count() == 0
    four = corpus_pipeline.mix_to_target(spark, docs, data)
    assert four.columns == docs.columns
    clean = labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id").select("doc_id")
    assert clean.join(four, "doc_id", "left_anti").count() == 0
    five = corpus_pipeline.to_tokens(spark, docs, data)
    assert five.count() == docs.count() and five.where("size(ids) <> n_tokens").count() == 0


def test_run_is_the_stages_in_turn(spark, data):
    """Each stage on what its predecessor kept, held against the plain meaning of the stage, and the last against run()."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    first = corpus_pipeline.keep_quality(spark, docs, data).persist()
    kept = {r["doc_id"] for r in first.collect()}
    assert kept < set(held)
    second = corpus_pipeline.drop_near_copies(spark, first, data).persist()
    prints = {i: simhash.fingerprint(held[i]) for i in kept}
    alone = set()
    left = sorted(kept)
    while left:  # the component of the smallest id left
        group, edge = {left[0]}, [left[0]]
        while edge:
            near = {j for j in left if j not in group and bin(prints[j] ^ prints[edge[-1]]).count("1") <= simhash.MOST_BITS}
            edge.pop()
            edge += near
            group |= near
        alone.add(left[0])
        left = [j for j in left if j not in group]
    assert {r["doc_id"] for r in second.collect()} == alone
    third = corpus_pipeline.hide_secrets(spark, second, data).persist()
    texts = {r["doc_id"]: r["text"] or "" for r in third.collect()}
    assert set(texts) == alone and all(("<secret:" in t) == (t != held[i]) for i, t in texts.items())
    fourth = corpus_pipeline.mix_to_target(spark, third, data).collect()
    assert {r["doc_id"] for r in fourth} <= alone
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 AND toxic = 0")
    assert {r["doc_id"] for r in labels.collect()} & alone <= {r["doc_id"] for r in fourth}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    wanted = sorted((r["doc_id"], [model.bos_id(), *model.encode(r["text"] or ""), model.eos_id()]) for r in fourth)
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted((r["doc_id"], r["ids"]) for r in out.collect()) == wanted


def test_odd_rows_pass_every_stage(spark, data):
    df = odd_rows(spark, [prose(100), "token=abcdefghij " + prose(60, 2), None, ""])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, data)
        assert out.columns == df.columns and out.count() <= 2 * df.count()
        assert stage(spark, df.limit(0), data).count() == 0
    assert corpus_pipeline.to_tokens(spark, df, data).count() == df.count()
    assert corpus_pipeline.hide_secrets(spark, documents(spark, ["token=abcdefghij"]), data).first()["text"] == "<secret:assign>"
