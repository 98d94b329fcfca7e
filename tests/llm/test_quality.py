"""Quality rules and the passage classifier."""

import re
import math
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, odd_rows, prose

from tallyshelf.llm import mil, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered))


def corpus():
    clean = [prose(80 + i % 30, i) for i in range(120)]
    junk = [" | ".join(prose(70, 1000 + i).split()) for i in range(40)]
    return clean, junk


def labels(spark, n_clean, n_junk):
    rows = [(i, 1, 0) for i in range(n_clean)] + [(n_clean + i, 0, 0) for i in range(n_junk)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts(spark):
    texts = ["a b c a b c\nx\nx\n\n x", "| # $ <>&*%", "a b c\x85d", "l\r\nl\r\nl", prose(60) + " " + prose(60), *[t for t in AWKWARD if t is None or len(t) < 4000]]
    rows = quality_rules.judge(documents(spark, texts), np.zeros(64)).collect()
    for r in rows:
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_repeated_windows_with_large_numbers():
    codes = np.array([1 << 40, 5, 6, 1 << 40, 5, 6, 7])
    assert quality_rules.repeated_words(codes, (1 << 40) + 1) == 6


def test_ratio_separates_and_counts_everything(spark):
    clean, junk = corpus()
    docs = documents(spark, clean + junk)
    trusted = labels(spark, 100, 0).union(labels(spark, 100, 0))  # repeated labels count once
    rows = quality_rules.apply_rules(docs, trusted).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 160))
    flagged = docs.selectExpr("text", "doc_id < 100 AS trusted")
    counts = quality_rules.count_ngrams(flagged).collect()
    n = sum(2 * len(t.split()) - 1 for t in clean + junk)
    assert sum(r["raw"] for r in counts) == n
    assert sum(r["trusted"] for r in counts) == sum(2 * len(t.split()) - 1 for t in clean[:100])
    # brute force for one text
    raw, good = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    p = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    codes, different = quality_rules.numbered(clean[3].split())
    want = np.mean([p[int(b)] for b in quality_rules.ngram_buckets(codes, quality_rules.Hashes().of(different), len(p))])
    assert abs(next(r["score"] for r in rows if r["doc_id"] == 3) - want) < 1e-9


def test_the_cut_follows_the_trusted_documents(spark):
    clean = [prose(80 + i % 30, i) for i in range(300)]
    # two words in 90 are junk: mild enough for a loose constant cut
    mild = [" ".join(w if k % 45 else "|" for k, w in enumerate(prose(90, 2000 + i).split())) for i in range(10)]
    docs = documents(spark, clean + mild)
    marks = labels(spark, 290, 0)
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, marks).collect()}
    assert all(-0.12 < rows[i]["score"] for i in range(300, 310)) and not any(rows[i]["kept"] for i in range(300, 310))
    assert sum(rows[i]["kept"] for i in range(300)) >= 298
    # brute force: the least score of the trusted ones if each were not trusted, since one in 1000 of 290 is none
    counts = quality_rules.bucket_counts(quality_rules.count_ngrams(docs.selectExpr("text", "doc_id < 290 AS trusted")))
    hashes, least = quality_rules.Hashes(), []
    for i in range(290):
        codes, different = quality_rules.numbered(clean[i].split())
        found = quality_rules.ngram_buckets(codes, hashes.of(different), quality_rules.BUCKETS).astype(np.int64)
        others = counts[1] - np.bincount(found, minlength=quality_rules.BUCKETS)
        least.append(quality_rules.log_ratios(counts[0], others)[found].mean())
    cut = quality_rules.CELL * np.floor(min(least) / quality_rules.CELL)
    assert {i for i, r in rows.items() if r["kept"]} == {i for i, r in rows.items() if not r["base_failed"] and r["score"] >= cut}


def test_every_trusted_document_counts(spark, monkeypatch):
    clean, junk = corpus()
    docs, marks = documents(spark, clean + junk), labels(spark, 100, 0)
    want = sorted(map(tuple, quality_rules.apply_rules(docs, marks).collect()))
    # neither a bound on the trusted documents nor the way of the join changes the result
    monkeypatch.setattr(quality_rules, "TRUSTED_SAMPLE", 20, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, quality_rules.apply_rules(docs, marks).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("buckets", [1 << 8, 1 << 14, 1 << 16, 1 << 20])
def test_buckets_are_packed_and_back(buckets):
    rng = np.random.default_rng(5)
    for n in (1, 2, 700, 40_000):
        found = np.append(rng.integers(0, buckets, n), buckets - 1).astype(np.uint64)
        packed = quality_rules.bucket_steps(found, buckets)
        assert quality_rules.buckets_of(packed, buckets).tolist() == sorted(found.tolist())


def test_no_text_is_shuffled(spark, monkeypatch):
    """The join with the trusted ids deals buckets, and deals them at every size."""
    plans, collected = [], quality_rules.bucket_counts
    monkeypatch.setattr(quality_rules, "bucket_counts", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collected(df))
    clean, junk = corpus()
    quality_rules.apply_rules(documents(spark, clean + junk), labels(spark, 100, 0)).collect()
    joins = [x for x in plans[0].split("\n") if "Join" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    below = plans[0].split("SortMergeJoin", 1)[1]
    assert "text" not in below.split("MapInArrow", 1)[0] and "MapInArrow" in below


def test_a_null_id_counts_but_is_not_trusted(spark):
    texts = [prose(60, i) for i in range(6)]
    df = documents(spark, texts).selectExpr("nullif(doc_id, 5) AS doc_id", "text")
    df = df.union(df.where("doc_id = 0"))
    found = quality_rules.text_ngrams(df, "text", "doc_id")
    marked = found.join(spark.createDataFrame([(0, True), (None, True)], "doc_id long, trusted boolean"), "doc_id", "left")
    counts = quality_rules.sum_ngrams(marked).collect()
    each = [2 * len(t.split()) - 1 for t in texts]
    assert sum(r["raw"] for r in counts) == sum(each) + each[0]
    assert sum(r["trusted"] for r in counts) == 2 * each[0]


def test_the_cut_gives_up_one_in_a_thousand(spark):
    scores = spark.range(5000).selectExpr("(id - 2500) / 1000D + 0.00005D AS untrusted_score")
    assert abs(quality_rules.cut(scores) + 2.495) < 1e-9
    assert quality_rules.cut(scores.limit(0)) == -np.inf


def test_rules_on_odd_rows_and_empty_tables(spark):
    df = odd_rows(spark, [prose(80), None])
    none = labels(spark, 0, 0)
    rows = quality_rules.apply_rules(df, none).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.0} and sum(r["kept"] for r in rows) == 3
    assert quality_rules.apply_rules(df.limit(0), none).collect() == []


def test_gradients():
    rng = np.random.default_rng(3)
    bags = [rng.random((n, mil.WIDTH)).astype(np.float32) for n in (1, 4, 2)]
    y = np.array([1, 0, 1], np.float32)
    shapes = {"W": (mil.WIDTH, 5), "b": (5,), "U": (5, 3), "V": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    model = mil.AttentionModel({k: rng.normal(0, 0.5, s) for k, s in shapes.items()}, np.zeros(mil.WIDTH), np.ones(mil.WIDTH))
    every, starts = np.concatenate(bags), np.array([0, 1, 5])

    def loss():
        p = model.forward(every, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(every, starts, y)
    for k, w in model.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - found[k][at]) < 1e-6, k
    attention = model.forward(every, starts)["a"]
    assert np.allclose(np.add.reduceat(attention, starts), 1)


def test_classifier_holds_out_and_learns(spark):
    clean, junk = corpus()
    docs, marks = documents(spark, clean + junk), labels(spark, 120, 40)
    rows = mil.score_all(docs, marks).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] < 120) for r in held]) > 0.95
    # labels of held-out rows change nothing
    flipped = marks.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = {r["doc_id"]: r["score"] for r in mil.score_all(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_scores_bag_by_bag(spark):
    """Every passage through the layers by itself, in plain loops."""
    clean, junk = corpus()
    texts = [*clean[:10], *junk[:10], "", prose(700, 3)]
    model = mil.fit(documents(spark, clean + junk), labels(spark, 120, 40))
    w, encoder = {k: v.astype(float) for k, v in model.weights.items()}, mil.PassageEncoder()
    got = {r["doc_id"]: r["score"] for r in mil.classify(documents(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        hidden, raw = [], []
        for features in encoder.encode(text):
            x = [(f - m) / s for f, m, s in zip(features.tolist(), model.mean.tolist(), model.scale.tolist())]
            h = [math.tanh(sum(a * b for a, b in zip(x, w["W"][:, j])) + w["b"][j]) for j in range(mil.HIDDEN)]
            dot = lambda matrix, j, h=h: sum(a * b for a, b in zip(h, matrix[:, j]))
            raw.append(sum(w["w"][j] * math.tanh(dot(w["V"], j)) / (1 + math.exp(-dot(w["U"], j))) for j in range(mil.GATE)))
            hidden.append(h)
        odds = [math.exp(r - max(raw)) for r in raw]
        z = [sum(o * h[j] for o, h in zip(odds, hidden)) / sum(odds) for j in range(mil.HIDDEN)]
        score = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"])) + w["d"][0])))
        assert got[i] == pytest.approx(score, abs=1e-4)


def test_classifier_edges(spark):
    df = odd_rows(spark, AWKWARD)
    rows = mil.score_all(df, labels(spark, 0, 0)).collect()
    assert len(rows) == len(AWKWARD) + 2 and {r["score"] for r in rows} == {0.5}
    model = mil.fit(*(documents(spark, [prose(90, i) for i in range(20)] + ["# | #"] * 20), labels(spark, 20, 20)))
    scored = mil.classify(df, model)
    assert set(scored.columns) == set(df.columns) and scored.count() == len(AWKWARD) + 2
    assert mil.accepted(df, model, 0.0).columns == df.columns and mil.accepted(df, model, 2.0).count() == 0
    assert mil.classify(df.limit(0), model).collect() == []


def test_every_passage_is_encoded():
    text = prose(1000)
    encoder = mil.PassageEncoder()
    assert len(encoder.encode(text)) == -(-1000 // mil.PASSAGE_WORDS) and len(encoder.encode("")) == 1
    changed = text.rsplit(" ", 1)[0] + " #####"
    assert not np.array_equal(encoder.encode(text)[-1], encoder.encode(changed)[-1])
