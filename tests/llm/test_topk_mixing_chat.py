"""Top-k search, mixing and chat formatting."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, documents, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyshelf.llm import bitsliced, chat, mixing

# ------------------------------------------------------------------ top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def slow_top(rows, k=5):
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found_top(spark, rows):
    q = bitsliced.quantised(vectors(spark, rows))
    return sorted(tuple(r) for r in bitsliced.top_k(q, q.where("vec_id % 50 = 0")).collect())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 0.2, 16)).astype(float).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(30)]  # ties beyond k
    want = slow_top(rows)
    assert found_top(spark, rows) == want
    monkeypatch.setattr(bitsliced, "ROW_BLOCK", 64)
    monkeypatch.setattr(bitsliced, "QUERY_BLOCK", 4)
    assert found_top(spark, rows) == want


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, -2.0], 0), (1, [3.0, None], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0),
            (5, [-1.0, 0.5], 0), (6, [1.0], 0), (None, [1.0, 1.0], 0), (50, [0.0, 0.0], 0), (100, [], 0), (7, [0.001, -0.001], 0), (5, [-1.0, 0.5], 0)]
    assert found_top(spark, rows) == slow_top(rows)
    assert found_top(spark, rows[:1]) == [] and found_top(spark, []) == []


def test_top_k_keeps_large_finite_vectors(spark):
    """Components of which some products leave 64 bits in the parts they are summed from, next to small ones."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist(), 0) for i in range(120)]
    for i in (0, 1, 50, 77):
        rows[i] = (i, (rng.normal(0, 1, 8) * 1e5 * 6.0 ** (i % 3)).astype(np.float32).tolist(), 0)
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert found_top(spark, rows) == sorted(want) and {0, 50} <= {q for q, *_ in want}
    with pytest.raises(Exception, match="too large for 64 bits"):
        found_top(spark, [(0, [1e13, 1.0], 0), (1, [1e13, 1.0], 0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=5, max_size=5), min_size=1, max_size=9))
def test_bitmap_sums(numbers):
    grid = np.array(numbers)
    stack = np.stack([np.stack([np.packbits((row >> j & 1).astype(np.uint8), bitorder="little") for j in range(6)]) for row in np.pad(grid, ((0, 0), (0, 59)))])
    total = bitsliced.add_all(np.ascontiguousarray(stack).view(np.uint64).reshape(len(grid), 6, 1))
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << j for j, s in enumerate(total))
    assert got[:5].tolist() == grid.sum(0).tolist()
    every = np.array([31], np.uint64)
    assert bitsliced.kth_best(total, every, 2) == sorted(grid.sum(0))[-2]
    assert bitsliced.positions(bitsliced.at_least(total, every, 30)).tolist() == np.flatnonzero(grid.sum(0) >= 30).tolist()


# ------------------------------------------------------------------ mixing


def labelled_corpus(spark):
    clean = [prose(60, i) for i in range(80)]
    toxic = [prose(50, 100 + i) + " vile filth vile wretch" for i in range(40)]
    low = [" ".join(f"{w}#" for w in prose(60, 200 + i).split()) for i in range(40)]
    docs = documents(spark, clean + toxic + low)
    names = ["clean"] * 80 + ["toxic"] * 40 + ["low"] * 40
    # every other document is labelled
    return docs, spark.createDataFrame([(i, n) for i, n in enumerate(names) if i % 2], "doc_id long, domain string"), names


def test_rates_meet_targets(spark):
    docs, marks, names = labelled_corpus(spark)
    weights = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    rows = mixing.mix(docs, marks, weights, "clean").collect()
    assert len(rows) == len(names)
    for r in rows:
        assert r["rate"] >= 0 and abs(sum(r["posteriors"]) - 1) < 1e-9 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        assert mixing.DOMAINS[int(np.argmax(r["posteriors"]))] == names[r["doc_id"]]
    total = sum(r["n_words"] for r in rows)
    now = np.array([sum(r["n_words"] * r["posteriors"][d] for r in rows) for d in range(3)]) / total
    then = np.array([sum(r["rate"] * r["n_words"] * r["posteriors"][d] for r in rows) for d in range(3)]) / total
    goal = now[0] * np.array([1, 0.2 / 0.7, 0.1 / 0.7])
    assert np.abs(then - goal).max() < 5e-3


def test_rates_against_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(1, 200, 60)
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(60)], "doc_id long, n_words long, posteriors array<double>")
    weights = {"clean": 0.6, "low": 0.4, "toxic": 0.0}
    fit = mixing.fit_rates(df, weights, "clean")
    got = np.array([r["rate"] for r in mixing.with_rates(df, fit).orderBy("doc_id").collect()])
    assert np.allclose(got, fit.walk(p)[0])
    share = n / n.sum()
    goal = (share @ p)[0] * np.array([1, 0.4 / 0.6, 0])
    rates = np.ones(60)
    step = 1 / (np.linalg.eigvalsh(p.T @ (share[:, None] * p))[-1] + mixing.RIDGE)
    for _ in range(20_000):
        rates = np.maximum(0, rates - step * (p @ ((share * rates) @ p - goal) + mixing.RIDGE * (rates - 1)))

    def value(r):
        return 0.5 * (((share * r) @ p - goal) ** 2).sum() + mixing.RIDGE / 2 * (share * (r - 1) ** 2).sum()

    assert (got >= 0).all() and value(got) <= value(rates) + 1e-4


@pytest.mark.parametrize("rare", [60, 20, 3])
def test_rare_domains_reach_their_targets(spark, rare):
    """Shares of 0.3 %, 0.1 % and 0.015 % of all tokens."""
    names = [0] * 19_700 + [1] * 300 + [2] * rare
    hot = np.eye(3).tolist()
    df = spark.createDataFrame([(i, 100, hot[d]) for i, d in enumerate(names)], "doc_id long, n_words long, posteriors array<double>")
    fit = mixing.fit_rates(df, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, "clean")
    copies = mixing.with_rates(df, fit).withColumn("copies", mixing.nearest_copies(F.col("rate")))
    assert {r["doc_id"]: r["copies"] for r in copies.collect()} == {i: int(d == 0) for i, d in enumerate(names)}
    assert fit.missed == ()
    wanted = np.array([0.85, 0.1, 0.05])
    fit = mixing.fit_rates(df, dict(zip(mixing.DOMAINS, wanted.tolist())), "clean")
    got = np.array([r["rate"] for r in mixing.with_rates(df, fit).orderBy("doc_id").collect()])
    totals = np.bincount(names, weights=got)
    assert np.abs(totals / (totals[0] * wanted / wanted[0]) - 1).max() < 2e-3 and fit.missed == ()


def test_targets_out_of_reach_are_reported(spark):
    docs, marks, _ = labelled_corpus(spark)
    present = docs.where("doc_id < 120")  # no low-quality ones, yet some are wanted
    with pytest.warns(UserWarning, match="low 0 for"):
        mixing.mix(present, marks, {"clean": 0.7, "low": 0.2, "toxic": 0.1}, "clean")


def test_the_fit_is_a_table_with_a_status(spark):
    docs, marks, _ = labelled_corpus(spark)
    mixed, fit = mixing.mix_with_fit(docs.where("doc_id < 120"), marks, {"clean": 0.7, "low": 0.2, "toxic": 0.1}, "clean")
    report = {r["domain"]: r for r in mixing.fit_report(spark, fit).collect()}
    assert {d: r["status"] for d, r in report.items()} == {"clean": "reached", "low": "missed", "toxic": "reached"}
    rows = mixed.collect()
    total = sum(r["n_words"] for r in rows)
    for i, d in enumerate(mixing.DOMAINS):
        assert abs(sum(r["rate"] * r["n_words"] * r["posteriors"][i] for r in rows) / total - report[d]["expected"]) < 1e-9


def test_partial_steps_replay_to_the_same_rates():
    p = np.random.default_rng(1).dirichlet([0.5, 0.5, 0.5], 50)
    steps = ((0.5, (2.0, -1.0, 0.5)), (1.0, (0.3, 0.9, -2.0)), (0.25, (1.5, 0.1, 0.0)), (0.5, (4.0, 0.0, 0.0)))
    rate = np.ones(50)
    for length, m in steps:
        rate = np.maximum(0, (1 - length) * rate + length * (1 - p @ np.array(m)))
    assert np.allclose(mixing.Fit(steps, (), ()).walk(p)[0], rate)


def test_posteriors_against_a_plain_softmax(spark):
    docs, marks, _ = labelled_corpus(spark)
    model = mixing.fit_domains(docs, marks)
    got = {r["doc_id"]: r["posteriors"] for r in mixing.with_posteriors(docs, model).collect()}
    for r in docs.collect():
        words = r["text"].lower().split()
        parts = set()
        for w in {w.strip(".,;:!?()\"'") for w in words}:
            parts |= {w, *[w[:n] + "*" for n in mixing.BEGINNINGS if len(w) > n]}
        buckets = {xxhash.xxh3_64_intdigest(x.encode()) % mixing.BUCKETS for x in parts}
        buckets.add(mixing.BUCKETS + min(9, 10 * len(set(words)) // len(words)))
        raw = [sum(model.weights[model.places[b]][d] for b in buckets) + model.bias[d] for d in range(3)]
        odds = [math.exp(x - max(raw)) for x in raw]
        assert got[r["doc_id"]] == pytest.approx([o / sum(odds) for o in odds], abs=1e-9)


def test_labels_of_absent_documents_have_no_say(spark):
    docs, marks, names = labelled_corpus(spark)
    present = docs.where("doc_id < 120")  # the low-quality ones are gone, their labels are not
    rows = mixing.mix(present, marks, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, "clean").collect()
    assert all(r["posteriors"][1] == 0 for r in rows)
    kept = {r["doc_id"] for r in rows if r["rate"] + 0.5 >= 1}
    assert kept == {i for i in range(120) if names[i] == "clean"}


def test_mixing_edges(spark):
    df = odd_rows(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mix(df, none, {"clean": 1.0, "low": 1.0, "toxic": 1.0}, "clean").collect()
    assert len(rows) == len(AWKWARD) + 2
    assert all(abs(x - 1 / 3) < 1e-9 for r in rows for x in r["posteriors"])
    assert mixing.mix(df.limit(0), none, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, "clean").collect() == []


# ------------------------------------------------------------------ chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def slow_digest(rows):
    held = {}
    for c, t, r, x in sorted(rows, key=lambda row: tuple((v is not None, v or 0) if isinstance(v, int) or v is None and i < 2 else (v is not None, v or "") for i, v in enumerate(row))):
        held.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in held.items():
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", None), (1, 2, "assistant", "back\\slash \\. <s></s> é😀"), (2, 1, "user", "b"),
            (2, 0, "assistant", "first"), (3, 0, "tool", "x[/TURN]"), (3, 1, None, ""), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, None, "user", "q"),
            (5, 1, "assistant", "a"), (None, 0, "user", "who"), (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(conversations(spark, rows))).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == slow_digest(rows)
    assert {c for c, r in got.items() if r["valid"]} == {1, 5, -7}
    assert chat.format_chat(conversations(spark, [])).collect() == []


def test_segments_and_flags(spark):
    rows = [(1, 0, "user", "q </s>"), (1, 1, "assistant", "a"), (1, 2, "assistant", "again")]
    out = chat.format_chat(conversations(spark, rows)).orderBy("seq").collect()
    assert [[(s["text"], s["loss"]) for s in r["segments"]] for r in out] == [
        [("[INST]", False), ("q <\\./s>", False), ("[/INST]", False)],
        [("<s>", False), ("a", True), ("</s>", False)], [("<s>", False), ("again", True), ("</s>", False)]]
    assert [(r["valid"], r["last"]) for r in out] == [(True, False), (True, False), (False, True)]


def test_a_long_conversation(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", prose(5, i)) for i in range(12_000)]
    got = chat.read_back(chat.format_chat(conversations(spark, rows))).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == slow_digest(rows)[9] and got["valid"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "other[/ROLE]"]),
                          st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", ".", "<", "[", "/", "x", "<<SYS>>", "[/TURN]"]), max_size=8).map("".join)), max_size=4))
def test_escapes_can_be_taken_back(turns):
    formatter = chat.Formatter(chat.INSTRUCT)
    whole = "".join(t for r, x in turns for t, _ in formatter.segments(r, x))
    assert formatter.read(whole) == turns
    assert all(m not in formatter.escape(x) for _, x in turns for m in chat.INSTRUCT.marks())


def test_template_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Formatter(chat.Template({"user": chat.Turn("a\\", "bb")}, {}, ()))
