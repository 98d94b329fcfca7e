"""Near copies and repeated passages against brute force."""

import hashlib
from collections import Counter, deque

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, DOCUMENTS, documents, odd_rows, prose
from pyspark.sql import functions as F

from tallyshelf.llm import passages, simhash, suffix, vantage


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, most):
    """Smallest id reachable over links, by search."""
    out = {}
    for i, p in sorted(zip(ids, prints)):
        if i in out:
            continue
        queue, out[i] = deque([p]), i
        while queue:
            q = queue.popleft()
            for j, r in zip(ids, prints):
                if j not in out and bin(q ^ r).count("1") <= most:
                    out[j] = i
                    queue.append(r)
    return out


def test_fingerprints_and_groups(spark):
    base = prose(400)
    texts = [*AWKWARD, base, base.upper(), base + " end", base.replace("river", "rivers", 1), *[prose(60, i) for i in range(30)], "a b c d e", "a b c d e f", None]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    got = {r["doc_id"]: r for r in rows}
    prints = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = slow_components(list(range(len(texts))), prints, 4)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert spark.sql("SELECT lower(hex(xxhash64('a b c d e')))").first()[0] == f"{xxhash.xxh64_intdigest(b'a b c d e', 42):x}"


def test_odd_rows_and_empty_tables(spark):
    df = odd_rows(spark, [prose(50), prose(50) + " more", None])
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 5
    alike = [r for r in rows if r["doc_id"] in (0, None)]
    assert len({(r["fingerprint"], r["component_id"]) for r in alike}) == 1
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({r["component_id"] for r in rows})
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_an_id_with_two_texts_loses_no_group(spark):
    a, b, c = prose(120, 1), prose(130, 77), prose(140, 5)
    rows = [(5, a), (5, b), (7, a), (8, b), (9, c), (9, c), (None, a)]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCUMENTS)
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.one_of_each(df).collect())
    assert kept == sorted([(5, a), (5, b), (9, c), (-1, a)])
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {5, 9}


@pytest.mark.parametrize("blocks", [1, 2, 3, 5])
def test_trees_miss_no_link(blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 2**63, 120, dtype=np.uint64)
    points = centres[rng.integers(0, 120, 900)]
    for _ in range(3):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    points = np.unique(points)
    rng.shuffle(points)
    groups, first = vantage.Groups(len(points)), 0
    for mask, reach in vantage.bit_blocks(4, blocks):
        tree, first = vantage.build(points[:200], mask, reach, 4, 30, first)
        homes = []
        for _, home, guests in vantage.route(tree, points):
            homes += home.tolist()
            vantage.link(points, home, guests, mask, reach, 4, groups, leaf=8)
        assert sorted(homes) == list(range(len(points)))
    want = slow_components(list(range(len(points))), points.tolist(), 4)
    assert [groups.root(i) for i in range(len(points))] == [want[i] for i in range(len(points))]


def test_crowds_and_chains(spark):
    # a chain of single-bit steps and a crowd within two bits of each other, more than a leaf holds
    chain = [(1 << (i + 1)) - 1 for i in range(40)]
    crowd = [(0xABCD << 44) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    prints = np.array(chain + crowd, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint long")
    found = df.join(simhash.groups_of(df), "fingerprint").collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 40} == {0}
    assert {r["component_id"] for r in found if r["doc_id"] >= 40} == {40}


def test_connected_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (300, 150), (500, 400)]
    found = {r["a"]: r["b"] for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100, 300: 100, 500: 400}
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(40):
        pieces = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        data = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        words, room = suffix.symbols(data)
        order, place = suffix.suffix_array(words, room)
        raw = [data[i:i + r].tobytes() for i, r in enumerate(room)]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: ([*raw[i], 256], i + room[i]))
        assert (order[place] == np.arange(len(data))).all()
        shared = suffix.common_prefixes(order, place, words, room, stride=7)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1]], raw[order[k]]
            assert shared[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def slow_removal(rows, length):
    encoded = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + length] for _, b in encoded for s in range(len(b) - length + 1))
    out = []
    for i, b in encoded:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passages_found(df, length=passages.LENGTH):
    return sorted((tuple(r) for r in passages.remove_repeats(df, length).collect()), key=str)


def repeating_texts():
    shared = prose(120, 77)  # several hundred bytes
    texts = [prose(90, i) + " " + shared[i:i + 200 + i % 5] + " é中 " + prose(30, 50 + i) for i in range(12)]
    texts += [shared[:199], shared[100:300], shared[100:300], prose(300, 5), prose(300, 5) + " tail", "é" * 300, "ab" * 400, "x" * 199, "x" * 200, "y" * 201]
    return texts


@pytest.mark.parametrize("part, shard", [(passages.PART, passages.SHARD_BYTES), (2, 3000)])
def test_repeats_against_brute_force(spark, monkeypatch, part, shard):
    monkeypatch.setattr(passages, "PART", part)
    monkeypatch.setattr(passages, "SHARD_BYTES", shard)
    rows = list(enumerate(repeating_texts()))
    assert passages_found(documents(spark, [t for _, t in rows])) == slow_removal(rows, passages.LENGTH)


def test_a_long_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(passages, "PART", 16)
    monkeypatch.setattr(passages, "SHARD_BYTES", 3000)
    line = prose(40, 9)[:99] + "\n"
    texts = [line * 1000, prose(60, 4) + line * 3 + prose(60, 5), line[:50] + line * 2, prose(60, 6)]
    rows = list(enumerate(texts))
    df = documents(spark, texts)
    assert passages_found(df) == slow_removal(rows, passages.LENGTH)
    # what a shard gets of one anchor: not every occurrence
    docs = df.selectExpr("text", "xxhash64(doc_id, text) AS key")
    found = docs.select("key", "text").mapInArrow(passages._anchor_rows(passages.LENGTH), "key bigint, a bigint, c bigint, n bigint")
    flagged = docs.join(passages._flags(found), "key", "left")
    dealt = passages._dealt(flagged.mapInArrow(passages._sent(passages.LENGTH), passages.SENT_SCHEMA))
    sizes = [r["n"] for r in dealt.groupBy("a", "side", "part").agg(F.count("*").alias("n")).collect()]
    assert sizes and max(sizes) <= 2 * passages.PART


@pytest.mark.parametrize("part", [3, 10, 1000])
def test_a_hot_anchor_in_unlike_contexts(spark, monkeypatch, part):
    """One piece with many surroundings: shared to the left, to the right, on both sides, or not at all."""
    monkeypatch.setattr(passages, "PART", part)
    core = prose(40, 1234)[:150]
    lefts, rights = [prose(30, 400 + i) for i in range(6)], [prose(30, 500 + i) for i in range(6)]
    texts = [lefts[i % 6][-(60 + i):] + core + rights[(i // 6) % 6][:50 + i] for i in range(36)]
    texts += [prose(20, 600 + i) + core + prose(20, 700 + i) for i in range(20)] + [core, core + rights[0], lefts[0] + core]
    rows = list(enumerate(texts))
    assert passages_found(documents(spark, texts)) == slow_removal(rows, passages.LENGTH)


@pytest.mark.parametrize("width, most", [(175, 0), (230, 60 * 60)])
def test_a_spread_group_hands_on_few_strings(spark, monkeypatch, width, most):
    """Surroundings that differ too near to the shared bytes drop out by counts, not string by string."""
    monkeypatch.setattr(passages, "PART", 8)
    found, stored = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df: found.append(stored(df)) or found[-1])
    core = prose(60, 1234)[:width]
    texts = [prose(40, 800 + i) + f" {i:02d}" + core + f"{i:02d} " + prose(40, 900 + i) for i in range(60)]
    rows = list(enumerate(texts))
    assert passages_found(documents(spark, texts)) == slow_removal(rows, passages.LENGTH)
    # only of ranges whose bytes recur, not one for each of the strings around the core
    assert found[-1].where("open").count() <= most


def test_repeats_in_odd_rows_and_empty_tables(spark):
    texts = [prose(80), None, "", "short", prose(80, 3)]
    df = odd_rows(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert passages_found(df) == slow_removal(rows, passages.LENGTH)
    assert passages_found(df.limit(0)) == []
    kept = {r["doc_id"]: r["kept"] for r in passages.remove_repeats(documents(spark, texts), texts=True).collect()}
    assert kept[0].decode() == texts[0] and kept[1] == b""


def test_anchors_in_chunks(monkeypatch):
    data = np.frombuffer(prose(3000).encode(), np.uint8)
    whole = passages.anchors(data)
    monkeypatch.setattr(passages, "CHUNK", 1000)
    chunked = passages.anchors(data)
    assert whole[0].tolist() == chunked[0].tolist() and whole[1].tolist() == chunked[1].tolist()
    gaps = np.diff(np.concatenate([[-1], whole[0], [len(data) - passages.PIECE + 1]]))
    assert gaps.max() <= passages.LENGTH - passages.PIECE + 1
