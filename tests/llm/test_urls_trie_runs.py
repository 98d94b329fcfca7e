"""URL templates, the conversation trie and periodic runs against plain versions of the same definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import AWKWARD, documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyshelf.llm import periodic, prefix_trie, url_templates

# periodic runs


def runs_by_trying(words):
    """Every start and period, extended word by word."""
    found, n = [], len(words)
    for start in range(n):
        for period in range(1, n // 4 + 1):
            end = start + period
            while end < n and words[end] == words[end - period]:
                end += 1
            long = end - start >= max(6, 4 * period)
            extends = start > 0 and start - 1 + period < n and words[start - 1] == words[start - 1 + period]
            smaller = long and any(words[start + r:end] == words[start:end - r] for r in range(1, period))
            if long and not extends and not smaller:
                found.append((start, end - start, period))
    return found


def without_repeats(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def replanted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


words_of_text = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(words_of_text, st.integers(1, 6)), max_size=4))
def test_runs_equal_trying_all(parts):
    texts = [w * k for w, k in parts]
    runs, counts, collapsed = periodic.runs_of(texts)
    at = 0
    for words, n, rest in zip(texts, counts.tolist(), collapsed):
        expected = runs_by_trying(words)
        assert [tuple(r) for r in runs[at:at + n].tolist()] == expected
        assert rest.decode() == without_repeats([w.decode() for w in words], expected)
        at += n


def test_long_periodic_text():
    words = [b"x%d" % (i % 50) for i in range(50_000)] + [b"a", b"a", b"b"] * 20_000
    runs, _, collapsed = periodic.runs_of([words])
    assert runs.tolist() == [[0, 50_000, 50], [50_000, 60_000, 3]] and len(collapsed[0].split()) == 53


def test_run_digest_of_awkward_texts(spark):
    rng = random.Random(3)
    texts = [*AWKWARD[:6], *[" ".join(rng.choice(["la", "li"]) for _ in range(rng.randint(0, 90))) for _ in range(60)], "a b\n" * 30]
    df = odd_rows(spark, texts)
    got = periodic.run_digest(periodic.find_runs(periodic.planted(df))).collect()
    assert len(got) == df.count()
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(tuple(r)[1:])
    for doc_id, text in [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]:
        words = replanted(doc_id, [w.decode() for w in (text or "").encode().split()])
        runs = sorted(runs_by_trying(words), key=lambda r: (r[0], r[2])) if len(words) < 4000 else [(0, len(words), 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        row = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
               hashlib.sha256(without_repeats(words, runs).encode()).hexdigest())
        assert row in of[doc_id]
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_runs_keep_other_columns(spark):
    df = documents(spark, ["go on " * 5, None]).withColumn("runs", F.lit("mine"))
    out = periodic.find_runs(df.drop("runs"), keep=["doc_id", "lang"]).orderBy("doc_id").collect()
    assert [(r["lang"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out] == [("en", [(0, 10, 2)], "go on"), ("en", [], "")]
    assert periodic.find_runs(df).count() == 2


# conversation trie


def trie_by_hand(rows, rebuilt=True):
    """All nodes from a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), key, (role, text)))
    paths = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    if rebuilt:
        before = dict(paths)
        for c in paths:
            h = zlib.crc32(str(c).encode()) % 6
            paths[c] = before.get(c - c % 100, [])[:h] + before[c][h:]
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(node))
        out.add((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]),
                 sum(not children[m] for m in below), sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(5 * n), n):
        deep = rng.choice([1, 2, 3, 6, 12])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no 😀"][:1 + t % 3])) for t in range(deep)]
    copied = [(c, t, "user", f"same {t}") for c in range(10_000, 10_000 + n) for t in range(4)]
    odd = [(20_000, None, None, None), (20_000, 1, "user", "b"), (20_000, 1, "user", "a"), (20_000, 1, "user", "a"), (None, 0, "user", "x"),
           (20_001, 3, "", "")]
    return rows + copied + odd


@pytest.mark.parametrize("shard_paths", [1, 3, 7, 2048])
@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_equals_a_dictionary(spark, shard_paths, rebuilt):
    rows = conversations(shard_paths, 60)
    df = spark.createDataFrame(rows, TURNS).withColumn("path", F.lit("mine")).withColumn("node", F.lit(1)).repartition(5)
    paths = prefix_trie.paths_of(df)
    if rebuilt:
        paths = prefix_trie.with_family_heads(paths)
    got = prefix_trie.trie_digest(prefix_trie.trie_nodes(paths, shard_paths)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    expected = trie_by_hand(rows, rebuilt)
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_nodes(prefix_trie.with_family_heads(prefix_trie.paths_of(none))).count() == 0
    alone = spark.createDataFrame([(101, 0, "user", "hello")], TURNS)  # its head has more turns than it, its family none
    (root,) = prefix_trie.trie_nodes(prefix_trie.with_family_heads(prefix_trie.paths_of(alone))).collect()
    assert (root["conv_id"], root["depth"], root["parent_conv_id"], root["n_convs"], root["n_leaves"]) == (101, 0, None, 1, 1)


def test_one_very_long_conversation(spark):
    rows = [(1, t, "user", "again") for t in range(3000)] + [(2, t, "user", "again") for t in range(2000)]
    nodes = prefix_trie.trie_nodes(prefix_trie.paths_of(spark.createDataFrame(rows, TURNS)), 1)
    assert nodes.count() == 3001
    top = nodes.where("depth = 0").first()
    assert (top["n_leaves"], top["saved_tokens"]) == (1, 2000 * 5)


# URL templates


def filtered(spark, urls, **more):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in url_templates.filter_urls(pages.withColumn("host", F.lit("mine")), **more).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme.com/x": ("", "", None), "http://A.Ü.Com?x=/1": ("a.Ü.com", "", None),
        "http://a.com/": ("a.com", "/", "com/"), "x://y.com/a://b.com/": ("y.com", "/a://b.com/", "com/"),
        "https://m.example.com/en/5#top": ("m.example.com", "/en/5", "example.com/en/"),
        "https://www.example.com/en/5": ("www.example.com", "/en/5", "www.example.com/en/"),
        "https://b.www.example.com/en/5": ("b.www.example.com", "/en/5", "www.example.com/en/"),
        "https://notexample.com/en/5": ("notexample.com", "/en/5", "com/"), "https://a.net/es/1?q": ("a.net", "/es/1", "net/es/"),
        "https://net/fr/": ("net", "/fr/", "net/fr/"), "https://a.net/es": ("a.net", "/es", None), "": ("", "", None),
        "http://a.b.org#x/y": ("a.b.org", "", None), "http://multi\nline.org/a\nb": ("multi\nline.org", "/a\nb", None),
    }
    got = filtered(spark, list(cases))
    for i, (host, path, rule) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert filtered(spark, []) == {}


def test_templates_wildcards_and_purity(spark):
    spam = [f"http://shop.org/offer/{w}-{'abcdefghij'[i % 10]}/buy" for i, w in enumerate(["pill", "coin", "bet", "win", "spin", "slot"] * 6)]
    spam = [u.replace("/offer/", f"/offer/{chr(97 + i % 26)}{chr(97 + i // 26)}") for i, u in enumerate(spam)]
    news = [f"http://shop.org/news/2024/{i}.html" for i in range(30)]
    deep = [f"http://shop.org/a/b/c/d/{w}/{w}" for w in "uvw"]
    labels = spark.createDataFrame([(u, True) for u in spam[:12]] + [(u, False) for u in news[:12]], "url string, blocked boolean")
    urls = [*spam, *news, *deep, "http://else.org/offer/aapill-a/buy"]
    got = filtered(spark, urls, rules=(), labels=labels)
    of = {u: got[i] for i, u in enumerate(urls)}
    assert all(of[u]["verdict"] == "block" and of[u]["template"] == "/offer/*/buy" for u in spam)
    assert all(of[u]["verdict"] == "allow" and of[u]["template"] == "/news/<n>/<n>.html" for u in news)
    assert {of[u]["template"] for u in deep} == {"/a/b/c/d/**"}
    assert of[urls[-1]]["verdict"] == "allow"  # another host has a tree of its own


def test_similar_siblings_are_merged_and_unlike_ones_are_not(spark):
    def pages(part, n, blocked):
        return [(f"http://h.org/x/{part}", blocked)] * n

    labels = spark.createDataFrame(
        [*pages("one", 40, True), *pages("two", 3, True), *pages("good", 60, False), *pages("few", 1, False)], "url string, blocked boolean")
    got = filtered(spark, ["http://h.org/x/one", "http://h.org/x/two", "http://h.org/x/good", "http://h.org/x/few", "http://h.org/x/new"],
                   rules=(), labels=labels)
    assert [got[i]["verdict"] for i in (0, 2)] == ["block", "allow"]
    # too few labels to differ from their siblings: one branch, one purity
    assert got[1]["purity"] == got[3]["purity"] == got[4]["purity"]


def test_plan_has_no_python(spark, data, capsys):
    url_templates.filter_urls(spark.read.parquet(f"{data}/pages.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan
