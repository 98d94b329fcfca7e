"""Secret scan with a trigram inverted index.

A shard is a bounded run of texts inside one task. Its index maps each trigram that some rule's query mentions to
the sorted list of the texts that contain it. A rule's Boolean query intersects and unites those postings; only
the texts left are verified with the rule's pattern. A rule whose pattern implies no trigram scans every text.
Shards are independent, so a lost executor costs only its own tasks, and memory is bounded by the shard.

Defined results: a null or empty text has no spans; repeated rows and rows without an id are scanned like any
other; an empty table gives an empty result; further columns pass through `find_secrets`, and a column of the
input that is called `secrets` is replaced. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.llm.common import sliced, texts_of
from tallyshelf.llm.secret_rules import ANYTHING, RULES, SecretRule, Trigrams, trigram_query, trigrams_in

BREAK = b"\xff"  # no UTF-8 text contains this byte, so no trigram crosses two texts
SPAN = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of one shard."""

    def __init__(self, texts: list[str], wanted: list[str], slot: np.ndarray):
        """`slot` gives each trigram code its place in `wanted` plus one, or 0."""
        self.size = len(texts)
        parts = [t.encode("utf-8", "replace").lower() for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        data = np.frombuffer(BREAK.join([*parts, b""]), np.uint8).astype(np.uint32)
        codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        places = slot[codes]
        at = np.flatnonzero(places)
        pairs = np.unique((places[at].astype(np.int64) - 1) * self.size + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.size)
        self.postings = {w: pairs[cuts[i]:cuts[i + 1]] % self.size for i, w in enumerate(wanted)}

    def find(self, query: Trigrams) -> np.ndarray:
        """The texts that satisfy a query, in order."""
        if isinstance(query, str):
            return self.postings[query]
        if query == ANYTHING:
            return np.arange(self.size)
        kind, parts = query
        found = [self.find(p) for p in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        left = found[0]
        for more in found[1:]:
            left = np.intersect1d(left, more, assume_unique=True)
        return left


def slots(wanted: list[str]) -> np.ndarray:
    table = np.zeros(1 << 24, np.uint16)
    for i, w in enumerate(wanted):
        a, b, c = w.encode("latin-1")
        table[a << 16 | b << 8 | c] = i + 1
    return table


class Scanner:
    """Scans shards of texts with one set of rules."""

    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*[trigrams_in(q) for _, _, q in self.rules]))
        self.slot = slots(self.wanted)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of every text by start, then by the order of the rules."""
        index = TrigramIndex(texts, self.wanted, self.slot)
        spans: list[list] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for i in index.find(query).tolist():
                spans[i] += [(m.start(), order, m.end(), rule.kind) for m in pattern.finditer(texts[i]) if rule.check(m)]
        return [[(s, e, kind) for s, _, e, kind in sorted(found)] for found in spans]


def find_secrets(
    df: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of `df` (all by default) and a column `secrets`: the spans of every text."""
    df = df.drop("secrets")
    keep = df.columns if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("secrets", SPAN)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in sliced(batches, text):
            found = scanner.scan(texts_of(batch, text))
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], spans], [*keep, "secrets"])

    return df.mapInArrow(scan, schema)


def redact_secrets(df: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The same rows and columns with each secret replaced by <secret:kind>; overlapping spans count as the first one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in sliced(batches, text):
            column = batch.column(text).to_pylist()
            texts = ["" if t is None else t for t in column]
            for i, found in enumerate(scanner.scan(texts)):
                out, at = [], 0
                for start, end, kind in found:
                    if start >= at:
                        out += [texts[i][at:start], f"<secret:{kind}>"]
                    at = max(at, end)
                if found:
                    column[i] = "".join([*out, texts[i][at:]])
            place = batch.schema.get_field_index(text)
            yield batch.set_column(place, text, pa.array(column, batch.schema.field(text).type))

    return df.mapInArrow(scan, df.schema)



def scan_digest(df: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The columns of the contract, then the number of spans of the added kinds."""
    base = [r.kind for r in rules if r.base]
    df = find_secrets(df.select("doc_id", "text"), rules=rules, keep=["doc_id"])
    spans = F.col("secrets")

    def text_of(kept):
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return df.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(text_of(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text_of(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["kind"].isin(base))).cast("long").alias("n_more"))


# The same in SQL for comparison: every rule over every text.
def sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    words = ["password", "passwd", "secret", "token", "api_?key"]
    folded = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    value = r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for i, r in enumerate(rules):
        pattern = f"({folded}){value}" if r.kind == "assign" else r.pattern
        check = {"assign": f"length(regexp_extract(v, '{pattern}', 2)) >= 6", "access": "length(v) >= 20"}.get(r.kind, "true")
        parts.append(f"""SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, s, s + length(v) AS e FROM (
    SELECT doc_id, x.v, x.s FROM (SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(v := hits[i],
      s := list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)))) AS x
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))) WHERE {check}""")
    joined = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({joined} FILTER (base), '')) AS base_sha256, coalesce({joined}, '') AS spans,
  count(*) FILTER (NOT base) AS n_more FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
