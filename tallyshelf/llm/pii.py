"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is a column expression. A pattern is applied twice, once for its matches and once for the gaps
between them; the lengths of both give the offsets (code points, end exclusive). A rule with `base=True` keeps
every match that passes its check; the others must also reach the threshold with their context words.

Defined results: a null or empty text has no spans; repeated rows and rows without an id are scanned like any
other; an empty table gives an empty result; further columns pass through, a column that has the name of an
added one is replaced. Texts of any length are scanned whole in one linear pass per pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 70
CONTEXT = 40
SPANS = "array<struct<start:int,end:int,kind:string,score:int,value:string>>"


@dataclass(frozen=True)
class PiiRule:
    """`pattern` proposes; `check(value, before, after)` confirms, where before and after are the gaps around it.

    `needs` is a text that every match contains: texts without it skip the pattern. Points: `prior`, then 20 for a
    word of `for_words` and minus 20 for a word of `against_words` within the context, at most 100.
    """

    kind: str
    pattern: str
    check: Callable[[Column, Column, Column], Column]
    prior: int
    for_words: str
    against_words: str
    base: bool = False
    needs: str | None = None


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 when divided by 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    ) == 1


PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ip(value: Column, before: Column, after: Column) -> Column:
    return value.rlike(rf"^{PART}(\.{PART}){{3}}$")


def _card(value: Column, before: Column, after: Column) -> Column:
    return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)


def _phone(value: Column, before: Column, after: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _apart(before: Column, after: Column) -> Column:
    return ~before.rlike("[A-Za-z0-9-]$") & ~after.rlike("^[A-Za-z0-9-]")


def _iban(value: Column, before: Column, after: Column) -> Column:
    code = F.replace(value, F.lit(" "), F.lit(""))
    return F.when(_apart(before, after) & F.length(code).between(15, 34), mod97(code)).otherwise(False)


def _ssn(value: Column, before: Column, after: Column) -> Column:
    return _apart(before, after) & ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$")


# Characters of an IBAN by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As many characters as the country has, in one piece or in groups of four: what follows is never taken."""
    kinds = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        spaced = rf"(?:\x20[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "")
        kinds.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})")
    return "(?:" + "|".join(kinds) + ")"


# The patterns of the first four are those of the contract, written so that no attempt scans a run twice: a match
# can only begin where a run begins or where the last match ended, and what was taken is never given back.
RULES = (
    PiiRule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
            lambda v, b, a: F.lit(True), 80, "mail|contact|write to", "noreply", base=True, needs="@"),
    PiiRule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 60, "ip|host|address|server", "version|release",
            base=True, needs="."),
    PiiRule("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 80, "card|visa|credit|payment", "order|invoice|tracking", base=True),
    PiiRule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 60, "phone|call|tel|mobile|fax", "order|invoice|version",
            base=True, needs="+"),
    PiiRule("iban", _iban_pattern(), _iban, 80, "iban|account|bank", "serial"),
    PiiRule("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 50, "ssn|social security", "order|invoice", needs="-"),
)


def _found(text: Column, rule: PiiRule) -> Column:
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return hits if rule.needs is None else F.when(F.contains(text, F.lit(rule.needs)), hits).otherwise(none)


def _near(words: str, before: Column, after: Column) -> Column:
    return F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT)))).rlike(words)


def _spans(text: Column, hits: Column, rule: PiiRule, threshold: int) -> Column:
    gaps = F.split(text, rule.pattern, -1)
    n = F.size(hits)
    zipped = F.arrays_zip(
        F.slice(gaps, F.lit(1), n).alias("before"), hits.alias("value"), F.slice(gaps, F.lit(2), n).alias("after"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        score = F.least(F.lit(100), F.lit(rule.prior)
                        + F.when(_near(rule.for_words, x["before"], x["after"]), 20).otherwise(0)
                        - F.when(_near(rule.against_words, x["before"], x["after"]), 20).otherwise(0))
        fine = rule.check(x["value"], x["before"], x["after"])
        fine = fine if rule.base else fine & (score >= threshold)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"),
                        score.cast("int").alias("score"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(fine, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

    none = F.array().cast(SPANS)
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda held: held["out"])
    return F.when(n > 0, walked).otherwise(none)


def find_pii(df: DataFrame, text: str = "text", rules: tuple[PiiRule, ...] = RULES, threshold: int = THRESHOLD) -> DataFrame:
    """`df` with a column `pii_<kind>` per rule: its spans by start, each with score and value."""
    names = [f"pii_{r.kind}" for r in rules]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = df.withColumns({n: _found(whole, r) for n, r in zip(names, rules)})
    return found.withColumns({n: _spans(whole, F.col(n), r, threshold) for n, r in zip(names, rules)})


def span_text(kinds: list[str], rules: tuple[PiiRule, ...] = RULES) -> Column:
    """kind:start:end of the named kinds by start, then by the order of the rules, joined by commas."""

    def keyed(kind: str, order: int) -> Column:
        return F.transform(F.col(f"pii_{kind}"), lambda s: F.struct(
            s["start"].alias("s"), F.lit(order).alias("k"), s["end"].alias("e"), s["kind"].alias("n")))

    ordered = F.array_sort(F.concat(*[keyed(r.kind, i) for i, r in enumerate(rules) if r.kind in kinds]))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["n"], x["s"], x["e"])), ",")


def digest(found: DataFrame, rules: tuple[PiiRule, ...] = RULES) -> DataFrame:
    """The columns of the contract, then the counts of the added kinds and the highest score."""
    base, more = [r.kind for r in rules if r.base], [r.kind for r in rules if not r.base]

    def count(kind: str) -> Column:
        return F.size(f"pii_{kind}").cast("long").alias(f"n_{kind}")

    best = F.array_max(F.concat(*[F.transform(F.col(f"pii_{r.kind}"), lambda s: s["score"]) for r in rules]))
    return found.select(
        "doc_id", *map(count, base), F.sha2(span_text(base, rules), 256).alias("base_sha256"),
        span_text([r.kind for r in rules], rules).alias("spans"), *map(count, more), best.cast("long").alias("max_score"))


# The same in SQL for comparison: the contract's own patterns, offsets from matches and gaps.
def sql() -> str:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    patterns = {"email": email, "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+"}
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    apart = "NOT regexp_matches(b, '[A-Za-z0-9-]$') AND NOT regexp_matches(a, '^[A-Za-z0-9-]')"
    code = "replace(v, ' ', '')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN list_sum(list_transform(range(1, length({digits}) + 1), "
                f"lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INT) "
                f"ELSE CAST(reverse({digits})[i] AS INT) * 2 % 10 + CAST(reverse({digits})[i] AS INT) // 5 END)) % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "ssn": f"{apart} AND NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '-00-|-0000$')",
    }
    # an IBAN is at most 34 characters, 68 digits at most: the remainder is taken in three parts
    number = (f"list_aggregate(list_transform(string_split({code}[5:] || {code}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
              "THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')")
    third = f"CAST('0' || {number}[1:30] AS HUGEINT) % 97"
    second = f"CAST(({third}) || {number}[31:60] AS HUGEINT) % 97"
    checks["iban"] = f"{apart} AND length({code}) BETWEEN 15 AND 34 AND CAST(({second}) || {number}[61:] AS HUGEINT) % 97 = 1"
    parts = []
    for i, r in enumerate(RULES):
        pattern = patterns.get(r.kind, r.pattern)
        context = f"lower(right(b, {CONTEXT}) || ' ' || left(a, {CONTEXT}))"
        score = (f"least(100, {r.prior} + CASE WHEN regexp_matches({context}, '{r.for_words}') THEN 20 ELSE 0 END"
                 f" - CASE WHEN regexp_matches({context}, '{r.against_words}') THEN 20 ELSE 0 END)")
        parts.append(f"""SELECT doc_id, {i} AS k, '{r.kind}' AS kind, s, s + length(v) AS e, {score} AS score, {str(r.base).lower()} AS base
  FROM (SELECT doc_id, x.b, x.v, x.a, x.s FROM (SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
      b := gaps[i], v := hits[i], a := gaps[i + 1], s := list_sum(list_transform(gaps[:i], lambda g: length(g)))
        + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)))) AS x
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))
  ) WHERE {checks[r.kind]}{'' if r.base else f' AND {score} >= {THRESHOLD}'}""")
    each = " UNION ALL ".join(parts)
    joined = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({each})
SELECT doc_id, {counts}, sha256(coalesce({joined} FILTER (base), '')) AS base_sha256, coalesce({joined}, '') AS spans,
  CAST(max(score) AS BIGINT) AS max_score FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
