"""URL filter: domain rules first, then a tree of path templates per host, judged by labelled purity.

1. Rules (host, path) fit a host, its subdomains and every path that starts with the rule's; the longest one wins.
   What a rule decides is labelled by it; further labels may be given.
2. Paths are split into segments, runs of digits become `<n>`. Level by level, a node of a host's tree whose children are
   mostly rare is variable there: its rare children become the wildcard `*`. Segments below `LEVELS` become `**`.
3. A template is merged with its siblings unless its share of blocked labels differs from that of all siblings by more than
   the Hoeffding bound for its number of labels.
4. Purity is the share of blocked labels of the merged branch, smoothed towards the share under its parent, that
   towards the host's share of mostly blocked branches (each branch one observation), that towards `PRIOR`. Templates that
   reach `REJECT` are blocked. Without any label a template stays.

Everything is an aggregate or a join over distinct (host, path shape), combined before it is shuffled; a host with a third of
all pages costs one partial row per shape and task. No column but the key and the url is read.

Defined results: a null url, or one without `://`, has an empty host and path and the empty template of that host;
repeated rows count as often as they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import stored

LEVELS = 4
RARE = 5  # a child with fewer pages is rare
VARIABLE = 10  # so many rare children, and half of all, make a node variable
DOUBT = 0.05  # of the Hoeffding bound
WEIGHT = 5.0  # labels that a prior counts for
PRIOR = 0.25
REJECT = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", False), Rule("example.com", "/en/", True), Rule("www.example.com", "/en/", False),
    Rule("net", "/es/", True), Rule("net", "/fr/", True),
)


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host` and `path`."""
    rest = F.when(F.contains(F.col(url), F.lit("://")), F.regexp_replace(url, r"^(?s:.*?)://", ""))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    after = F.expr("substring(_rest, length(host) + 1)")
    df = df.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("host", host)
    df = df.withColumn("path", F.regexp_extract(after, r"^[^?#]*", 0)).drop("_rest")
    return df.withColumn("host", F.translate("host", string.ascii_uppercase, string.ascii_lowercase))


def ruled(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds `rule`, the name of the longest rule that fits, and `blocked`, what it says."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, says = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.block)).otherwise(says)
    return df.withColumns({"rule": name, "blocked": says})


def shape_of(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "<n>")


def templates(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, shape, template, parent, branch, n_labels, n_blocked) from rows (host, path, blocked), null where unlabelled.

    The shapes, each level's wildcards and the templates are stored, so no level repeats the work of those above.
    """
    shapes = stored(pages.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("n_labels"), F.count_if("blocked").alias("n_blocked")))
    segments = F.split("shape", "/")
    tree = shapes.select("*", F.lit("").alias("prefix"), F.lit("").alias("parent"), F.lit("").alias("branch"),
                         F.slice(segments, F.lit(2), F.size(segments)).alias("rest"))
    for level in range(levels):
        tree = tree.withColumn("segment", F.get("rest", F.lit(0)))
        children = tree.where(F.col("segment").isNotNull()).groupBy("host", "prefix", "segment").agg(F.sum("n").alias("pages"))
        rare = F.count_if(F.col("pages") < RARE)
        nodes = children.groupBy("host", "prefix").agg(((rare >= VARIABLE) & (rare * 2 >= F.count(F.lit(1)))).alias("variable"))
        wild = stored(children.join(nodes.where("variable"), ["host", "prefix"]).where(F.col("pages") < RARE).select(
            "host", "prefix", "segment", F.lit("*").alias("wildcard")))
        step = F.concat("prefix", F.lit("/"), F.coalesce("wildcard", "segment"))
        grown = tree.join(wild, ["host", "prefix", "segment"], "left").withColumn("_next", step)
        goes_on = F.col("segment").isNotNull()
        tree = grown.select(
            "host", "shape", "n", "n_labels", "n_blocked", F.when(goes_on, F.col("prefix")).otherwise(F.col("parent")).alias("parent"),
            (F.when(goes_on, F.col("_next")).otherwise(F.col("branch")) if level == 0 else F.col("branch")).alias("branch"),
            F.when(goes_on, F.col("_next")).otherwise(F.col("prefix")).alias("prefix"),
            F.slice("rest", F.lit(2), F.size("rest") + 1).alias("rest"))
    deeper = F.size("rest") > 0
    return stored(tree.select(
        "host", "shape", F.when(deeper, F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix")).alias("template"),
        F.when(deeper, F.col("prefix")).otherwise(F.col("parent")).alias("parent"), "branch", "n_labels", "n_blocked"))


def _smoothed(blocked: Column, labels: Column, prior: Column) -> Column:
    return (blocked + prior * WEIGHT) / (labels + WEIGHT)


def judged(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) for every shape of :func:`templates`."""
    def totals() -> list[Column]:
        return [F.sum("n_labels").alias("n_labels"), F.sum("n_blocked").alias("n_blocked")]

    leaves = shapes.groupBy("host", "branch", "parent", "template").agg(*totals())
    parents = leaves.groupBy("host", "parent").agg(F.sum("n_labels").alias("parent_labels"), F.sum("n_blocked").alias("parent_blocked"))
    branches = leaves.groupBy("host", "branch").agg(*totals()).where("n_labels > 0")
    hosts = branches.groupBy("host").agg(
        F.count(F.lit(1)).alias("branches"), F.count_if(F.col("n_blocked") * 2 > F.col("n_labels")).alias("blocked_branches"))
    share = F.col("n_blocked") / F.col("n_labels") - F.col("parent_blocked") / F.col("parent_labels")
    bound = F.sqrt(F.lit(math.log(2 / DOUBT) / 2) / F.col("n_labels"))
    known = leaves.join(parents, ["host", "parent"]).withColumn(
        "distinct", (F.col("n_labels") > 0) & F.coalesce(F.abs(share) > bound, F.lit(False)))
    merged = known.where(~F.col("distinct")).groupBy("host", "parent").agg(
        F.sum("n_labels").alias("merged_labels"), F.sum("n_blocked").alias("merged_blocked"))
    host_prior = _smoothed(F.coalesce("blocked_branches", F.lit(0)), F.coalesce("branches", F.lit(0)), F.lit(PRIOR))
    parent_prior = _smoothed(F.col("parent_blocked"), F.col("parent_labels"), host_prior)
    purity = _smoothed(
        F.when(F.col("distinct"), F.col("n_blocked")).otherwise(F.coalesce("merged_blocked", F.lit(0))),
        F.when(F.col("distinct"), F.col("n_labels")).otherwise(F.coalesce("merged_labels", F.lit(0))), parent_prior)
    scored = known.join(merged, ["host", "parent"], "left").join(hosts, "host", "left").select("host", "template", purity.alias("purity"))
    return shapes.select("host", "shape", "template").join(scored, ["host", "template"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, labels: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every page; the last two are null where a rule decides.

    `labels` has the columns `url` and `blocked` (boolean); it adds to what the rules label.
    """
    found = ruled(parsed(pages.select(key, "url")), rules)
    evidence = found.select("host", "path", "blocked")
    if labels is not None:
        evidence = evidence.unionByName(parsed(labels.select("url", "blocked")).select("host", "path", "blocked"))
    scored = judged(templates(evidence))
    by_rule = found.where(F.col("rule").isNotNull()).select(
        key, "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"),
        F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    others = found.where(F.col("rule").isNull()).withColumn("shape", shape_of(F.col("path"))).join(scored, ["host", "shape"])
    by_template = others.select(
        key, "host", "path", "rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"), "template", "purity")
    return by_rule.unionByName(by_template)


def sql(rules: Sequence[Rule] = RULES, levels: int = LEVELS) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def case(of) -> str:
        fits = [f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN {of(r)}" for r in ordered]
        return f"CASE {' '.join(fits)} END"

    names, says = case(lambda r: f"'{r.name}'"), case(lambda r: str(r.block).lower())
    steps = []
    for k in range(levels):
        branch = "CASE WHEN goes_on THEN next ELSE branch END" if k == 0 else "branch"
        steps.append(f"""
c{k} AS (SELECT host, prefix, rest[1] AS segment, sum(n) AS pages FROM t{k} WHERE len(rest) > 0 GROUP BY ALL),
v{k} AS (SELECT host, prefix FROM c{k} GROUP BY ALL
  HAVING count(*) FILTER (pages < {RARE}) >= {VARIABLE} AND 2 * count(*) FILTER (pages < {RARE}) >= count(*)),
g{k} AS (
  SELECT t.*, len(rest) > 0 AS goes_on, t.prefix || '/' || CASE WHEN c.pages < {RARE} AND v.host IS NOT NULL THEN '*' ELSE c.segment END AS next
  FROM t{k} t LEFT JOIN c{k} c ON c.host = t.host AND c.prefix = t.prefix AND c.segment = t.rest[1]
  LEFT JOIN v{k} v ON v.host = t.host AND v.prefix = t.prefix),
t{k + 1} AS (
  SELECT host, shape, n, n_labels, n_blocked, CASE WHEN goes_on THEN prefix ELSE parent END AS parent, {branch} AS branch,
    CASE WHEN goes_on THEN next ELSE prefix END AS prefix, rest[2:] AS rest FROM g{k}),""")
    return f"""WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM cut),
parsed AS (
  SELECT page_id, translate(host, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM split),
found AS (SELECT *, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape, {names} AS rule, {says} AS blocked FROM parsed),
t0 AS (
  SELECT host, shape, count(*) AS n, count(blocked) AS n_labels, count(*) FILTER (blocked) AS n_blocked, '' AS parent, '' AS branch,
    '' AS prefix, string_split(shape, '/')[2:] AS rest FROM found GROUP BY host, shape),{"".join(steps)}
shapes AS (
  SELECT host, shape, n_labels, n_blocked, branch, CASE WHEN len(rest) > 0 THEN prefix || '/**' ELSE prefix END AS template,
    CASE WHEN len(rest) > 0 THEN prefix ELSE parent END AS parent FROM t{levels}),
leaves AS (SELECT host, branch, parent, template, sum(n_labels) AS n, sum(n_blocked) AS b FROM shapes GROUP BY ALL),
parents AS (SELECT host, parent, sum(n) AS pn, sum(b) AS pb FROM leaves GROUP BY ALL),
branches AS (SELECT host, branch, sum(n) AS n, sum(b) AS b FROM leaves GROUP BY ALL HAVING sum(n) > 0),
hosts AS (SELECT host, count(*) AS hn, count(*) FILTER (b * 2 > n) AS hb FROM branches GROUP BY host),
known AS (
  SELECT l.*, pn, pb, n > 0 AND abs(b / n - pb / pn) > sqrt({math.log(2 / DOUBT) / 2!r}::DOUBLE / n) AS distinct_
  FROM leaves l JOIN parents USING (host, parent)),
merged AS (SELECT host, parent, sum(n) AS mn, sum(b) AS mb FROM known WHERE NOT distinct_ GROUP BY ALL),
priors AS (
  SELECT k.*, mn, mb, (coalesce(hb, 0) + {PRIOR}::DOUBLE * {WEIGHT}::DOUBLE) / (coalesce(hn, 0) + {WEIGHT}::DOUBLE) AS host_prior
  FROM known k LEFT JOIN merged USING (host, parent) LEFT JOIN hosts USING (host)),
scored AS (
  SELECT host, template, (CASE WHEN distinct_ THEN b ELSE coalesce(mb, 0) END
      + (pb + host_prior * {WEIGHT}::DOUBLE) / (pn + {WEIGHT}::DOUBLE) * {WEIGHT}::DOUBLE)
    / (CASE WHEN distinct_ THEN n ELSE coalesce(mn, 0) END + {WEIGHT}::DOUBLE) AS purity FROM priors)
SELECT f.page_id, f.host, f.path, f.rule,
  CASE WHEN CASE WHEN rule IS NOT NULL THEN blocked ELSE purity >= {REJECT} END THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN template END AS template, CASE WHEN rule IS NULL THEN purity END AS purity
FROM found f JOIN shapes USING (host, shape) JOIN scored USING (host, template)"""
