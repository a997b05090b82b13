"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain-language-source tree. Siblings share their parent's budget by weight; one that holds
too little (its tokens times `max_epochs`) takes what it has and its shortage goes to its siblings, and only what a whole
subtree cannot take reaches the parent's siblings. That is: share = min(capacity, weight * level), with the one level at
which a sibling group uses its budget. A leaf then takes whole epochs of its documents and, for the rest, the longest
prefix of one more epoch that fits, in an order drawn by md5 of seed, epoch and doc_id.

Edge cases: null languages, sources and domains are the name ''; null or empty texts hold no tokens and follow their leaf;
a leaf without tokens gets no copies; equal keys of the order go by doc_id; repeated rows count as often as they stand;
a weight of 0 gives nothing, and if all siblings that hold tokens weigh 0 their parent's budget stays unused; an empty table
gives an empty result; columns of the input stay as they are, whatever their names, but for n_tokens and copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import cut

LEVELS = ("_domain", "_lang", "_source")


def source_stem(source: Column) -> Column:
    """The default domain: the source's name without its last digit."""
    return F.regexp_replace(source, "[0-9]$", "")


def _level(parents: list[str], name: str, cap: str, weight: str, budget: str) -> Column:
    """What a unit of weight gets if siblings up to this one, by capacity for their weight, are full; null at weight 0."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.asc_nulls_last(F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))), name)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.when(F.col(weight) > 0, (F.col(budget) - before) / rest)


def _weight(level: str, given: dict[str, float]) -> Column:
    if any(v < 0 for v in given.values()):
        raise ValueError("weights must not be negative")
    if not given:
        return F.lit(1.0)
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1.0))


def budgets(leaves: DataFrame, total: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves: the three levels and `tokens`. Adds `quota`, the tokens each leaf is to give."""
    nodes = leaves.withColumn("_cap", (F.col("tokens") * max_epochs).cast("double"))
    out = nodes.withColumn("_budget", F.lit(float(total)))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        weight = _weight(level, weights.get(level.removeprefix("_"), {}))
        groups = out.groupBy(*path).agg(F.sum("_cap").alias("_c"), F.first("_budget").alias("_b")).withColumn("_w", weight)
        groups = groups.withColumn("_level", _level(path[:-1], level, "_c", "_w", "_b"))
        top = F.max("_level").over(Window.partitionBy(*path[:-1]) if depth else Window.partitionBy(F.lit(0)))
        share = F.when(F.col("_w") > 0, F.least(F.col("_c"), F.col("_w") * top)).otherwise(0.0)
        groups = groups.withColumn("_share", share).select(*path, "_share")
        out = out.drop("_budget").join(groups, path).withColumnRenamed("_share", "_budget")
    return out.select(*LEVELS, "tokens", F.floor("_budget").cast("bigint").alias("quota"))


def mix(docs: DataFrame, share: float = 1.0, max_epochs: int = 4, weights: dict[str, dict[str, float]] | None = None, domain: Column | None = None, seed: int = 17) -> DataFrame:
    """docs with n_tokens and copies, how often the mixture holds each.

    share: the budget as a share of all tokens; weights: of names at the levels domain, lang and source, 1 where none is given.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "copies")])
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = docs.select(
        F.struct("*").alias("_doc"), F.regexp_count(name(F.col("text")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"), F.col("doc_id").alias("_id"),
        name(source_stem(F.col("source")) if domain is None else domain).alias("_domain"), name(F.col("lang")).alias("_lang"), name(F.col("source")).alias("_source"))
    levels = list(LEVELS)
    leaves = cut(named.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    quotas = budgets(leaves, total, max_epochs, weights or {})
    full, rest = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0), F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(-1)
    quotas = cut(quotas.select(*levels, full.alias("_full"), rest.alias("_rest")), "quotas")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id").cast("string")))
    drawn = named.join(quotas, levels).withColumn("_key", key).withColumn("_bin", F.substring("_key", 1, 3))
    # Tokens of each leaf by the first three hex digits of the order; only the bin in which the prefix ends is sorted.
    bins = drawn.groupBy(*levels, "_bin", "_rest").agg(F.sum("n_tokens").alias("_t"))
    w = Window.partitionBy(*levels).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_to", F.sum("_t").over(w)).select(*levels, "_bin", "_rest", (F.col("_to") - F.col("_t")).alias("_before"), "_to")
    ends = bins.where("_before <= _rest and _to > _rest")
    ends = cut(ends.groupBy(*levels).agg(F.min(F.struct("_bin", "_before")).alias("x")).select(*levels, F.col("x._bin").alias("_end"), "x._before"), "ends")
    drawn = drawn.join(ends, levels, "left")
    once_more = (F.col("_rest") >= 0) & (F.col("_end").isNull() | (F.col("_bin") < F.col("_end")))
    inside = drawn.where("_end is null or _bin != _end").select("_doc", "n_tokens", (F.col("_full") + F.when(once_more, 1).otherwise(0)).alias("copies"))
    run = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = drawn.where("_bin = _end").withColumn("_run", run + F.col("_before"))
    edge = edge.select("_doc", "n_tokens", (F.col("_full") + F.when(F.col("_run") <= F.col("_rest"), 1).otherwise(0)).alias("copies"))
    return inside.union(edge).select("_doc.*", "n_tokens", "copies")


def mixture_sql(docs: str = "documents", share: float = 1.0, max_epochs: int = 4, seed: int = 17, weights: dict[str, dict[str, float]] | None = None) -> str:
    """The mixture in DuckDB SQL, with the default domain."""

    def weight(level: str, column: str) -> str:
        given = (weights or {}).get(level, {})
        return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {float(v)}::DOUBLE' for k, v in given.items())} ELSE 1.0::DOUBLE END" if given else "1.0::DOUBLE"

    def level(name: str, path: str, parent: str, w: str) -> str:
        above, _, own = path.rpartition(", ")
        order = f"PARTITION BY {above or '0'} ORDER BY CASE WHEN w > 0 THEN c / w END NULLS LAST, {own} ROWS BETWEEN"
        return f"""
{name}0 AS (SELECT {path}, sum(cap) AS c, any_value(b) AS b, {w} AS w FROM {parent} GROUP BY {path}),
{name}1 AS (SELECT *, CASE WHEN w > 0 THEN (b - coalesce(sum(c) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) END AS lv FROM {name}0),
{name}2 AS (SELECT {path}, CASE WHEN w > 0 THEN least(c, w * max(lv) OVER (PARTITION BY {above or '0'})) ELSE 0 END AS share FROM {name}1),
{name} AS (SELECT p.* EXCLUDE (b), q.share AS b FROM {parent} p JOIN {name}2 q USING ({path}))"""

    return f"""
WITH n AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
  coalesce(regexp_replace(source, '[0-9]$', ''), '') AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM {docs}),
leaf AS (SELECT d, l, s, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS DOUBLE) AS cap,
  (SELECT sum(n_tokens) FROM n) * CAST({share} AS DOUBLE) AS b FROM n GROUP BY d, l, s),{level("x", "d", "leaf", weight("domain", "d"))},
{level("y", "d, l", "x", weight("lang", "l"))},{level("z", "d, l, s", "y", weight("source", "s"))},
q AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN CAST(floor(b) AS BIGINT) // tokens ELSE 0 END AS fu,
  CASE WHEN tokens > 0 THEN CAST(floor(b) AS BIGINT) % tokens ELSE -1 END AS rest FROM z),
o AS (SELECT n.*, fu, rest, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY md5('{seed}:' || fu || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM n JOIN q USING (d, l, s))
SELECT doc_id, n_tokens, CAST(fu + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o"""


#: The weights of the query and of the pipeline's stage: three parts English, two parts German, one part other languages;
#: sources of the group src1 count twice, and source src7 three times within its group.
WEIGHTS = {"domain": {"src1": 2.0}, "lang": {"en": 3.0, "de": 2.0}, "source": {"src7": 3.0}}
ORACLE_SQL = mixture_sql(weights=WEIGHTS)
