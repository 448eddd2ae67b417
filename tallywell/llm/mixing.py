"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A token budget flows from the root to the leaves by weight. A node can take at most max_epochs passes over its own tokens;
what a child cannot take goes to its siblings by their weights, and since a node is never given more than its leaves can
take together, a shortage reaches an ancestor's other children only when all siblings are full. Each leaf then takes
whole epochs and, of the next one, the documents whose seeded keys come first, up to its tokens.

No leaf is gathered or sorted: token sums by key prefix find the bucket that holds the cut, and only that bucket is
looked into. All arithmetic is on whole numbers (tokens times weights must stay below 2^63), so results do not depend
on partitioning.

Defined cases: a null domain, language or source is the branch "unknown"; a null or empty text has no tokens; leaves
without any tokens take nothing; rows with equal doc_ids share a key and are taken together; an empty table gives no
rows; extra columns pass (pipeline) or are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import table

#: Hexadecimal digits of a key that make a bucket.
PREFIX = 4
WORD = r"[^\x20\x09-\x0D]+"


def _cases(column: str, values: Mapping[str, object], rest: object) -> str:
    """A CASE expression that Spark and DuckDB both read."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {quote(rest)} END" if arms else quote(rest)


@dataclass(frozen=True)
class Mixture:
    """Whole-number weights of the tree's branches, and how much to take."""

    domains: Mapping[str, str] = field(default_factory=lambda: {f"src{i}": "web" if i < 10 else "books" if i < 15 else "forums" for i in range(20)})
    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"web": 60, "books": 25, "forums": 15})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    source_weights: Mapping[str, int] = field(default_factory=lambda: {"src0": 6})
    other_weight: int = 1
    #: Budget as a share of the tokens at hand, in percent.
    percent: int = 90
    max_epochs: int = 2
    seed: int = 17

    def domain_sql(self) -> str:
        return _cases("source", self.domains, "other")

    def weight_sql(self, level: str) -> str:
        return _cases(level, {"domain": self.domain_weights, "lang": self.lang_weights, "source": self.source_weights}[level], self.other_weight)


LEVELS = ("domain", "lang", "source")


def _leaf_columns(mixture: Mixture) -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    return {"m_domain": F.expr(mixture.domain_sql().replace("CASE source", "CASE coalesce(source, 'unknown')")), "m_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "m_source": source}


def _key(mixture: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], mixture: Mixture, level: str) -> DataFrame:
    """What each child gets of its parent's `budget`, given its `room`; children are filled in the order of room by weight."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("room") / F.col("w"), f"m_{level}")
    w = nodes.withColumn("w", F.expr(mixture.weight_sql(level).replace(f"CASE {level}", f"CASE m_{level}")).cast("long"))
    w = w.withColumn("filled", F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("room"))
    w = w.withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("full", F.col("room") * F.col("left_w") <= F.col("w") * (F.col("budget") - F.col("filled")))
    w = w.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by), F.lit(0)))
    w = w.withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    return w.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.expr("((budget - spent) * w) div open_w"))).drop("w", "filled", "left_w", "full", "spent", "open_w")


def quotas(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """Tokens to take of each leaf (m_domain, m_lang, m_source, have), as whole epochs and a rest of the next one."""
    keys = [f"m_{x}" for x in LEVELS]
    nodes = leaves.withColumn("room", F.col("have") * mixture.max_epochs)
    total = leaves.agg(F.coalesce(F.expr(f"sum(have) * {mixture.percent} div 100"), F.lit(0)).alias("t")).first()["t"]
    given = None
    for depth, level in enumerate(LEVELS):
        at = nodes.groupBy(*keys[: depth + 1]).agg(F.sum("room").alias("room"))
        if given is None:
            at = at.withColumn("budget", F.least(F.lit(total).cast("long"), F.sum("room").over(Window.partitionBy(F.lit(0)))))
        else:
            at = at.join(given, keys[:depth])
        given = _shared_out(at, keys[:depth] or [F.lit(0)], mixture, level).select(*keys[: depth + 1], "budget")
    out = leaves.join(given, keys).withColumnRenamed("budget", "quota")
    some = F.col("have") > 0
    return out.select(*keys, "have", "quota", F.when(some, F.expr("quota div have")).otherwise(0).alias("epochs"), F.when(some, F.expr("quota % have")).otherwise(0).alias("rest"))


def plan(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Each leaf's quota, whole epochs, and the key up to which the next epoch's documents are taken."""
    keys = [f"m_{x}" for x in LEVELS]
    rows = table(docs.select(F.col("doc_id"), *(c.alias(k) for k, c in _leaf_columns(mixture).items()), tokens().alias("n")), "mix-rows")
    leaves = table(rows.groupBy(*keys).agg(F.sum("n").alias("have")), "mix-leaves")
    quota = table(quotas(leaves, mixture), "mix-quotas")
    keyed = rows.join(quota.filter("rest > 0"), keys).withColumn("key", _key(mixture, F.col("epochs")))
    sums = keyed.groupBy(*keys, "rest", F.substring("key", 1, PREFIX).alias("bucket")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = table(sums.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))).groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b")).select(*keys, "b.*"), "mix-cuts")
    inside = keyed.withColumn("bucket", F.substring("key", 1, PREFIX)).join(cut, [*keys, "bucket"]).groupBy(*keys, "bucket", "rest", "before", "key").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.filter("upto <= rest").groupBy(*keys).agg(F.max("key").alias("last"))
    # without any of the bucket's documents, what lies before the bucket
    ends = cut.join(last, keys, "left").select(*keys, F.coalesce("last", "bucket").alias("last_key"))
    return table(quota.join(ends, keys, "left"), "mix-plan")


def _taken(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """doc (all columns of a document as they are), m_domain, m_lang, m_source, m_epoch: a row each time it is taken."""
    keys = [f"m_{x}" for x in LEVELS]
    planned = plan(docs, mixture).select(*keys, F.col("epochs").alias("m_epochs"), F.col("rest").alias("m_rest"), F.col("last_key").alias("m_last"))
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", *(c.alias(k) for k, c in _leaf_columns(mixture).items())).join(planned, keys)
    more = (F.col("m_rest") > 0) & (_key(mixture, F.col("m_epochs")) <= F.col("m_last"))
    times = F.col("m_epochs") + F.coalesce(more.cast("long"), F.lit(0))
    return rows.withColumn("m_times", times).filter("m_times > 0").withColumn("m_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_times") - 1)))


def mixed(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch: a row each time a document is taken."""
    own = docs.select("doc_id", "text", "lang", "source")
    rows = _taken(own, mixture or Mixture())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), tokens("doc.text").alias("tokens"), F.col("m_epoch").alias("epoch"))


def mixed_documents(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """The documents of the mixture with their columns; one taken in several epochs stands there as often."""
    return _taken(docs, mixture or Mixture()).select("doc.*")


def oracle(mixture: Mixture | None = None) -> str:
    """The same in DuckDB, with a running sum over each whole leaf."""
    m = mixture or Mixture()
    step = """
    {name}_a AS (SELECT *, {w} AS w FROM {name}_0),
    {name}_b AS (SELECT *, sum(room) OVER (PARTITION BY {by} ORDER BY room / w, {level} ROWS UNBOUNDED PRECEDING) - room AS filled,
        sum(w) OVER (PARTITION BY {by} ORDER BY room / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM {name}_a),
    {name}_c AS (SELECT *, room * left_w <= w * (budget - filled) AS is_full FROM {name}_b),
    {name}_d AS (SELECT *, coalesce(sum(room) FILTER (is_full) OVER (PARTITION BY {by}), 0) AS spent, sum(w) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS open_w FROM {name}_c),
    {name} AS (SELECT {keys}, CASE WHEN is_full THEN room ELSE ((budget - spent) * w) // open_w END AS budget FROM {name}_d)"""
    parts = [
        step.format(name="l1", w=m.weight_sql("domain"), by="0", level="domain", keys="domain"),
        "l2_0 AS (SELECT domain, lang, sum(room) AS room, any_value(budget) AS budget FROM leaves JOIN l1 USING (domain) GROUP BY domain, lang)",
        step.format(name="l2", w=m.weight_sql("lang"), by="domain", level="lang", keys="domain, lang"),
        "l3_0 AS (SELECT domain, lang, source, room, budget FROM leaves JOIN l2 USING (domain, lang))",
        step.format(name="l3", w=m.weight_sql("source"), by="domain, lang", level="source", keys="domain, lang, source"),
    ]
    return f"""
    WITH named AS (SELECT doc_id, text, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source FROM documents),
    rows_ AS (SELECT doc_id, {m.domain_sql()} AS domain, lang, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM named),
    leaves AS (SELECT domain, lang, source, sum(tokens) AS have, sum(tokens) * {m.max_epochs} AS room FROM rows_ GROUP BY ALL),
    l1_0 AS (SELECT domain, sum(room) AS room, (SELECT least(sum(have) * {m.percent} // 100, sum(room)) FROM leaves) AS budget FROM leaves GROUP BY domain),
    {",".join(parts)},
    quota AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN budget // have ELSE 0 END AS epochs, CASE WHEN have > 0 THEN budget % have ELSE 0 END AS rest FROM l3 JOIN leaves USING (domain, lang, source)),
    keyed AS (SELECT *, md5('{m.seed}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM rows_ JOIN quota USING (domain, lang, source)),
    summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM keyed),
    times AS (SELECT *, epochs::BIGINT + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed)
    SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(n))::BIGINT AS epoch FROM times WHERE n > 0"""
