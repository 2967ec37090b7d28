"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain > language > source. A token budget flows from the root: at each node the
children share it by weight, a child never gets more than its subtree can supply (its tokens
times ``max_epochs``), and what a short child cannot take goes to its siblings; only what all
siblings together cannot take stays with the parent's siblings, since the parent itself was
capped by the same subtree supply one level up.

A leaf with budget b and supply s takes b // s whole epochs of its documents and a token-prefix
of the next epoch, in the order of a seeded hash of (seed, epoch, doc_id). The prefix is turned
into one cut-off key per leaf: summed ranges of the hash say in which range it lies, that range is
cut into 4096 finer ones, and so on until it holds few enough rows to sort. No task ever sorts a
large part of a leaf, and the documents themselves only meet a table with one row per leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.llm.common import scratch

LEAF = ["domain", "lang", "source"]
#: Digits of a hash by which a range is refined, and rows of a range that are sorted.
DIGITS, SORTED_ROWS = 3, 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixTargets:
    """Positive integer weights by name at each level; names that are not listed get ``other``."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def weight(self, level: str) -> Column:
        table = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        if any(w <= 0 for w in [*table.values(), self.other]):
            raise ValueError("weights must be positive")
        out = F.lit(self.other)
        for name, w in table.items():
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("long")


def n_tokens(text: Column) -> Column:
    """Tokens counted as runs of characters outside ``[\\x20\\x09-\\x0D]``; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Share ``budget`` of each parent among its children by ``weight``, each up to ``cap``.

    In the order of cap / weight the children that take their whole cap come first; the others
    share what is left by weight. Adds ``share``.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), level)
    whole = Window.partitionBy(*parent)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fill = (F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))) / (
        F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")
    )
    marked = children.withColumn("full", F.col("cap") / F.col("weight") <= fill)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    return marked.withColumn(
        "share", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * ((F.col("budget") - taken) / F.nullif(open_weight, F.lit(0))))
    )


def leaf_budgets(leaves: DataFrame, targets: MixTargets, budget_fraction: float, max_epochs: int) -> DataFrame:
    """Integer token budgets for leaves (domain, lang, source, supply)."""
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = leaves.agg(F.floor(F.sum("supply") * F.lit(budget_fraction)).cast("double").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # total is one row
    domains = water_fill(domains.withColumn("weight", targets.weight("domain")).withColumn("root", F.lit(0)), ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = water_fill(langs.withColumn("weight", targets.weight("lang")), ["domain"], "lang")
    found = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    found = water_fill(found.withColumn("weight", targets.weight("source")), ["domain", "lang"], "source")
    budget = F.floor("share").cast("long")
    return found.select(*LEAF, "supply", budget.alias("leaf_budget")).withColumns(
        {"epochs": F.expr("leaf_budget div supply"), "rest": F.col("leaf_budget") % F.col("supply")}
    )


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch of its leaf, as sortable text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    domain: Column,
    targets: MixTargets,
    budget_fraction: float = 0.5,
    max_epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """The selected rows of ``docs`` with domain, n_tokens, leaf_budget and copies (epochs it is in).

    domain: a column over ``docs`` that names each row's domain. The budget is that fraction of all
    tokens. Null text has no tokens; null domain, lang and source count as the name 'unknown'.
    Leaves without tokens get nothing. Rows that repeat a doc_id stand at the same place of an
    epoch and are taken or left together. An empty table gives an empty one. Columns of ``docs``
    with the names of new ones are replaced.
    """
    docs = docs.drop("n_tokens", "leaf_budget", "copies")
    own = "mix_"  # before the names of helping columns; other than those of docs
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    leaf_of = {f"{own}domain": named(domain), f"{own}lang": named(F.col("lang")), f"{own}source": named(F.col("source"))}
    wide = docs.withColumns(leaf_of | {"n_tokens": n_tokens(F.col("text"))})
    narrow = scratch(wide.select("doc_id", "n_tokens", *[F.col(f"{own}{x}").alias(x) for x in LEAF]).where("n_tokens > 0"), "tokens")
    leaves = narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    plan = scratch(leaf_budgets(leaves, targets, budget_fraction, max_epochs), "budgets")
    largest = narrow.groupBy(*LEAF).count().agg(F.max("count")).first()[0] or 0
    cuts = cut_keys(narrow, plan, seed, largest)
    plan = scratch(plan.join(cuts, LEAF, "left"), "cuts").select(
        *[F.col(x).alias(f"{own}{x}") for x in LEAF], "leaf_budget", F.col("epochs").alias(f"{own}epochs"), F.col("cut").alias(f"{own}cut")
    )
    chosen = wide.where("n_tokens > 0").join(plan, list(leaf_of))
    partial = F.coalesce(epoch_key(seed, F.col(f"{own}epochs"), F.col("doc_id")) <= F.col(f"{own}cut"), F.lit(False))
    kept = chosen.withColumn("copies", F.col(f"{own}epochs") + partial.cast("long")).where("copies > 0")
    return kept.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() != "domain"], F.col(f"{own}domain").alias("domain"), "n_tokens", "leaf_budget", "copies"
    )


def cut_keys(narrow: DataFrame, plan: DataFrame, seed: int, largest: int) -> DataFrame:
    """(domain, lang, source, cut): the last key of each leaf's token-prefix, for leaves that have one.

    narrow: (doc_id, n_tokens, domain, lang, source); largest: rows of the largest leaf, which says
    how often ranges are refined.
    """
    keyed = narrow.join(plan.where("rest > 0").select(*LEAF, "epochs", "rest"), LEAF)
    keyed = keyed.withColumn("key", epoch_key(seed, F.col("epochs"), F.col("doc_id"))).drop("epochs")
    edge = plan.where("rest > 0").select(*LEAF, F.lit("").alias("range"), F.lit(0).cast("long").alias("before"))
    level, left = 0, largest
    while level == 0 or left > SORTED_ROWS:
        # the one range of each leaf where the prefix ends
        inside = keyed.join(edge, LEAF).where(F.substring("key", 1, level * DIGITS) == F.col("range")).drop("range")
        level, left = level + 1, left / 16**DIGITS
        ranges = inside.groupBy(*LEAF, F.substring("key", 1, level * DIGITS).alias("range")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("range"))
        ranges = ranges.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        edge = scratch(ranges.where("before <= rest and upto > rest").select(*LEAF, "range", "before"), "edges")
    at_edge = keyed.join(edge, LEAF).where(F.substring("key", 1, level * DIGITS) == F.col("range"))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))
    inside = at_edge.withColumn("upto", running).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return edge.join(inside, LEAF, "left").select(*LEAF, F.coalesce("cut", "range").alias("cut"))


#: Documents have no domain column; the query takes it from the number in the source's name.
DOMAINS = ("web", "books", "forum")
TARGETS = MixTargets(
    domains={"web": 5, "books": 3, "forum": 2},
    langs={"en": 5, "de": 2, "fr": 2, "es": 1},
    sources={"src0": 1},
)


def source_domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 3
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number + 1)


def op3_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, source_domain(F.col("source")), TARGETS).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies"
    )


def _fill_sql(name: str, children: str, parent: str, level: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""
{name}_a AS (
  SELECT *, (budget - (sum(cap) OVER o - cap))
            / (sum(weight) OVER ({by}) - sum(weight) OVER o + weight) AS fill
  FROM {children} WINDOW o AS ({by}ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING)
), {name}_b AS (SELECT *, cap / weight <= fill AS is_full FROM {name}_a
), {name} AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * ((budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}))
         / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}), 0)) END AS share
  FROM {name}_b
)"""


OP3_SQL = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s,
         CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END AS domain,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, l, s, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM t WHERE n_tokens > 0 GROUP BY ALL
), d0 AS (
  SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS weight,
         (SELECT CAST(floor(sum(supply) * CAST(0.5 AS DOUBLE)) AS DOUBLE) FROM leaves) AS budget
  FROM leaves GROUP BY domain
), {_fill_sql("d", "d0", "", "domain")}, l0 AS (
  SELECT x.domain, x.l, CAST(sum(x.cap) AS BIGINT) AS cap, CASE x.l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(d.share) AS budget
  FROM leaves x JOIN d USING (domain) GROUP BY x.domain, x.l
), {_fill_sql("g", "l0", "domain", "l")}, s0 AS (
  SELECT x.domain, x.l, x.s, x.supply, x.cap, 1 AS weight, g.share AS budget FROM leaves x JOIN g USING (domain, l)
), {_fill_sql("f", "s0", "domain, l", "s")}, plan AS (
  SELECT domain, l, s, supply, CAST(floor(share) AS BIGINT) AS leaf_budget FROM f
), keyed AS (
  SELECT t.*, leaf_budget, leaf_budget // supply AS epochs, leaf_budget % supply AS rest,
         md5('17:' || CAST(leaf_budget // supply AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key
  FROM t JOIN plan USING (domain, l, s) WHERE n_tokens > 0
), ranked AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key) AS upto FROM keyed
)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ranked WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
