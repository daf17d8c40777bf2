"""Mixing sources to target weights by hierarchical budgeting, DataFrame operations only.

The tree is domain, language, source. A token is a word. Capacities (supply times the epochs
allowed) are added up from the leaves; the budget is handed down. At each node the budget is
shared in proportion to the children's weights; a child that cannot use its share gives the
shortage to its siblings, and only what a whole subtree cannot use passes to the node above,
since a node never receives more than it can hold. Whole numbers throughout, rounded down, so
at most a token per node is left unspent.

A leaf with budget b and supply s takes b // s whole epochs and a prefix of b % s tokens of
the next epoch, whose order is a hash of seed, epoch and doc_id. The prefix ends at a border
key found by radix selection: token sums per 4096 key ranges (map-side combined), then per
4096 parts of the one range that holds the border, then the few rows left. No leaf is sorted
or collected, however hot. The document at the border is taken; ``taken`` says how many of
its tokens count.

Tree tables have a row per source; windows run over the children of one node and over the
4096 ranges of one leaf. The only join against documents is on the leaf, whose table the
planner may broadcast when small; otherwise adaptive skew handling splits hot leaves.

Edge cases: null lang and source are taken as empty; null text has no tokens; a weight that is
not named is the default, and a weight of 0 gives nothing; a leaf without tokens gets nothing;
rows that repeat a doc_id in a leaf have one key, so at the border all of them are taken, each
with at most the tokens left there; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.llm.common import WORD, kept, text_of

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Targets:
    """Whole-number weights by name; ``other`` for names that are not listed."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    budget_percent: int = 80  # of all tokens of the input
    max_epochs: int = 3
    seed: str = "mix-1"


def _weight(level: str, targets: Targets) -> Column:
    named = getattr(targets, level)
    out = F.lit(targets.other)
    for name, value in named.items():
        out = F.when(F.col(level) == name, F.lit(value)).otherwise(out)
    return out.cast("bigint")


def _decimal(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _shared(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """``nodes`` (weight, capacity, given) with ``budget``: the part of ``given`` each gets.

    Children are filled in order of capacity per unit of weight: one is full if its capacity
    is no more than its part of what the fuller ones before it have left.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0))
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = family.orderBy("ratio", child)
    before = F.coalesce(
        F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumn("ratio", ratio).withColumns({"before": before, "after": after})
    full = _decimal(F.col("capacity")) * _decimal(F.col("after")) <= (
        _decimal(F.col("given") - F.col("before")) * _decimal(F.col("weight")))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumns({
        "spent": F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(F.lit(0))).over(family),
        "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(F.lit(0))).over(family),
    })
    part = F.expr(
        "cast((cast(given - spent as decimal(19,0)) * cast(weight as decimal(19,0)))"
        " div cast(open as decimal(19,0)) as bigint)"
    )
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(part)
    return nodes.withColumn("budget", budget).drop(
        "ratio", "before", "after", "full", "spent", "open", "given")


def leaf_budgets(leaves: DataFrame, targets: Targets, total: int) -> DataFrame:
    """Per leaf of (domain, lang, source, supply): budget, whole epochs, tokens of the next."""
    weights = {f"weight_{c}": _weight(c, targets) for c in LEAF}
    usable = F.least(*[F.col(w) for w in weights]) > 0
    leaves = leaves.withColumns(weights).withColumn(
        "capacity", F.when(usable, F.col("supply") * targets.max_epochs).otherwise(F.lit(0)))
    capacity = F.sum("capacity").alias("capacity")
    langs = leaves.groupBy("domain", "lang").agg(
        capacity, F.max("weight_lang").alias("weight"))
    domains = leaves.groupBy("domain").agg(capacity, F.max("weight_domain").alias("weight"))
    budget = total * targets.budget_percent // 100
    down = _shared(domains.withColumn("given", F.lit(budget).cast("bigint")), [], "domain")
    for level, nodes in ((2, langs), (3, leaves.withColumn("weight", F.col("weight_source")))):
        parents, child = LEAF[: level - 1], LEAF[level - 1]
        given = down.select(*parents, F.col("budget").alias("given"))
        down = _shared(nodes.join(given, parents), parents, child)
    epochs = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0))
    rest = F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(F.lit(0))
    return down.select(
        *LEAF, "supply", "budget", epochs.cast("bigint").alias("epochs"), rest.alias("rest"))


def order_key(targets: Targets, epoch: Column, doc: Column) -> Column:
    """32 hex digits that order the documents of a leaf in one epoch."""
    doc = F.coalesce(doc.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(targets.seed), epoch.cast("string"), doc))


def _crossing(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Per leaf the ``part`` that holds the border, and the tokens before it."""
    upto = W.partitionBy(*LEAF).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = rows.groupBy(*LEAF, *keys, part, "rest").agg(F.sum("n_tokens").alias("tokens"))
    sums = sums.withColumn("upto", F.sum("tokens").over(upto))
    if "before" in keys:
        sums = sums.withColumn("upto", F.col("upto") + F.col("before"))
    hit = (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest"))
    return sums.where(hit).select(*LEAF, part, (F.col("upto") - F.col("tokens")).alias("before"))


def _borders(keyed: DataFrame) -> DataFrame:
    """Per leaf with a prefix to take: the border key, and the tokens before it."""
    rows = keyed.where("rest > 0").select(*LEAF, "key", "rest", "n_tokens")
    rows = rows.withColumns(
        {"high": F.substring("key", 1, 3), "middle": F.substring("key", 4, 3)})
    first = _crossing(rows, [], "high")
    inside = rows.join(first, [*LEAF, "high"])
    second = _crossing(inside, ["before"], "middle")
    near = inside.drop("before").join(second, [*LEAF, "middle"])
    return _crossing(near, ["before"], "key").withColumnRenamed("key", "border")


def plan_mix(docs: DataFrame, targets: Targets, domain: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, leaf, n_tokens, key; leaf table with epochs, rest, border, before)."""
    slim = kept(
        docs.select(
            "doc_id", F.coalesce(domain, F.lit("")).alias("domain"),
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("n_tokens"),
        ),
        "mix-rows",
    )
    leaves = kept(slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply")), "mix-leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    budgets = kept(leaf_budgets(leaves, targets, total), "mix-budgets")
    keyed = slim.join(budgets, LEAF).withColumn(
        "key", order_key(targets, F.col("epochs"), F.col("doc_id")))
    keyed = kept(keyed, "mix-keys")
    return keyed, kept(budgets.join(_borders(keyed), LEAF, "left"), "mix-plan")


def _copies() -> Column:
    inside = F.coalesce(F.col("key") <= F.col("border"), F.lit(False))
    return F.col("epochs") + inside.cast("bigint")


def mix_report(docs: DataFrame, targets: Targets, domain: Column) -> DataFrame:
    """Per document: doc_id, its leaf, n_tokens, copies, and taken, the tokens that count."""
    keyed, plan = plan_mix(docs, targets, domain)
    rows = keyed.join(plan.select(*LEAF, "border", "before"), LEAF)
    last = (
        F.when(F.col("key") < F.col("border"), F.col("n_tokens"))
        .when(F.col("key") == F.col("border"),
              F.least("n_tokens", F.col("rest") - F.col("before")))
        .otherwise(F.lit(0))
    )
    return rows.select(
        "doc_id", *LEAF, "n_tokens", _copies().alias("copies"),
        (F.col("epochs") * F.col("n_tokens") + last).alias("taken"),
    )


def mixed(docs: DataFrame, targets: Targets, domain: Column) -> DataFrame:
    """``docs`` in the target mixture, columns as they were; a row comes once for each copy."""
    _, plan = plan_mix(docs, targets, domain)
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    ).join(plan.select(*LEAF, "epochs", "border"), LEAF)
    rows = rows.withColumn("key", order_key(targets, F.col("epochs"), F.col("row.doc_id")))
    rows = rows.withColumn("copies", _copies()).where("copies > 0")
    if targets.max_epochs > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select("row.*")
