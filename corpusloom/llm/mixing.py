"""Mixing sources to target weights by budgets on a domain-language-source tree.

DataFrame operations only. Cost at scale: texts are read once to count tokens; budgets are windows
over tree nodes; the seeded order of all leaves is one range partitioning with prefix sums from part
totals, so that a leaf with a third of all rows, or of rows with the same or no id, is many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order, row_key, with_keys

LEAF = ["domain", "lang", "source"]
SMALL = 100_000  # leaves that may be broadcast
#: Tokens are runs of other than ASCII white space.
TOKEN = r"[^ \t\n\r\f\x0B]+"

DOMAIN_WEIGHTS = {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def source_domain(source: Column) -> Column:
    """The domain of a source by the number its name ends in: dom0 to dom3, other without one."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(
        F.concat(F.lit("dom"), (number.cast("bigint") % 4).cast("string"))
    )


def _weight(column: str, weights: dict[str, int], other: int) -> Column:
    cases = F.lit(other)
    for key, weight in weights.items():
        cases = F.when(F.col(column) == key, weight).otherwise(cases)
    return cases.cast("bigint")


def share_budget(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Deal each parent's `budget` to its children by weight, none above its `capacity`.

    What a full child leaves goes to its siblings by their weights. With the children in order of
    capacity over weight, the level that every open child gets a unit of weight is the largest of
    (budget - capacity before) / (weight from here on).
    """
    order = Window.partitionBy(*parent).orderBy("ratio", key)
    used = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)))
        .withColumn("level", F.when(weight_left > 0, (F.col("budget") - used) / weight_left))
        .withColumn("level", F.coalesce(F.max("level").over(Window.partitionBy(*parent)), F.lit(0.0)))
        .withColumn("budget", F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("level")))
        .drop("ratio", "level", "weight")
    )


def leaf_budgets(
    leaves: DataFrame,
    budget: Column,
    domain_weights: dict[str, int],
    lang_weights: dict[str, int],
    source_weights: dict[str, int],
    max_epochs: int,
) -> DataFrame:
    """(domain, lang, source, leaf_tokens) -> the same with `budget` tokens, whole, for each leaf.

    A node can take max_epochs times its tokens; one of weight 0 nothing. Budgets go from the root
    down, limited by what a node's leaves can take, so that a short leaf is made up for by its
    siblings first, and only a node short as a whole by its ancestors' other children.
    """
    nodes = (
        leaves.withColumn("w3", _weight("source", source_weights, 1))
        .withColumn("w2", _weight("lang", lang_weights, 1))
        .withColumn("w1", _weight("domain", domain_weights, 1))
        .withColumn(
            "capacity",
            F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("leaf_tokens") * max_epochs).otherwise(0),
        )
    )
    langs = nodes.groupBy("domain", "lang", "w1", "w2").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain", "w1").agg(F.sum("capacity").alias("capacity"))
    everything = F.sum("capacity").over(Window.partitionBy("root"))
    top = domains.withColumn("root", F.lit(0)).select(
        "root", "domain", "capacity", F.col("w1").alias("weight"), F.least(budget, everything).cast("double").alias("budget")
    )
    by_domain = share_budget(top, ["root"], "domain").select("domain", "budget")
    middle = langs.join(by_domain, "domain").select("domain", "lang", "capacity", F.col("w2").alias("weight"), "budget")
    by_lang = share_budget(middle, ["domain"], "lang").select("domain", "lang", "budget")
    low = nodes.join(by_lang, ["domain", "lang"]).select(
        *LEAF, "leaf_tokens", "capacity", F.col("w3").alias("weight"), "budget"
    )
    return share_budget(low, ["domain", "lang"], "source").select(
        *LEAF, "leaf_tokens", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget")
    )


def mix_sources(
    docs: DataFrame,
    budget_share: float = 0.6,
    max_epochs: int = 4,
    seed: int = 17,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    lang_weights: dict[str, int] = LANG_WEIGHTS,
    source_weights: dict[str, int] | None = None,
    domain: Column | None = None,
    passed: tuple[str, ...] = (),
) -> DataFrame:
    """The documents chosen to fill budget_share of all tokens by weight, and how often each counts.

    Returns doc_id, domain, lang, source, n_tokens, copies (at least 1) and the columns `passed` of chosen rows. A leaf
    is read in whole epochs while its budget lasts, then up to the budget in an epoch's order: that
    of md5(seed:epoch:doc_id). The last part ends before the first document that would pass the
    budget. A null language, source or domain is 'unknown' ('other' as a domain); a null text has no tokens; documents
    without tokens cost nothing. Ties of the hash are ordered by doc_id and tokens; repeated rows
    count each. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(source_domain(F.col("source")) if domain is None else domain, F.lit("other")).alias("domain"),
            F.coalesce("lang", F.lit("unknown")).alias("lang"),
            F.coalesce("source", F.lit("unknown")).alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("n_tokens"),
            *passed,
        )
    )
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("leaf_tokens"))
    total = leaves.agg(F.sum("leaf_tokens")).first()[0] or 0
    target = int(total * budget_share)
    plan = leaf_budgets(
        leaves, F.lit(target), domain_weights, lang_weights, source_weights or {}, max_epochs
    ).select(
        *LEAF,
        F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(0).alias("epochs"),
        F.when(F.col("leaf_tokens") > 0, F.expr("budget % leaf_tokens")).otherwise(0).alias("rest"),
    )
    plan = cut(plan)

    order_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = rows.join(F.broadcast(plan) if plan.count() <= SMALL else plan, LEAF).withColumn("order_key", order_key)
    # Ranges of the whole order, cut inside a leaf and among rows alike, so no leaf or key is one task.
    placed = in_order(keyed, [*LEAF, "order_key", "doc_id", "n_tokens", *passed], ("n_tokens",))
    starts = placed.groupBy(*LEAF).agg(F.min("n_tokens_before").alias("leaf_start"))
    dealt = placed.join(F.broadcast(starts) if plan.count() <= SMALL else starts, LEAF)
    ends = F.col("n_tokens_before") + F.col("n_tokens") - F.col("leaf_start")
    copies = F.least(F.col("epochs") + F.when(ends <= F.col("rest"), 1).otherwise(0), F.lit(max_epochs)).cast("int")
    return dealt.select("doc_id", *LEAF, "n_tokens", copies.alias("copies"), *passed).where("copies > 0")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that mix_sources() chooses, each once; rows with the same doc_id are told apart by text."""
    keyed = docs.select("doc_id", "text", "lang", "source", row_key(docs).alias("key"))
    return with_keys(docs, mix_sources(keyed, passed=("key",), **options).select("key").distinct(), "left_semi")
