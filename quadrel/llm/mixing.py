"""Mixing of sources to target weights by hierarchical budgets.

Leaves are paths of a tree (domain, language, source). A token budget flows from the
root: each node deals it to its children by their weights; a child gets no more than
its leaves can give (their tokens times `max_epochs`); what it cannot take goes to
its siblings, and to the siblings of its parent only when all of them are full.
This water filling is exact in closed form: sorted by capacity over weight, the
children up to some point are full and the rest share what is left by weight.

A leaf's documents are read in seeded order, epoch by epoch: whole epochs, then the
shortest prefix of the next that reaches the budget. The order is a hash of seed,
epoch and id. The prefix is found without sorting a leaf: tokens are summed for
slices of the hash range, and only the slice that holds the end is ranked. What joins the
documents is a row for each leaf.

Defined results. Tokens are words [^\\x20\\x09-\\x0D]+; null or empty text has none and
is taken with the epoch it falls in at no cost. Null parts of a path are the part
''. A text longer than a budget is taken if any of the budget is left. Weights that are not given are `default_weight`; a weight of 0 gives no budget.
Rows that repeat an id are taken or left together. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents of one slice of a leaf's hash range, about.
SLICE_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Words of a text, counted without splitting it: starts of runs that are not blank."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _deal(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds budget to children (weight, capacity, total of their parent): exact water filling."""
    by = ", ".join(parent) if parent else "1"
    over = f"partition by {by} order by (case when weight > 0 then capacity / weight else 0 end), node"
    run = children.withColumn("full_before", F.expr(f"coalesce(sum(case when weight > 0 then capacity else 0 end) over ({over} rows between unbounded preceding and 1 preceding), 0)"))
    run = run.withColumn("weight_left", F.expr(f"sum(weight) over ({over} rows between current row and unbounded following)"))
    # The share if all before are full and this and the rest divide what is left.
    level = F.expr("case when weight > 0 then greatest(total - full_before, 0) / weight_left else 0 end")
    run = run.withColumn("own_level", level)
    run = run.withColumn("is_full", F.expr("weight > 0 and capacity <= own_level * weight"))
    # The first child that is not full sets the level of all after it.
    run = run.withColumn("open_level", F.expr(f"(min(case when weight > 0 and not is_full then struct(full_before, own_level) end) over (partition by {by})).own_level"))
    budget = F.expr("case when weight <= 0 then 0 when is_full then capacity else least(capacity, open_level * weight) end")
    return run.withColumn("budget", budget.cast("double")).drop("full_before", "weight_left", "own_level", "is_full", "open_level")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], float], total: Column, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """Adds budget (tokens, double) to leaves (path columns, tokens).

    weights: of a node among its siblings, by its path. The tree has a row for each node; it
    follows the configured mixture, not the corpus.
    """
    spark = leaves.sparkSession
    known = [(*k, *[None] * (len(path) - len(k)), float(w)) for k, w in weights.items()]
    schema = ", ".join([*(f"w_{c} string" for c in path), "w double"])
    weighted = spark.createDataFrame(known, schema)
    leaves = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    dealt = None
    for depth in range(1, len(path) + 1):
        head, parent = path[:depth], path[: depth - 1]
        nodes = leaves.groupBy(*head).agg(F.sum("capacity").alias("capacity"))
        match = [F.col(f"w_{c}").eqNullSafe(F.col(c)) if c in head else F.col(f"w_{c}").isNull() for c in path]
        on = match[0]
        for m in match[1:]:
            on = on & m
        nodes = nodes.join(weighted, on, "left").withColumn("weight", F.coalesce("w", F.lit(default_weight)).cast("double")).drop("w", *(f"w_{c}" for c in path))
        nodes = nodes.withColumn("total", total.cast("double")) if dealt is None else nodes.join(dealt, parent)
        dealt = _deal(nodes.withColumn("node", F.col(head[-1])), parent).select(*head, F.col("budget").alias("total"))
    return leaves.drop("capacity").join(dealt.withColumnRenamed("total", "budget"), path)


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch, 0 to 2**48 - 1: leading digits of a hash that any SQL engine has."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    path: dict[str, Column],
    weights: dict[tuple[str, ...], float],
    budget_share: float,
    max_epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, the path, n_tokens, leaf_tokens, leaf_budget, copies.

    budget_share: the budget, in tokens of the whole input. copies: how often a document is taken.
    """
    cols = list(path)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), *(F.coalesce(e.cast("string"), F.lit("")).alias(c) for c, e in path.items()), count_words(F.col(text_col).cast("string")).alias("n_tokens"))
    rows = common.store(rows, "leaves")
    leaves = rows.groupBy(*cols).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    leaves = common.store(leaves, "leafs", few=True)
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaf_budgets(leaves, cols, weights, F.lit(float(whole) * budget_share), max_epochs)
    # Whole epochs, and what is left for a prefix of the next; the cut to 1e-6 hides rounding only.
    budgets = budgets.withColumn("leaf_budget", F.round("budget", 6))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(0).cast("long")
    budgets = budgets.withColumn("epochs", epochs).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("tokens"))
    budgets = budgets.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / slice_rows)).cast("long"))
    budgets = common.store(budgets.select(*cols, "tokens", "leaf_budget", "epochs", "rest", "slices"), "budgets", few=True)

    # The slice of each leaf in which its last epoch ends: from sums, a row for each slice.
    def placed(leaf: DataFrame) -> DataFrame:
        at = rows.join(common.small(leaf), cols)
        at = at.withColumn("place", _place(seed, F.col("epochs"), F.col("doc_id")))
        return at.withColumn("slice", F.floor(F.col("place") * F.col("slices") / F.lit(float(1 << 48))).cast("long"))

    by = ", ".join(cols)
    sums = placed(budgets).groupBy(*cols, "rest", "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    sums = sums.withColumn("slice_start", F.expr(f"sum(slice_tokens) over (partition by {by} order by slice) - slice_tokens"))
    sums = sums.where("slice_start < rest and slice_start + slice_tokens >= rest").select(*cols, F.col("slice").alias("end_slice"), "slice_start")
    ends = common.store(budgets.join(sums, cols), "ends", few=True)
    # The last place that is taken; rows of one place (repeated ids) share the tokens before them.
    ranked = placed(ends).where("slice = end_slice")
    ranked = ranked.withColumn("before", F.expr(f"slice_start + coalesce(sum(n_tokens) over (partition by {by} order by place range between unbounded preceding and 1 preceding), 0)"))
    cuts = ranked.where("before < rest").groupBy(*cols).agg(F.max("place").alias("cut"))
    cuts = common.store(budgets.join(cuts, cols, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))), "cuts", few=True)
    out = placed(cuts).withColumn("taken", F.col("place") <= F.col("cut"))
    return out.select("doc_id", *cols, "n_tokens", F.col("tokens").alias("leaf_tokens"), "leaf_budget", (F.col("epochs") + F.col("taken").cast("long")).alias("copies"))
