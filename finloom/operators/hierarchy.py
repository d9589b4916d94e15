"""Parent-child hierarchies as DataFrames.

Ancestor chains are found by doubling: after k joins every row knows 2^k
ancestors, so depth 10 takes at most four rounds and no collected state.
Chains are arrays bounded by the depth limit.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.columns import effective_on
from finloom.schemas import FACTOR, TOTAL
from finloom.session import materialise


def ancestor_chains(rows: DataFrame, key: str, parent: Column, item: Column, length: int) -> DataFrame:
    """(key, chain, beyond): ``item`` of the row, its parent, grandparent, ...

    ``chain`` holds at least ``length`` items unless the ancestors end first;
    ``beyond`` is the id that would follow, null when the top was reached. A
    ``beyond`` that names no row stays set.
    """
    chains = rows.select(F.col(key), F.array(item).alias("chain"), parent.alias("beyond"), parent.isNotNull().alias("_open"))
    rounds = max(1, math.ceil(math.log2(length)))
    for done in range(1, rounds + 1):
        upper = chains.select(
            F.col(key).alias("_at"),
            F.lit(True).alias("_wanted"),
            F.col("chain").alias("_more"),
            F.col("beyond").alias("_next"),
            F.col("_open").alias("_next_open"),
        )
        # finished chains ask for their own key, which spreads them over the partitions, and match nothing
        lower = chains.withColumn("_at", F.when(F.col("_open"), F.col("beyond")).otherwise(F.col(key)))
        lower = lower.withColumnRenamed("_open", "_wanted")
        found = F.col("_more").isNotNull()
        chains = lower.join(upper, ["_at", "_wanted"], "left").select(
            key,
            F.when(found, F.concat("chain", "_more")).otherwise(F.col("chain")).alias("chain"),
            F.when(found, F.col("_next")).otherwise(F.col("beyond")).alias("beyond"),
            F.coalesce("_next_open", F.lit(False)).alias("_open"),
        )
        if done % 3 == 0 and done < rounds:
            # each round doubles the plan, so it is cut here; most hierarchies are complete by now
            chains = materialise(chains, "chains")
            if chains.filter("_open").isEmpty():
                break
    return chains.drop("_open")


def explode_hierarchy(
    cost_centers: DataFrame,
    as_of: dt.date,
    root: int | None = None,
    max_depth: int = 10,
    include_inactive: bool = False,
) -> DataFrame:
    """Every node below the roots with level, paths, leaf flag, child count and weight.

    Without ``root`` the parentless nodes are roots and skip the active and
    effective-date tests; an explicit root must pass them.
    """
    allowed = effective_on(as_of)
    if not include_inactive:
        allowed = F.col("is_active") & allowed
    parent = F.col("parent_id") if root is None else F.when(F.col("cost_center_id") != root, F.col("parent_id"))
    item = F.struct(
        F.col("cost_center_id").alias("id"),
        F.col("name").alias("name"),
        F.col("weight").alias("weight"),
        allowed.alias("allowed"),
    )
    chains = ancestor_chains(cost_centers, "cost_center_id", parent, item, max_depth + 1)

    top = F.element_at("chain", -1)
    tested = F.slice("chain", F.lit(1), F.size("chain") - 1) if root is None else F.col("chain")
    reached = chains.filter(
        F.col("beyond").isNull() & (F.size("chain") <= max_depth + 1) & F.forall(tested, lambda s: s["allowed"])
    )
    if root is not None:
        reached = reached.filter(top["id"] == root)

    down = F.reverse("chain")
    start = F.element_at(down, 1)["weight"].cast(FACTOR)
    nodes = reached.select(
        "cost_center_id",
        (F.size("chain") - 1).alias("level"),
        F.array_join(F.transform(down, lambda s: s["name"]), " > ").alias("path"),
        F.array_join(F.transform(down, lambda s: F.lpad(s["id"].cast("string"), 10, "0")), "/").alias("sort_path"),
        F.aggregate(
            F.slice(down, F.lit(2), F.size(down)), start, lambda acc, s: (acc * s["weight"]).cast(FACTOR)
        ).alias("cumulative_weight"),
        F.transform(down, lambda s: s["id"]).alias("path_ids"),
    )
    attributes = cost_centers.select("cost_center_id", "code", "name", "parent_id")
    nodes = nodes.join(attributes, "cost_center_id")

    with_children = cost_centers.filter(F.col("parent_id").isNotNull())
    if not include_inactive:
        with_children = with_children.filter("is_active")
    with_children = with_children.select(F.col("parent_id").alias("cost_center_id")).distinct().withColumn("_parent", F.lit(True))
    child_count = nodes.groupBy(F.col("parent_id").alias("cost_center_id")).agg(F.count("*").alias("_children"))
    return (
        nodes.join(with_children, "cost_center_id", "left")
        .join(child_count, "cost_center_id", "left")
        .select(
            "cost_center_id",
            "code",
            "name",
            "parent_id",
            "level",
            "path",
            "sort_path",
            F.col("_parent").isNull().alias("is_leaf"),
            F.coalesce("_children", F.lit(0)).cast("int").alias("child_count"),
            "cumulative_weight",
            "path_ids",
        )
    )


def hierarchy_path(cost_centers: DataFrame, delimiter: str = " > ", max_depth: int = 20) -> DataFrame:
    """Name path from the top for every node; at most ``max_depth`` names."""
    chains = ancestor_chains(cost_centers, "cost_center_id", F.col("parent_id"), F.col("name"), max_depth)
    names = F.reverse(F.slice("chain", 1, max_depth))
    return chains.select("cost_center_id", F.array_join(names, delimiter).alias("path"))


def processing_order(nodes: DataFrame) -> list[Column]:
    """Bottom-up order of exploded nodes."""
    return [F.col("level").desc(), F.col("cost_center_id")]


def hierarchy_rollup(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Amount of every node with all its descendants.

    Lines are summed per cost centre first; only those sums are spread over
    the ancestors, at most one row per level.
    """
    own = lines.groupBy("cost_center_id").agg(F.sum("final_amount").cast(TOTAL).alias("own_amount"))
    spread = (
        nodes.select("cost_center_id", "path_ids")
        .join(own, "cost_center_id")
        .select(F.explode("path_ids").alias("cost_center_id"), "own_amount")
    )
    subtotal = spread.groupBy("cost_center_id").agg(F.sum("own_amount").cast(TOTAL).alias("subtotal_amount"))
    zero = F.lit(0).cast(TOTAL)
    return (
        nodes.select("cost_center_id", "parent_id", "level")
        .join(own, "cost_center_id", "left")
        .join(subtotal, "cost_center_id", "left")
        .select(
            "cost_center_id",
            "parent_id",
            "level",
            F.coalesce("own_amount", zero).alias("own_amount"),
            F.coalesce("subtotal_amount", zero).alias("subtotal_amount"),
        )
    )


def rule_closure(rules: DataFrame, as_of: dt.date, rule_ids: list[int] | None = None, max_level: int = 10) -> DataFrame:
    """(rule_id, depends_on, level): direct and transitive dependencies of active rules.

    A chain stops where it would meet a rule again.
    """
    active = rules.filter(F.col("is_active") & F.col("depends_on").isNotNull())
    if rule_ids is None:
        active = active.filter(effective_on(as_of))
    else:
        active = active.filter(F.col("rule_id").isin(rule_ids))
    chains = ancestor_chains(active, "rule_id", F.col("depends_on"), F.col("depends_on"), max_level)
    seen = F.concat(F.array("rule_id"), "chain")
    steps = chains.select("rule_id", seen.alias("seen"), F.posexplode(F.slice("chain", 1, max_level)).alias("pos", "depends_on"))
    repeated = F.col("pos") + 2 != F.array_position("seen", F.col("depends_on"))
    # a repeated rule ends the chain, and everything after it repeats too
    return steps.filter(~repeated | (F.col("pos") == 0)).select(
        "rule_id", "depends_on", (F.col("pos") + 1).alias("level")
    )
