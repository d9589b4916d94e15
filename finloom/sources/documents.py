"""XML and JSON parameters as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.schemas import RATE

_TARGETS_DDL = (
    "Target array<struct<_CostCenterID:int, _CostCenterCode:string, _AllocationPercentage:decimal(8,6), _Priority:int,"
    " AccountFilter:string, ExcludePattern:string, Conditions:struct<Condition:array<string>>>>"
)
_ENTITIES_DDL = "Entity array<struct<_Code:string, _Name:string, _Include:int>>"


def seasonal_factors(spark: SparkSession, json_text: str | None) -> DataFrame:
    """(month, factor) from a JSON array; twelve times 1 when there is none."""
    if json_text is None:
        months = spark.range(1, 13, 1, 1).select(F.col("id").cast("int").alias("month"))
        return months.withColumn("factor", F.lit(1).cast(RATE))
    values = F.from_json(F.lit(json_text), "array<decimal(8,6)>")
    return spark.range(1).select(F.posexplode(values).alias("pos", "factor")).select((F.col("pos") + 1).alias("month"), "factor")


def factor_of_month(month: Column, json_text: str | None) -> Column:
    """Factor of a month as an expression; null for a month the list does not reach."""
    if json_text is None:
        return F.when(month.between(1, 12), F.lit(1)).cast(RATE)
    return F.get(F.from_json(F.lit(json_text), "array<decimal(8,6)>"), month - 1)


def rule_targets(rules: DataFrame) -> DataFrame:
    """One row per target element of the rules' XML."""
    target = F.explode(F.from_xml("target_spec", _TARGETS_DDL, {"rowTag": "AllocationTargets"})["Target"]).alias("t")
    return rules.select(
        "rule_id", "rule_code", "rule_name", "rule_type", "allocation_method", "sequence",
        "effective_from", "effective_to", F.col("is_active").alias("rule_is_active"), target,
    ).select(
        "rule_id", "rule_code", "rule_name", "rule_type", "allocation_method", "sequence",
        F.col("t._CostCenterID").alias("target_id"),
        F.col("t._CostCenterCode").alias("target_code"),
        F.col("t._AllocationPercentage").alias("target_pct"),
        F.col("t._Priority").alias("priority"),
        F.col("t.AccountFilter").alias("account_filter"),
        F.col("t.ExcludePattern").alias("exclude_pattern"),
        F.coalesce(F.size("t.Conditions.Condition") > 0, F.lit(False)).alias("has_conditions"),
        F.col("t.Conditions.Condition").alias("conditions"),
        "effective_from", "effective_to", "rule_is_active",
    )


def entity_list(spark: SparkSession, xml_text: str) -> DataFrame:
    """(entity_code, entity_name, include) from an entity list; included unless it says otherwise."""
    entities = F.from_xml(F.lit(xml_text), _ENTITIES_DDL, {"rowTag": "Entities"})["Entity"]
    return spark.range(1).select(F.explode(entities).alias("e")).select(
        F.col("e._Code").alias("entity_code"),
        F.col("e._Name").alias("entity_name"),
        (F.coalesce("e._Include", F.lit(1)) == 1).alias("include"),
    )
