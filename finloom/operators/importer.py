"""Import of budget lines: lookups, validation, and what each row does."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from finloom.operators.sinks import new_lines
from finloom.schemas import FINAL, LINE_KEY, MONEY
from finloom.session import materialise

# Error codes and texts in the order in which the checks report.
CHECKS = [
    ("MISSING_ACCOUNT", "GL Account not found or not specified", "gl_account_id"),
    ("MISSING_COSTCENTER", "Cost Center not found or not specified", "cost_center_id"),
    ("MISSING_PERIOD", "Fiscal Period not found or not specified", "fiscal_period_id"),
    ("INVALID_AMOUNT", "Amount is NULL", "original_amount"),
    ("NON_BUDGETABLE", "Account is not marked as budgetable", "gl_account_id"),
    ("INACTIVE_CC", "Cost Center is inactive", "cost_center_id"),
    ("CLOSED_PERIOD", "Fiscal period is closed", "fiscal_period_id"),
    ("DUPLICATE_IN_BATCH", "Duplicate entry within import batch", None),
    ("ALREADY_EXISTS", "Record already exists in target budget", None),
]

_STAGING_DEFAULTS = [
    ("gl_account_id", "int"),
    ("account_number", "string"),
    ("cost_center_id", "int"),
    ("cost_center_code", "string"),
    ("fiscal_period_id", "int"),
    ("fiscal_year", "int"),
    ("fiscal_month", "int"),
    ("original_amount", "decimal(19,4)"),
    ("adjusted_amount", "decimal(19,4)"),
    ("spread_method", "string"),
    ("notes", "string"),
]


def staging_rows(rows: DataFrame) -> DataFrame:
    """Import rows of any source with all staging columns and a row id.

    Rows that come without an id are stored once numbered, because a second
    computation of the source could number them differently.
    """
    if "row_id" not in rows.columns:
        rows = materialise(rows.withColumn("row_id", F.monotonically_increasing_id()), "staging")
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in _STAGING_DEFAULTS if name not in rows.columns]
    present = [F.col(name) for name, _ in _STAGING_DEFAULTS if name in rows.columns]
    return rows.select("row_id", *present, *missing)


def resolve_lookups(staging: DataFrame, accounts: DataFrame, cost_centers: DataFrame, periods: DataFrame) -> DataFrame:
    """Fill missing ids from account number, cost-centre code and year and month."""
    by_number = accounts.select("account_number", F.col("gl_account_id").alias("_account"))
    by_code = cost_centers.select(F.col("code").alias("cost_center_code"), F.col("cost_center_id").alias("_centre"))
    by_month = periods.select("fiscal_year", "fiscal_month", F.col("fiscal_period_id").alias("_period"))
    return (
        staging.join(by_number, "account_number", "left")
        .join(by_code, "cost_center_code", "left")
        .join(by_month, ["fiscal_year", "fiscal_month"], "left")
        .withColumn("gl_account_id", F.coalesce("gl_account_id", "_account"))
        .withColumn("cost_center_id", F.coalesce("cost_center_id", "_centre"))
        .withColumn("fiscal_period_id", F.coalesce("fiscal_period_id", "_period"))
        .select(*staging.columns)
    )


def _complete_key() -> Column:
    return F.col("gl_account_id").isNotNull() & F.col("cost_center_id").isNotNull() & F.col("fiscal_period_id").isNotNull()


def first_rows(resolved: DataFrame) -> DataFrame:
    """Lowest row id per line key; an aggregate, so a key with many rows is reduced before the shuffle."""
    return resolved.filter(_complete_key()).groupBy(*LINE_KEY).agg(F.min("row_id").alias("first_row_id"))


def duplicates_in_batch(resolved: DataFrame) -> DataFrame:
    """Rows that repeat the key of an earlier row."""
    first = first_rows(resolved).select(F.col("first_row_id").alias("row_id"))
    return resolved.filter(_complete_key()).join(first, "row_id", "left_anti")


def _with_flags(resolved: DataFrame, accounts: DataFrame, cost_centers: DataFrame, periods: DataFrame) -> DataFrame:
    """Resolved rows with what the checks need to know of their account, cost centre and period."""
    return (
        resolved.join(accounts.select("gl_account_id", F.col("is_budgetable").alias("_budgetable")), "gl_account_id", "left")
        .join(cost_centers.select("cost_center_id", F.col("is_active").alias("_active")), "cost_center_id", "left")
        .join(periods.select("fiscal_period_id", F.col("is_closed").alias("_closed")), "fiscal_period_id", "left")
        .select(*resolved.columns, "_budgetable", "_active", "_closed")
    )


def _rules(mode: str, duplicates: str) -> dict[str, tuple[Column, str]]:
    """Condition and severity of each check; no check at all in mode NONE."""
    if mode == "NONE":
        return {}
    strict = "ERROR" if mode == "STRICT" else "WARNING"
    return {
        "MISSING_ACCOUNT": (F.col("gl_account_id").isNull(), strict),
        "MISSING_COSTCENTER": (F.col("cost_center_id").isNull(), strict),
        "MISSING_PERIOD": (F.col("fiscal_period_id").isNull(), strict),
        "INVALID_AMOUNT": (F.col("original_amount").isNull(), "ERROR"),
        "NON_BUDGETABLE": (~F.col("_budgetable"), "WARNING"),
        "INACTIVE_CC": (~F.col("_active"), strict),
        "CLOSED_PERIOD": (F.col("_closed"), "ERROR"),
        "DUPLICATE_IN_BATCH": (F.col("row_id") != F.col("first_row_id"), "WARNING"),
        "ALREADY_EXISTS": (F.col("_line_id").isNotNull(), "ERROR" if duplicates == "REJECT" else "WARNING"),
    }


def _tagged(flagged: DataFrame, target: DataFrame, mode: str, duplicates: str) -> DataFrame:
    """Rows with their errors and ``action``: INSERT, UPDATE, SKIP or REJECT.

    Two reads of ``flagged``: keys are reduced to one row each, with the first
    row and the row that would be written, before they meet the target budget.
    """
    rules = _rules(mode, duplicates)
    sound = _complete_key() & F.col("original_amount").isNotNull()
    for code, (condition, severity) in rules.items():
        # these two depend on the key; the first is a warning, the second is the same for all rows of a key
        if severity == "ERROR" and code not in ("DUPLICATE_IN_BATCH", "ALREADY_EXISTS"):
            sound = sound & ~F.coalesce(condition, F.lit(False))
    sound_id = F.when(sound, F.col("row_id"))
    written = F.max(sound_id) if duplicates == "UPDATE" else F.min(sound_id)
    existing = target.groupBy(*LINE_KEY).agg(F.min("line_id").alias("_line_id"))
    keys = flagged.filter(_complete_key()).groupBy(*LINE_KEY).agg(F.min("row_id").alias("first_row_id"), written.alias("_written"))
    joined = flagged.join(keys.join(existing, LINE_KEY, "left"), LINE_KEY, "left")
    kind = "array<struct<code:string,message:string,column_name:string,severity:string>>"
    none = F.array().cast(kind)
    lists, texts, wrong = [none], [], F.lit(False)
    for code, message, column in CHECKS:
        if code not in rules:
            continue
        condition, severity = rules[code]
        error = F.struct(
            F.lit(code).alias("code"),
            F.lit(message).alias("message"),
            F.lit(column).cast("string").alias("column_name"),
            F.lit(severity).alias("severity"),
        )
        # lists of one or none are joined: a lambda over nine places would run outside generated code
        lists.append(F.when(condition, F.array(error).cast(kind)).otherwise(none))
        texts.append(F.when(condition, f"{code}: {message}"))
        if severity == "ERROR":
            wrong = wrong | F.coalesce(condition, F.lit(False))
    errors, text = F.concat(*lists), F.concat_ws("; ", *texts)
    importable = F.col("is_valid") & _complete_key() & F.col("original_amount").isNotNull()
    there = F.col("_line_id").isNotNull()
    chosen = F.col("row_id") == F.col("_written")
    taken = F.when(there, "UPDATE").otherwise("INSERT") if duplicates == "UPDATE" else F.when(~there, "INSERT").otherwise("SKIP")
    return (
        joined.withColumn("errors", errors)
        .withColumn("is_valid", ~wrong)
        .withColumn("validation_errors", F.when(text != "", text))
        .withColumn("action", F.when(~importable, "REJECT").when(chosen, taken).otherwise("SKIP"))
        .drop("_budgetable", "_active", "_closed", "first_row_id", "_written")
    )


def validate(
    resolved: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    periods: DataFrame,
    target: DataFrame,
    mode: str = "STRICT",
    duplicates: str = "REJECT",
) -> DataFrame:
    """Staging rows with ``errors`` (code, message, column, severity), ``is_valid`` and ``validation_errors``."""
    flagged = _with_flags(resolved, accounts, cost_centers, periods)
    return _tagged(flagged, target, mode, duplicates).select(*resolved.columns, "errors", "is_valid", "validation_errors")


def import_errors(validated: DataFrame) -> DataFrame:
    """One row per failed check."""
    return validated.select("row_id", F.inline("errors"))


def import_error_summary(validated: DataFrame) -> DataFrame:
    """Failed checks by code; an ERROR outranks a WARNING."""
    return (
        import_errors(validated)
        .groupBy("code")
        .agg(
            F.count("*").alias("error_count"),
            F.when(F.max(F.col("severity") == "ERROR"), "ERROR").otherwise("WARNING").alias("max_severity"),
        )
    )


def conditional_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("total_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
    )


def rejected_sample(validated: DataFrame, n: int = 100) -> DataFrame:
    """The first rejected rows by row id, for the report."""
    return (
        validated.filter(~F.col("is_valid"))
        .orderBy("row_id")
        .limit(n)
        .select(
            "row_id", "account_number", "cost_center_code", "fiscal_year", "fiscal_month", "original_amount", "validation_errors"
        )
    )


def importable_rows(validated: DataFrame, header_id: int, run_id: str, keep: list[str] | None = None) -> DataFrame:
    """Valid rows as budget lines; a row whose ids stayed unknown cannot become one."""
    adjusted = F.coalesce("adjusted_amount", F.lit(0).cast(MONEY)).cast(MONEY)
    return validated.filter(F.col("is_valid") & _complete_key() & F.col("original_amount").isNotNull()).select(
        F.lit(header_id).alias("header_id"),
        *LINE_KEY,
        "original_amount",
        adjusted.alias("adjusted_amount"),
        (F.col("original_amount") + adjusted).cast(FINAL).alias("final_amount"),
        "spread_method",
        F.lit("BULK_IMPORT").alias("source_system"),
        F.lit(run_id).alias("source_reference"),
        "row_id",
        *(keep or []),
    )


class ImportResult(NamedTuple):
    """``validated``: stored rows with errors and action; ``lines``: written lines with their ids; ``metrics``: counts of the run."""

    validated: DataFrame
    errors: DataFrame
    lines: DataFrame
    counts: DataFrame
    metrics: dict[str, int]


def _actions() -> list[Column]:
    tags = {"inserted": "INSERT", "updated": "UPDATE", "skipped": "SKIP", "rejected": "REJECT"}
    counted = [F.count_if(F.col("action") == tag).alias(name) for name, tag in tags.items()]
    return [F.count(F.lit(1)).alias("total_rows"), F.count_if("is_valid").alias("valid_rows"), F.count_if(~F.col("is_valid")).alias("invalid_rows"), *counted]


def import_budget(
    rows: DataFrame,
    header_id: int,
    lines: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    periods: DataFrame,
    run_id: str,
    mode: str = "STRICT",
    duplicates: str = "REJECT",
) -> ImportResult:
    """One import run: validated rows, errors, written lines with their action, counts.

    REJECT and SKIP insert the first row of each new key; UPDATE writes the
    last row of each key. Rows that are valid but not written are skipped.

    The source is read once. Its resolved rows are stored, every row gets its
    tag in one pass over them, and the counts are observed while the tagged
    rows are written; lines, errors and reports read the tagged rows. Inserted
    lines are complete new lines, with ids in the order of the rows; updates
    carry the id of the line they change.
    """
    target = lines.filter(F.col("header_id") == header_id)
    resolved = resolve_lookups(staging_rows(rows), accounts, cost_centers, periods)
    flagged = materialise(_with_flags(resolved, accounts, cost_centers, periods), "resolved")
    seen = Observation("import")
    tagged = materialise(_tagged(flagged, target, mode, duplicates).observe(seen, *_actions()), "tagged")
    # rows that hold nothing to count leave no observation
    metrics = {name: seen.get.get(name) or 0 for name in ("total_rows", "rejected", "inserted", "updated", "skipped", "valid_rows", "invalid_rows")}
    tags = ["row_id", "action"]
    inserted = importable_rows(tagged.filter("action = 'INSERT'"), header_id, run_id, keep=["action"])
    updated = importable_rows(tagged.filter("action = 'UPDATE'"), header_id, run_id, keep=["action", "_line_id"])
    written = new_lines(inserted, lines, ["row_id"], keep=tags).unionByName(
        updated.withColumnRenamed("_line_id", "line_id"), allowMissingColumns=True
    )
    counts = rows.sparkSession.createDataFrame(
        [tuple(metrics[c] for c in COUNTS)], ", ".join(f"{c} long" for c in COUNTS)
    )
    return ImportResult(tagged, import_errors(tagged), written, counts, metrics)


COUNTS = ["total_rows", "rejected", "inserted", "updated", "skipped"]
