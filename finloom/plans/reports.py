"""Nested reports as JSON or XML text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.operators.importer import ImportResult, import_error_summary, rejected_sample
from finloom.operators.reconcile import LINK_KEY, PAIR_KEY, report_order
from finloom.plans.close import Close
from finloom.plans.documents import Section, document, element, leaf
from finloom.plans.reconciliation import Reconciliation


def _nested_matches(status: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs with an array of at most four match types."""
    per_link = types.groupBy(*LINK_KEY).agg(F.array_sort(F.collect_list(F.struct("match_type", "match_count"))).alias("matches"))
    return status.join(per_link, LINK_KEY, "left")


def reconciliation_report(status: DataFrame, types: DataFrame, accounts: DataFrame) -> DataFrame:
    """One JSON document per pair with its nested match types, in report order."""
    pairs = _nested_matches(status, types).join(accounts.select("gl_account_id", "account_number"), "gl_account_id")
    document = F.to_json(
        F.struct(
            "entity1", "entity2", "status", "account_number", "entity1_amount", "entity2_amount", "variance",
            "is_within_tolerance", "matches",
        )
    )
    return pairs.orderBy(*report_order()).select(*PAIR_KEY, "status", "variance", document.alias("document"))


def reconciliation_xml(status: DataFrame, types: DataFrame, accounts: DataFrame) -> DataFrame:
    """One XML element per pair with nested match elements."""
    pairs = _nested_matches(status, types).join(accounts.select("gl_account_id", "account_number"), "gl_account_id")
    matches = F.transform("matches", lambda m: F.struct(m["match_type"].alias("_Type"), m["match_count"].alias("Count")))
    element = F.struct(
        F.col("entity1").alias("_Entity1"),
        F.col("entity2").alias("_Entity2"),
        F.col("status").alias("_Status"),
        F.col("account_number").alias("Account"),
        F.col("entity1_amount").alias("Amount1"),
        F.col("entity2_amount").alias("Amount2"),
        F.col("variance").alias("Variance"),
        F.col("is_within_tolerance").alias("WithinTolerance"),
        matches.alias("Match"),
    )
    return pairs.orderBy(*report_order()).select(*PAIR_KEY, F.to_xml(element, {"rowTag": "Pair"}).alias("document"))


def import_report(result: ImportResult, run_id: str, source: str, header_id: int) -> DataFrame:
    """One JSON document: counts, errors by type, first rejected rows with all their values."""
    by_code = import_error_summary(result.validated).agg(
        F.array_sort(F.collect_list(F.struct("code", "error_count", "max_severity"))).alias("error_summary")
    )
    sample = rejected_sample(result.validated)
    listed = sample.agg(F.array_sort(F.collect_list(F.struct(*sample.columns))).alias("sample"))
    names = ["total_rows", "valid_rows", "invalid_rows", "inserted", "updated", "skipped", "rejected"]
    counts = F.struct(*[F.lit(result.metrics[n]).cast("long").alias(n) for n in names])
    return by_code.select(
        F.to_json(
            F.struct(
                F.lit(run_id).alias("batch_id"),
                F.lit(source).alias("source"),
                F.lit(header_id).alias("target_header_id"),
                counts.alias("summary"),
                "error_summary",
                listed.scalar().alias("rejected_sample"),
            )
        ).alias("document")
    )


def close_steps(spark: SparkSession, close: Close) -> DataFrame:
    """The steps of a close as rows."""
    rows = [(i + 1, s.name, s.status, s.rows, s.message) for i, s in enumerate(close.steps)]
    return spark.createDataFrame(rows, "step_number int, step_name string, status string, rows_affected long, message string")


def close_report(spark: SparkSession, close: Close, run_id: str, fiscal_period_id: int, close_type: str) -> DataFrame:
    """One JSON document: findings, steps and summary of a close."""
    steps = close_steps(spark, close)
    counts = [F.count_if(F.col("status") == s).alias(f"{s.lower()}_steps") for s in ("COMPLETED", "FAILED", "WARNING")]
    listed = F.array_sort(F.collect_list(F.struct("step_number", "step_name", "status", "rows_affected", "message")))
    findings = close.validations.agg(F.array_sort(F.collect_list(F.struct("code", "severity", "message"))))
    summary = steps.agg(listed.alias("steps"), *counts, F.sum("rows_affected").alias("total_rows"))
    return summary.select(
        F.to_json(
            F.struct(
                F.lit(run_id).alias("run_id"),
                F.lit(fiscal_period_id).alias("fiscal_period_id"),
                F.lit(close_type).alias("close_type"),
                F.lit(close.status).alias("status"),
                findings.scalar().alias("validation_errors"),
                "steps",
                F.struct(
                    "completed_steps", "failed_steps", "warning_steps", "total_rows",
                    F.lit(close.metrics["consolidated_header_id"]).cast("int").alias("consolidated_header_id"),
                    F.lit(close.metrics["unreconciled"]).cast("long").alias("unreconciled"),
                    F.lit(close.metrics["total_variance"]).cast("decimal(38,4)").alias("total_variance"),
                ).alias("summary"),
            )
        ).alias("document")
    )


def _leaves(rows: DataFrame, names: dict[str, str]) -> list:
    return [leaf(tag, F.col(c)) for tag, c in names.items()]


def _one(tag: str, rows: DataFrame, names: dict[str, str], section: str | None = None) -> Section:
    """A section of one item that has the columns as elements."""
    return Section(section, rows, element(tag, {}, _leaves(rows, names)), [rows.columns[0]], few=True)


def reconciliation_document(
    run: Reconciliation, accounts: DataFrame, run_id: str, on: dt.date, header_id: int, tolerance_amount: str = "0.01", tolerance_pct: str = "0.001"
) -> DataFrame:
    """The whole reconciliation report in pieces: attributes, statistics, entities, pairs in report order with their matches, matched lines.

    A pair names its match types with their counts; the matched lines stand
    once per account and partner in a section of their own.
    """
    spark = run.status.sparkSession
    statistics = {"TotalPairs": "total_pairs", "Reconciled": "reconciled", "Unreconciled": "unreconciled", "TotalVariance": "total_variance",
                  "OutOfToleranceVariance": "out_of_tolerance_variance"}
    entity = element(
        "Entity", {"Code": F.col("entity_code"), "Name": F.col("entity_name")}, [leaf("PairCount", F.col("pair_count")), leaf("TotalVariance", F.col("total_variance"))]
    )
    numbers = accounts.select("gl_account_id", "account_number")
    pairs = _nested_matches(run.status, run.match_types).join(numbers, "gl_account_id")
    matches = F.array_join(
        F.transform("matches", lambda m: element("Match", {"Type": m["match_type"]}, [leaf("Count", m["match_count"])])), ""
    )
    amounts = {"Account": "account_number", "Amount1": "entity1_amount", "Amount2": "entity2_amount", "Variance": "variance",
               "VariancePercent": "variance_pct", "WithinTolerance": "is_within_tolerance"}
    pair = element(
        "Pair", {"ID": F.col("pair_id"), "Entity1": F.col("entity1"), "Entity2": F.col("entity2"), "Status": F.col("status"), "Partner": F.col("partner_account_id")},
        [*_leaves(pairs, amounts), matches],
    )
    line = element(
        "MatchedLine", {"Type": F.col("match_type"), "Score": F.col("match_score"), "Account": F.col("gl_account_id"), "Partner": F.col("partner_account_id")},
        [leaf("SourceID", F.col("source_line_id")), leaf("TargetID", F.col("target_line_id")), leaf("Details", F.col("match_details"))],
    )
    sections = [
        _one("Statistics", run.stats, statistics),
        Section("Entities", run.entity_stats, entity, ["entity_code"]),
        Section("IntercompanyPairs", pairs, pair, report_order(), "pair_id"),
        Section("MatchedLines", run.lines, line, [*LINK_KEY, "source_line_id"]),
    ]
    attributes = {"ReconciliationID": run_id, "ReconciliationDate": on.isoformat(), "BudgetHeaderID": header_id, "ToleranceAmount": tolerance_amount,
                  "TolerancePercent": tolerance_pct}
    return document(spark, "ReconciliationReport", attributes, sections)


def import_document(result: ImportResult, run_id: str, source: str, header_id: int) -> DataFrame:
    """The whole import report in pieces: attributes, counts, errors by type, the first rejected rows."""
    spark = result.validated.sparkSession
    named = {"TotalRows": "total_rows", "ValidRows": "valid_rows", "InvalidRows": "invalid_rows", "InsertedRows": "inserted", "UpdatedRows": "updated",
             "SkippedRows": "skipped", "RejectedRows": "rejected"}
    counts = spark.createDataFrame([tuple(result.metrics[c] for c in named.values())], ", ".join(f"{c} long" for c in named.values()))
    error = element("ErrorType", {"Code": F.col("code")}, [leaf("Count", F.col("error_count")), leaf("MaxSeverity", F.col("max_severity"))])
    values = {"Account": "account_number", "CostCenter": "cost_center_code", "Year": "fiscal_year", "Month": "fiscal_month", "Amount": "original_amount",
              "Errors": "validation_errors"}
    sample = rejected_sample(result.validated)
    rejected = element("RejectedRow", {"Row": F.col("row_id")}, _leaves(sample, values))
    sections = [
        _one("Summary", counts, named),
        Section("ErrorSummary", import_error_summary(result.validated), error, ["code"], few=True),
        Section("RejectedSample", sample, rejected, ["row_id"], few=True),
    ]
    return document(spark, "ImportResults", {"BatchID": run_id, "Source": source, "TargetBudgetID": header_id}, sections)


def close_document(spark: SparkSession, close: Close, run_id: str, fiscal_period_id: int, close_type: str) -> DataFrame:
    """The whole close report in pieces: attributes, findings, steps, metrics."""
    period = close.periods.filter(F.col("fiscal_period_id") == fiscal_period_id).select("period_name", "fiscal_year").first()
    steps = close_steps(spark, close)
    finding = element("ValidationError", {"Code": F.col("code"), "Severity": F.col("severity")}, [leaf("Message", F.col("message"))])
    step = element(
        "Step", {"Sequence": F.col("step_number"), "Name": F.col("step_name"), "Status": F.col("status")},
        [leaf("RowsAffected", F.col("rows_affected")), leaf("ErrorMessage", F.col("message"))],
    )
    done = {"CompletedSteps": "COMPLETED", "FailedSteps": "FAILED", "WarningSteps": "WARNING"}
    metrics = steps.agg(
        *[F.count_if(F.col("status") == s).alias(tag) for tag, s in done.items()],
        F.sum("rows_affected").alias("TotalRowsProcessed"),
        F.any_value(F.lit(close.metrics["consolidated_header_id"]).cast("int")).alias("ConsolidatedBudgetID"),
        F.any_value(F.lit(close.metrics["unreconciled"]).cast("long")).alias("UnreconciledItems"),
        F.any_value(F.lit(close.metrics["total_variance"]).cast("decimal(38,4)")).alias("TotalVariance"),
    )
    sections = [
        Section("ValidationErrors", close.validations, finding, ["code"], few=True),
        Section("ProcessingSteps", steps, step, ["step_number"], few=True),
        _one("Metrics", metrics, {c: c for c in metrics.columns}, "Summary"),
    ]
    attributes = {"RunID": run_id, "PeriodID": fiscal_period_id, "PeriodName": period and period["period_name"],
                  "FiscalYear": period and period["fiscal_year"], "CloseType": close_type, "Status": close.status}
    return document(spark, "FinancialCloseResults", attributes, sections)
