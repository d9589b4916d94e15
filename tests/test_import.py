from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.operators import importer
from finloom.operators.sinks import append_lines, insert_ignore, overwrite_budgets, upsert, upsert_actions
from finloom.schemas import IMPORT_CODES
from finloom.session import new_folder
from finloom.sources.tables import read_csv, read_rowset, read_staging_table

STAGING = (
    "row_id long, account_number string, cost_center_code string, fiscal_year int, fiscal_month int,"
    " original_amount decimal(19,4), adjusted_amount decimal(19,4), spread_method string, notes string"
)


@pytest.fixture(scope="module")
def world(spark):
    centres = b.cost_centers(spark, [(1, None), {"cost_center_id": 2, "parent_id": 1, "is_active": False}])
    accounts = b.accounts(spark, [{"gl_account_id": 10}, {"gl_account_id": 11, "is_budgetable": False}])
    periods = b.periods(spark, [(1, 2000, 1), (2, 2000, 2, True), (3, 2000, 3)])
    lines = b.lines(spark, [(100, 10, 1, 3, 50), (101, 10, 1, 1, 7, 2)])
    return {"accounts": accounts, "cost_centers": centres, "periods": periods, "lines": lines}


def staged(spark, rows):
    full = [(i + 1, *r[:4], None if r[4] is None else Decimal(r[4]), None, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, STAGING)


ROWS = [
    ("GL10", "C1", 2000, 1, 5),  # 1 good
    ("NOPE", "C1", 2000, 1, 5),  # 2 account
    ("GL10", "NOPE", 2000, 1, 5),  # 3 cost centre
    ("GL10", "C1", 1999, 1, 5),  # 4 period
    ("GL10", "C1", 2000, 1, None),  # 5 amount, repeats row 1
    ("GL11", "C1", 2000, 1, 5),  # 6 not budgetable
    ("GL10", "C2", 2000, 1, 5),  # 7 inactive
    ("GL10", "C1", 2000, 2, 5),  # 8 closed
    ("GL10", "C1", 2000, 3, 9),  # 9 exists
    ("GL10", "C1", 2000, 1, 6),  # 10 repeats row 1
    ("NOPE", "NOPE", 1999, 1, None),  # 11 four errors
]


def run(spark, world, rows=ROWS, **options):
    return importer.import_budget(staged(spark, rows), 1, run_id="r", **world, **options)


def test_codes_and_messages(spark, world):
    result = run(spark, world)
    errors = {}
    for row in result.errors.collect():
        errors.setdefault(row["row_id"], []).append((row["code"], row["severity"]))
    assert errors == {
        2: [("MISSING_ACCOUNT", "ERROR")],
        3: [("MISSING_COSTCENTER", "ERROR")],
        4: [("MISSING_PERIOD", "ERROR")],
        5: [("INVALID_AMOUNT", "ERROR"), ("DUPLICATE_IN_BATCH", "WARNING")],
        6: [("NON_BUDGETABLE", "WARNING")],
        7: [("INACTIVE_CC", "ERROR")],
        8: [("CLOSED_PERIOD", "ERROR")],
        9: [("ALREADY_EXISTS", "ERROR")],
        10: [("DUPLICATE_IN_BATCH", "WARNING")],
        11: [(c, "ERROR") for c in ("MISSING_ACCOUNT", "MISSING_COSTCENTER", "MISSING_PERIOD", "INVALID_AMOUNT")],
    }
    text = result.validated.filter("row_id = 5").first()["validation_errors"]
    assert text == "INVALID_AMOUNT: Amount is NULL; DUPLICATE_IN_BATCH: Duplicate entry within import batch"
    assert result.validated.filter("row_id = 1").first()["validation_errors"] is None


def test_severity_ranking(spark, world):
    rows = [("GL11", "C1", 2000, 1, 5), ("NOPE", "C1", 2000, 1, 5)]
    summary = b.collect(importer.import_error_summary(run(spark, world, rows).validated))
    assert summary == [("MISSING_ACCOUNT", 1, "ERROR"), ("NON_BUDGETABLE", 1, "WARNING")]


def test_reject_keeps_first_row(spark, world):
    result = run(spark, world)
    got = b.collect(result.lines, "gl_account_id", "cost_center_id", "fiscal_period_id", "original_amount", "action")
    assert got == [(10, 1, 1, 5, "INSERT"), (11, 1, 1, 5, "INSERT")]
    counts = result.counts.first().asDict()
    assert counts == {"total_rows": 11, "rejected": 8, "inserted": 2, "updated": 0, "skipped": 1}


def test_update_takes_last_row(spark, world):
    result = run(spark, world, duplicates="UPDATE")
    got = b.collect(result.lines, "gl_account_id", "fiscal_period_id", "original_amount", "action")
    assert got == [(10, 1, 6, "INSERT"), (10, 3, 9, "UPDATE"), (11, 1, 5, "INSERT")]
    counts = result.counts.first()
    assert counts["inserted"] + counts["updated"] + counts["skipped"] + counts["rejected"] == counts["total_rows"]


def test_skip_leaves_existing_rows(spark, world):
    result = run(spark, world, duplicates="SKIP")
    assert (10, 3) not in b.collect(result.lines, "gl_account_id", "fiscal_period_id")
    assert result.counts.first().asDict() == {"total_rows": 11, "rejected": 7, "inserted": 2, "updated": 0, "skipped": 2}


def test_lenient_rejects_only_rows_without_ids(spark, world):
    result = run(spark, world, mode="LENIENT")
    valid = [r[0] for r in b.collect(result.validated.filter("is_valid"), "row_id")]
    assert valid == [1, 2, 3, 4, 6, 7, 10]
    got = b.collect(result.lines, "gl_account_id", "cost_center_id", "fiscal_period_id")
    assert got == [(10, 1, 1), (10, 2, 1), (11, 1, 1)]
    assert result.counts.first()["rejected"] == 7


def test_none_checks_nothing(spark, world):
    result = run(spark, world, mode="NONE")
    assert result.errors.count() == 0 and result.validated.filter("is_valid").count() == 11


def test_given_ids_are_kept(spark, world):
    rows = spark.createDataFrame([(1, 11, "GL10")], "row_id long, gl_account_id int, account_number string")
    resolved = importer.resolve_lookups(importer.staging_rows(rows), world["accounts"], world["cost_centers"], world["periods"])
    assert resolved.first()["gl_account_id"] == 11


def test_rejected_sample_is_ordered(spark, world):
    assert [r["row_id"] for r in importer.rejected_sample(run(spark, world).validated, 3).collect()] == [2, 3, 4]


def test_hot_key(spark, world):
    """One key holds most rows; still one line, and every other row is a repeat."""
    rows = [("GL10", "C1", 2000, 1, i + 1) for i in range(400)] + [("GL11", "C1", 2000, 3, 1)]
    result = run(spark, world, rows)
    assert result.lines.count() == 2
    assert importer.import_error_summary(result.validated).filter("code = 'DUPLICATE_IN_BATCH'").first()["error_count"] == 399


def test_csv(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(
        ",".join(IMPORT_CODES.fieldNames())
        + "\nGL10,C1,2000,1,5.5,0,EVEN,ünï\nGL10,C1,2000,x,5.5,0,EVEN,bad month\nGL10,C1\nGL11,C1,2000,2,,,,\n",
        encoding="utf-8",
    )
    rows = read_csv(spark, str(path))
    assert b.collect(rows, "account_number", "fiscal_month", "original_amount", "notes") == [
        ("GL10", 1, Decimal("5.5"), "ünï"),
        ("GL11", 2, None, None),
    ]
    assert rows.count() == 2
    bad = sorted(r["value"] for r in spark.read.text(f"{path}.errors").collect())
    assert bad == ["GL10,C1", "GL10,C1,2000,x,5.5,0,EVEN,bad month"]
    with pytest.raises(ValueError, match="2 lines"):
        read_csv(spark, str(path), max_errors=1)


def test_rowset_and_table(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4.5, None, None, "n")], "gl_account_id long, cost_center_id long, fiscal_period_id long, original_amount double, adjusted_amount double, spread_method string, notes string")
    assert read_rowset(rows).first()["original_amount"] == Decimal("4.5")
    spark.createDataFrame([("A", "C", 2000, 1, Decimal(1), None, None, None, "extra")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in IMPORT_CODES.fields) + ", other string").createOrReplaceTempView("staged_rows")
    assert read_staging_table(spark, "staged_rows").columns == IMPORT_CODES.fieldNames()


def test_insert_ignore(spark):
    target = b.lines(spark, [(1, 10, 1, 1, 5)])
    rows = b.lines(spark, [(9, 10, 1, 2, 9), (8, 10, 1, 2, 8), (7, 10, 1, 1, 7)])
    assert b.collect(insert_ignore(rows, target, "line_id"), "fiscal_period_id", "final_amount") == [(2, 8)]


def test_upsert_and_partition_overwrite(spark):
    path = new_folder(spark, "test-upsert")
    append_lines(b.lines(spark, [(1, 10, 1, 1, 5), (2, 10, 1, 2, 6), (3, 10, 1, 1, 70, 2)]), path)
    schema = b.lines(spark, []).schema
    stored = spark.read.schema(schema).parquet(path)
    fresh = b.lines(spark, [(8, 10, 1, 2, 60), (9, 10, 1, 3, 90)]).withColumn("row_id", F.col("line_id")).drop("line_id")
    overwrite_budgets(upsert(fresh, stored.filter("header_id = 1"), "row_id"), path)
    after = spark.read.schema(schema).parquet(path)
    assert b.collect(after, "header_id", "fiscal_period_id", "final_amount") == [(1, 1, 5), (1, 2, 60), (1, 3, 90), (2, 1, 70)]
    assert after.filter("fiscal_period_id = 2").first()["line_id"] == 2
    assert after.filter("is_allocated IS NULL").isEmpty()


def test_lines_carry_ids_and_rows(spark, world):
    result = run(spark, world, duplicates="UPDATE")
    # ids go on above the largest of the whole table, in the order of the rows; an update keeps its line's id
    assert b.collect(result.lines, "row_id", "line_id", "action", "header_id", "is_allocated") == [
        (6, 102, "INSERT", 1, False), (9, 100, "UPDATE", 1, None), (10, 103, "INSERT", 1, False)]
    assert b.collect(result.validated, "row_id", "action") == [
        (i, {6: "INSERT", 9: "UPDATE", 10: "INSERT", 1: "SKIP"}.get(i, "REJECT")) for i in range(1, 12)]


@pytest.mark.parametrize("mode", ["STRICT", "LENIENT", "NONE"])
@pytest.mark.parametrize("duplicates", ["REJECT", "SKIP", "UPDATE"])
def test_tags_agree_with_the_single_sinks(spark, world, mode, duplicates):
    result = run(spark, world, mode=mode, duplicates=duplicates)
    target = world["lines"].filter("header_id = 1")
    ready = importer.importable_rows(result.validated, 1, "r")
    if duplicates == "UPDATE":
        want = upsert_actions(ready, target, "row_id")
    else:
        want = insert_ignore(ready, target, "row_id").withColumn("action", F.lit("INSERT"))
    columns = ["gl_account_id", "cost_center_id", "fiscal_period_id", "original_amount", "action"]
    assert b.collect(result.lines, *columns) == b.collect(want, *columns)
    counts = result.counts.first().asDict()
    assert counts["total_rows"] == 11 == counts["rejected"] + counts["inserted"] + counts["updated"] + counts["skipped"]
    assert counts["rejected"] == 11 - ready.count() and counts["inserted"] + counts["updated"] == want.count()


def test_import_of_no_rows(spark, world):
    result = run(spark, world, rows=[])
    assert result.counts.first().asDict() == dict.fromkeys(importer.COUNTS, 0)
    assert result.lines.isEmpty() and result.errors.isEmpty()


def test_the_source_is_scanned_once(spark, world, tmp_path):
    path = str(tmp_path / "staging")
    staged(spark, ROWS).write.parquet(path)
    source = spark.read.parquet(path)
    resolved = importer._with_flags(importer.resolve_lookups(importer.staging_rows(source), *[world[k] for k in ("accounts", "cost_centers", "periods")]), *[world[k] for k in ("accounts", "cost_centers", "periods")])
    assert resolved._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    result = importer.import_budget(source, 1, run_id="r", **world)
    for frame in (result.validated, result.errors, result.lines, result.counts):
        assert not any(path in f for f in frame.inputFiles())
