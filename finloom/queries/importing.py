"""Import sources, validation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import importer
from finloom.operators.sinks import append_lines, insert_ignore, new_lines, overwrite_budgets, upsert, upsert_actions
from finloom.plans.documents import items_of
from finloom.plans.reports import import_document
from finloom.queries.registry import query
from finloom.schemas import LINE_KEY
from finloom.session import new_folder
from finloom.sources.tables import read_csv, read_rowset, read_staging_table

HEADER = 3
RUN = "import-1"


def _resolved(t):
    return importer.resolve_lookups(importer.staging_rows(t.import_staging), t.gl_account, t.cost_center, t.fiscal_period)


def _target(t):
    return t.lines_of(HEADER)


def _validated(t, mode="STRICT", duplicates="REJECT"):
    return importer.validate(_resolved(t), t.gl_account, t.cost_center, t.fiscal_period, _target(t), mode, duplicates)


@query("resolve_lookups", "select row_id, gl_account_id, cost_center_id, fiscal_period_id from resolved")
def resolve_lookups(t):
    return _resolved(t).select("row_id", *LINE_KEY)


# One condition per error code, in reporting order.
_CHECKED = """
 select r.row_id, r.account_number, r.cost_center_code, r.fiscal_year, r.fiscal_month, r.original_amount, r.adjusted_amount,
        r.gl_account_id, r.cost_center_id, r.fiscal_period_id, u.pos, u.code, u.severity
   from (select x.*, e.gl_account_id is not null as already,
                case when x.gl_account_id is not null and x.cost_center_id is not null and x.fiscal_period_id is not null
                     then row_number() over (partition by x.gl_account_id, x.cost_center_id, x.fiscal_period_id order by x.row_id) end as nth
           from resolved x left join (select distinct gl_account_id, cost_center_id, fiscal_period_id from budget_line_item where header_id = 3) e
             on x.gl_account_id = e.gl_account_id and x.cost_center_id = e.cost_center_id and x.fiscal_period_id = e.fiscal_period_id) r,
        lateral (select * from (values
          (1, 'MISSING_ACCOUNT', '{strict}', r.gl_account_id is null),
          (2, 'MISSING_COSTCENTER', '{strict}', r.cost_center_id is null),
          (3, 'MISSING_PERIOD', '{strict}', r.fiscal_period_id is null),
          (4, 'INVALID_AMOUNT', 'ERROR', r.original_amount is null),
          (5, 'NON_BUDGETABLE', 'WARNING', not r.is_budgetable),
          (6, 'INACTIVE_CC', '{strict}', not r.is_active),
          (7, 'CLOSED_PERIOD', 'ERROR', r.is_closed),
          (8, 'DUPLICATE_IN_BATCH', 'WARNING', r.nth > 1),
          (9, 'ALREADY_EXISTS', '{exists}', r.already)) v(pos, code, severity, hit) where hit) u
"""
_ERRORS = _CHECKED.format(strict="ERROR", exists="ERROR")
_LENIENT = _CHECKED.format(strict="WARNING", exists="WARNING")


def _valid(errors: str) -> str:
    return f"select * from resolved where row_id not in (select row_id from ({errors}) e where severity = 'ERROR')"


@query("import_errors", f"select row_id, code, severity from ({_ERRORS}) e")
def import_errors(t):
    return importer.import_errors(_validated(t)).select("row_id", "code", "severity")


@query("import_errors_lenient", f"select row_id, code, severity from ({_LENIENT}) e")
def import_errors_lenient(t):
    return importer.import_errors(_validated(t, "LENIENT", "UPDATE")).select("row_id", "code", "severity")


@query("import_valid", f"select row_id, gl_account_id, cost_center_id, fiscal_period_id, original_amount from ({_valid(_ERRORS)}) v")
def import_valid(t):
    return _validated(t).filter("is_valid").select("row_id", *LINE_KEY, "original_amount")


@query(
    "import_error_summary",
    f"""select code, count(*) as error_count, case when max((severity = 'ERROR')::int) = 1 then 'ERROR' else 'WARNING' end as max_severity
          from ({_ERRORS}) e group by 1""",
)
def import_error_summary(t):
    return importer.import_error_summary(_validated(t))


@query(
    "conditional_counts",
    f"""select (select count(*) from resolved) as total_rows, (select count(*) from ({_valid(_ERRORS)}) v) as valid_rows,
               (select count(distinct row_id) from ({_ERRORS}) e where severity = 'ERROR') as invalid_rows""",
)
def conditional_counts(t):
    return importer.conditional_counts(_validated(t))


_MESSAGES = """case code when 'MISSING_ACCOUNT' then 'GL Account not found or not specified'
   when 'MISSING_COSTCENTER' then 'Cost Center not found or not specified' when 'MISSING_PERIOD' then 'Fiscal Period not found or not specified'
   when 'INVALID_AMOUNT' then 'Amount is NULL' when 'NON_BUDGETABLE' then 'Account is not marked as budgetable'
   when 'INACTIVE_CC' then 'Cost Center is inactive' when 'CLOSED_PERIOD' then 'Fiscal period is closed'
   when 'DUPLICATE_IN_BATCH' then 'Duplicate entry within import batch' else 'Record already exists in target budget' end"""


@query(
    "string_agg_ordered",
    f"""select row_id, string_agg(concat(code, ': ', {_MESSAGES}), '; ' order by pos) as validation_errors from ({_ERRORS}) e group by 1""",
)
def string_agg_ordered(t):
    return _validated(t).filter(F.col("validation_errors").isNotNull()).select("row_id", "validation_errors")


@query(
    "rejected_sample",
    f"""select row_id, account_number, cost_center_code, fiscal_year, fiscal_month, original_amount,
               string_agg(concat(code, ': ', {_MESSAGES}), '; ' order by pos) as validation_errors
          from ({_ERRORS}) e group by all having max((severity = 'ERROR')::int) = 1 order by row_id limit 100""",
)
def rejected_sample(t):
    return importer.rejected_sample(_validated(t))


@query(
    "w_dedupe",
    """select row_id from (select row_id, row_number() over (partition by gl_account_id, cost_center_id, fiscal_period_id order by row_id) as n
         from resolved where gl_account_id is not null and cost_center_id is not null and fiscal_period_id is not null) q where n > 1""",
)
def dedupe(t):
    return importer.duplicates_in_batch(_resolved(t)).select("row_id")


@query(
    "semi_anti",
    """select r.row_id from resolved r where exists (select 1 from budget_line_item l where l.header_id = 3
          and l.gl_account_id = r.gl_account_id and l.cost_center_id = r.cost_center_id and l.fiscal_period_id = r.fiscal_period_id)
        and not exists (select 1 from budget_line_item l where l.header_id = 2
          and l.gl_account_id = r.gl_account_id and l.cost_center_id = r.cost_center_id and l.fiscal_period_id = r.fiscal_period_id)""",
)
def semi_anti(t):
    lines = t.budget_line_item
    return (
        _resolved(t)
        .join(_target(t), LINE_KEY, "left_semi")
        .join(lines.filter("header_id = 2"), LINE_KEY, "left_anti")
        .select("row_id")
    )


_IMPORTABLE = f"""
 select row_id, gl_account_id, cost_center_id, fiscal_period_id, original_amount, adjusted_amount from ({_valid(_LENIENT)}) v
  where gl_account_id is not null and cost_center_id is not null and fiscal_period_id is not null and original_amount is not null
"""
_NEW_ROWS = f"""
 select i.* from (select *, row_number() over (partition by gl_account_id, cost_center_id, fiscal_period_id order by row_id) as n from ({_IMPORTABLE}) m) i
  where n = 1 and not exists (select 1 from budget_line_item l where l.header_id = 3 and l.gl_account_id = i.gl_account_id
        and l.cost_center_id = i.cost_center_id and l.fiscal_period_id = i.fiscal_period_id)
"""
_LAST_ROWS = f"""
 select i.*, exists (select 1 from budget_line_item l where l.header_id = 3 and l.gl_account_id = i.gl_account_id
        and l.cost_center_id = i.cost_center_id and l.fiscal_period_id = i.fiscal_period_id) as present
   from (select *, row_number() over (partition by gl_account_id, cost_center_id, fiscal_period_id order by row_id desc) as n from ({_IMPORTABLE}) m) i
  where n = 1
"""


def _ready(t):
    return importer.importable_rows(_validated(t, "LENIENT", "UPDATE"), HEADER, RUN)


_NEXT_ID = "(select max(line_id) from budget_line_item) + row_number() over (order by row_id)"


@query(
    "sink_insert_ignore",
    f"""select {_NEXT_ID} as line_id, gl_account_id, cost_center_id, fiscal_period_id, original_amount, adjusted_amount,
               (original_amount + adjusted_amount)::decimal(20,4) as final_amount, false as is_allocated from ({_NEW_ROWS}) n""",
)
def sink_insert_ignore(t):
    """New lines as they are inserted: first row of each new key, with ids above the table's and the defaults."""
    added = new_lines(insert_ignore(_ready(t).withColumn("_place", F.col("row_id")), _target(t), "row_id"), t.budget_line_item, ["_place"])
    return added.select("line_id", *LINE_KEY, "original_amount", "adjusted_amount", "final_amount", "is_allocated")


@query(
    "sink_upsert",
    f"""select gl_account_id, cost_center_id, fiscal_period_id, original_amount, adjusted_amount,
               case when present then 'UPDATE' else 'INSERT' end as action from ({_LAST_ROWS}) n""",
)
def sink_upsert(t):
    return upsert_actions(_ready(t), _target(t), "row_id").select(*LINE_KEY, "original_amount", "adjusted_amount", "action")


@query(
    "sink_upsert_table",
    f"""select l.line_id, l.gl_account_id, l.cost_center_id, l.fiscal_period_id, coalesce(n.original_amount, l.original_amount) as original_amount,
               (coalesce(n.original_amount, l.original_amount) + coalesce(n.adjusted_amount, l.adjusted_amount))::decimal(20,4) as final_amount,
               false as is_allocated
          from (select * from budget_line_item where header_id = 3) l left join ({_LAST_ROWS}) n
            on l.gl_account_id = n.gl_account_id and l.cost_center_id = n.cost_center_id and l.fiscal_period_id = n.fiscal_period_id
        union all
        select line_id, gl_account_id, cost_center_id, fiscal_period_id, original_amount, (original_amount + adjusted_amount)::decimal(20,4), false
          from (select {_NEXT_ID} as line_id, * from ({_LAST_ROWS}) x where not present) a""",
)
def sink_upsert_table(t):
    """The stored target after its budget folder was replaced by the upsert's result."""
    path = new_folder(t.spark, "upsert")
    append_lines(t.budget_line_item, path)
    stored = t.spark.read.schema(t.budget_line_item.schema).parquet(path)
    overwrite_budgets(upsert(_ready(t), stored.filter(F.col("header_id") == HEADER), "row_id", stored), path)
    after = t.spark.read.schema(t.budget_line_item.schema).parquet(path).filter(F.col("header_id") == HEADER)
    return after.select("line_id", *LINE_KEY, "original_amount", "final_amount", "is_allocated")


@query(
    "import_budget",
    f"""select (select count(*) from resolved) as total_rows,
               (select count(*) from resolved) - (select count(*) from ({_IMPORTABLE}) m) as rejected,
               (select count(*) from ({_LAST_ROWS}) n where not present) as inserted,
               (select count(*) from ({_LAST_ROWS}) n where present) as updated,
               (select count(*) from ({_IMPORTABLE}) m) - (select count(*) from ({_LAST_ROWS}) n) as skipped""",
)
def import_budget(t):
    run = importer.import_budget(
        t.import_staging, HEADER, t.budget_line_item, t.gl_account, t.cost_center, t.fiscal_period, RUN, "LENIENT", "UPDATE"
    )
    return run.counts


@query(
    "import_lines",
    f"""select case when present then l.line_id else a.line_id end as line_id, n.gl_account_id, n.cost_center_id, n.fiscal_period_id,
               (n.original_amount + n.adjusted_amount)::decimal(20,4) as final_amount, case when present then 'UPDATE' else 'INSERT' end as action, n.row_id
          from ({_LAST_ROWS}) n
          left join (select row_id, {_NEXT_ID} as line_id from ({_LAST_ROWS}) x where not present) a on n.row_id = a.row_id
          left join (select * from budget_line_item where header_id = 3) l on n.gl_account_id = l.gl_account_id
           and n.cost_center_id = l.cost_center_id and n.fiscal_period_id = l.fiscal_period_id""",
)
def import_lines(t):
    """Written lines of an import with the ids they get or have, the row they come from and their action."""
    run = importer.import_budget(
        t.import_staging, HEADER, t.budget_line_item, t.gl_account, t.cost_center, t.fiscal_period, RUN, "LENIENT", "UPDATE"
    )
    return run.lines.select("line_id", *LINE_KEY, "final_amount", "action", "row_id")


_STRICT_ROWS = f"""select i.* from (select *, row_number() over (partition by gl_account_id, cost_center_id, fiscal_period_id order by row_id) as n
                      from ({_valid(_ERRORS)}) v) i where n = 1"""


@query(
    "nested_report_import",
    f"""
    select 'Summary' as section, u.key, cast(u.value as varchar) as value from
      (select (select count(*) from resolved) as total, (select count(*) from ({_valid(_ERRORS)}) v) as valid, (select count(*) from ({_STRICT_ROWS}) s) as inserted) c,
      lateral (select * from (values ('TotalRows', total), ('ValidRows', valid), ('InvalidRows', total - valid), ('InsertedRows', inserted), ('UpdatedRows', 0),
                                     ('SkippedRows', valid - inserted), ('RejectedRows', total - valid)) v(key, value)) u
    union all
    select 'ErrorType', code, concat(count(*), '|', case when max((severity = 'ERROR')::int) = 1 then 'ERROR' else 'WARNING' end) from ({_ERRORS}) e group by code
    union all
    select 'RejectedRow', cast(row_id as varchar), concat_ws('|', account_number, cost_center_code, fiscal_year, fiscal_month, original_amount, errors) from (
      select row_id, account_number, cost_center_code, fiscal_year, fiscal_month, original_amount, string_agg(concat(code, ': ', {_MESSAGES}), '; ' order by pos) as errors
        from ({_ERRORS}) e group by all having max((severity = 'ERROR')::int) = 1 order by row_id limit 100) r
    """,
)
def nested_report_import(t):
    """The whole XML report of an import, parsed back: counts, errors by type, the first rejected rows with all their values."""
    run = importer.import_budget(
        t.import_staging, HEADER, t.budget_line_item, t.gl_account, t.cost_center, t.fiscal_period, RUN
    )
    pieces = import_document(run, RUN, "STAGING_TABLE", HEADER)
    names = ["TotalRows", "ValidRows", "InvalidRows", "InsertedRows", "UpdatedRows", "SkippedRows", "RejectedRows"]
    counts = items_of(pieces, "Summary", ", ".join(f"{n} long" for n in names))
    summary = counts.select(F.lit("Summary").alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])))
    errors = items_of(pieces, "ErrorType", "_Code string, Count long, MaxSeverity string")
    errors = errors.select(F.lit("ErrorType").alias("section"), F.col("_Code").alias("key"), F.concat_ws("|", F.col("Count").cast("string"), "MaxSeverity").alias("value"))
    fields = ["Account", "CostCenter", "Year", "Month", "Amount", "Errors"]
    rows = items_of(pieces, "RejectedRow", "_Row long, " + ", ".join(f"{n} string" for n in fields))
    rows = rows.select(F.lit("RejectedRow").alias("section"), F.col("_Row").cast("string").alias("key"), F.concat_ws("|", *fields).alias("value"))
    return summary.unionByName(errors).unionByName(rows)


_CODES = "account_number, cost_center_code, fiscal_year, fiscal_month"


@query(
    "src_csv",
    f"""select {_CODES}, count(*) as n, sum(original_amount)::decimal(38,4) as original_amount from import_staging
         where row_id % 97 <> 0 group by all""",
)
def src_csv(t):
    """Staging rows written as a file, every 97th amount unreadable, and read back without those lines."""
    path = new_folder(t.spark, "csv")
    text = F.when(F.col("row_id") % 97 == 0, "n/a").otherwise(F.col("original_amount").cast("string"))
    columns = ["account_number", "cost_center_code", "fiscal_year", "fiscal_month"]
    t.import_staging.select(*columns, text.alias("original_amount"), "adjusted_amount", "spread_method", "notes").write.csv(
        path, header=True
    )
    rows = read_csv(t.spark, path, max_errors=None)
    return rows.groupBy(*columns).agg(F.count("*").alias("n"), F.sum("original_amount").cast("decimal(38,4)").alias("original_amount"))


@query(
    "src_rowset",
    "select row_id, gl_account_id, cost_center_id, fiscal_period_id, original_amount, adjusted_amount from resolved",
)
def src_rowset(t):
    resolved = _resolved(t)
    return (
        read_rowset(resolved.withColumn("notes", F.col("row_id").cast("string")))
        .withColumn("row_id", F.col("notes").cast("long"))
        .select("row_id", *LINE_KEY, "original_amount", "adjusted_amount")
    )


@query(
    "src_table",
    f"select {_CODES}, count(*) as n, sum(adjusted_amount)::decimal(38,4) as adjusted_amount from import_staging group by all",
)
def src_table(t):
    t.import_staging.createOrReplaceTempView("finloom_import_staging")
    rows = read_staging_table(t.spark, "finloom_import_staging")
    columns = ["account_number", "cost_center_code", "fiscal_year", "fiscal_month"]
    return rows.groupBy(*columns).agg(F.count("*").alias("n"), F.sum("adjusted_amount").cast("decimal(38,4)").alias("adjusted_amount"))
