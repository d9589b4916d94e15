"""Planning tables projected from the order-management test tables.

Suppliers become cost centres below nations and regions, part brands become
accounts, return flags become budgets and shipped lines become budget lines.
Each table is projected once per session and input folder, stored in the
shared working folder and read back from there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.functions.ordering import PIECE, SLOT, in_order, with_dense_index
from finloom.schemas import FINAL, MONEY, WEIGHT
from finloom.session import bound_tasks, new_folder

FIRST_YEAR = 1995
HEADERS = (1, 2, 3)
FIRST_OPEN_YEAR = 2000
CHART_FROM = "1995-01-01"

_stored: dict[tuple[str, str, str], str] = {}


def period_id(day):
    return ((F.year(day) - FIRST_YEAR) * 12 + F.month(day)).cast("int")


class PlanningTables:
    """Lazily stored planning tables for one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _is_stored(self, name: str) -> bool:
        return (self.spark.sparkContext.applicationId, self.folder, name) in _stored

    def _store(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key in _stored:
            try:
                return self.spark.read.parquet(_stored[key])
            except AnalysisException:
                pass  # the stored copy is gone; project it again
        path = new_folder(self.spark, name)
        writer = build().write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        _stored[key] = path
        return self.spark.read.parquet(path)

    # ---- dimensions -----------------------------------------------------

    @cached_property
    def fiscal_period(self) -> DataFrame:
        return self._store("fiscal_period", self._fiscal_period)

    def _fiscal_period(self) -> DataFrame:
        """Months from the first shipping year to the year after the last, plus a 13th per year."""
        years = self.raw("lineitem").agg(
            F.min(F.year("l_shipdate")).alias("y0"), (F.max(F.year("l_shipdate")) + 1).alias("y1")
        )
        months = years.select(F.explode(F.sequence("y0", "y1")).alias("fiscal_year")).select(
            "fiscal_year", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("fiscal_month")
        )
        adjustment = F.col("fiscal_month") == 13
        calendar_month = F.least("fiscal_month", F.lit(12))
        start = F.make_date("fiscal_year", calendar_month, F.lit(1))
        return months.select(
            F.when(adjustment, F.col("fiscal_year") + 1000)
            .otherwise((F.col("fiscal_year") - FIRST_YEAR) * 12 + F.col("fiscal_month"))
            .cast("int")
            .alias("fiscal_period_id"),
            F.col("fiscal_year").cast("int"),
            F.ceil(calendar_month / 3).cast("int").alias("fiscal_quarter"),
            F.col("fiscal_month").cast("int"),
            F.concat(F.lit("FY"), "fiscal_year", F.lit("-P"), F.lpad(F.col("fiscal_month").cast("string"), 2, "0")).alias(
                "period_name"
            ),
            F.when(adjustment, F.last_day(start)).otherwise(start).alias("period_start"),
            F.last_day(start).alias("period_end"),
            F.when(adjustment, F.col("fiscal_year") < FIRST_OPEN_YEAR + 2)
            .otherwise(F.col("fiscal_year") < FIRST_OPEN_YEAR)
            .alias("is_closed"),
            adjustment.alias("is_adjustment"),
        )

    @cached_property
    def cost_center(self) -> DataFrame:
        return self._store("cost_center", self._cost_center)

    def _cost_center(self) -> DataFrame:
        region, nation, supplier = self.raw("region"), self.raw("nation"), self.raw("supplier")

        def node(df, id_, code, name, parent, weight, active=F.lit(True), until=F.lit(None)):
            return df.select(
                id_.cast("int").alias("cost_center_id"),
                code.alias("code"),
                name.alias("name"),
                parent.cast("int").alias("parent_id"),
                weight.cast(WEIGHT).alias("weight"),
                active.alias("is_active"),
                F.to_date(F.lit(CHART_FROM)).alias("effective_from"),
                until.cast("date").alias("effective_to"),
            )

        top = node(
            self.spark.range(1), F.lit(1), F.lit("ALL"), F.lit("All entities"), F.lit(None), F.lit("1.0")
        )
        regions = node(
            region, 10 + F.col("r_regionkey"), F.concat(F.lit("R"), "r_regionkey"), F.col("r_name"), F.lit(1), F.lit("0.5")
        )
        nation_code = F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey")
        nations = node(
            nation, 100 + F.col("n_nationkey"), nation_code, F.col("n_name"), 10 + F.col("n_regionkey"), F.lit("0.25")
        )
        key = F.col("s_suppkey")
        suppliers = node(
            supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
            1000 + key,
            F.concat(nation_code, F.lit("-S"), "s_suppkey"),
            F.col("s_name"),
            100 + F.col("n_nationkey"),
            F.concat(F.lit("0."), (key % 9 + 1).cast("string")),
            key % 17 != 3,
            F.when(key % 23 == 5, F.to_date(F.lit("1999-12-31"))),
        )
        return top.unionByName(regions).unionByName(nations).unionByName(suppliers)

    @cached_property
    def cost_center_history(self) -> DataFrame:
        """Row versions: every seventh leaf had another name and weight until 1999."""
        now = self.cost_center
        reorganised = (F.col("cost_center_id") > 1000) & (F.col("cost_center_id") % 7 == 0)
        change = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
        begin = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
        end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
        current = now.withColumn("valid_from", F.when(reorganised, change).otherwise(begin)).withColumn("valid_to", end)
        former = (
            now.filter(reorganised)
            .withColumn("name", F.concat(F.lit("Former "), "name"))
            .withColumn("weight", F.lit("0.1").cast(WEIGHT))
            .withColumn("valid_from", begin)
            .withColumn("valid_to", change)
        )
        return current.unionByName(former)

    @cached_property
    def gl_account(self) -> DataFrame:
        return self._store("gl_account", self._gl_account)

    def _gl_account(self) -> DataFrame:
        number = F.substring("p_brand", 7, 10).cast("int")
        types = F.array(*[F.lit(t) for t in ("R", "X", "A", "L", "E")])
        brands = (
            self.raw("part")
            .select("p_brand")
            .distinct()
            .select(
                number.alias("gl_account_id"),
                F.concat(F.lit("GL"), F.lpad(F.substring("p_brand", 7, 10), 3, "0")).alias("account_number"),
                F.col("p_brand").alias("account_name"),
                F.element_at(types, number % 5 + 1).alias("account_type"),
                (number % 8 != 0).alias("is_budgetable"),
                F.lit(False).alias("intercompany_flag"),
                F.lit(None).cast("int").alias("consolidation_account_id"),
            )
        )
        special = self.spark.createDataFrame(
            [
                (101, "GL101", "IC receivable", "A", True, True, 102),
                (102, "GL102", "IC payable", "L", True, True, 101),
                (103, "GL103", "IC suspense", "A", True, True, 999),
                (104, "GL104", "Overhead", "X", True, False, None),
            ],
            brands.schema,
        )
        return brands.unionByName(special)

    @cached_property
    def budget_header(self) -> DataFrame:
        return self._store("budget_header", self._budget_header)

    def _budget_header(self) -> DataFrame:
        """One budget per return flag, spanning the periods of its lines."""
        spans = self.budget_line_item.groupBy("header_id").agg(
            F.min("fiscal_period_id").alias("start_period_id"), F.max("fiscal_period_id").alias("end_period_id")
        )

        def by_header(*values):
            return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("header_id"))

        return spans.select(
            "header_id",
            by_header("BASE", "COMP", "DRFT").alias("budget_code"),
            by_header("Base plan", "Comparison plan", "Draft plan").alias("budget_name"),
            F.lit("ANNUAL").alias("budget_type"),
            by_header("BASE", "OPTIMISTIC", "STRETCH").alias("scenario_type"),
            by_header("APPROVED", "LOCKED", "DRAFT").alias("status_code"),
            F.col("header_id").alias("version_number"),
            F.lit(FIRST_OPEN_YEAR).alias("fiscal_year"),
            "start_period_id",
            "end_period_id",
            F.lit(None).cast("int").alias("base_header_id"),
            F.lit(None).cast("string").alias("extended_properties"),
            F.when(F.col("header_id") == 2, F.lit("2000-01-01").cast("timestamp_ntz")).alias("locked_at"),
        )

    # ---- facts ----------------------------------------------------------

    @cached_property
    def budget_line_item(self) -> DataFrame:
        """All budgets; what ``lines_of`` has stored of them is not projected again."""
        alone = [h for h in HEADERS if self._is_stored(f"budget-{h}")]
        if not alone or self._is_stored("budget_line_item"):
            return self._lines("budget_line_item", lambda: self._budget_line_item())
        others = self._lines("other-budgets-" + "-".join(map(str, alone)), lambda: self._budget_line_item().filter(~F.col("header_id").isin(alone)))
        for header_id in alone:
            others = others.unionByName(self.lines_of(header_id))
        return others

    def lines_of(self, header_id: int) -> DataFrame:
        """The lines of one budget. Only they are projected if the whole table is not there yet."""
        if self._is_stored("budget_line_item"):
            return self.budget_line_item.filter(F.col("header_id") == header_id)
        return self._lines(f"budget-{header_id}", lambda: self._budget_line_item().filter(F.col("header_id") == header_id))

    def _lines(self, name: str, build) -> DataFrame:
        return self._store(name, build, partition_by="header_id").withColumn("header_id", F.col("header_id").cast("int"))

    def _budget_line_item(self) -> DataFrame:
        lines = self._trade_lines().unionByName(self._intercompany_lines()).unionByName(self._overhead_lines())
        header, gl, cc, period = (
            F.col(c).cast("long") for c in ("header_id", "gl_account_id", "cost_center_id", "fiscal_period_id")
        )
        return lines.select(
            (((header * 1000 + gl) * 10000000000 + cc) * 1000 + period).alias("line_id"),
            "header_id",
            "gl_account_id",
            "cost_center_id",
            "fiscal_period_id",
            F.col("original_amount").cast(MONEY).alias("original_amount"),
            F.col("adjusted_amount").cast(MONEY).alias("adjusted_amount"),
            (F.col("original_amount") + F.col("adjusted_amount")).cast(FINAL).alias("final_amount"),
            F.when(gl % 3 == 0, F.col("original_amount")).cast(MONEY).alias("local_currency_amount"),
            F.when(period % 2 == 0, F.col("original_amount")).cast(MONEY).alias("reporting_currency_amount"),
            F.lit(None).cast("string").alias("spread_method"),
            F.lit("LEDGER").alias("source_system"),
            F.lit(None).cast("string").alias("source_reference"),
            F.lit(False).alias("is_allocated"),
            F.lit(None).cast("long").alias("allocation_source_line_id"),
            F.lit(None).cast("decimal(18,6)").alias("allocation_pct"),
        )

    def _trade_lines(self) -> DataFrame:
        flag = F.col("l_returnflag")
        priced = self.raw("lineitem").join(self.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return priced.groupBy(
            F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("header_id"),
            F.substring("p_brand", 7, 10).cast("int").alias("gl_account_id"),
            (1000 + F.col("l_suppkey")).cast("int").alias("cost_center_id"),
            period_id("l_shipdate").alias("fiscal_period_id"),
        ).agg(
            F.sum(F.col("l_extendedprice").cast(MONEY)).alias("original_amount"),
            (-F.sum(F.col("l_quantity").cast(MONEY))).alias("adjusted_amount"),
        )

    def _intercompany_lines(self) -> DataFrame:
        """Twelve monthly balances on three intercompany accounts for every supplier."""
        legs = F.array(
            F.struct(F.lit(101).alias("gl"), F.lit(1).alias("sgn")),
            F.struct(F.lit(102).alias("gl"), F.lit(-1).alias("sgn")),
            F.struct(F.lit(103).alias("gl"), F.lit(1).alias("sgn")),
        )
        key, period = F.col("s_suppkey"), F.col("period")
        balance = F.when((key % 5 == 0) & (period % 7 == 0), 0).otherwise(
            (1000 + key) * F.when(period % 2 == 0, 1).otherwise(-1) * F.col("leg.sgn")
        )
        on_payable = F.col("leg.gl") == 102
        offset = (
            F.when(on_payable & (F.col("n_regionkey") == 1) & (key % 4 == 1), F.lit("3").cast(MONEY))
            .when(on_payable & (F.col("n_regionkey") == 2), F.lit("0.01").cast(MONEY))
            .otherwise(F.lit("0").cast(MONEY))
        )
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .withColumn("leg", F.explode(legs))
            .select(
                F.lit(1).alias("header_id"),
                F.col("leg.gl").alias("gl_account_id"),
                (1000 + key).cast("int").alias("cost_center_id"),
                period.alias("fiscal_period_id"),
                (balance.cast(MONEY) + offset).alias("original_amount"),
                F.lit("0").cast(MONEY).alias("adjusted_amount"),
            )
        )

    def _overhead_lines(self) -> DataFrame:
        """Order value per customer nation and month, booked on the nation's cost centre."""
        placed = self.raw("orders").join(
            self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        )
        return placed.groupBy(
            F.lit(1).alias("header_id"),
            F.lit(104).alias("gl_account_id"),
            (100 + F.col("c_nationkey")).cast("int").alias("cost_center_id"),
            period_id("o_orderdate").alias("fiscal_period_id"),
        ).agg(
            F.sum(F.col("o_totalprice").cast(MONEY)).alias("original_amount"),
            F.lit("0").cast(MONEY).alias("adjusted_amount"),
        )

    @cached_property
    def import_staging(self) -> DataFrame:
        stored = self._store("import_staging", self._import_staging)
        names = [c for c in stored.columns if c not in (PIECE, SLOT)]
        return with_dense_index(stored, "row_id").select("row_id", *names)

    def _import_staging(self) -> DataFrame:
        """Every shipped line as an import row with codes; some codes are bad, some amounts missing.

        Stored in order with piece and position, from which readers get the row
        id. Rows that agree in all of ``order`` are alike in every column, so
        the order needs no more columns of the line.
        """
        centres = (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "n_regionkey", "n_nationkey")
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
        brands = self.raw("part").select("p_partkey", F.substring("p_brand", 7, 10).alias("brand"))
        lines = (
            self.raw("lineitem")
            .join(brands, F.col("l_partkey") == F.col("p_partkey"))
            .join(centres, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(*order, "brand", "n_regionkey", "n_nationkey")
        )
        bad = F.col("l_orderkey") % 53 == 0
        missing = (F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 11 == 0)
        return in_order(lines, order).select(
            F.when(bad, F.concat(F.lit("BAD"), "l_partkey"))
            .otherwise(F.concat(F.lit("GL"), F.lpad("brand", 3, "0")))
            .alias("account_number"),
            F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey", F.lit("-S"), "l_suppkey").alias("cost_center_code"),
            F.year("l_shipdate").cast("int").alias("fiscal_year"),
            F.month("l_shipdate").cast("int").alias("fiscal_month"),
            F.when(~missing, F.col("l_extendedprice").cast(MONEY)).alias("original_amount"),
            (-F.col("l_quantity").cast(MONEY)).cast(MONEY).alias("adjusted_amount"),
            F.lit("EVEN").alias("spread_method"),
            F.lit(None).cast("string").alias("notes"),
            PIECE,
            SLOT,
        )

    @cached_property
    def journal(self) -> DataFrame:
        """One consolidation journal per order."""
        status = F.when(F.col("o_orderstatus") == "O", "DRAFT").when(F.col("o_orderstatus") == "P", "SUBMITTED").otherwise("POSTED")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("journal_id"),
            F.concat(F.lit("J"), "o_orderkey").alias("journal_number"),
            F.lit("ADJUSTMENT").alias("journal_type"),
            F.lit(1).alias("header_id"),
            period_id("o_orderdate").alias("fiscal_period_id"),
            F.col("o_orderdate").cast("date").alias("posting_date"),
            F.lit(None).cast("string").alias("description"),
            status.alias("status_code"),
        )

    @cached_property
    def journal_line(self) -> DataFrame:
        """One journal line per shipped line: odd line numbers debit, even ones credit."""
        amount = F.col("l_extendedprice").cast(MONEY)
        odd = F.col("l_linenumber") % 2 == 1
        zero = F.lit("0").cast(MONEY)
        return (
            self.raw("lineitem")
            .join(self.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("journal_id"),
                F.col("l_linenumber").alias("line_number"),
                F.substring("p_brand", 7, 10).cast("int").alias("gl_account_id"),
                (1000 + F.col("l_suppkey")).cast("int").alias("cost_center_id"),
                F.when(odd, amount).otherwise(zero).alias("debit_amount"),
                # a few lines carry both sides, which the journal rules forbid
                F.when(~odd | (F.col("l_orderkey") % 101 == 0), amount).otherwise(zero).alias("credit_amount"),
                F.lit(None).cast("string").alias("description"),
            )
        )

    # ---- allocation rules ----------------------------------------------

    @cached_property
    def allocation_rule(self) -> DataFrame:
        return self._store("allocation_rule", self._allocation_rule)

    def _allocation_rule(self) -> DataFrame:
        """One direct rule per supplier and one pattern rule per region."""

        def target(attributes, body=F.lit("")):
            return F.concat(F.lit("<Target "), attributes, F.lit(">"), body, F.lit("</Target>"))

        def attribute(name, value):
            return F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('" '))

        def spec(*targets):
            return F.concat(F.lit("<AllocationTargets>"), *targets, F.lit("</AllocationTargets>"))

        key, nation = F.col("s_suppkey"), F.col("n_nationkey")
        own_code = F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey", F.lit("-S"), "s_suppkey")
        conditional = F.when(
            key % 6 == 1, F.lit("<AccountFilter>GL0%</AccountFilter><Conditions><Condition>x</Condition></Conditions>")
        ).otherwise(F.lit("<ExcludePattern>GL9%</ExcludePattern>"))
        supplier_spec = spec(
            target(
                F.concat(
                    attribute("CostCenterID", 100 + nation), attribute("AllocationPercentage", F.lit("0.25")),
                    attribute("Priority", F.lit(1)),
                )
            ),
            target(F.concat(attribute("CostCenterCode", own_code), attribute("Priority", F.lit(2))), conditional),
        )
        suppliers = (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                (1000 + key).cast("int").alias("rule_id"),
                F.concat(F.lit("SUP_"), "s_suppkey").alias("rule_code"),
                F.concat(F.lit("Rule of "), "s_name").alias("rule_name"),
                F.lit("DIRECT").alias("rule_type"),
                F.lit("REVENUE").alias("allocation_method"),
                (1000 + key).cast("int").alias("source_cost_center_id"),
                F.lit(None).cast("string").alias("cc_pattern"),
                F.when(key % 3 == 1, "GL0__").when(key % 3 == 2, "GL01%").alias("account_pattern"),
                supplier_spec.alias("target_spec"),
                F.element_at(F.array(*map(F.lit, ("REVENUE", "EXPENSE", "HEADCOUNT", "CUSTOM"))), (key % 4 + 1).cast("int")).alias("basis"),
                F.when(key % 5 == 0, "UP").when(key % 5 == 1, "DOWN").otherwise("NEAREST").alias("rounding"),
                (10 + key % 3 * 10).cast("int").alias("sequence"),
                # chains 3 -> 2 -> 1 -> 0, one rule with an absent parent, one two-cycle
                F.when(key % 16 == 12, 1001 + key)
                .when(key % 10 == 4, 900000 + key)
                .when(key % 4 != 0, 999 + key)
                .cast("int")
                .alias("depends_on"),
                F.to_date(F.lit(CHART_FROM)).alias("effective_from"),
                F.when(key % 11 == 7, F.to_date(F.lit("1998-12-31"))).alias("effective_to"),
                (key % 13 != 5).alias("is_active"),
            )
        )
        region = F.col("r_regionkey")
        region_spec = spec(
            target(F.concat(attribute("CostCenterID", 10 + region), attribute("Priority", F.lit(1)))),
            target(
                F.concat(
                    attribute("CostCenterCode", F.concat(F.lit("R"), "r_regionkey")),
                    attribute("AllocationPercentage", F.lit("0.125")), attribute("Priority", F.lit(2)),
                )
            ),
            target(F.concat(attribute("CostCenterCode", F.lit("NOWHERE")), attribute("Priority", F.lit(3)))),
        )
        regions = self.raw("region").select(
            (10 + region).cast("int").alias("rule_id"),
            F.concat(F.lit("REG_"), "r_regionkey").alias("rule_code"),
            F.concat(F.lit("Overhead of "), "r_name").alias("rule_name"),
            F.lit("STEP_DOWN").alias("rule_type"),
            F.lit("HEADCOUNT").alias("allocation_method"),
            F.lit(None).cast("int").alias("source_cost_center_id"),
            F.concat(F.lit("R"), "r_regionkey", F.lit("-N%")).alias("cc_pattern"),
            F.when(region % 2 == 0, "GL104").otherwise("GL_04").alias("account_pattern"),
            region_spec.alias("target_spec"),
            F.when(region % 2 == 0, "EQUAL").otherwise("HEADCOUNT").alias("basis"),
            F.lit("NEAREST").alias("rounding"),
            F.lit(5).alias("sequence"),
            F.lit(None).cast("int").alias("depends_on"),
            F.to_date(F.lit(CHART_FROM)).alias("effective_from"),
            F.lit(None).cast("date").alias("effective_to"),
            F.lit(True).alias("is_active"),
        )
        return suppliers.unionByName(regions)


#: The raw tables that grow.
FACTS = ("customer", "supplier", "part", "orders", "lineitem")


def planning_tables(spark: SparkSession, folder: str) -> PlanningTables:
    tables = PlanningTables(spark, folder)
    bound_tasks(spark, [f"{tables.folder}/{name}.parquet" for name in FACTS])
    return tables
