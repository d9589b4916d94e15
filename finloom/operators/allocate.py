"""Rule-driven cost allocation."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.functions.columns import effective_on
from finloom.functions.patterns import like, matches_all, pattern_pairs
from finloom.operators.sinks import new_lines
from finloom.schemas import FACTOR, FINAL, MONEY, NATURAL_KEY
from finloom.session import materialise
from finloom.sources.documents import rule_targets


def pattern_matches(rules: DataFrame, pattern: str, dimension: DataFrame, key: str, text: str) -> DataFrame:
    """(rule_id, key): dimension rows whose ``text`` matches the rule's LIKE pattern; a null pattern matches everything, like ``%``.

    Distinct patterns are matched with the texts once, through an index of
    their literals.
    """
    wanted = rules.select("rule_id", F.when(matches_all(pattern), "%").otherwise(F.col(pattern)).alias("pattern"))
    texts = dimension.select(key, F.coalesce(text, F.lit("")).alias("text"))
    return pattern_pairs(wanted.select("pattern"), texts).join(wanted, "pattern").select("rule_id", key)


def active_rules(rules: DataFrame, rule_ids: list[int] | None = None, as_of: dt.date | None = None) -> DataFrame:
    """Active rules, of the list when there is one; ``as_of`` also enforces their dates."""
    chosen = rules.filter("is_active")
    if rule_ids is not None:
        chosen = chosen.filter(F.col("rule_id").isin(rule_ids))
    return chosen if as_of is None else chosen.filter(effective_on(as_of))


def parse_rule_ids(text: str | None) -> list[int] | None:
    """Comma-separated rule ids; entries that are no number are ignored."""
    if text is None:
        return None
    return [int(part) for part in (p.strip() for p in text.split(",")) if part.lstrip("+-").isdigit()]


class RuleMatches(NamedTuple):
    """Dimension rows each rule takes its lines from, and the accounts of each account pattern."""

    by_centre: DataFrame
    by_account: DataFrame
    pattern_accounts: DataFrame


def rule_matches(rules: DataFrame, cost_centers: DataFrame, accounts: DataFrame) -> RuleMatches:
    """Rules that name or describe cost centres with those, all other rules with the accounts they describe.

    A pattern that every text matches counts as none.
    """
    numbers = accounts.select("gl_account_id", "account_number")
    centre = cost_centers.select("cost_center_id", "code")
    for pattern in ("cc_pattern", "account_pattern"):
        rules = rules.withColumn(pattern, F.when(~matches_all(pattern), F.col(pattern)))
    detail = rules.select("rule_id", "sequence", "depends_on", "basis", "rounding", "account_pattern")
    named = (
        rules.join(centre, F.col("source_cost_center_id") == F.col("cost_center_id"))
        .filter(F.col("cc_pattern").isNull() | like("code", "cc_pattern"))
        .select("rule_id", "cost_center_id")
    )
    anywhere = F.col("source_cost_center_id").isNull() & F.col("cc_pattern").isNull()
    described = F.col("source_cost_center_id").isNull() & F.col("cc_pattern").isNotNull()
    # centres and accounts are looked up together; a rule that takes everything has no pattern to look up but a percent sign
    of_account = F.coalesce("account_pattern", F.when(anywhere, "%"))
    wanted = rules.select(
        F.inline(F.array(F.struct(F.lit("C").alias("domain"), F.when(described, F.col("cc_pattern")).alias("pattern")), F.struct(F.lit("A").alias("domain"), of_account.alias("pattern"))))
    )
    texts = centre.select(F.lit("C").alias("domain"), F.col("cost_center_id").alias("id"), F.coalesce("code", F.lit("")).alias("text")).unionByName(
        numbers.select(F.lit("A").alias("domain"), F.col("gl_account_id").alias("id"), F.coalesce("account_number", F.lit("")).alias("text"))
    )
    # stored, because their true size decides how the lines meet them
    pairs = materialise(pattern_pairs(wanted, texts, "domain").select("domain", "pattern", "id"), "pattern-pairs")
    of_centre = pairs.filter("domain = 'C'").select("pattern", F.col("id").alias("cost_center_id"))
    pattern_accounts = pairs.filter("domain = 'A'").select("pattern", F.col("id").alias("gl_account_id"))
    through_pattern = rules.filter(described).withColumnRenamed("cc_pattern", "pattern").join(of_centre, "pattern").select("rule_id", "cost_center_id")
    by_centre = named.unionByName(through_pattern)
    by_account = rules.filter(anywhere).select("rule_id", of_account.alias("pattern")).join(pattern_accounts, "pattern").select("rule_id", "gl_account_id")
    return RuleMatches(
        materialise(by_centre.join(detail, "rule_id"), "rule-centres"),
        materialise(by_account.join(detail, "rule_id"), "rule-accounts"),
        pattern_accounts.withColumnRenamed("pattern", "account_pattern"),
    )


def open_lines(lines: DataFrame, fiscal_period_id: int | None = None) -> DataFrame:
    """Lines that can still be allocated; a line without a flag is not allocated yet."""
    found = lines.filter((F.col("final_amount") != 0) & ~F.coalesce("is_allocated", F.lit(False)))
    if fiscal_period_id is not None:
        found = found.filter(F.col("fiscal_period_id") == fiscal_period_id)
    return found.select("line_id", "gl_account_id", "cost_center_id", "fiscal_period_id", "final_amount")


def attach_rules(rows: DataFrame, matches: RuleMatches, cost_centers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each row with each rule that takes it; rows have an account and a cost centre.

    Equality joins on ids only; what is left of a rule is a row filter. The
    rows are read twice: once by centre, once by account.
    """
    # no rule keeps a pattern of percent signs alone, so one stands for rules that take every account
    every = accounts.select(F.lit("%").alias("account_pattern"), "gl_account_id")
    taken = matches.pattern_accounts.filter("account_pattern <> '%'").unionByName(every)
    centres = cost_centers.select("cost_center_id")
    columns = [*rows.columns, "rule_id", "sequence", "depends_on", "basis", "rounding"]
    at_centre = rows.join(matches.by_centre, "cost_center_id").withColumn("account_pattern", F.coalesce("account_pattern", F.lit("%")))
    through_centre = at_centre.join(taken, ["account_pattern", "gl_account_id"], "left_semi").select(*columns)
    through_account = rows.join(matches.by_account, "gl_account_id").join(centres, "cost_center_id", "left_semi")
    return through_centre.unionByName(through_account.select(*columns))


def rule_sources(
    lines: DataFrame, rules: DataFrame, cost_centers: DataFrame, accounts: DataFrame, fiscal_period_id: int | None = None
) -> DataFrame:
    """Rule-line combinations: the lines each rule allocates."""
    matches = rule_matches(rules, cost_centers, accounts)
    return attach_rules(open_lines(lines, fiscal_period_id), matches, cost_centers, accounts)


def target_centres(targets: DataFrame, cost_centers: DataFrame) -> DataFrame:
    """Targets with their cost centre by id or by code; a target naming two centres yields both.

    Two equality joins instead of one join on a disjunction.
    """
    centre = cost_centers.select(
        F.col("cost_center_id").alias("joined_id"),
        F.col("code").alias("_code"),
        F.col("name").alias("target_name"),
        F.col("parent_id").alias("target_parent_id"),
        F.col("is_active").alias("target_is_active"),
    )
    by_id = targets.join(centre, F.col("target_id") == F.col("joined_id"), "left").drop("_code")
    by_code = (
        targets.filter(F.col("target_code").isNotNull())
        .join(centre, F.col("target_code") == F.col("_code"))
        .filter(F.col("target_id").isNull() | (F.col("joined_id") != F.col("target_id")))
        .drop("_code")
    )
    # a target without a match by id stays only if the code finds none either
    found = by_id.filter(F.col("joined_id").isNotNull()).unionByName(by_code)
    unmatched = by_id.filter(F.col("joined_id").isNull()).join(
        cost_centers.select(F.col("code").alias("target_code")), "target_code", "left_anti"
    )
    return found.unionByName(unmatched.select(*found.columns))


def driver_amounts(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Revenue and expense per cost centre and period."""
    typed = accounts.filter(F.col("account_type").isin("R", "X")).select("gl_account_id", "account_type")
    return (
        lines.join(typed, "gl_account_id")
        .groupBy("cost_center_id", "fiscal_period_id", "account_type")
        .agg(F.sum("final_amount").cast(MONEY).alias("amount"))
    )


def source_totals(drivers: DataFrame, cost_centers: DataFrame) -> DataFrame:
    """Driver totals of each cost centre together with its direct children."""
    centres = cost_centers.select("cost_center_id", "parent_id")
    both = drivers.join(centres, "cost_center_id").select(
        F.explode(F.array_compact(F.array("cost_center_id", "parent_id"))).alias("source_id"),
        "fiscal_period_id",
        "account_type",
        "amount",
    )
    return both.groupBy("source_id", "fiscal_period_id", "account_type").agg(F.sum("amount").cast(MONEY).alias("source_total"))


def allocation_factor(
    requests: DataFrame, lines: DataFrame, accounts: DataFrame, cost_centers: DataFrame
) -> DataFrame:
    """Add ``factor`` to requests (source_id, target_id, basis, fiscal_period_id).

    REVENUE and EXPENSE: target amount over the source's own and children's
    amount; HEADCOUNT: target weight over the children's weights; EQUAL: one
    over the number of active children. 0 for any other basis, a zero or
    missing total or a missing target value; null when an input is null.
    """
    drivers = driver_amounts(lines, accounts)
    account_type = F.when(F.col("basis") == "REVENUE", "R").when(F.col("basis") == "EXPENSE", "X")
    totals = source_totals(drivers, cost_centers)
    values = drivers.select(F.col("cost_center_id").alias("target_id"), "fiscal_period_id", "account_type", F.col("amount").alias("target_value"))
    active = cost_centers.filter("is_active")
    children = (
        active.filter(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("source_id"))
        .agg(F.count("*").alias("_children"), F.sum("weight").cast(MONEY).alias("_children_weight"))
    )
    weights = active.select(F.col("cost_center_id").alias("target_id"), F.col("weight").cast(MONEY).alias("_target_weight"))

    headcount = F.col("basis") == "HEADCOUNT"
    total = F.when(headcount, F.col("_children_weight")).otherwise(F.col("source_total"))
    value = F.when(headcount, F.col("_target_weight")).otherwise(F.col("target_value"))
    # the guard stays around the division: operands outside the branch may be zero
    ratio = F.when(total.isNotNull() & (total != 0) & value.isNotNull(), (value / F.nullif(total, F.lit(0))).cast(FACTOR))
    equal = F.when(F.col("_children") > 0, (F.lit(1).cast("decimal(19,4)") / F.col("_children").cast("decimal(19,4)")).cast(FACTOR))
    known = F.lit(True)
    for name in ("source_id", "target_id", "basis", "fiscal_period_id"):
        known = known & F.col(name).isNotNull()
    factor = F.when(known, F.coalesce(F.when(F.col("basis") == "EQUAL", equal).otherwise(ratio), F.lit(0).cast(FACTOR)))
    return (
        requests.withColumn("account_type", account_type)
        .join(totals, ["source_id", "fiscal_period_id", "account_type"], "left")
        .join(values, ["target_id", "fiscal_period_id", "account_type"], "left")
        .join(children, "source_id", "left")
        .join(weights, "target_id", "left")
        .withColumn("factor", factor)
        .drop("account_type", "source_total", "target_value", "_children", "_children_weight", "_target_weight")
    )


def eligible_rules(rules: DataFrame, productive: DataFrame) -> DataFrame:
    """Rules without a parent, or whose chain of parents all produced rows and ends.

    Chains of any length count; a chain that runs into a cycle or to an unknown
    rule never ends. Runs on rule-sized frames only; the lines are read once
    for ``productive``. Every round doubles how far a rule looks and keeps one
    flag and one id per rule, until no chain is open or all rules are passed.
    """
    with_rows = rules.select("rule_id", "depends_on").join(productive.select("rule_id").distinct().withColumn("_rows", F.lit(True)), "rule_id", "left")
    # ``good``: the parents looked at so far have rows; ``beyond``: the next one
    steps = with_rows.select("rule_id", F.coalesce("_rows", F.lit(False)).alias("own"), F.lit(True).alias("good"), F.col("depends_on").alias("beyond"))
    steps = materialise(steps, "rules")
    seen, most = 1, steps.count()
    while seen <= most and not steps.filter("good AND beyond IS NOT NULL").isEmpty():
        upper = steps.select(F.col("rule_id").alias("beyond"), F.col("own").alias("_own"), F.col("good").alias("_good"), F.col("beyond").alias("_next"))
        going = steps.filter("good AND beyond IS NOT NULL").join(upper, "beyond", "left")
        # an unknown parent is not good
        going = going.select("rule_id", "own", F.coalesce(F.col("_own") & F.col("_good"), F.lit(False)).alias("good"), F.col("_next").alias("beyond"))
        steps = materialise(going.unionByName(steps.filter("NOT good OR beyond IS NULL")), "rules")
        seen *= 2
    return steps.filter("good AND beyond IS NULL").select("rule_id")


class Allocation(NamedTuple):
    """``lines``, ``marked`` and ``ledger`` are None after a dry run."""

    results: DataFrame
    lines: DataFrame | None
    marked: DataFrame | None
    totals: DataFrame
    ledger: DataFrame | None


def allocation_results(
    lines: DataFrame,
    rules: DataFrame,
    cost_centers: DataFrame,
    accounts: DataFrame,
    fiscal_period_id: int | None = None,
    rule_ids: list[int] | None = None,
    pct_first: bool = False,
    enforce_dates_on: dt.date | None = None,
) -> DataFrame:
    """Allocated amounts per source line and target for one budget's lines.

    UP and DOWN round the target percentage's share to cents (the driver's
    share where no percentage is given); every other mode rounds the driver's
    share, unless ``pct_first`` prefers the percentage there too.
    """
    chosen = active_rules(rules, rule_ids, enforce_dates_on)
    targets = (
        target_centres(rule_targets(chosen), cost_centers)
        .filter("target_is_active")
        .select("rule_id", "priority", "target_pct", F.coalesce("target_id", "joined_id").alias("target_id"))
    )
    targets = materialise(targets, "rule-targets")
    matches = rule_matches(chosen, cost_centers, accounts)
    # stored, because it is read for the factors and for the amounts
    taken = materialise(attach_rules(open_lines(lines, fiscal_period_id), matches, cost_centers, accounts), "rule-lines")
    # factors and eligibility depend on rule, cost centre and period, not on the single lines
    used = taken.select("rule_id", F.col("cost_center_id").alias("source_id"), "fiscal_period_id", "basis").distinct()
    used = materialise(used, "rule-use")
    productive = used.select("rule_id").join(targets.select("rule_id"), "rule_id", "left_semi")
    runnable = eligible_rules(chosen, productive)
    requests = used.join(runnable, "rule_id", "left_semi").join(targets, "rule_id")
    # stored, so that a small table of factors is broadcast and the lines are not shuffled for it
    factors = materialise(allocation_factor(requests, lines, accounts, cost_centers).drop("basis"), "factors")
    factored = (
        taken.withColumnRenamed("cost_center_id", "source_id")
        .join(factors, ["rule_id", "source_id", "fiscal_period_id"])
    )
    amount = F.col("final_amount").cast(MONEY)
    share = F.coalesce(F.col("target_pct").cast(FACTOR), F.col("factor"))
    driver_share = share if pct_first else F.col("factor")
    cents = amount * share * 100
    allocated = (
        F.when(F.col("rounding") == "UP", F.ceil(cents).cast("decimal(30,0)") / F.lit(100).cast("decimal(3,0)"))
        .when(F.col("rounding") == "DOWN", F.floor(cents).cast("decimal(30,0)") / F.lit(100).cast("decimal(3,0)"))
        .otherwise(F.round(amount * driver_share, 2))
    )
    return factored.select(
        F.col("line_id").alias("source_line_id"),
        F.col("target_id").alias("target_cost_center_id"),
        F.col("gl_account_id").alias("target_gl_account_id"),
        allocated.cast(MONEY).alias("amount"),
        F.coalesce(F.col("target_pct").cast("decimal(18,6)"), F.col("factor").cast("decimal(18,6)")).alias("pct"),
        "rule_id",
        "sequence",
        "priority",
        "fiscal_period_id",
    )


def allocation_ledger(results: DataFrame, header_id: int, target: DataFrame) -> DataFrame:
    """Every result row as a budget line with what becomes of it, stored.

    ``outcome`` is INSERT for the first row of a key by rule sequence, rule,
    source line and target priority, COLLISION for the others, and EXISTS for
    all rows of a key the budget already has. ``winner_line_id`` is the source
    line whose row is inserted, ``kept_line_id`` the line that was there. One
    aggregate finds the winners; rows that agree in everything count one by one.
    """
    candidates = results.select(
        F.lit(header_id).alias("header_id"),
        F.col("target_gl_account_id").alias("gl_account_id"),
        F.col("target_cost_center_id").alias("cost_center_id"),
        "fiscal_period_id",
        F.col("amount").alias("original_amount"),
        F.lit(0).cast(MONEY).alias("adjusted_amount"),
        F.col("amount").cast(FINAL).alias("final_amount"),
        F.lit(True).alias("is_allocated"),
        F.col("source_line_id").alias("allocation_source_line_id"),
        F.col("pct").alias("allocation_pct"),
        "rule_id",
        "sequence",
        "priority",
    )
    candidates = materialise(candidates.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    order = F.struct("sequence", "rule_id", "allocation_source_line_id", "priority", "_row")
    winners = candidates.groupBy(*NATURAL_KEY).agg(F.min(order).alias("_winner"))
    there = target.groupBy(*NATURAL_KEY).agg(F.min("line_id").alias("kept_line_id"))
    joined = candidates.join(winners.join(there, NATURAL_KEY, "left"), NATURAL_KEY)
    outcome = (
        F.when(F.col("kept_line_id").isNotNull(), "EXISTS").when(F.col("_winner._row") == F.col("_row"), "INSERT").otherwise("COLLISION")
    )
    winner = F.when(F.col("kept_line_id").isNull(), F.col("_winner.allocation_source_line_id"))
    return materialise(joined.withColumn("outcome", outcome).withColumn("winner_line_id", winner).drop("_winner", "_row"), "ledger")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Rows and amount per outcome; together they are all results."""
    return ledger.groupBy("outcome").agg(F.count("*").alias("rows"), F.sum("original_amount").cast("decimal(38,4)").alias("amount"))


def allocated_lines(ledger: DataFrame, target: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The ledger's inserted rows as new budget lines; ids follow the source lines.

    ``lines`` is the whole table when ``target`` is a part of it.
    """
    added = ledger.filter("outcome = 'INSERT'")
    return new_lines(added, target if lines is None else lines, ["allocation_source_line_id", "gl_account_id", "cost_center_id", "fiscal_period_id"])


def mark_allocated(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Budget lines with ``is_allocated`` set on every allocated source line."""
    sources = results.select(F.col("source_line_id").alias("line_id")).distinct().withColumn("_source", F.lit(True))
    return (
        lines.join(sources, "line_id", "left")
        .withColumn("is_allocated", F.coalesce("is_allocated", F.lit(False)) | F.col("_source").isNotNull())
        .drop("_source")
    )


def rule_totals(results: DataFrame) -> DataFrame:
    """Amount and number of result rows per rule."""
    return results.groupBy("rule_id").agg(
        F.sum("amount").cast("decimal(38,4)").alias("total_allocated"), F.count("*").alias("target_count")
    )


def allocate_costs(
    lines: DataFrame, header_id: int, rules: DataFrame, cost_centers: DataFrame, accounts: DataFrame, dry_run: bool = False, **options
) -> Allocation:
    """Allocation of one budget: results, lines to insert, marked lines, rule totals, and the ledger that says
    what becomes of every result; a dry run ends with results and totals.
    """
    budget = lines.filter(F.col("header_id") == header_id)
    results = allocation_results(budget, rules, cost_centers, accounts, **options)
    if dry_run:
        return Allocation(results, None, None, rule_totals(results), None)
    results = materialise(results, "allocated")
    ledger = allocation_ledger(results, header_id, budget)
    return Allocation(results, allocated_lines(ledger, budget, lines), mark_allocated(budget, results), rule_totals(results), ledger)
