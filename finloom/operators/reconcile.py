"""Intercompany reconciliation.

Pair sums come from per-entity totals instead of line-by-line joins, and
match statistics from counts per distinct amount instead of all line pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.columns import entity_of
from finloom.functions.ordering import lay_out, with_dense_index, with_last_known, with_next_known, with_running_total
from finloom.schemas import TOTAL
from finloom.session import materialise

PAIR_KEY = ["entity1", "entity2", "gl_account_id", "partner_account_id"]
LINK_KEY = ["gl_account_id", "partner_account_id"]
STATUS_RANK = {"UNRECONCILED": 1, "PARTIAL_MATCH": 2}


def entities_of_budget(lines: DataFrame, cost_centers: DataFrame) -> DataFrame:
    """Distinct entities of the budget's lines, all included."""
    centres = cost_centers.select("cost_center_id", entity_of(F.col("code")).alias("entity_code"))
    return (
        lines.select("cost_center_id")
        .distinct()
        .join(centres, "cost_center_id")
        .select("entity_code")
        .distinct()
        .withColumn("entity_name", F.lit(None).cast("string"))
        .withColumn("include", F.lit(True))
    )


def ic_links(accounts: DataFrame) -> DataFrame:
    """Intercompany accounts with their partner account."""
    return accounts.filter(F.col("intercompany_flag") & F.col("consolidation_account_id").isNotNull()).select(
        "gl_account_id", F.col("consolidation_account_id").alias("partner_account_id")
    )


def _link_accounts(accounts: DataFrame) -> DataFrame:
    """All accounts on either side of a link."""
    return ic_links(accounts).select(F.explode(F.array("gl_account_id", "partner_account_id")).alias("gl_account_id")).distinct()


#: Pairs that one task puts together.
ROWS_PER_TASK = 250_000


def linked_lines(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """The lines on either side of a link with the columns that pairs and matches need; matches of other lines do not exist."""
    return lines.join(_link_accounts(accounts), "gl_account_id", "left_semi").select(
        "line_id", "gl_account_id", "cost_center_id", "fiscal_period_id", "final_amount"
    )


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], split_by: str, rows_per_task: int) -> DataFrame:
    """``left`` with all rows of ``right`` of the same key, a left join whose hot keys are dealt to several tasks.

    The rows per key are counted on both sides first. A key whose pairs fill
    n tasks has its left rows dealt to n parts by ``split_by`` and its right
    rows, the side that is copied, repeated for each part.
    """
    pairs = F.col("_left").cast("double") * F.col("_right")
    parts = F.least(F.col("_left"), F.ceil(pairs / rows_per_task)).cast("int")
    counted = left.groupBy(*keys).agg(F.count("*").alias("_left")).join(right.groupBy(*keys).agg(F.count("*").alias("_right")), keys)
    counted = counted.select(*keys, parts.alias("_parts"))
    dealt = left.join(counted, keys, "left").withColumn("_part", F.pmod(F.xxhash64(split_by), F.coalesce("_parts", F.lit(1))).cast("int"))
    copied = right.join(counted, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [*keys, "_part"], "left").drop("_part")


def ic_pairs(
    lines: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    entities: DataFrame | None = None,
    tolerance_amount: str = "0.01",
    tolerance_pct: str = "0.001",
    mode: str = "reference",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Balances of each entity pair on each account and its partner account.

    ``reference`` multiplies each side by the other side's line count, which
    is what joining line by line does. ``per_period`` compares plain sums
    within a period. Without ``entities`` all of the budget's entities count.
    The result has one row per pair of entities that share a link; the pairs
    of one partner account are dealt to as many tasks as they fill.
    """
    grain = ["fiscal_period_id"] if mode == "per_period" else []
    centres = cost_centers.select("cost_center_id", entity_of(F.col("code")).alias("entity"))
    # one row per account and cost centre from here on, however many lines share them
    sums = (
        lines.join(_link_accounts(accounts), "gl_account_id", "left_semi")
        .groupBy("gl_account_id", "cost_center_id", *grain)
        .agg(F.sum("final_amount").alias("s"), F.count("*").alias("n"))
        .join(centres, "cost_center_id", "left")
        .withColumn("_known", F.col("entity").isNotNull())
        .groupBy("gl_account_id", F.coalesce("entity", F.lit("")).alias("entity"), "_known", *grain)
        .agg(F.sum("s").cast(TOTAL).alias("s"), F.sum("n").alias("n"))
    )
    sums = materialise(sums, "entity-sums")
    own = sums.filter("_known").join(ic_links(accounts), "gl_account_id")
    if entities is not None:
        included = entities.filter("include").select(F.col("entity_code").alias("entity"))
        own = own.join(included, "entity", "left_semi")
    own = own.select(
        F.col("entity").alias("entity1"), "gl_account_id", "partner_account_id", F.col("s").alias("s1"), F.col("n").alias("n1"), *grain
    )
    # lines of unknown cost centres and entities named '' fall together on the partner side
    partner = sums.groupBy(F.col("gl_account_id").alias("partner_account_id"), F.col("entity").alias("entity2"), *grain).agg(
        F.sum("s").cast(TOTAL).alias("s2"), F.sum("n").alias("n2")
    )
    zero = F.lit(0).cast(TOTAL)
    joined = _spread_join(own, partner, ["partner_account_id", *grain], "entity1", rows_per_task).withColumn("entity2", F.coalesce("entity2", F.lit("")))
    one, other = F.col("s1"), F.coalesce("s2", zero)
    if mode == "reference":
        one = one * F.coalesce("n2", F.lit(1))
        other = other * F.col("n1")
    pairs = joined.select(
        *PAIR_KEY, *grain, one.cast(TOTAL).alias("entity1_amount"), (-other).cast(TOTAL).alias("entity2_amount")
    ).filter((F.col("entity1_amount") != 0) | (F.col("entity2_amount") != 0))

    variance = (F.col("entity1_amount") - F.col("entity2_amount")).cast(TOTAL)
    size = F.abs("entity1_amount")
    tolerated = (F.abs("variance") <= F.lit(tolerance_amount).cast("decimal(19,4)")) | (
        (size > 0) & (F.abs("variance") <= F.lit(tolerance_pct).cast("decimal(5,4)") * size)
    )
    rounded = F.abs(F.round("entity1_amount", 0)).cast(TOTAL).cast("string")
    return (
        pairs.withColumn("variance", variance)
        .withColumn("variance_pct", F.when(size > 0, F.col("variance").cast("double") / size.cast("double")))
        .withColumn("is_within_tolerance", tolerated)
        .withColumn(
            "match_hash",
            F.sha2(F.concat_ws("|", "entity1", "entity2", F.col("gl_account_id").cast("string"), rounded), 256),
        )
    )


def match_amounts(lines: DataFrame, accounts: DataFrame, tolerance_amount: str = "0.01") -> DataFrame:
    """How the source lines of each distinct amount match the partner account's lines.

    One row per account, partner and source amount with the number of source
    lines and, per source line, the number of partner lines matching exactly,
    within tolerance or partially, and the nearest partner amount. Every line
    pair is counted and none is formed: the counts within tolerance are
    differences of a running count over the sorted partner amounts.
    """
    tolerance = F.lit(tolerance_amount).cast("decimal(19,4)")
    links = ic_links(accounts)
    amounts = (
        lines.join(_link_accounts(accounts), "gl_account_id", "left_semi")
        .groupBy("gl_account_id", F.col("final_amount").alias("amount"))
        .agg(F.count("*").alias("n"))
    )
    amounts = materialise(amounts, "ic-amounts")
    source = amounts.join(links, "gl_account_id")
    partner_accounts = links.select(F.col("partner_account_id").alias("gl_account_id")).distinct()
    target = amounts.join(partner_accounts, "gl_account_id", "left_semi")

    # the sought partner amount is the negated source amount; probes around it bound the tolerance band
    sought = -F.col("amount")
    probes = F.array(
        *[
            F.struct(point.cast("decimal(21,4)").alias("point"), F.lit(rank).alias("rank"), F.lit(probe).alias("probe"))
            for point, rank, probe in ((sought - tolerance, 0, "LOW"), (sought, 2, "AT"), (sought + tolerance, 3, "HIGH"))
        ]
    )
    questions = source.select(
        F.col("partner_account_id").alias("account"), "gl_account_id", "amount", F.inline(probes)
    ).withColumn("n", F.lit(0).cast("long"))
    # at equal points: LOW before the partner amounts, AT and HIGH after them
    events = questions.unionByName(
        target.select(
            F.col("gl_account_id").alias("account"), F.col("amount").cast("decimal(21,4)").alias("point"), "n"
        )
        .withColumn("rank", F.lit(1))
        .withColumn("probe", F.lit("TARGET")),
        allowMissingColumns=True,
    )
    placed = lay_out(events, ["account", "point", "rank", "gl_account_id", "amount"])
    is_target = F.col("probe") == "TARGET"
    held = F.when(is_target, F.struct("account", "point", "n"))
    placed = with_running_total(placed, "n", "upto")
    placed = with_next_known(with_last_known(placed, held, "below"), held, "above")

    def at(probe: str, value: Column, name: str) -> Column:
        return F.max(F.when(F.col("probe") == probe, value)).alias(name)

    def same_account(side: str) -> Column:
        return F.when(F.col(f"{side}.account") == F.col("account"), F.col(f"{side}.point"))

    answers = (
        placed.filter(~is_target)
        .groupBy("gl_account_id", F.col("account").alias("partner_account_id"), "amount")
        .agg(
            (at("HIGH", F.col("upto"), "_h") - at("LOW", F.col("upto"), "_l")).alias("within_n"),
            at("AT", same_account("below"), "below"),
            at("AT", same_account("above"), "above"),
            at("AT", F.when(same_account("below") == -F.col("amount"), F.col("below.n")), "exact_n"),
        )
    )
    partner_lines = target.groupBy(F.col("gl_account_id").alias("partner_account_id")).agg(F.sum("n").alias("partner_n"))
    zero = F.lit(0).cast("long")
    gap_below, gap_above = -F.col("amount") - F.col("below"), F.col("above") + F.col("amount")
    nearest = (
        F.when(F.col("above").isNull() | (gap_below <= gap_above), F.col("below")).otherwise(F.col("above")).cast("decimal(20,4)")
    )
    counted = (
        source.select(*LINK_KEY, "amount", F.col("n").alias("source_lines"))
        .join(answers, [*LINK_KEY, "amount"])
        .join(partner_lines, "partner_account_id", "left")
        .select(
            *LINK_KEY,
            F.col("amount").alias("source_amount"),
            "source_lines",
            F.coalesce("exact_n", zero).alias("exact_n"),
            (F.col("within_n") - F.coalesce("exact_n", zero)).alias("tolerance_n"),
            (F.coalesce("partner_n", zero) - F.col("within_n")).alias("partial_n"),
            F.coalesce("partner_n", zero).alias("partner_lines"),
            nearest.alias("nearest_amount"),
        )
    )
    distance = F.col("source_amount") + F.coalesce("nearest_amount", F.lit(0).cast("decimal(20,4)"))
    kind = (
        F.when(F.col("nearest_amount").isNull(), "UNMATCHED_SOURCE")
        .when(F.col("exact_n") > 0, "EXACT")
        .when(F.abs(distance) <= tolerance, "TOLERANCE")
        .otherwise("PARTIAL")
    )
    score = (
        F.when(F.col("exact_n") > 0, F.lit(1.0))
        .when(F.col("source_amount") != 0, 1.0 - F.abs(distance.cast("double") / F.col("source_amount").cast("double")))
        .otherwise(F.lit(0.0))
    )

    def shown(value: Column) -> Column:
        return F.call_function("format_number", F.round(value, 2), F.lit("#,##0.00"))

    return (
        counted.withColumn("match_type", kind)
        .withColumn("match_score", score)
        .withColumn(
            "match_details",
            F.concat(
                F.lit("Source: "),
                shown(F.col("source_amount")),
                F.lit(" | Target: "),
                shown(F.coalesce("nearest_amount", F.lit(0).cast("decimal(20,4)"))),
                F.lit(" | Diff: "),
                shown(distance),
            ),
        )
    )


def ranked_lines(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines on either side of a link with ``rank``, their place by line id among the lines of their account and amount.

    The rank is a distance in one spread order, so an amount that fills most
    of an account is not gathered anywhere.
    """
    own = lines.join(_link_accounts(accounts), "gl_account_id", "left_semi").select("gl_account_id", F.col("final_amount").alias("amount"), "line_id")
    numbered = with_dense_index(lay_out(own.filter("amount IS NOT NULL"), ["gl_account_id", "amount", "line_id"]), "_index")
    first = numbered.groupBy("gl_account_id", "amount").agg(F.min("_index").alias("_first"))
    ranked = numbered.join(first, ["gl_account_id", "amount"]).withColumn("rank", F.col("_index") - F.col("_first") + 1)
    return materialise(ranked.select("gl_account_id", "amount", "line_id", "rank"), "ranked")


def match_targets(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """source_line_id, gl_account_id, partner_account_id, target_line_id, target_amount and pairing of every source line.

    The k-th source line of an amount is paired with the k-th partner line of
    the opposite amount (EXACT), by line id. The source lines left over get
    the partner line left over in their link whose amount is NEAREST to the
    opposite one; of two equally near the lower amount, of equal amounts the
    lowest line id. A source line has no target when none is left over.
    Pairs are found by equality of amount and rank, and nearest amounts in one
    order of the amounts that are left over; no two lists of lines are multiplied.
    """
    ranked, links = ranked_lines(lines, accounts), ic_links(accounts)
    amounts = ranked.groupBy("gl_account_id", "amount").agg(F.max("rank").alias("n"))
    amounts = materialise(amounts, "ic-amounts")
    opposite = (-F.col("amount")).cast(amounts.schema["amount"].dataType)
    source = amounts.join(links, "gl_account_id").select(*LINK_KEY, opposite.alias("point"), F.col("n").alias("source_n"))
    target = links.join(amounts.withColumnRenamed("gl_account_id", "partner_account_id"), "partner_account_id")
    target = target.select(*LINK_KEY, F.col("amount").alias("point"), F.col("n").alias("target_n"))
    zero = F.lit(0).cast("long")
    sides = source.join(target, [*LINK_KEY, "point"], "full").select(
        *LINK_KEY, "point", F.coalesce("source_n", zero).alias("source_n"), F.coalesce("target_n", zero).alias("target_n")
    )
    # only one side of an amount can be left over
    left_over = lay_out(sides.filter("source_n <> target_n"), [*LINK_KEY, "point"])
    held = F.when(F.col("target_n") > F.col("source_n"), F.struct(*LINK_KEY, "point", (F.col("source_n") + 1).alias("rank")))
    placed = with_next_known(with_last_known(left_over, held, "below"), held, "above").filter("source_n > target_n")

    def of_link(side: str) -> Column:
        same = (F.col(f"{side}.gl_account_id") == F.col("gl_account_id")) & (F.col(f"{side}.partner_account_id") == F.col("partner_account_id"))
        return F.when(same, F.col(side))

    below, above = of_link("below"), of_link("above")
    is_below = above.isNull() | (F.col("point") - below["point"] <= above["point"] - F.col("point"))
    nearest = placed.select(*LINK_KEY, "point", "target_n", F.when(is_below, below).otherwise(above).alias("_t")).select(
        *LINK_KEY, "point", "target_n", F.col("_t.point").alias("near"), F.col("_t.rank").alias("near_rank")
    )
    # every source line asks for one line of its partner account, by amount and rank
    asked = (
        ranked.join(links, "gl_account_id")
        .withColumn("point", opposite)
        .join(nearest, [*LINK_KEY, "point"], "left")
        .withColumn("_exact", F.col("target_n").isNull() | (F.col("rank") <= F.col("target_n")))
        .select(
            F.col("line_id").alias("source_line_id"),
            *LINK_KEY,
            F.when(F.col("_exact"), "EXACT").otherwise("NEAREST").alias("pairing"),
            F.when(F.col("_exact"), F.col("point")).otherwise(F.col("near")).alias("target_amount"),
            F.when(F.col("_exact"), F.col("rank")).otherwise(F.col("near_rank")).alias("_rank"),
        )
    )
    there = ranked.select(
        F.col("gl_account_id").alias("partner_account_id"), F.col("amount").alias("target_amount"), F.col("rank").alias("_rank"), F.col("line_id").alias("target_line_id")
    )
    answered = asked.join(there, ["partner_account_id", "target_amount", "_rank"], "left")
    return answered.select(
        "source_line_id", *LINK_KEY, "target_line_id", "target_amount", F.when(F.col("target_line_id").isNotNull(), F.col("pairing")).alias("pairing")
    )


def match_lines(lines: DataFrame, matches: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Every intercompany source line with its match counts and best match, and with ``targets`` the line it is paired with."""
    detail = (
        lines.select(F.col("line_id").alias("source_line_id"), "gl_account_id", F.col("final_amount").alias("source_amount"))
        .join(matches, ["gl_account_id", "source_amount"])
        .drop("source_lines")
    )
    return detail if targets is None else detail.join(targets, ["source_line_id", *LINK_KEY], "left")


def match_types(matches: DataFrame) -> DataFrame:
    """Number of line pairs per account, partner and match type."""
    unmatched = F.when(F.col("partner_lines") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("match_type"), (F.col("source_lines") * n).alias("n"))
            for kind, n in (
                ("EXACT", F.col("exact_n")),
                ("TOLERANCE", F.col("tolerance_n")),
                ("PARTIAL", F.col("partial_n")),
                ("UNMATCHED_SOURCE", unmatched),
            )
        ]
    )
    return (
        matches.select(*LINK_KEY, F.inline(kinds))
        .filter(F.col("n") > 0)
        .groupBy(*LINK_KEY, "match_type")
        .agg(F.sum("n").alias("match_count"))
    )


def recon_status(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Reconciliation status of each pair."""
    found = matches.groupBy(*LINK_KEY).agg(
        F.max(F.col("exact_n") > 0).alias("_exact"), F.max(F.col("partial_n") > 0).alias("_partial")
    )
    status = (
        F.when(F.col("is_within_tolerance"), "RECONCILED")
        .when(F.col("_exact"), "MATCHED")
        .when(F.col("_partial"), "PARTIAL_MATCH")
        .otherwise("UNRECONCILED")
    )
    return pairs.join(found, LINK_KEY, "left").withColumn("status", status).drop("_exact", "_partial")


def recon_stats(status: DataFrame) -> DataFrame:
    """One row of totals over all pairs."""
    size = F.abs("variance")

    def total(condition: Column | None = None) -> Column:
        value = size if condition is None else F.when(condition, size)
        return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)

    unreconciled = F.col("status") == "UNRECONCILED"
    return status.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("status") == "RECONCILED").alias("reconciled"),
        F.count_if(unreconciled).alias("unreconciled"),
        total().alias("total_variance"),
        total(~F.col("is_within_tolerance")).alias("out_of_tolerance_variance"),
        total(unreconciled).alias("unreconciled_variance"),
    )


def entity_stats(status: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs and variance per included entity; a pair of one entity with itself counts once."""
    touched = (
        status.select(F.explode(F.array_distinct(F.array("entity1", "entity2"))).alias("entity_code"), F.abs("variance").alias("v"))
        .groupBy("entity_code")
        .agg(F.count("*").alias("pair_count"), F.sum("v").cast(TOTAL).alias("total_variance"))
    )
    return (
        entities.filter("include")
        .join(touched, "entity_code", "left")
        .select("entity_code", "entity_name", F.coalesce("pair_count", F.lit(0)).alias("pair_count"), "total_variance")
    )


def report_order() -> list[Column]:
    """Open pairs first, then by size of variance; the pair key breaks ties."""
    rank = F.when(F.col("status") == "UNRECONCILED", 1).when(F.col("status") == "PARTIAL_MATCH", 2).otherwise(3)
    return [rank, F.abs("variance").desc(), *[F.col(c) for c in PAIR_KEY]]
