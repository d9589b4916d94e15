import datetime as dt
import random
from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.operators import journals, reconcile
from finloom.plans.reconciliation import reconcile_intercompany
from finloom.sources.documents import entity_list

DAY = dt.date(2000, 3, 15)


def world(spark, rows, links=((101, 102), (102, 101), (103, 999))):
    codes = ["A-1", "A-2", "B-1", "A1-1", "B"]
    centres = b.cost_centers(spark, [{"cost_center_id": i + 1, "parent_id": None, "code": c} for i, c in enumerate(codes)])
    accounts = b.accounts(
        spark, [{"gl_account_id": g, "intercompany_flag": True, "consolidation_account_id": p} for g, p in links]
    )
    return b.lines(spark, rows), accounts, centres


def entity(code):
    return code.split("-")[0]


CODES = {1: "A-1", 2: "A-2", 3: "B-1", 4: "A1-1", 5: "B"}


def brute_pairs(rows, links):
    """Line by line, the way the joins are written down."""
    sums = {}
    for _, gl, cc, _, amount in rows:
        if gl not in links:
            continue
        partners = [(entity(CODES[c]), a) for _, g, c, _, a in rows if g == links[gl]] or [("", Decimal(0))]
        for other, partner_amount in partners:
            key = (entity(CODES[cc]), other, gl, links[gl])
            one, two = sums.get(key, (0, 0))
            sums[key] = (one + amount, two + partner_amount)
    return sorted((*k, a, -p) for k, (a, p) in sums.items() if a or p)


def random_rows(seed, n=120, hot=False):
    rnd = random.Random(seed)
    choices = [Decimal(x) for x in ("5", "-5", "5.005", "-4.995", "0", "7.01", "-7", "-7.02", "1000")]
    return [
        (i, 101 if hot and i % 3 else rnd.choice([101, 102, 103]), rnd.randint(1, 5), i, Decimal(5) if hot and i % 2 else rnd.choice(choices))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed, hot", [(1, False), (2, False), (3, True)])
def test_pairs_equal_line_by_line_sums(spark, seed, hot):
    rows = random_rows(seed, hot=hot)
    got = reconcile.ic_pairs(*world(spark, rows))
    assert b.collect(got, *reconcile.PAIR_KEY, "entity1_amount", "entity2_amount") == brute_pairs(rows, {101: 102, 102: 101, 103: 999})


def kind(a, c, tolerance=Decimal("0.01")):
    if a == -c:
        return "EXACT"
    return "TOLERANCE" if abs(a + c) <= tolerance else "PARTIAL"


@pytest.mark.parametrize("seed, hot", [(4, False), (5, True)])
def test_match_counts_equal_line_pairs(many_pieces, seed, hot):
    rows = random_rows(seed, hot=hot)
    lines, accounts, _ = world(many_pieces, rows)
    got = {(r["gl_account_id"], r["source_amount"]): r for r in reconcile.match_amounts(lines, accounts).collect()}
    amounts = {g: [r[4] for r in rows if r[1] == g] for g in (101, 102, 103)}
    for gl, partner in ((101, 102), (102, 101), (103, 999)):
        others = amounts.get(partner, [])
        assert {a for g, a in got if g == gl} == set(amounts[gl])
        for a in set(amounts[gl]):
            row = got[gl, a]
            kinds = [kind(a, c) for c in others]
            assert (row["exact_n"], row["tolerance_n"], row["partial_n"]) == tuple(map(kinds.count, ("EXACT", "TOLERANCE", "PARTIAL")))
            assert row["source_lines"] == amounts[gl].count(a) and row["partner_lines"] == len(others)
            if others:
                assert abs(a + row["nearest_amount"]) == min(abs(a + c) for c in others)
            else:
                assert row["nearest_amount"] is None and row["match_type"] == "UNMATCHED_SOURCE"


def test_details_text_and_score(spark):
    lines, accounts, _ = world(spark, [(1, 101, 1, 1, Decimal("1234.565")), (2, 102, 3, 1, Decimal("-1000"))])
    row = reconcile.match_amounts(lines, accounts).filter("gl_account_id = 101").first()
    assert row["match_details"] == "Source: 1,234.57 | Target: -1,000.00 | Diff: 234.57"
    assert row["match_type"] == "PARTIAL" and abs(row["match_score"] - (1 - 234.565 / 1234.565)) < 1e-12


def statuses(spark, rows):
    lines, accounts, centres = world(spark, rows)
    pairs = reconcile.ic_pairs(lines, accounts, centres)
    got = reconcile.recon_status(pairs, reconcile.match_amounts(lines, accounts))
    return {(r["entity1"], r["entity2"], r["gl_account_id"]): r["status"] for r in got.collect()}


def test_status_ladder(spark):
    # equal amounts
    assert statuses(spark, [(1, 101, 1, 1, 5), (2, 102, 3, 1, -5)])["A", "B", 101] == "RECONCILED"
    # one exact match among others
    got = statuses(spark, [(1, 101, 1, 1, 5), (2, 101, 1, 2, 900), (3, 102, 3, 1, -5)])
    assert got["A", "B", 101] == "MATCHED"
    assert statuses(spark, [(1, 101, 1, 1, 5), (2, 102, 3, 1, -9)])["A", "B", 101] == "PARTIAL_MATCH"
    # no partner lines at all
    assert statuses(spark, [(1, 103, 1, 1, 5)])["A", "", 103] == "UNRECONCILED"
    # only matches within tolerance, whose differences add up beyond it
    close = [(i, 101, 1, i, Decimal("0.005")) for i in range(4)] + [(10 + i, 102, 3, i, Decimal(0)) for i in range(4)]
    assert statuses(spark, close)["A", "B", 101] == "UNRECONCILED"


def test_tolerances(spark):
    def flags(one, two):
        pairs = reconcile.ic_pairs(*world(spark, [(1, 101, 1, 1, one), (2, 102, 3, 1, two)], links=((101, 102),)))
        return [r["is_within_tolerance"] for r in pairs.collect()]

    assert flags("5", "-4.99") == [True]
    assert flags("5", "-4.98") == [False]
    assert flags("5000", "-4995") == [True]
    assert flags("5000", "-4994.99") == [False]
    assert flags("0", "-4") == [False]


def test_entity_prefix_is_exact(spark):
    lines, accounts, centres = world(spark, [(1, 103, 1, 1, 5), (2, 103, 4, 1, 7)])
    pairs = reconcile.ic_pairs(lines, accounts, centres)
    status = reconcile.recon_status(pairs, reconcile.match_amounts(lines, accounts))
    got = b.collect(journals.adjustment_lines(status, centres, 9), "line_number", "cost_center_id", "debit_amount", "description")
    assert got == [(1, 1, 5, "IC Adjustment: A <-> "), (2, 4, 7, "IC Adjustment: A1 <-> ")]


def test_entity_filter_and_stats(spark):
    lines, accounts, centres = world(spark, [(1, 101, 1, 1, 5), (2, 102, 2, 1, -4), (3, 102, 3, 1, -1)])
    listed = entity_list(spark, '<Entities><Entity Code="A" Name="x"/><Entity Code="B" Include="0"/></Entities>')
    assert b.collect(listed, "entity_code", "include") == [("A", True), ("B", False)]
    pairs = reconcile.ic_pairs(lines, accounts, centres, entities=listed)
    assert {r["entity1"] for r in pairs.collect()} == {"A"}
    status = reconcile.recon_status(pairs, reconcile.match_amounts(lines, accounts))
    # pairs A-A and A-B on 101, A-A on 102; a pair of A with itself counts once
    assert b.collect(reconcile.entity_stats(status, listed), "entity_code", "pair_count") == [("A", 3)]


def test_whole_run_with_journal(spark):
    lines, accounts, centres = world(spark, [(1, 103, 3, 1, -5), (2, 101, 1, 1, 8), (3, 102, 3, 1, -8)])
    periods = b.periods(spark, [(3, 2000, 3), (4, 2000, 4)])
    run = reconcile_intercompany(lines, accounts, centres, periods, 1, "abcdefghij", DAY, create_adjustments=True)
    stats = run.stats.first()
    assert (stats["total_pairs"], stats["unreconciled"], stats["unreconciled_variance"]) == (3, 1, 5)
    journal = run.journal.first()
    assert (journal["journal_number"], journal["fiscal_period_id"], journal["status_code"]) == ("ICR-20000315-abcdefgh", 3, "DRAFT")
    assert b.collect(run.journal_lines, "debit_amount", "credit_amount", "cost_center_id") == [(0, 5, 3)]


def paired_by_hand(rows, links):
    """Target of every source line: equal ranks of opposite amounts, then the nearest line left over."""
    out = []
    for account, partner in links:
        sources = sorted((r for r in rows if r[1] == account and r[4] is not None), key=lambda r: r[0])
        targets = sorted((r for r in rows if r[1] == partner and r[4] is not None), key=lambda r: r[0])
        rank = lambda side, r: sum(x[4] == r[4] and x[0] <= r[0] for x in side)
        found = {s[0]: t[0] for s in sources for t in targets if t[4] == -s[4] and rank(sources, s) == rank(targets, t)}
        left = [t for t in targets if t[0] not in found.values()]
        for s in sources:
            if s[0] in found:
                out.append((s[0], account, partner, found[s[0]], "EXACT"))
            elif left:
                near = min(left, key=lambda t: (abs(s[4] + t[4]), t[4], t[0]))
                out.append((s[0], account, partner, near[0], "NEAREST"))
            else:
                out.append((s[0], account, partner, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_source_lines(many_pieces, seed):
    rng = random.Random(seed)
    links = [(101, 102), (102, 101), (103, 102), (104, 999)]
    accounts = b.accounts(many_pieces, [{"gl_account_id": a, "intercompany_flag": True, "consolidation_account_id": p} for a, p in links])
    # account 102 holds one amount in most of its lines
    rows = [(i, rng.choice([101, 101, 102, 103, 104]), 1, i, rng.choice([-5, -5, -5, 5, 5, rng.randrange(-9, 10)])) for i in range(250)]
    got = reconcile.match_targets(b.lines(many_pieces, rows), accounts)
    names = ["source_line_id", "gl_account_id", "partner_account_id", "target_line_id", "pairing"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == paired_by_hand(rows, links)
    assert got.filter("target_line_id IS NOT NULL AND target_amount IS NULL").isEmpty()


def test_targets_without_partner_lines(spark):
    accounts = b.accounts(spark, [{"gl_account_id": 101, "intercompany_flag": True, "consolidation_account_id": 102}])
    got = reconcile.match_targets(b.lines(spark, [(1, 101, 1, 1, 5), (2, 101, 1, 2, 0)]), accounts)
    assert b.collect(got, "source_line_id", "target_line_id", "pairing") == [(1, None, None), (2, None, None)]
    assert reconcile.match_targets(b.lines(spark, []), accounts).isEmpty()


def test_a_hot_link_is_dealt_to_many_tasks(many_pieces):
    """One link has nearly all pairs; no task holds more than twice the median."""
    spark = many_pieces
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 400
        centres = b.cost_centers(spark, [{"cost_center_id": i, "parent_id": None, "code": f"E{i}-1"} for i in range(1, n + 1)])
        accounts = b.accounts(spark, [{"gl_account_id": g, "intercompany_flag": True, "consolidation_account_id": p} for g, p in [(101, 102), (103, 104)]])
        rows = [(i * 4 + k, g, i, 1, i + k) for i in range(1, n + 1) for k, g in enumerate((101, 102))] + [(9000, 103, 1, 1, 5), (9001, 104, 2, 1, 7)]
        lines = b.lines(spark, rows)
        spread = reconcile.ic_pairs(lines, accounts, centres, rows_per_task=500)
        whole = reconcile.ic_pairs(lines, accounts, centres)
        assert sorted(map(str, spread.collect())) == sorted(map(str, whole.collect())) and spread.count() == n * n + 1

        def largest(df):
            sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
            return sizes[-1], sizes[len(sizes) // 2]

        most, median = largest(spread)
        assert most <= 2 * median and largest(whole)[0] >= n * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
