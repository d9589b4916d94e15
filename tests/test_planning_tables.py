from finloom.plans import reconciliation
from finloom.queries import intercompany
from finloom.queries.registry import QUERIES
from finloom.sources import planning_tables as pt

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_queries_of_one_budget_project_only_that_budget(spark, monkeypatch):
    monkeypatch.setattr(pt, "_stored", {})
    for name in ("rule_totals", "nested_report_reconciliation"):
        QUERIES[name](spark, FOLDER).collect()
    names = {name for _, _, name in pt._stored}
    assert "budget-1" in names and "budget_line_item" not in names
    parts = rows(pt.planning_tables(spark, FOLDER).budget_line_item)  # the other budgets are added
    assert rows(pt.planning_tables(spark, FOLDER).lines_of(2)) == [r for r in parts if "header_id=2" in r]
    monkeypatch.setattr(pt, "_stored", {})
    tables = pt.planning_tables(spark, FOLDER)
    assert rows(tables.budget_line_item) == parts
    assert rows(tables.lines_of(1)) == [r for r in parts if "header_id=1" in r]


def test_reconciliation_matches_only_lines_of_links(spark, monkeypatch):
    given = []
    targets = reconciliation.match_targets
    monkeypatch.setattr(reconciliation, "match_targets", lambda lines, accounts: (given.append(lines), targets(lines, accounts))[1])
    intercompany.nested_report_reconciliation(pt.planning_tables(spark, FOLDER))
    assert {r[0] for r in given[0].select("gl_account_id").distinct().collect()} <= {101, 102, 103, 999}
