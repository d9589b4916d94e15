import datetime as dt
from decimal import Decimal

import builders as b

from finloom.operators.hierarchy import explode_hierarchy, hierarchy_path, hierarchy_rollup, rule_closure

AS_OF = dt.date(2001, 1, 1)


def levels(df):
    return {r["cost_center_id"]: r["level"] for r in df.collect()}


def test_depth_limit(spark):
    chain = b.cost_centers(spark, [(1, None)] + [(i, i - 1) for i in range(2, 13)])
    assert levels(explode_hierarchy(chain, AS_OF)) == {i: i - 1 for i in range(1, 12)}
    assert levels(explode_hierarchy(chain, AS_OF, max_depth=3)) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert levels(explode_hierarchy(chain, AS_OF, root=5, max_depth=2)) == {5: 0, 6: 1, 7: 2}


def test_inactive_node_cuts_its_subtree(spark):
    rows = [(1, None), {"cost_center_id": 2, "parent_id": 1, "is_active": False}, (3, 2), (4, 1)]
    assert levels(explode_hierarchy(b.cost_centers(spark, rows), AS_OF)) == {1: 0, 4: 1}
    assert levels(explode_hierarchy(b.cost_centers(spark, rows), AS_OF, include_inactive=True)) == {1: 0, 2: 1, 3: 2, 4: 1}


def test_roots_skip_the_filters_unless_named(spark):
    rows = [{"cost_center_id": 1, "parent_id": None, "is_active": False}, (2, 1)]
    centres = b.cost_centers(spark, rows)
    assert levels(explode_hierarchy(centres, AS_OF)) == {1: 0, 2: 1}
    assert levels(explode_hierarchy(centres, AS_OF, root=1)) == {}


def test_cycle_entered_by_root(spark):
    centres = b.cost_centers(spark, [(1, 2), (2, 1), (3, 2), (9, None)])
    assert levels(explode_hierarchy(centres, AS_OF)) == {9: 0}
    assert levels(explode_hierarchy(centres, AS_OF, root=1)) == {1: 0, 2: 1, 3: 2}


def test_parent_that_does_not_exist(spark):
    centres = b.cost_centers(spark, [(1, None), (2, 77), (3, 2)])
    assert levels(explode_hierarchy(centres, AS_OF)) == {1: 0}


def test_leaf_flag_ignores_dates(spark):
    expired = {"cost_center_id": 2, "parent_id": 1, "effective_to": dt.date(2000, 6, 1)}
    row = explode_hierarchy(b.cost_centers(spark, [(1, None), expired]), AS_OF).collect()
    assert [(r["is_leaf"], r["child_count"]) for r in row] == [(False, 0)]


def test_paths_and_weights(spark):
    rows = [
        {"cost_center_id": 1, "parent_id": None, "weight": "0.3333"},
        {"cost_center_id": 2, "parent_id": 1, "weight": "0.3333"},
        {"cost_center_id": 30, "parent_id": 2, "weight": "0.3333"},
    ]
    row = explode_hierarchy(b.cost_centers(spark, rows), AS_OF).filter("cost_center_id = 30").first()
    assert row["path"] == "N1 > N2 > N30"
    assert row["sort_path"] == "0000000001/0000000002/0000000030"
    # 0.3333 * 0.3333 = 0.11108889; times 0.3333 = 0.037025927037 rounds at ten places
    assert row["cumulative_weight"] == Decimal("0.0370259270")


def test_hierarchy_path_limit_and_cycle(spark):
    chain = b.cost_centers(spark, [(1, None)] + [(i, i - 1) for i in range(2, 26)] + [(101, 102), (102, 101)])
    paths = {r["cost_center_id"]: r["path"] for r in hierarchy_path(chain, "/").collect()}
    assert paths[3] == "N1/N2/N3"
    assert paths[25] == "/".join(f"N{i}" for i in range(6, 26))
    assert paths[101].split("/") == ["N102", "N101"] * 10


def test_rollup_root_is_total_of_reachable_lines(spark):
    rows = [(1, None), (2, 1), (3, 2), {"cost_center_id": 4, "parent_id": 1, "is_active": False}, (5, 1)]
    centres = b.cost_centers(spark, rows)
    frame = b.lines(spark, [(1, 1, 1, 1, 10), (2, 1, 2, 1, 5), (3, 1, 3, 1, 2), (4, 1, 3, 2, 1), (5, 1, 4, 1, 100)])
    got = b.collect(hierarchy_rollup(frame, explode_hierarchy(centres, AS_OF)), "cost_center_id", "own_amount", "subtotal_amount")
    assert got == [(1, 10, 18), (2, 5, 8), (3, 3, 3), (5, 0, 0)]


def test_rule_closure(spark):
    rows = [
        {"rule_id": 1}, {"rule_id": 2, "depends_on": 1}, {"rule_id": 3, "depends_on": 2}, {"rule_id": 4, "depends_on": 99},
        {"rule_id": 7, "depends_on": 8}, {"rule_id": 8, "depends_on": 7}, {"rule_id": 12, "depends_on": 1},
        {"rule_id": 13, "depends_on": 12}, {"rule_id": 20, "depends_on": 1, "is_active": False},
        {"rule_id": 21, "depends_on": 1, "effective_to": dt.date(2000, 2, 1)},
    ]
    frame = b.rules(spark, rows)
    got = b.collect(rule_closure(frame, AS_OF))
    # 13 -> 12 -> 1 holds although "1" is part of "12"
    want = [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 99, 1), (7, 8, 1), (8, 7, 1), (12, 1, 1), (13, 1, 2), (13, 12, 1)]
    assert got == want
    assert b.collect(rule_closure(frame, AS_OF, rule_ids=[3, 21])) == [(3, 2, 1), (21, 1, 1)]


def test_rule_closure_depth(spark):
    frame = b.rules(spark, [{"rule_id": 1}] + [{"rule_id": i, "depends_on": i - 1} for i in range(2, 16)])
    assert max(r["level"] for r in rule_closure(frame, AS_OF).collect()) == 10
