from finloom.operators import allocate
from finloom.queries import allocation
from finloom.sources import planning_tables as pt

FOLDER = "/root/testdata/sf0.001"


def test_lines_meet_rules_in_one_frame_that_is_stored(spark, monkeypatch):
    seen = []
    attach = allocate.attach_rules

    def counted(lines, *others):
        seen.append(lines.columns)
        return attach(lines, *others)

    monkeypatch.setattr(allocate, "attach_rules", counted)
    allocation.rule_totals(pt.planning_tables(spark, FOLDER))
    assert len(seen) == 1
