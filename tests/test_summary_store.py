"""The stored summary against sums over all lines."""

import random

import builders as b
import pytest

from finloom.operators import summary_store as store
from finloom.operators.summary import MEASURES, line_totals
from finloom.schemas import NATURAL_KEY
from finloom.session import new_folder

COLUMNS = [*NATURAL_KEY, *MEASURES]


def rows_of(df):
    return b.collect(df, *COLUMNS)


def line(number, header, key, amount):
    return (number, key % 3, key % 4, key % 5, amount, header)


def test_random_changes_equal_sums_over_all_lines(spark):
    rng = random.Random(3)
    path = new_folder(spark, "test-store")
    lines = {n: line(n, rng.randrange(1, 5), rng.randrange(60), rng.randrange(-9, 10)) for n in range(80)}
    store.build(b.lines(spark, list(lines.values())), path)
    for step in range(3):
        gone = rng.sample(sorted(lines), 20)
        removed = [lines.pop(n) for n in gone]
        if step == 1:  # budget 2 loses all its lines
            removed += [lines.pop(n) for n in [n for n, x in lines.items() if x[5] == 2]]
        # some lines change their amount, some are new
        added = [line(n, lines_header, rng.randrange(60), 7) for n, lines_header in zip(gone[:8], (1, 1, 3, 3, 4, 4, 5, 5))]
        lines |= {x[0]: x for x in added}
        version = store.apply_changes(spark, path, b.lines(spark, removed), b.lines(spark, added))
        assert version == step + 2
        assert rows_of(store.stored_totals(spark, path)) == rows_of(line_totals(b.lines(spark, list(lines.values()))))


def test_a_budget_without_lines_serves_none(spark):
    path = new_folder(spark, "test-store")
    frame = b.lines(spark, [(1, 1, 1, 1, 5), (2, 1, 1, 1, -5), (3, 1, 1, 2, 0, 2)])
    store.build(frame, path)
    store.apply_changes(spark, path, removed=frame.filter("header_id = 1"))
    assert [r[0] for r in rows_of(store.stored_totals(spark, path))] == [2]
    store.apply_changes(spark, path, removed=frame.filter("header_id = 2"))
    assert rows_of(store.stored_totals(spark, path)) == [] and store.latest_version(spark, path) == 3
    store.apply_changes(spark, path, added=frame)
    assert rows_of(store.stored_totals(spark, path)) == rows_of(line_totals(frame))


def test_sums_of_zero_keep_their_key_while_lines_are_there(spark):
    path = new_folder(spark, "test-store")
    store.build(b.lines(spark, [(1, 1, 1, 1, 5)]), path)
    store.apply_changes(spark, path, added=b.lines(spark, [(2, 1, 1, 1, -5)]))
    (row,) = store.stored_totals(spark, path).collect()
    assert (row.total_final_amount, row.line_item_count) == (0, 2)


def test_readers_see_one_version(spark):
    path = new_folder(spark, "test-store")
    first, second = b.lines(spark, [(1, 1, 1, 1, 5), (2, 1, 1, 1, 9, 2)]), b.lines(spark, [(1, 1, 1, 1, 50), (2, 1, 1, 1, 90, 2)])
    store.build(first, path)
    before = store.stored_totals(spark, path)
    headers = store.write_data(line_totals(second), path, 2)  # a refresh that has not come to its end
    assert rows_of(store.stored_totals(spark, path)) == rows_of(line_totals(first))
    store.write_manifest(spark, path, 2, dict.fromkeys(headers, 2))
    assert rows_of(store.stored_totals(spark, path)) == rows_of(line_totals(second))
    assert rows_of(before) == rows_of(store.stored_totals(spark, path, 1)) == rows_of(line_totals(first))


def test_an_unfinished_refresh_is_written_over(spark):
    path = new_folder(spark, "test-store")
    frame = b.lines(spark, [(1, 1, 1, 1, 5)])
    store.build(frame, path)
    store.write_data(line_totals(b.lines(spark, [(9, 2, 2, 2, 1), (8, 2, 2, 2, 1, 3)])), path, 2)
    store.apply_changes(spark, path, added=b.lines(spark, [(2, 1, 1, 2, 6)]))
    assert [r[4] for r in rows_of(store.stored_totals(spark, path))] == [5, 6]


def test_untouched_budgets_stay_where_they_are(spark):
    path = new_folder(spark, "test-store")
    frame = b.lines(spark, [(1, 1, 1, 1, 5), (2, 1, 1, 1, 9, 2)])
    store.build(frame, path)
    store.apply_changes(spark, path, added=b.lines(spark, [(3, 1, 1, 2, 1, 2)]))
    files = {f.split("/data/")[1].rsplit("/", 1)[0] for f in store.stored_totals(spark, path).inputFiles()}
    assert files == {"version=1/header_id=1", "version=2/header_id=2"}
    store.apply_changes(spark, path, added=b.lines(spark, [(4, 1, 1, 3, 1, 2)]))
    assert b.collect(store.superseded(spark, path, keep=1)) == [(2, 1), (2, 2)]
    assert b.collect(store.superseded(spark, path, keep=2)) == [(2, 1)]


@pytest.mark.parametrize("removed", [[(1, 1, 1, 1, 5), (2, 1, 1, 1, 5)], [(1, 1, 1, 1, 4)], [(1, 2, 1, 1, 5)]])
def test_changes_that_do_not_fit_are_refused(spark, removed):
    path = new_folder(spark, "test-store")
    store.build(b.lines(spark, [(1, 1, 1, 1, 5)]), path)
    with pytest.raises(Exception, match="do not fit"):
        store.apply_changes(spark, path, removed=b.lines(spark, removed))
    assert store.latest_version(spark, path) == 1


def test_no_lines(spark):
    path = new_folder(spark, "test-store")
    store.build(b.lines(spark, []), path)
    assert rows_of(store.stored_totals(spark, path)) == []
    store.apply_changes(spark, path)
    assert store.latest_version(spark, path) == 2
