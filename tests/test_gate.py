from loreline.plans.queries_pages import QUERIES
from test_check_files import SILVER, row

CHAPTERS = "line_no long, number int, revid long, timestamp string, wikitext string"


def lines(*numbers):
    return [(i, n, 1, None, "text") for i, n in enumerate(numbers)], CHAPTERS


def run(spark, name, d):
    return [tuple(r) for r in QUERIES[name](spark, d).collect()]


def test_a_gap_above_the_old_constants_is_missing(spark, tables):
    last = 20_600
    there = [n for n in range(1, last + 1) if n not in (300, 20_550)]
    d = tables(chapters=lines(1, last, -5, None), silver=([row(n) for n in there], SILVER))
    assert sorted(run(spark, "missing_chapters", d)) == [(300,), (20_550,)]
    assert run(spark, "gate", d) == [(last - 2, 2, 0, False)]


def test_chapters_that_do_not_exist_are_not_missing(spark, tables):
    d = tables(chapters=lines(1, 2, 3, 3), silver=([row(1), row(2), row(3), row(3)], SILVER))
    assert run(spark, "missing_chapters", d) == []
    assert run(spark, "gate", d) == [(3, 0, 0, True)]


def test_chapters_that_silver_lacks_at_the_end_are_missing(spark, tables):
    d = tables(chapters=lines(1, 2, 3), silver=([row(1)], SILVER))
    assert sorted(run(spark, "missing_chapters", d)) == [(2,), (3,)]
    assert run(spark, "gate", d) == [(1, 2, 0, False)]
