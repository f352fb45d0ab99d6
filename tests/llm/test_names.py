"""Names against all pairs by edit distance."""

import random

import pytest
from pyspark.sql import functions as F

from loreline.llm.names import LETTERS_PER_EDIT, MAX_EDITS, map_redirects, match_names, pigeonhole_join, unmatched_values

REDIRECTS = "redirect_id long, redirect string, canonical_name string, entry_id string"
CANON = "entry_id long, canonical_name string, value string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_join_finds_all_pairs_within_the_edits_and_no_others(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 16)))
    entries, values = sorted({word() for _ in range(60)}), []
    for e in entries:
        v = list(e)
        for _ in range(r.randint(0, 4)):
            v[r.randint(0, len(v)) : r.randint(0, len(v))] = r.choice(["", "a", "x"])
        values.append("".join(v))
    values = sorted({v for v in values + [word() for _ in range(40)] if v})
    got = pigeonhole_join(
        spark.createDataFrame([(v, "p", v) for v in values], "value string, form string, key string"),
        spark.createDataFrame([(i, "p", e) for i, e in enumerate(entries)], "entry_id int, form string, key string"), MAX_EDITS)
    found = {(x.value, x.entry_id, x.distance) for x in got.collect()}
    want = {(v, i, d) for v in values for i, e in enumerate(entries) if (d := distance(v, e)) <= min(MAX_EDITS, len(e) // LETTERS_PER_EDIT)}
    assert found == want


def match(spark, values, entries=("Rob", "Jane Roe", "Mary Leigh", "Xanthippe", "Xanthipps")):
    v = spark.createDataFrame([(x,) for x in values], "value string")
    e = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(entries)], CANON)
    return {r.value: r.entry_id for r in match_names(v, e).collect()}


def test_short_names_do_not_stand_for_others(spark):
    assert match(spark, ["Tom", "Ann", "Zed", "Rob", "rob"]) == {"Tom": -1, "Ann": -1, "Zed": -1, "Rob": 0, "rob": 0}


def test_typing_habits(spark):
    typed = ["JANE ROE", "Roe, Jane", "Captain Jane Roe", "J. Roe", "Ｊａｎｅ　Ｒｏｅ", "Jané Roe", "[[Jane Roe]]", "Jane_Roe#History", "Jane Roe/history", "Mary Liegh", 'Mary "Red" Leigh', "Маry Leigh"]
    got = match(spark, typed)
    assert got == {t: 1 if "L" not in t else 2 for t in typed}


def test_ties_nulls_and_blanks_name_none(spark):
    assert match(spark, ["Xanthippx", None, "", "  ", "...", "x" * 5000]) == {"Xanthippx": -1, None: -1, "": -1, "  ": -1, "...": -1, "x" * 5000: -1}


def test_every_redirect_once_and_what_names_none_is_reported(spark):
    rows = [(1, "Rob", None, "x"), (1, "Rob", None, "x"), (2, "Q", " ", "x"), (3, "q", "Jane Roe", "x"), (4, None, None, "x"), (5, "Q", None, "x")]
    red, canon = spark.createDataFrame(rows, REDIRECTS), spark.createDataFrame([(7, "Rob", "v"), (8, "Jane Roe", "v"), (8, "Jane Roe", "v"), (9, None, "v")], CANON)
    assert sorted((r.redirect_id, r.entry_id) for r in map_redirects(red, canon).collect()) == [(1, 7), (2, -1), (3, 8), (4, -1), (5, -1)]
    assert {r.value: r.redirects for r in unmatched_values(red, canon).collect()} == {"Q": 2, None: 1}
    none = canon.limit(0)
    assert map_redirects(red, none).where(F.col("entry_id") >= 0).count() == 0 and map_redirects(red.limit(0), none).count() == 0
