"""Attributes as known at event time, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loreline.operators.asof import change_history, last_known
from loreline.operators.known import known_mentions, version_timeline

MENTIONS = "mention_id long, canonical_name string, chapter int, alias string, extra string"
REGISTRY = "canonical_name string, entity_type string, aliases array<string>, valid_from int, valid_to int, mention_id int"
DISGUISES = "alias string, canonical_name string, revelation int"


def brute(histories, probes):
    out = set()
    for entity, at, *rest in probes:
        got = []
        for rows in histories.values():
            best = max(((a, v) for e, a, v in rows if e == entity and at is not None and a <= at), default=(None, None), key=lambda x: x[0])
            got.append(best[1])
        out.add((entity, at, *rest, *got))
    return out


def random_case(seed, hot=False):
    r = random.Random(seed)
    names = ["a", "b", "c", "ü"]
    history = lambda v: [(e, t, v(r)) for e in names for t in sorted(r.sample(range(-20, 60), r.randint(0, 12)))]
    histories = {"x": history(lambda r: r.choice([None, "p", "q", "r"])), "y": history(lambda r: r.randint(0, 9))}
    probes = [(r.choice(["a"] * (20 if hot else 1) + [*names, "z", None]), r.choice([None, *range(-30, 70)]), i % 150) for i in range(300)]
    return histories, probes


@pytest.mark.parametrize(("seed", "block", "per_part"), [(1, 7, 1 << 20), (2, 1000, 1 << 20), (3, 1, 1 << 20), (4, 16, 3)])
def test_last_known_is_brute_force(spark, seed, block, per_part, monkeypatch):
    monkeypatch.setattr("loreline.operators.asof.MOST_HOT", 10_000 if per_part > 100 else 10**9)
    histories, probes = random_case(seed, hot=per_part < 100)
    frames = {"x": spark.createDataFrame(histories["x"], "entity string, at long, value string"), "y": spark.createDataFrame(histories["y"], "entity string, at long, value long")}
    asked = spark.createDataFrame(probes, "entity string, at long, id int")
    got = last_known(frames, asked, block, per_part)
    assert got.columns == ["entity", "at", "id", "x", "y"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(histories, probes)


def test_probes_are_shuffled_once_and_no_version_has_all_attributes(spark):
    histories, probes = random_case(5)
    frames = {"x": spark.createDataFrame(histories["x"], "entity string, at long, value string"), "y": spark.createDataFrame(histories["y"], "entity string, at long, value long")}
    got = last_known(frames, spark.createDataFrame(probes, "entity string, at long, id int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union", plan.index("Union") + 1)]
    assert "Exchange" not in top.split("Aggregate")[1]  # the pivot runs on the matches' partitioning


def test_empty_inputs_and_taken_names(spark):
    history = spark.createDataFrame([], "entity string, at long, value string")
    asked = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "entity string, at long")
    assert sorted(map(str, (tuple(r) for r in last_known({"x": history}, asked).collect()))) == ["('a', 1, None)", "(None, 2, None)"]
    assert last_known({"x": history}, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        last_known({"at": history}, asked)
    with pytest.raises(ValueError):
        last_known({"x": history}, asked.withColumn("block", F.lit(1)))


def test_change_history_keeps_changes_only(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, None)], "e string, t long, v string")
    got = change_history(rows, "e", "t", F.col("v")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == ["('a', 1, 'x')", "('a', 3, None)", "('a', 5, 'x')", "('b', 1, None)"]


def test_timeline_of_nested_overlapping_and_open_versions(spark):
    rows = [("a", None, None, 1, None, 0), ("a", None, None, 5, 9, 0), ("a", None, None, 6, 7, 0), ("a", None, None, 6, 7, 0), ("b", None, None, 3, 4, 0), ("b", None, None, 9, 8, 0), (None, None, None, 1, 2, 0), ("c", None, None, None, 2, 0)]
    got = version_timeline(spark.createDataFrame(rows, REGISTRY)).collect()
    line = {}
    for r in sorted(got, key=lambda r: (r.canonical_name, r.at)):
        line.setdefault(r.canonical_name, []).append((r.at, r.valid_from))
    assert line == {"a": [(1, 1), (5, 5), (6, 6), (8, 5), (10, 1)], "b": [(3, 3), (5, None)]}


def test_mentions_under_the_name_known_then(spark):
    mentions = [(1, "Ann", 3, "Mask", "x"), (1, "Ann", 3, "Mask", "x"), (2, "Ann", 9, "Mask", "x"), (3, "Ann", 2, None, None), (4, None, 2, None, None), (5, "Bob", None, None, None), (6, "Nobody", 4, None, None)]
    registry = [("Ann", "Character", ["A"], 2, 4, 1), ("Ann", "Place", ["A", "B"], 5, None, 1), ("Mask", "Group", None, 3, 6, 1), ("Mask", "Group", None, 3, 6, 1)]
    disguises = [("Mask", "Ann", 7), ("Mask", "Ann", 7), ("Hood", "Bob", None)]
    got = known_mentions(spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(disguises, DISGUISES))
    rows = {r.mention_id: (r.known_name, r.registered, r.latest, r.valid_from, r.entity_type, r.aliases) for r in got.collect()}
    assert got.count() == 6 and rows == {
        1: ("Mask", True, 3, 3, "Group", None), 2: ("Ann", True, 5, 5, "Place", ["A", "B"]), 3: ("Ann", True, 5, 2, "Character", ["A"]),
        4: (None, False, None, None, None, None), 5: ("Bob", False, None, None, None, None), 6: ("Nobody", False, None, None, None, None)}


def test_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    some = spark.createDataFrame([(1, "Ann", 3, "Mask", "x")], MENTIONS)
    assert known_mentions(none(MENTIONS), none(REGISTRY), none(DISGUISES)).count() == 0
    assert [(r.known_name, r.registered, r.valid_from) for r in known_mentions(some, none(REGISTRY), none(DISGUISES)).collect()] == [("Ann", False, None)]
