"""Histories from several sources, against brute force."""

import random

import pytest

from loreline.operators import history as h
from loreline.plans.queries_core import DELIVERIES

UPDATES = "update_id long, canonical_name string, chapter int, entity_type string, aliases array<string>, present boolean, mention_count int"


def brute(rows):
    seen = {}
    for uid, name, chapter, kind, aliases, present, _ in sorted(rows, key=lambda r: r[0]):
        if name and name.strip() and chapter is not None:
            seen[name, chapter] = (kind, tuple(sorted({a for a in aliases or [] if a is not None}))) if present else None
    out, names = set(), {n for n, _ in seen}
    for name in names:
        line = sorted(((c, s) for (n, c), s in seen.items() if n == name), key=lambda x: x[0])
        runs = []
        for c, s in line:
            if not runs or runs[-1][1] != s:
                runs.append((c, s))
        for i, (c, s) in enumerate(runs):
            if s is not None:
                out.add((name, s[0], s[1], c, runs[i + 1][0] - 1 if i + 1 < len(runs) else -1))
    return out


def updates(seed, n=400, names=("a", "b", "c", "hot", "hot", "hot", "ü z")):
    r = random.Random(seed)
    rows = [
        (i, r.choice([*names, None, "  "] if r.random() < 0.1 else names), r.choice([None, *range(1, 25)]) if r.random() < 0.1 else r.randint(1, 25), r.choice(["Place", "Ship", None]),
         r.choice([None, [], ["x"], ["y", "x"], ["x", "y", "x", None]]), r.choice([True, True, True, False, None]), r.randint(0, 9))
        for i in range(n)]
    return [*rows, *r.sample(rows, 20)]


def found(df):
    rows = [(r.canonical_name, r.entity_type, tuple(r.aliases), r.valid_from, r.valid_to) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "sources", "partitions"), [(1, 1, 1), (2, 3, 5), (3, 4, 40), (4, 2, None)])
def test_history_of_several_sources_is_brute_force(spark, seed, sources, partitions):
    rows = updates(seed)
    parts = [spark.createDataFrame(rows[i::sources], UPDATES) for i in range(sources)]
    assert found(h.entity_history(*parts, partitions=partitions)) == brute(rows)


def test_a_snapshot_that_comes_later_is_merged_with_stored_runs(spark, tmp_path):
    rows = updates(7)
    first, second = rows[:250], rows[250:]
    observed = [h.observations(spark.createDataFrame(x, UPDATES)) for x in (first, second)]
    cuts = h.cut_keys(observed[:1], 6)
    paths = [h.store_run(o, cuts, f"file://{tmp_path}/{i}") for i, o in enumerate(observed)]
    runs = h.merge_runs(spark, paths, len(cuts) + 1)
    assert "Exchange hashpartitioning" not in runs._jdf.queryExecution().executedPlan().toString()
    names = {r.canonical_name for r in runs.collect()}
    assert names == {n for n, *_ in brute(rows)} | {r[1] for r in rows if r[1] and r[1].strip() and r[2] is not None}


def test_no_more_than_a_batch_of_a_file_is_held(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(h, "_BATCH", 16)
    rows = updates(8)
    path = h.store_run(h.observations(spark.createDataFrame(rows, UPDATES)), [], f"file://{tmp_path}/r")
    (files,) = h.run_files(spark, path).values()
    keys = [r[:3] for r in h._rows(files[0])]
    assert keys == sorted(keys) and len(keys) > 16


def test_deliveries_are_the_whole_log(spark):
    df = spark.createDataFrame(updates(9), UPDATES)
    parts = h.deliveries(df, DELIVERIES)
    assert len(parts) == DELIVERIES and sum(p.count() for p in parts) == df.count()
    assert found(h.entity_history(*parts)) == found(h.entity_history(df))
    assert h.deliveries(df.limit(0), 3)[0].count() == 0


def test_empty_sources_give_an_empty_history(spark):
    none = spark.createDataFrame([], UPDATES)
    assert h.entity_history(none, none).count() == 0


def test_many_sampled_keys_that_are_one(spark):
    rows = [(i, "hot", 1, f"t{i}", None, True, 0) for i in range(500)]
    df = spark.createDataFrame(rows, UPDATES)
    assert len(h.cut_keys([h.observations(df)], 8)) <= 1
    assert found(h.entity_history(df, partitions=8)) == {("hot", "t499", (), 1, -1)}
