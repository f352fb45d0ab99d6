"""Only new or changed records, over restarts and failures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loreline.operators import incremental as inc
from loreline.operators.incremental import ChapterWork, merge, process_increment, unhandled_chapters
from loreline.sources.versioned import CHANGE, DELETE, FILE, INSERT, POS, CommitConflict, VersionedTable

KV = StructType([StructField("k", IntegerType()), StructField("v", StringType())])
CHAPTERS = "line_no long, number int, revid long, timestamp string, wikitext string"
STATE = "number int, revid long, complete boolean, run_id int"
RUNS = "run_id int, started_at timestamp, status string"


@pytest.fixture
def table(spark, tmp_path):
    return lambda name="t", schema=KV: VersionedTable(spark, f"file://{tmp_path}/{name}", schema)


def frame(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def read(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_versions_stay_as_they_were_and_differences_are_net(spark, table):
    t = table()
    a = t.commit(t.manifest(), added=frame(spark, [(1, "a"), (2, "b"), (2, "b")]))
    b = merge(t, frame(spark, [(1, "a"), (3, "c")]), ["k"], ["v"])
    assert read(t, a.version) == [(1, "a"), (2, "b"), (2, "b")] and read(t) == [(1, "a"), (3, "c")]
    got = sorted((r.k, r[CHANGE]) for r in t.changes(a.version, b.version).collect())
    assert got == [(2, DELETE), (2, DELETE), (3, INSERT)]
    assert read(t, -1) == [] and t.changes(b.version, b.version).count() == 0


def test_a_version_is_made_once(spark, table):
    t = table()
    base = t.manifest()
    t.commit(base, added=frame(spark, [(1, "a")]))
    with pytest.raises(CommitConflict):
        t.commit(base, added=frame(spark, [(2, "b")]))
    assert read(t) == [(1, "a")]


def test_vectors_are_read_only_with_the_files_they_touch(spark, table):
    t = table()
    t.commit(t.manifest(), added=frame(spark, [(1, "a"), (2, "b")]).coalesce(1))
    t.commit(t.manifest(), added=frame(spark, [(3, "c")]).coalesce(1))
    m = merge(t, frame(spark, [(1, "z")]), ["k"], ["v"], delete_missing=False)
    first, second = m.files[:2]
    assert m.vectors([first]) and not m.vectors([second]) and not m.vectors(m.files[2:])
    assert read(t) == [(1, "z"), (2, "b"), (3, "c")]


def test_compaction_changes_nothing_a_consumer_sees(spark, table):
    t = table()
    t.commit(t.manifest(), added=frame(spark, [(1, "a"), (2, "b")]))
    before = merge(t, frame(spark, [(2, "c")]), ["k"], ["v"])
    after = t.compact()
    assert read(t) == [(2, "c")] and not after.deletes and after.version == before.version + 1
    assert t.changes(before.version, after.version).count() == 0
    assert t.compact() is None


def test_files_of_others_are_registered_as_they_stand(spark, table, tmp_path):
    for i, rows in enumerate(([(1, "a")], [(2, "b")])):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log/day={i}")
    one = spark.read.parquet(f"file://{tmp_path}/log/day=0").inputFiles()
    both = one + spark.read.parquet(f"file://{tmp_path}/log/day=1").inputFiles()
    t = table()
    a, b = t.register(one), t.register(both)
    assert t.register(both) == b and t.changed_files(a.version)[0] == tuple(both[1:])
    assert read(t) == [(1, "a"), (2, "b")] and [(r.k, r[CHANGE]) for r in t.changes(a.version).collect()] == [(2, INSERT)]
    m = merge(t, frame(spark, [(1, "x")]), ["k"], ["v"], delete_missing=False)
    assert read(t) == [(1, "x"), (2, "b")] and m.deletes


def test_rows_change_places_and_do_not_pile_up(spark, table):
    src, out = table("src"), table("out", StructType.fromDDL("k int, twice string"))

    def double(changes):
        rows = changes["s"].where(F.col(CHANGE) == INSERT).select("k", F.concat("v", "v").alias("twice"))
        return rows, changes["s"].select("k")

    run = lambda: process_increment({"s": src}, out, ["k"], double)
    merge(src, frame(spark, [(1, "a"), (2, "b")]), ["k"], ["v"])
    run()
    merge(src, frame(spark, [(1, "c"), (3, "d")]), ["k"], ["v"])
    run()
    assert read(out) == [(1, "cc"), (3, "dd")] and run() is None


def test_a_failure_before_the_commit_repeats_the_increment_and_one_after_does_not(spark, table, monkeypatch):
    src, out, calls = table("src"), table("out"), []

    def same(changes):
        calls.append(1)
        return changes["s"].where(F.col(CHANGE) == INSERT).select("k", "v"), changes["s"].select("k")

    merge(src, frame(spark, [(1, "a")]), ["k"], ["v"])
    whole = VersionedTable._publish
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        process_increment({"s": src}, out, ["k"], same)
    assert out.version() == -1 and read(out) == []

    def killed_after(self, m):
        whole(self, m)
        raise OSError("killed")

    monkeypatch.setattr(VersionedTable, "_publish", killed_after)
    with pytest.raises(OSError):
        process_increment({"s": src}, out, ["k"], same)
    monkeypatch.setattr(VersionedTable, "_publish", whole)
    assert process_increment({"s": src}, out, ["k"], same) is None
    assert read(out) == [(1, "a")] and len(calls) == 2


def test_an_output_that_is_ahead_is_an_error(spark, table, tmp_path):
    src, out = table("src"), table("out")
    merge(src, frame(spark, [(1, "a")]), ["k"], ["v"])
    same = lambda c: (c["s"].select("k", "v"), c["s"].select("k"))
    process_increment({"s": src}, out, ["k"], same)
    with pytest.raises(ValueError):
        process_increment({"s": table("other")}, out, ["k"], same)


# -- chapters ---------------------------------------------------------------------------------------


def brute(chapters, state, runs):
    current = {}
    for _, number, revid, _, text in chapters:
        if number is not None and number > 0 and text is not None and text.strip(" \u200b") and revid is not None:
            current[number] = max(current.get(number, revid), revid)
    ok, stored = {r: s for r, s, status in runs if status == "ok"}, {}
    for number, revid, complete, run in state:
        if run in ok and number is not None:
            at = (ok[run], run, revid if revid is not None else -1)
            old = stored.get(number)
            if old is None or at > old[0]:
                stored[number] = (at, revid, bool(complete))
            elif at == old[0]:
                stored[number] = (at, revid, old[2] and bool(complete))
    return sorted((n, r) for n, r in current.items() if not (n in stored and stored[n][2] and stored[n][1] == r))


def lines(*rows):
    return [(i, n, r, None, t) for i, (n, r, t) in enumerate(rows)]


T = ["2026-01-0%d 00:00:00" % i for i in range(1, 8)]


def runs_of(spark, *rows):
    return spark.createDataFrame([(a, b, c) for a, b, c in rows], "run_id int, started_at string, status string").withColumn("started_at", F.to_timestamp("started_at"))


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_run_after_run_reads_only_new_files(spark, tmp_path):
    log, state, root = (f"file://{tmp_path}/{x}" for x in ("chapters", "state", "work"))
    chapters_1 = lines((1, 10, "a"), (1, 11, "b"), (2, 20, "c"), (-1, 5, "x"), (3, 30, " ​"), (4, None, "q"), (None, 1, "q"), (2, 20, "c"))
    state_1 = [(1, 11, True, 1), (2, 20, False, 1), (2, 20, True, 2)]
    runs_1 = [(1, T[0], "ok"), (2, T[1], "failed")]
    write(spark, chapters_1, CHAPTERS, log)
    write(spark, state_1, STATE, state)
    got = lambda r: sorted(tuple(x) for x in unhandled_chapters(spark.read.parquet(log), spark.read.parquet(state), runs_of(spark, *r), root, files=True).collect())
    assert got(runs_1) == brute(chapters_1, state_1, runs_1) == [(2, 20)]
    work = ChapterWork(spark, root)
    versions = {n: getattr(work, n).version() for n in ("log", "state", "current", "handled", "pending")}
    assert got(runs_1) == [(2, 20)]  # nothing is new, so no table gets a version
    assert versions == {n: getattr(work, n).version() for n in versions}
    # New files: chapter 1 changes, 5 is new, an old revision of 2 is written late; the failed run turns out well.
    chapters_2, runs_2 = lines((1, 12, "d"), (5, 50, "e"), (2, 19, "old")), [(1, T[0], "ok"), (2, T[1], "ok")]
    write(spark, chapters_2, CHAPTERS, log)
    before = work.log.version()
    assert got(runs_2) == brute(chapters_1 + chapters_2, state_1, runs_2) == [(1, 12), (5, 50)]
    new, gone, touched, vectors = work.log.changed_files(before)
    assert len(new) == 1 and not (gone or touched or vectors)
    assert sorted(r.number for r in work.current.changes(versions["current"]).where(F.col(CHANGE) == INSERT).collect()) == [1, 5]
    write(spark, [(1, 12, True, 3), (5, 50, None, 3)], STATE, state)
    runs_3 = [*runs_2, (3, T[2], "ok")]
    assert got(runs_3) == [(5, 50)]


def test_a_file_that_leaves_the_log_takes_its_records_along(spark, tmp_path):
    path, none = f"file://{tmp_path}/c", spark.createDataFrame([], STATE)
    for rows in (lines((1, 10, "a"), (2, 20, "b")), lines((1, 11, "c"), (3, 30, "d"))):
        write(spark, rows, CHAPTERS, path)
    none.write.parquet(f"file://{tmp_path}/s")
    state, runs, root = spark.read.schema(STATE).parquet(f"file://{tmp_path}/s"), runs_of(spark, (1, T[0], "ok")), f"file://{tmp_path}/w"
    both = spark.read.parquet(path)
    second = [f for f in both.inputFiles() if spark.read.parquet(f).where("revid = 11").count()]
    first = [f for f in both.inputFiles() if f not in second]
    assert unhandled_chapters(both, state, runs, root, files=True).count() == 3
    rest = spark.read.parquet(*first)
    assert sorted(map(tuple, unhandled_chapters(rest, state, runs, root, files=True).collect())) == [(1, 10), (2, 20)]


def test_killed_anywhere_the_next_run_gives_the_same(spark, tmp_path, monkeypatch):
    chapters, state, runs = lines((1, 10, "a"), (2, 20, "b")), [(1, 10, True, 1), (2, 19, True, 1)], [(1, T[0], "ok")]
    frames = spark.createDataFrame(chapters, CHAPTERS), spark.createDataFrame(state, STATE), runs_of(spark, *runs)
    whole = VersionedTable._publish
    for stop in (0, 3, 5, 6):  # before log, current and pending, and not at all
        root, made = f"file://{tmp_path}/w{stop}", []

        def publish(self, m):
            if len(made) == stop:
                made.append(1)
                raise OSError("killed")
            made.append(1)
            whole(self, m)

        monkeypatch.setattr(VersionedTable, "_publish", publish)
        try:
            unhandled_chapters(*frames, root)
            assert stop == 6
        except OSError:
            assert stop < 6
        monkeypatch.setattr(VersionedTable, "_publish", whole)
        assert sorted(map(tuple, unhandled_chapters(*frames, root).collect())) == [(2, 20)]


@pytest.mark.parametrize("have", ["nothing", "no state", "no chapters"])
def test_empty_tables(spark, have):
    chapters = lines((1, 10, "a")) if have == "no state" else []
    state = [(1, 10, True, 1)] if have == "no chapters" else []
    got = unhandled_chapters(spark.createDataFrame(chapters, CHAPTERS), spark.createDataFrame(state, STATE), spark.createDataFrame([], RUNS))
    assert [tuple(r) for r in got.collect()] == ([(1, 10)] if have == "no state" else [])


def test_reserved_names(spark, tmp_path):
    with pytest.raises(ValueError):
        VersionedTable(spark, f"file://{tmp_path}/x", StructType.fromDDL(f"{FILE} string"))
    assert POS == "_pos" and inc.RECORD.names == ["number", "revid"]
