"""Processing only new or changed records, exactly once over failures.

Inputs and outputs are VersionedTables. A consumer keeps, in the commit of its output, the
version of each input that the output covers; a run reads the difference of the manifests
since (added and removed files, deletion vectors), replaces the output rows of the keys
that changed and commits rows, deletions and covered versions in one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from loreline.session import materialise, scratch_path
from loreline.sources.versioned import CHANGE, FILE, INSERT, POS, Manifest, VersionedTable

LOG = StructType([StructField("number", IntegerType()), StructField("revid", LongType()), StructField("wikitext", StringType())])
RECORD = StructType([StructField("number", IntegerType()), StructField("revid", LongType())])
HANDLED = StructType([*RECORD.fields, StructField("complete", BooleanType())])

Changes = dict[str, DataFrame]


def merge(target: VersionedTable, current: DataFrame, keys: list[str], payload: list[str],
          properties: dict[str, str] | None = None, delete_missing: bool = True) -> Manifest:
    """Bring ``target`` to the rows of ``current`` (unique by ``keys``) in one commit; none
    if it holds them already and there are no ``properties`` to set.

    Rows whose payload is the same stay where they are. Changed and new rows go to new
    files; the old rows of changed keys, and with ``delete_missing`` of keys that are
    absent from ``current``, get deletion vectors. Nulls in keys and payload compare as
    equal to null. One join by key, which without ``delete_missing`` starts from
    ``current``; what moves is written once and both halves of the commit read it, so an
    input that changes meanwhile cannot split them.
    """
    base = target.manifest()
    old = target.read(base.version, located=True).select(*(F.col(c).alias(f"_o_{c}") for c in [*keys, *payload]), FILE, POS)
    on = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    new = current.select(*target.schema.names).withColumn("_new", F.lit(True))
    both = new.join(old, on, "full" if delete_missing else "left")
    same = F.col("_new") & F.col(FILE).isNotNull()
    for p in payload:
        same = same & F.col(p).eqNullSafe(F.col(f"_o_{p}"))
    moved = materialise(both.where(~F.coalesce(same, F.lit(False))).select(*target.schema.names, "_new", FILE, POS), "moved")
    if base.version >= 0 and not properties and not moved.limit(1).count():
        return base
    added = moved.where("_new").select(*target.schema.names)
    stale = moved.where(F.col(FILE).isNotNull()).select(FILE, POS).distinct()
    return target.commit(base, added=added, deletes=stale if base.files else None, properties=properties)


def process_increment(sources: dict[str, VersionedTable], output: VersionedTable, keys: list[str],
                      transform: Callable[[Changes], tuple[DataFrame, DataFrame]]) -> Manifest | None:
    """Bring ``output`` up to the present versions of ``sources``; None if it is.

    transform gets the changes of each source since the version that ``output`` covers,
    and gives (rows, touched): all output rows of the keys in ``touched`` are replaced by
    ``rows``, so a changed record takes the place of what it made before. Rows, deletions
    and covered versions are one commit: a failure before it leaves files that no manifest
    names and the next run repeats the same increment, a failure after it finds the
    versions recorded. No record is skipped or counted twice.
    """
    base = output.manifest()
    upto = {n: s.version() for n, s in sources.items()}
    done = {n: int(base.properties.get(f"processed.{n}", -1)) for n in sources}
    behind = [n for n in sources if upto[n] < done[n]]
    if behind:
        raise ValueError(f"older than what the output covers: {behind}")
    if base.version >= 0 and upto == done:
        return None
    rows, touched = transform({n: s.changes(done[n], upto[n]) for n, s in sources.items()})
    rows, stale = materialise(rows.select(*output.schema.names), "increment"), None
    if base.files:
        hit = output.read(base.version, located=True).join(touched.select(*keys).distinct(), keys, "left_semi")
        stale = hit.select(FILE, POS)
    return output.commit(base, added=rows, deletes=stale, properties={f"processed.{n}": str(v) for n, v in upto.items()})


# -- chapters that the last successful run did not handle -------------------------------------


def current_records(chapters: DataFrame) -> DataFrame:
    """(number, revid) of the current record of each chapter.

    Records are lines with a positive number and a wikitext that isn't blank; the highest
    revid of a number is its current record. Nulls and repeats are harmless.
    """
    return (
        chapters.where((F.col("number") > 0) & F.col("wikitext").rlike(r"[^\s\p{Z}\x{FEFF}\x{200B}]"))
        .groupBy("number").agg(F.max("revid").alias("revid"))
    )


def stored_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """(number, revid, complete) a number was left with by its latest successful run.

    Rows of runs that failed, still run or are unknown are left out. Runs are ordered by
    start, then id. Where one run left several rows for a number, it counts as complete
    only if the row with the highest revid says so throughout.
    """
    ok = runs.where("status = 'ok'").select("run_id", "started_at").distinct()
    at = F.struct("started_at", "run_id", "revid")
    rows = state.where("number IS NOT NULL").join(ok, "run_id")
    ranked = rows.groupBy("number", "started_at", "run_id", "revid").agg(F.min(F.coalesce("complete", F.lit(False))).alias("complete"))
    return ranked.groupBy("number").agg(F.max_by(F.struct("revid", "complete"), at).alias("s")).select("number", "s.revid", "s.complete")


class ChapterWork:
    """What is left to do, kept up to date from one run to the next.

    Tables below ``root``: ``log`` and ``state`` hold the files of the bronze log and of
    the state as they stand, ``runs`` the ingestion runs, ``current`` the current record
    and ``handled`` the stored state of each number, ``pending`` the result. A run reads
    the new files of log and state and the rows of the numbers these name.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: DataType = IntegerType()):
        self.spark, self.root, run = spark, root, StructField("run_id", run_id)
        states = StructType([*HANDLED.fields, run])
        runs = StructType([run, StructField("started_at", TimestampType()), StructField("status", StringType())])
        self.log, self.state, self.runs, self.current, self.handled, self.pending = (
            VersionedTable(spark, f"{root}/{name}", schema)
            for name, schema in (("log", LOG), ("state", states), ("runs", runs), ("current", RECORD), ("handled", HANDLED), ("pending", RECORD)))

    def advance(self, chapters: DataFrame, state: DataFrame, runs: DataFrame, files: bool = True) -> DataFrame:
        """Take in the inputs as they are now and give (number, revid) of what is pending.

        files: ``chapters`` and ``state`` are whole tables of immutable parquet files, which
        are registered and read only when new; otherwise their rows are compared as they
        come, as new files of a table that is replaced.
        """
        for table, rows in ((self.log, chapters), (self.state, state)):
            if files:
                table.register(rows.inputFiles())
            else:
                base = table.manifest()
                table.commit(base, added=_cast(rows, table.schema), remove=base.files)
        merge(self.runs, _cast(runs, self.runs.schema).distinct(), self.runs.schema.names, [])
        process_increment({"log": self.log}, self.current, ["number"], self._current)
        process_increment({"state": self.state, "runs": self.runs}, self.handled, ["number"], self._handled)
        process_increment({"current": self.current, "handled": self.handled}, self.pending, ["number"], self._pending)
        return self.pending.read()

    def _current(self, changes: Changes) -> tuple[DataFrame, DataFrame]:
        new = changes["log"]
        found = materialise(current_records(new.where(F.col(CHANGE) == INSERT)), "found")
        if not any(self.log.changed_files(self._done(self.current, "log"))[1:]):
            # Lines were only added: a number's record is the higher of the one known and the new one.
            old = self.current.read().withColumnRenamed("revid", "old")
            newer = found.join(old, "number", "left").where("old IS NULL OR revid > old").select("number", "revid")
            newer = materialise(newer, "newer")
            return newer, newer
        touched = materialise(new.where("number > 0").select("number").distinct(), "touched")
        return current_records(self.log.read().join(touched, "number", "left_semi")), touched

    def _handled(self, changes: Changes) -> tuple[DataFrame, DataFrame]:
        runs = changes["runs"].select("run_id").distinct()
        of_runs = self.state.read().join(F.broadcast(runs), "run_id", "left_semi").select("number")  # runs: a row each
        touched = materialise(changes["state"].select("number").unionByName(of_runs).where("number IS NOT NULL").distinct(), "touched")
        return stored_state(self.state.read().join(touched, "number", "left_semi"), self.runs.read()), touched

    def _pending(self, changes: Changes) -> tuple[DataFrame, DataFrame]:
        touched = materialise(changes["current"].select("number").unionByName(changes["handled"].select("number")).distinct(), "touched")
        now = self.current.read().where("revid IS NOT NULL").join(touched, "number", "left_semi")
        kept = self.handled.read().where("complete").select("number", F.col("revid").alias("_stored"))
        return now.join(kept, "number", "left").where("_stored IS NULL OR _stored <> revid").select("number", "revid"), touched

    def _done(self, output: VersionedTable, source: str) -> int:
        return int(output.manifest().properties.get(f"processed.{source}", -1))


def _cast(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def unhandled_chapters(chapters: DataFrame, state: DataFrame, runs: DataFrame, root: str | None = None, files: bool = False) -> DataFrame:
    """(number, revid) of each chapter whose current record the last successful run did
    not handle completely, once each.

    With ``root`` the tables of former calls go on, and only what is new since is
    processed; without it everything is new. files: see ChapterWork.advance. Empty inputs
    give an empty result (no chapters) or every chapter (no state); other columns are
    ignored.
    """
    spark = chapters.sparkSession
    return ChapterWork(spark, root or scratch_path(spark, "work"), runs.schema["run_id"].dataType).advance(chapters, state, runs, files)
