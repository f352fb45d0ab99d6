"""Full histories of entity attributes from periodic snapshots and single updates.

Every source is stored as a run: cut at the same keys as all others into co-partitioned
files, each sorted by (entity, chapter, update). A partition's files are then opened side
by side and merged by key (a k-way merge of iterators), and a version is emitted when the
payload changes. Only the open version and one batch a file are held. Cutting by (entity,
chapter) splits hot entities; versions that touch a partition's edge, at most two a
partition, are joined up afterwards.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreline.session import file_system, materialise, scratch_path

OPEN = -1
PER_PARTITION = 500_000  # observations a partition is to hold
KEYS_PER_PARTITION = 64  # sampled keys that place the cuts; they move work, never results
_KEY = ["canonical_name", "chapter", "update_id"]
_OBSERVED = "canonical_name string, chapter long, update_id long, state string"
_RUN = "canonical_name string, valid_from long, valid_to long, state string, first boolean, last boolean"
_STATE = "entity_type string, aliases array<string>"
_BATCH = 8192

Key = tuple[str, int]


def observations(updates: DataFrame) -> DataFrame:
    """(canonical_name, chapter, update_id, state) of the rows that count.

    state: the payload as JSON, '' where the entity is absent. Rows without name (null or
    blank) or chapter are left out; aliases are a sorted set, null and null elements count
    as nothing; a null ``present`` is absence, a null ``update_id`` comes before all.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    state = F.to_json(F.struct(F.col("entity_type").alias("entity_type"), names.alias("aliases")))
    return updates.where("chapter IS NOT NULL AND trim(canonical_name) <> ''").select(
        "canonical_name", F.col("chapter").cast("long").alias("chapter"), F.coalesce(F.col("update_id").cast("long"), F.lit(-(2**63))).alias("update_id"),
        F.when(F.col("present"), state).otherwise("").alias("state"))


def cut_keys(sources: list[DataFrame], partitions: int | None = None) -> list[Key]:
    """Keys that cut all sources into about equal partitions.

    They come from a bounded sample of keys and only place the work. partitions: by
    default one per PER_PARTITION observations, at least one per core.
    """
    keys = [s.select("canonical_name", "chapter") for s in sources]
    whole = keys[0]
    for k in keys[1:]:
        whole = whole.unionByName(k)
    n = whole.count()
    partitions = partitions or max(whole.sparkSession.sparkContext.defaultParallelism, -(-n // PER_PARTITION))
    if n == 0 or partitions == 1:
        return []
    found = sorted(tuple(r) for r in whole.sample(min(1.0, partitions * KEYS_PER_PARTITION / n), 5).collect())
    return sorted({found[len(found) * i // partitions] for i in range(1, partitions)}) if found else []


def store_run(observed: DataFrame, cuts: list[Key], path: str) -> str:
    """Write a source as a run: one file per partition, sorted by key.

    Of rows for one name and chapter in a batch only the newest is moved, so a hot pair is
    reduced before the shuffle. A run is written once and can be merged with later ones.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("update_id", kind="stable").drop_duplicates(["canonical_name", "chapter"], keep="last")
            yield b.assign(p=[bisect_right(cuts, k) for k in zip(b["canonical_name"], b["chapter"])])

    placed = observed.mapInPandas(place, _OBSERVED + ", p int")
    placed = placed.repartitionById(len(cuts) + 1, F.col("p")).sortWithinPartitions("p", *_KEY)
    placed.write.partitionBy("p").parquet(path)
    return path


def run_files(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Files of a run by partition, as full addresses."""
    fs, root = file_system(spark, path)
    out: dict[int, list[str]] = {}
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("p="):
            files = [str(f.getPath().toString()) for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            out[int(name[2:])] = sorted(files)
    return out


def merge_runs(spark: SparkSession, paths: list[str], partitions: int) -> DataFrame:
    """Runs of equal states (see _RUN) over all stored sources; flags tell the edges of a
    partition. Sources are merged by key without a shuffle."""
    by_run = [run_files(spark, p) for p in paths]
    files = [f for i in range(partitions) if (f := [x for r in by_run for x in r.get(i, [])])]
    work = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(files)], "i int, files string").repartitionById(max(1, len(files)), F.col("i"))
    return work.mapInPandas(_merged, _RUN)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for files in b["files"]:
            rows = merge(*(_rows(f) for f in json.loads(files)), key=itemgetter(0, 1, 2))
            yield from _frames(versions(rows))


def _rows(address: str) -> Iterator[tuple[str, int, int, str]]:
    """The rows of one sorted file, a batch at a time."""
    from pyarrow import fs as pafs
    from pyarrow import parquet

    if address.startswith("file:"):
        system, path = pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    else:
        system, path = pafs.FileSystem.from_uri(address)
    with system.open_input_file(path) as f:
        for b in parquet.ParquetFile(f).iter_batches(_BATCH, columns=[*_KEY, "state"]):
            yield from zip(*(c.to_pylist() for c in b.columns))


def versions(rows: Iterator[tuple[str, int, int, str]]) -> Iterator[tuple]:
    """(name, from, to, state, first, last) runs of equal states in key order.

    Of rows for one name and chapter the last, that with the highest update, holds.
    """
    held: list | None = None  # name, from, state, is the first run
    seen: tuple[str, int, str] | None = None

    def step(now: tuple[str, int, str] | None) -> Iterator[tuple]:
        nonlocal held
        if now is None:
            return
        name, chapter, state = now
        if held is None:
            held = [name, chapter, state, True]
        elif name != held[0]:
            yield (held[0], held[1], OPEN, held[2], held[3], False)
            held = [name, chapter, state, False]
        elif state != held[2]:
            yield (held[0], held[1], chapter - 1, held[2], held[3], False)
            held = [name, chapter, state, False]

    for name, chapter, _, state in rows:
        if seen is not None and (name, chapter) != seen[:2]:
            yield from step(seen)
        seen = (name, chapter, state)
    yield from step(seen)
    if held is not None:
        yield (held[0], held[1], OPEN, held[2], held[3], True)


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    columns, out = [c.split()[0] for c in _RUN.split(", ")], []
    for r in rows:
        out.append(r)
        if len(out) == _BATCH:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def entity_history(*sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """All versions (canonical_name, entity_type, aliases, valid_from, valid_to).

    sources: tables of observations as in ``registry_updates``, snapshots or updates. A
    version runs from the chapter in which a present state begins to the chapter before
    the next different state (absence is one); valid_to is -1 if none follows. Equal
    consecutive states are one version. Of rows for one name and chapter, over all
    sources, the highest update_id holds; rows repeated within or across sources count
    once. Empty sources give an empty history; other columns are ignored.
    """
    spark = sources[0].sparkSession
    observed = [observations(s) for s in sources]
    cuts = cut_keys(observed, partitions)
    paths = [store_run(o, cuts, scratch_path(spark, "run")) for o in observed]
    runs = materialise(merge_runs(spark, paths, len(cuts) + 1), "versions")  # read twice
    inner = runs.where("NOT first AND NOT last").select("canonical_name", "valid_from", "valid_to", "state")
    whole = inner.unionByName(_stitch(runs.where("first OR last"))).where("state <> ''")
    return whole.withColumn("s", F.from_json("state", _STATE)).select("canonical_name", "s.entity_type", "s.aliases", "valid_from", "valid_to")


def deliveries(updates: DataFrame, n: int) -> list[DataFrame]:
    """``updates`` as ``n`` sources, cut by order of arrival."""
    ends = updates.agg(F.min("update_id").alias("a"), F.max("update_id").alias("b")).first()
    if ends.a is None:
        return [updates]
    width = -(-(ends.b - ends.a + 1) // n)
    nth = F.coalesce(F.floor((F.col("update_id") - ends.a) / width), F.lit(0))
    return [updates.where(nth == i) for i in range(n)]


def _stitch(edges: DataFrame) -> DataFrame:
    """Join up the runs at partition edges (two rows a partition at most, so one task)."""
    w = Window.partitionBy(F.lit(1)).orderBy("canonical_name", "valid_from")

    def prior(c: str) -> Column:
        return F.lag(c).over(w)

    same = prior("last") & F.col("first") & (prior("canonical_name") == F.col("canonical_name")) & (prior("state") == F.col("state"))
    grouped = edges.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    grouped = grouped.withColumn("g", F.sum("starts").over(w))
    tail = F.struct("valid_from", "valid_to", "last")
    whole = grouped.groupBy("g", "canonical_name", "state").agg(F.min("valid_from").alias("valid_from"), F.max(tail).alias("t"))
    follows = F.lead("canonical_name").over(w) == F.col("canonical_name")
    end = F.when(F.col("t.last") & follows, F.lead("valid_from").over(w) - 1).otherwise(F.col("t.valid_to"))
    return whole.select("canonical_name", "valid_from", end.alias("valid_to"), "state")
