"""A small table format with immutable, numbered manifests.

Layout below ``root``::

    data/<uuid>/part-*.parquet   rows, never rewritten
    deletes/<uuid>/*.parquet     deletion vectors: (file, pos) of rows no longer live
    manifests/<version>.json     files and deletion vectors live in that version, plus properties

A manifest may also name files outside ``root``, registered as they stand: so an immutable
log that others write is a table too. Each deletion vector is kept with the files it
touches, and only the vectors of the files that are read are read. A commit writes its
files first and then puts ``manifests/<n+1>.json`` in place by a rename that fails if the
name is taken, so a commit happens wholly or not at all and two writers cannot make the
same version. Manifests hold names, one per written file; rows stay distributed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE, POS, CHANGE = "_file", "_pos", "_change"
INSERT, DELETE = "insert", "delete"


class CommitConflict(Exception):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    files: tuple[str, ...] = ()
    deletes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # vector -> files it touches
    properties: dict[str, str] = field(default_factory=dict)

    def vectors(self, files: Iterable[str]) -> tuple[str, ...]:
        """Deletion vectors that touch any of ``files``."""
        wanted = set(files)
        return tuple(v for v, hit in self.deletes.items() if not wanted.isdisjoint(hit))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        clash = {FILE, POS, CHANGE} & {f.name for f in schema.fields}
        if clash:
            raise ValueError(f"reserved column names: {sorted(clash)}")

    # -- storage ---------------------------------------------------------------------

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}")

    def _list(self, rest: str) -> list[str]:
        fs, p = self._fs(), self._path(rest)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        """The last committed version, -1 for a table without any."""
        return max((int(n[:-5]) for n in self._list("manifests") if n.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if version < 0:
            return Manifest(-1)
        stream = self._fs().open(self._path(f"manifests/{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(text)
        return Manifest(version, tuple(x["files"]), {v: tuple(hit) for v, hit in x["deletes"].items()}, x["properties"])

    def _stage(self, df: DataFrame, kind: str) -> list[str]:
        where = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{where}")
        return [f"{where}/{n}" for n in self._list(where) if n.endswith(".parquet")]

    def commit(self, base: Manifest, added: DataFrame | None = None, deletes: DataFrame | None = None,
               properties: dict[str, str] | None = None, register: Iterable[str] = (), remove: Iterable[str] = ()) -> Manifest:
        """Make the version after ``base``.

        ``added`` rows go to new files; ``register`` names files elsewhere that belong to
        the table from now on; ``deletes`` (file, pos) becomes a deletion vector;
        ``remove`` names files that leave. ``properties`` are merged over the old ones in
        the same atomic step, which is where a consumer keeps the version it has
        processed. Raises CommitConflict if the version exists already.
        """
        files = self._stage(added.select(*self.schema.names), "data") if added is not None else []
        vectors: dict[str, tuple[str, ...]] = {}
        for v in self._stage(deletes.select(FILE, POS), "deletes") if deletes is not None else []:
            hit = tuple(sorted(r[0] for r in self._vectors((v,)).select(FILE).distinct().collect()))
            if hit:
                vectors[v] = hit
        gone = set(remove)
        live = (*(f for f in base.files if f not in gone), *files, *(f for f in register if f not in base.files))
        kept = {v: left for v, hit in base.deletes.items() if (left := tuple(f for f in hit if f not in gone))}
        made = Manifest(base.version + 1, live, kept | vectors, base.properties | (properties or {}))
        self._publish(made)
        return made

    def _publish(self, made: Manifest) -> None:
        """Put a manifest in place by a rename that fails if its version is taken."""
        body = json.dumps({"files": made.files, "deletes": made.deletes, "properties": made.properties})
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temp, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{made.version:020d}.json")
        out = self._fs().create(temp, False)
        try:
            out.write(bytearray(body, "utf-8"))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temp, final, none)
        except Exception as e:
            self._fs().delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {made.version} exists") from e
            raise

    def register(self, files: Iterable[str], properties: dict[str, str] | None = None) -> Manifest:
        """Bring the table to hold just the named files elsewhere; no commit if it does.
        files: full addresses as ``DataFrame.inputFiles`` gives them.

        New names are added and absent ones leave, so the difference of two versions is
        the difference of two listings and no file is read to find it.
        """
        base, now = self.manifest(), list(dict.fromkeys(files))
        new, gone = [f for f in now if f not in set(base.files)], [f for f in base.files if f not in set(now)]
        return self.commit(base, properties=properties, register=new, remove=gone) if new or gone or base.version < 0 else base

    def compact(self) -> Manifest | None:
        """Rewrite the files that deletion vectors touch, so that none is left; None if
        none does. Consumers see no change, as the rows stay the same."""
        base = self.manifest()
        touched = tuple(f for f in base.files if base.vectors([f]))
        return self.commit(base, added=self._rows(touched, base), remove=touched) if touched else None

    # -- reading ---------------------------------------------------------------------

    def _address(self, file: str) -> str:
        """Where a file of a manifest lies; addresses of registered ones are URL-encoded."""
        return unquote(file) if "://" in file else f"{self.root}/{file}"

    def _rows(self, files: Iterable[str], m: Manifest, located: bool = False, skip: bool = True) -> DataFrame:
        """Live rows of ``files`` in version ``m``; located: with their file and position;
        not skip: rows that deletion vectors take away as well."""
        files = tuple(files)
        if not files:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumns({FILE: F.lit(""), POS: F.lit(0).cast("long")}) if located else empty
        vectors = m.vectors(files) if skip else ()
        df = self.spark.read.schema(self.schema).parquet(*map(self._address, files))
        if not (located or vectors):
            return df
        df = df.withColumns({FILE: _short(F.col("_metadata.file_path")), POS: F.col("_metadata.row_index")})
        if vectors:
            df = df.join(self._vectors(vectors), [FILE, POS], "left_anti")
        return df if located else df.select(*self.schema.names)

    def _vectors(self, vectors: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(f"{FILE} STRING, {POS} BIGINT").parquet(*(f"{self.root}/{v}" for v in vectors))

    def read(self, version: int | None = None, located: bool = False) -> DataFrame:
        m = self.manifest(version)
        return self._rows(m.files, m, located)

    def changed_files(self, since: int, until: int | None = None) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
        """(added, removed, kept files that new deletion vectors touch, these vectors): all
        that the changes between two versions are read from."""
        a, b = self.manifest(since), self.manifest(until)
        both = set(a.files) & set(b.files)
        fresh = tuple(v for v, hit in b.deletes.items() if v not in a.deletes and not both.isdisjoint(hit))
        touched = {f for v in fresh for f in b.deletes[v]} & both
        return tuple(f for f in b.files if f not in both), tuple(f for f in a.files if f not in both), tuple(sorted(touched)), fresh

    def changes(self, since: int, until: int | None = None, net: bool = True) -> DataFrame:
        """Rows inserted and deleted between two versions, with ``_change``.

        Only ``changed_files`` are read. net: rows that were rewritten unchanged (the same
        values deleted and inserted) are left out; equal rows are told apart by how often
        they occur.
        """
        a, b = self.manifest(since), self.manifest(until)
        new, gone, touched, fresh = self.changed_files(since, b.version)
        out = self._rows(new, b).withColumn(CHANGE, F.lit(INSERT))
        if gone:
            out = out.unionByName(self._rows(gone, a).withColumn(CHANGE, F.lit(DELETE)))
        if touched:
            hit = self._rows(touched, a, located=True).join(self._vectors(fresh).distinct(), [FILE, POS], "left_semi").select(*self.schema.names)
            out = out.unionByName(hit.withColumn(CHANGE, F.lit(DELETE)))
        if not (net and (gone or touched)):
            return out
        sign = F.sum(F.when(F.col(CHANGE) == INSERT, 1).otherwise(-1)).alias("_n")
        counted = out.groupBy(*self.schema.names).agg(sign).where("_n != 0")
        copies = F.explode(F.array_repeat(F.when(F.col("_n") > 0, INSERT).otherwise(DELETE), F.abs("_n").cast("int")))
        return counted.select(*self.schema.names, copies.alias(CHANGE))


def _short(path: Column) -> Column:
    """A file's name as manifests hold it."""
    own = F.regexp_replace(path, r"^.*/(data/[0-9a-f]{32}/[^/]+)$", "$1")
    return F.regexp_replace(own, "^file:/+", "file:///")
