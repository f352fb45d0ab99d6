"""Readers and writers of the layers' files, with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions.dialect import strip
from loreline.operators.resolve import Dimensions
from loreline.operators.silver import render_markdown
from loreline.session import file_system

BRONZE = "number INT, revid LONG, timestamp STRING, wikitext STRING"
STATE = "number INT, revid LONG, complete BOOLEAN"


def layer_paths(data_dir: str) -> dict[str, str]:
    root = data_dir.rstrip("/")
    return {"bronze": f"{root}/bronze", "silver": f"{root}/silver", "gold": f"{root}/gold", "state": f"{root}/state.json"}


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines with an order that follows file and place in it."""
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return rows.select(F.struct("f", "b", "i").alias("line_no"), "value")


def scan_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a JSON-lines archive, the last line of a number only; empty if missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], BRONZE)
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    rows = lines.select("line_no", F.from_json("value", BRONZE).alias("r")).where("r.number IS NOT NULL")
    return rows.groupBy("r.number").agg(F.max_by("r", "line_no").alias("r")).select("r.*")


def scan_state(spark: SparkSession, path: str) -> DataFrame:
    """(number, revid, complete) of the state file, a JSON object by number; empty if missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING,STRUCT<revid:LONG,complete:BOOLEAN>>").alias("m"))
    return whole.select(F.explode("m").alias("k", "v")).select(F.col("k").cast("int").alias("number"), "v.revid", "v.complete")


def scan_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): one item a line, blank lines and lines that begin with # left out."""
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(strip(F.col("value")).alias("name")).where("name <> ''")


def scan_common_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(sorted(r.w for r in scan_list(spark, path).select(F.lower("name").alias("w")).distinct().collect()))


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, comment lines left out."""
    return spark.read.csv(path, header=True, comment="#", schema=schema, enforceSchema=False)


def scan_json_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; fields that the schema doesn't name are not read."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def scan_category_cache(spark: SparkSession, path: str) -> DataFrame:
    """(title, categories) of a JSON object by title; empty if missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "title string, categories array<string>")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING,ARRAY<STRING>>").alias("m"))
    return whole.select(F.explode("m").alias("title", "categories"))


def scan_silver(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, value) of the chapters' Markdown files."""
    return spark.read.text(f"{folder}/chapter_*.md", wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")


def load_reference(spark: SparkSession, folder: str) -> Dimensions:
    """Every dimension from the files of one folder."""
    fruits = scan_json_dataset(spark, f"{folder}/devil_fruits.json", "name string, english string").withColumn("pos", F.monotonically_increasing_id())
    words = f"{folder}/common_words.txt"
    more = {"common_words": scan_common_words(spark, words)} if exists(spark, words) else {}
    return Dimensions(
        categories=scan_category_cache(spark, f"{folder}/wiki_categories.json"),
        redirects=scan_csv(spark, f"{folder}/redirects.csv", "redirect string, canonical_name string"),
        disguises=scan_csv(spark, f"{folder}/disguises.csv", "alias string, canonical_name string, revelation int"),
        overrides=scan_csv(spark, f"{folder}/type_overrides.csv", "canonical_name string, entity_type string"),
        concepts=scan_list(spark, f"{folder}/concepts.txt"),
        characters=scan_json_dataset(spark, f"{folder}/characters.json", "name string"),
        places=scan_json_dataset(spark, f"{folder}/islands.json", "name string"),
        fruits=fruits, **more)


# -- sinks: one file where the format is one file, written by a task and renamed -----------------


def write_single(df: DataFrame, path: str, text_column: str | None = None) -> None:
    """One text or JSON-lines file, in the order of ``df``, on any Hadoop file system.

    The file is written beside its place by one task, as the format is one file, and put
    there by a rename that replaces what was there.
    """
    spark = df.sparkSession
    fs, target = file_system(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}"
    one = df.coalesce(1)
    if text_column:
        one.select(text_column).write.text(temp)
    else:
        one.write.option("ignoreNullFields", "false").json(temp)
    folder = file_system(spark, temp)[1]
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(fs.makeQualified(target).getParent())
    replace_file(spark, fs.makeQualified(part), fs.makeQualified(target))
    fs.delete(folder, True)


def replace_file(spark: SparkSession, source, target) -> None:
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, overwrite)


def sink_bronze(bronze: DataFrame, path: str) -> None:
    write_single(bronze.select("number", "revid", "timestamp", "wikitext").orderBy("number"), path)


def sink_state(state: DataFrame, path: str) -> None:
    entries = F.sort_array(F.collect_list(F.struct(F.col("number"), F.struct("revid", "complete").alias("v"))))
    pairs = F.transform(entries, lambda x: F.struct(x["number"].cast("string").alias("k"), x["v"].alias("v")))
    write_single(state.agg(F.to_json(F.map_from_entries(pairs), {"pretty": "true"}).alias("value")), path, "value")


def sink_silver(chapters: DataFrame, folder: str) -> None:
    """One chapter_0000.md a chapter, written by the tasks that hold it into a folder that
    all executors reach; a file appears whole or not at all."""
    fs, target = file_system(chapters.sparkSession, folder)
    fs.mkdirs(target)
    address = fs.makeQualified(target).toString()

    def write(rows) -> None:
        from pyarrow import fs as pafs

        system, root = (pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")) if address.startswith("file:") else pafs.FileSystem.from_uri(address)
        for r in rows:
            name = f"chapter_{r.number:04d}.md"
            temp = f"{root}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temp) as f:
                f.write(r.md.encode("utf-8", "surrogatepass"))
            system.move(temp, f"{root}/{name}")

    chapters.select("number", render_markdown().alias("md")).foreachPartition(write)


def sink_registry(rows: DataFrame, path: str) -> None:
    write_single(rows.orderBy("valid_from", "canonical_name"), path)


def sink_quality(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    write_single(report.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")), path, "value")


def sink_candidates(candidates: DataFrame, path: str) -> None:
    """CSV with a byte-order mark and CRLF line ends, nulls as nothing."""
    def cell(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    columns = candidates.columns
    rows = candidates.select(F.lit(1).alias("at"), "link_count", "alias", "canonical_name", F.concat(F.concat_ws(",", *map(cell, columns)), F.lit("\r")).alias("value"))
    head = candidates.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(columns) + "\r")], "at int, value string")
    whole = rows.unionByName(head, allowMissingColumns=True).orderBy("at", F.desc("link_count"), "alias", "canonical_name")
    write_single(whole, path, "value")


def sink_category_cache(cache: DataFrame, path: str) -> None:
    pairs = F.sort_array(F.collect_list(F.struct("title", "categories")))
    write_single(cache.agg(F.to_json(F.map_from_entries(pairs), {"pretty": "true"}).alias("value")), path, "value")
