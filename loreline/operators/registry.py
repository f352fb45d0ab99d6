"""The registry: a slowly changing row per entity and chapter in which it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mention_steps(mentions: DataFrame, cast: DataFrame | None = None) -> DataFrame:
    """(canonical_name, chapter, n): mentions a chapter; a chapter of cast alone counts 0."""
    rows = mentions.select("canonical_name", "chapter", F.lit(1).alias("n"))
    if cast is not None:
        rows = rows.unionByName(cast.select("canonical_name", "chapter", F.lit(0).alias("n")))
    return rows.where("canonical_name IS NOT NULL AND chapter IS NOT NULL").groupBy("canonical_name", "chapter").agg(F.sum("n").alias("n"))


def disguise_merge(steps: DataFrame, disguises: DataFrame) -> DataFrame:
    """(canonical_name, chapter, n, low, high): at its revelation a disguise's mentions and
    chapters join its entity. Several may meet there; one without steps adds nothing."""
    told = disguises.where("revelation IS NOT NULL").distinct()
    rows = told.select("alias", F.col("canonical_name").alias("real"), "revelation").join(steps.withColumnRenamed("canonical_name", "alias"), "alias")
    return rows.groupBy(F.col("real").alias("canonical_name"), F.col("revelation").alias("chapter")).agg(F.sum("n").alias("n"), F.min("chapter").alias("low"), F.max("chapter").alias("high"))


def disguise_ends(disguises: DataFrame) -> DataFrame:
    return disguises.where("revelation IS NOT NULL").groupBy(F.col("alias").alias("canonical_name")).agg((F.max("revelation") - 1).alias("until"))


def registry(steps: DataFrame, disguises: DataFrame, first_use: DataFrame | None = None, types: DataFrame | None = None, catalogs: DataFrame | None = None) -> DataFrame:
    """Registry rows with running count, first and last sighting and validity.

    valid_to is the chapter before the next step, for a disguise's last row the chapter
    before its revelation, else null. With ``first_use`` the aliases used so far come
    along, with ``types`` and ``catalogs`` those of each entity. Steps are at most one a
    chapter and entity, so a hot entity's window is bounded by the number of chapters.
    """
    own = steps.select("canonical_name", "chapter", "n", F.col("chapter").alias("low"), F.col("chapter").alias("high"))
    all_steps = own.unionByName(disguise_merge(steps, disguises)).groupBy("canonical_name", "chapter").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("canonical_name").orderBy("chapter")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = all_steps.select(
        "canonical_name", F.col("chapter").alias("valid_from"), (F.lead("chapter").over(order) - 1).alias("next"),
        F.min("low").over(upto).alias("first_chapter_seen"), F.max("high").over(upto).alias("last_chapter_seen"), F.sum("n").over(upto).alias("mention_count"))
    rows = rows.join(disguise_ends(disguises), "canonical_name", "left").withColumn("valid_to", F.coalesce("next", "until")).drop("next", "until")
    if first_use is not None:
        rows = rows.join(aliases_asof(rows.select("canonical_name", "valid_from"), first_use), ["canonical_name", "valid_from"], "left")
        rows = rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    if types is not None:
        rows = rows.join(types, "canonical_name", "left").withColumn("entity_type", F.coalesce("entity_type", F.lit("Unknown")))
    if catalogs is not None:
        rows = rows.join(catalogs, "canonical_name", "left")
    order_of = ("canonical_name", "entity_type", "catalog", "aliases", "valid_from", "valid_to", "first_chapter_seen", "last_chapter_seen", "mention_count")
    return rows.select(*(c for c in order_of if c in rows.columns))


def aliases_asof(rows: DataFrame, first_use: DataFrame) -> DataFrame:
    """(canonical_name, valid_from, aliases): sorted aliases used at valid_from or before.

    A running set over the union of rows and alias dates: no range join.
    """
    both = rows.select("canonical_name", F.col("valid_from").alias("at"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("kind")).unionByName(
        first_use.select("canonical_name", F.col("first").alias("at"), "alias", F.lit(0).alias("kind")))
    upto = Window.partitionBy("canonical_name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("aliases", F.array_sort(F.collect_set("alias").over(upto)))
    return known.where("kind = 1").select("canonical_name", F.col("at").alias("valid_from"), "aliases")


def registry_at(rows: DataFrame, t: int) -> DataFrame:
    """Rows that hold at chapter ``t``."""
    return rows.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t)))
