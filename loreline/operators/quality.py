"""Quality figures of an extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("link", "alias_match")


def mention_totals(mentions: DataFrame) -> DataFrame:
    return mentions.where("canonical_name IS NOT NULL").groupBy("canonical_name").agg(F.count(F.lit(1)).alias("mention_count"))


def mentions_by_source(mentions: DataFrame) -> DataFrame:
    """(source, mentions) for the two sources, 0 included."""
    names = mentions.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    return names.join(mentions.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("mentions"))


def scenes_per_chapter(pages: DataFrame, scenes: DataFrame) -> DataFrame:
    """(chapter, scenes), chapters without any included."""
    counts = scenes.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    return pages.select(F.col("number").alias("chapter")).join(counts, "chapter", "left").select("chapter", F.coalesce("n", F.lit(0)).alias("scenes"))


def _met(rows: DataFrame, present: DataFrame) -> DataFrame:
    keys = present.select("canonical_name", "chapter", F.lit(1).alias("_in")).distinct()
    return rows.join(keys, ["canonical_name", "chapter"], "left").withColumn("met", F.coalesce("_in", F.lit(0)).cast("double")).drop("_in")


def recall_proxy(cast: DataFrame, mentions: DataFrame, arcs: DataFrame) -> DataFrame:
    """(arc, recall, appearances): share of appearances that are mentioned in their chapter,
    by arc and over all (arc null). arcs: (chapter, arc). Over nothing the share is null."""
    hits = _met(cast.where("appearance").select("canonical_name", "chapter"), mentions).join(arcs, "chapter")
    both = hits.select(F.explode(F.array(F.col("arc"), F.lit(None).cast("string"))).alias("arc"), "met")
    return both.groupBy("arc").agg(F.avg("met").alias("recall"), F.count(F.lit(1)).alias("appearances"))


def checked_matches(mentions: DataFrame, cast: DataFrame) -> DataFrame:
    """(canonical_name, surface, met) of alias matches of characters anywhere in the cast."""
    people = cast.where("NOT grouped").select("canonical_name", "chapter")
    rows = mentions.where("source = 'alias_match'").select("canonical_name", "chapter", "surface")
    return _met(rows.join(people.select("canonical_name").distinct(), "canonical_name", "left_semi"), people)


def precision_proxy(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg("met").alias("precision"))


def suspicious_aliases(matches: DataFrame, k: int = 20) -> DataFrame:
    """The k forms that fall outside the cast most often."""
    g = matches.groupBy(F.col("surface").alias("alias"), "canonical_name").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("met") == 0).alias("outside_cast"))
    return g.where("outside_cast > 0").orderBy(F.desc("outside_cast"), F.desc(F.col("outside_cast") / F.col("matches")), "alias", "canonical_name").limit(k)


def unknown_mention_share(mentions: DataFrame, types: DataFrame) -> DataFrame:
    x = mentions.join(types, "canonical_name")
    return x.agg(F.avg((F.col("entity_type") == "Unknown").cast("double")).alias("share"))


def top_entities(totals: DataFrame, types: DataFrame, k: int = 50) -> DataFrame:
    return totals.join(types, "canonical_name").orderBy(F.desc("mention_count"), "canonical_name").limit(k).select("canonical_name", "entity_type", "mention_count")


def unknown_entities(totals: DataFrame, types: DataFrame) -> DataFrame:
    """(canonical_name, mention_count) of every entity without a type, 0 included."""
    return types.where("entity_type = 'Unknown'").join(totals, "canonical_name", "left").select("canonical_name", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


def excluded_names(gone: DataFrame, categories: DataFrame) -> DataFrame:
    return gone.distinct().join(categories.withColumnRenamed("title", "name"), "name", "left").select(F.col("name").alias("canonical_name"), "categories")
