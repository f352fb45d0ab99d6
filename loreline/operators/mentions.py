"""Scenes, mentions by link and by alias, and the cast of chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.functions import wikitext as w
from loreline.functions.chartable import parse_characters, parse_groups
from loreline.functions.dialect import WORD, rx_quote


def scenes_of(pages: DataFrame) -> DataFrame:
    """(chapter, scene, text): paragraphs of prose of the long summary."""
    return pages.select(F.col("number").alias("chapter"), F.posexplode(w.scenes(w.section(F.col("wikitext"), "Long Summary"))).alias("scene", "text"))


def link_mentions(scenes: DataFrame, targets: DataFrame, common_words: tuple[str, ...]) -> DataFrame:
    """(chapter, scene, canonical_name, alias, catalog): every link that names an entity."""
    common = F.array(*map(F.lit, common_words)) if common_words else None
    rows = scenes.select("chapter", "scene", F.explode(w.links(F.col("text"))).alias("l")).select("chapter", "scene", "l.target", "l.label")
    rows = rows.join(targets, "target")
    return rows.select("chapter", "scene", "canonical_name", w.clean_alias(F.col("label"), F.col("own"), F.col("canonical_name"), common).alias("alias"), "catalog")


def cast_rows(pages: DataFrame) -> DataFrame:
    """(chapter, target, label, on_panel, annotations, grouped) of the character tables."""
    s = w.section(F.col("wikitext"), "Characters")
    people = F.transform(parse_characters(s), lambda c: F.struct(c["name"].alias("target"), c["label"].alias("label"), c["on_panel"].alias("on_panel"), c["annotations"].alias("annotations"), F.lit(False).alias("grouped")))
    groups = F.transform(parse_groups(s), lambda g: F.struct(g.alias("target"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("on_panel"), F.array().cast("array<string>").alias("annotations"), F.lit(True).alias("grouped")))
    return pages.select(F.col("number").alias("chapter"), F.explode(F.concat(people, groups)).alias("x")).select("chapter", "x.*")


def cast(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(chapter, canonical_name, appearance, grouped, alias, catalog): characters that
    appear, are recalled or shown on the cover, and linked groups."""
    seen = F.col("grouped") | F.col("on_panel") | F.exists("annotations", lambda a: a.rlike("flashback|cover"))
    x = rows.where(seen).join(targets, "target")
    alias = w.clean_alias(F.coalesce("label", F.lit("")), F.col("own"), F.col("canonical_name"))
    return x.select("chapter", "canonical_name", (F.col("on_panel") & ~F.col("grouped")).alias("appearance"), "grouped", F.when(~F.col("grouped"), alias).alias("alias"), "catalog")


def alias_first_use(mentions: DataFrame) -> DataFrame:
    """(canonical_name, alias, first): the chapter an alias was first used in."""
    return mentions.where("alias IS NOT NULL AND canonical_name IS NOT NULL").groupBy("canonical_name", "alias").agg(F.min("chapter").alias("first"))


def with_disguises(first_use: DataFrame, disguises: DataFrame) -> DataFrame:
    """A disguise becomes an alias at its revelation, whatever its first use was."""
    told = disguises.where("revelation IS NOT NULL").select("canonical_name", "alias", F.col("revelation").alias("told")).distinct()
    return first_use.join(told, ["canonical_name", "alias"], "full").select("canonical_name", "alias", F.coalesce("told", "first").alias("first"))


def chapter_forms(linked: DataFrame, first_use: DataFrame) -> DataFrame:
    """(chapter, form, canonical_name): names and dated aliases of the entities linked in a
    chapter; a form that two of them share is nobody's."""
    names = linked.select("chapter", "canonical_name").distinct()
    dated = names.join(first_use, "canonical_name").where(F.col("first") <= F.col("chapter")).select("chapter", F.col("alias").alias("form"), "canonical_name")
    forms = names.select("chapter", F.col("canonical_name").alias("form"), "canonical_name").unionByName(dated)
    one = forms.groupBy("chapter", "form").agg(F.min("canonical_name").alias("canonical_name"), F.max("canonical_name").alias("other"))
    return one.where("canonical_name = other").select("chapter", "form", "canonical_name")


def alias_matches(scenes: DataFrame, forms: DataFrame) -> DataFrame:
    """(chapter, scene, canonical_name, surface): unlinked occurrences of a chapter's forms.

    One pattern per chapter, longest form first, so matches are leftmost, longest and do
    not overlap; a form stands between characters that are no part of a word. Links are
    blanked, since they are mentions already.
    """
    w_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.length("form"), rx_quote(F.col("form")).alias("q")))), lambda x: x["q"]), "|")
    pattern = F.concat(F.lit(f"(?<!{WORD})(?:"), w_, F.lit(f")(?!{WORD})"))
    patterns = forms.groupBy("chapter").agg(pattern.alias("p"))
    text = F.replace(F.regexp_replace("text", w.LINK, "     "), F.lit("’"), F.lit("'"))
    hits = scenes.join(patterns, "chapter").select("chapter", "scene", F.explode(F.regexp_extract_all(text, F.col("p"), F.lit(0))).alias("form"))
    return hits.join(forms, ["chapter", "form"]).select("chapter", "scene", "canonical_name", F.col("form").alias("surface"))


def disguise_candidates(pages: DataFrame, targets: DataFrame, common_words: tuple[str, ...]) -> DataFrame:
    """(alias, canonical_name, link_count, first_chapter, last_chapter, revelation): aliases
    of characters that share no word with the name, for a human to look at."""
    texts = F.explode(F.array(*(w.section(F.col("wikitext"), h) for h in ("Long Summary", "Characters", "Chapter Notes")))).alias("text")
    scenes = pages.select(F.col("number").alias("chapter"), F.lit(0).alias("scene"), texts)
    found = link_mentions(scenes, targets, common_words).where("alias IS NOT NULL")
    found = found.where(~F.arrays_overlap(w.name_tokens(F.col("alias")), w.name_tokens(F.col("canonical_name"))))
    people = cast_rows(pages).where("NOT grouped").select("target").join(targets, "target").select("canonical_name").distinct()
    rows = found.join(people, "canonical_name", "left_semi").groupBy("alias", "canonical_name")
    return rows.agg(F.count(F.lit(1)).alias("link_count"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter")).withColumn("revelation", F.lit(None).cast("int"))
