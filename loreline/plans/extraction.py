"""From bronze pages to the registry and its quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.functions import wikitext as w
from loreline.operators import mentions as m
from loreline.operators import quality as q
from loreline.operators import registry as r
from loreline.operators import resolve as res
from loreline.session import materialise


@dataclass(frozen=True)
class Extraction:
    pages: DataFrame
    scenes: DataFrame
    targets: DataFrame
    cast: DataFrame
    mentions: DataFrame
    first_use: DataFrame
    types: DataFrame
    entry_catalogs: DataFrame
    excluded: DataFrame
    parts: DataFrame
    dimensions: res.Dimensions

    def registry(self) -> DataFrame:
        return r.registry(r.mention_steps(self.mentions, self.cast), self.dimensions.disguises, self.first_use, self.types, self.entry_catalogs)

    def disguise_candidates(self) -> DataFrame:
        return m.disguise_candidates(self.pages, self.targets, self.dimensions.common_words)

    def pages_without_categories(self) -> DataFrame:
        return res.pages_without_categories(self.parts, self.entry_catalogs, self.dimensions.categories)

    def arcs(self) -> DataFrame:
        return self.pages.select(F.col("number").alias("chapter"), F.coalesce(w.arc(F.col("wikitext")), F.lit(w.UNKNOWN_ARC)).alias("arc"))

    def quality(self) -> DataFrame:
        """The quality report as one row. Maps and lists in it are by chapter, arc, excluded
        or untyped name, as the report's format wants them; the figures behind them are
        distributed tables of loreline.operators.quality."""
        totals, d = q.mention_totals(self.mentions), self.dimensions
        matches = q.checked_matches(self.mentions, self.cast)
        recall = q.recall_proxy(self.cast, self.mentions, self.arcs())

        def gather(df: DataFrame, name: str, order: list, *columns: str) -> DataFrame:
            rows = df.select(F.struct(*order, F.struct(*columns).alias("row")).alias("x"))
            return rows.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias(name))

        def mapped(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
            return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))

        parts = [
            mapped(q.scenes_per_chapter(self.pages, self.scenes), "scenes_per_chapter", "chapter", "scenes"),
            recall.where("arc IS NULL").agg(F.max("recall").alias("recall_proxy")), mapped(recall.where("arc IS NOT NULL"), "recall_proxy_per_arc", "arc", "recall"),
            mapped(q.mentions_by_source(self.mentions), "mentions_by_source", "source", "mentions"), q.precision_proxy(matches).withColumnRenamed("precision", "precision_proxy"),
            gather(q.suspicious_aliases(matches), "suspicious_aliases", [(-F.col("outside_cast")).alias("a"), (-F.col("outside_cast") / F.col("matches")).alias("b"), F.col("alias").alias("c")], "alias", "canonical_name", "matches", "outside_cast"),
            q.unknown_mention_share(self.mentions, self.types).withColumnRenamed("share", "unknown_mention_share"),
            gather(q.top_entities(totals, self.types), "top_entities", [(-F.col("mention_count")).alias("a"), F.col("canonical_name").alias("b")], "canonical_name", "entity_type", "mention_count"),
            self.excluded.agg(F.count(F.lit(1)).alias("excluded_by_category")),
            gather(q.excluded_names(self.excluded, d.categories), "excluded_by_category_names", [F.col("canonical_name").alias("a")], "canonical_name", "categories"),
            gather(q.unknown_entities(totals, self.types), "unknown_entities", [(-F.col("mention_count")).alias("a"), F.col("canonical_name").alias("b")], "canonical_name", "mention_count"),
        ]
        # One row each: united by name and folded, so no row meets another in a join.
        names = [p.columns[0] for p in parts]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        return whole.agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))


def extract_entities(pages: DataFrame, d: res.Dimensions, cut_lineage: bool = True) -> Extraction:
    """Wire the operators: pages (number, wikitext), one row a number.

    Links, cast and mentions feed many branches; with ``cut_lineage`` each is written once
    in the shared folder and read back.
    """
    keep = (lambda df, name: materialise(df, name)) if cut_lineage else (lambda df, name: df)
    pages = pages.select("number", "wikitext")
    parts = keep(res.parts_of_pages(pages), "parts")
    catalog = res.catalogs(parts, d.categories)
    scenes = keep(m.scenes_of(pages), "scenes")
    cast_raw = m.cast_rows(pages)
    every = res.page_links(pages).select("target").unionByName(cast_raw.select("target")).distinct()
    targets = keep(res.link_targets(every, d.categories, catalog), "targets")
    linked = m.link_mentions(scenes, targets, d.common_words).withColumn("is_cast", F.lit(False)).withColumns({"appearance": F.lit(False), "grouped": F.lit(False)})
    people = m.cast(cast_raw, targets).withColumn("is_cast", F.lit(True)).withColumn("scene", F.lit(None).cast("int"))
    items = keep(res.resolve_items(linked.unionByName(people), d), "items")
    kept, gone = res.kept_items(items, d)
    kept = keep(kept, "kept")
    links, cast = kept.where("NOT is_cast"), kept.where("is_cast").select("chapter", "canonical_name", "appearance", "grouped", "alias", "catalog")
    first_use = keep(m.with_disguises(m.alias_first_use(links), d.disguises), "firstuse")
    matches = m.alias_matches(scenes, m.chapter_forms(links, first_use))
    none = F.lit(None).cast("string")
    mentions = links.select("chapter", "scene", "canonical_name", "alias", F.lit("link").alias("source"), none.alias("surface"), "catalog").unionByName(
        matches.select("chapter", "scene", "canonical_name", none.alias("alias"), F.lit("alias_match").alias("source"), "surface", none.alias("catalog")))
    mentions = keep(mentions, "mentions")
    entry_catalogs = kept.where("catalog IS NOT NULL").groupBy("canonical_name").agg(F.min("catalog").alias("catalog"))
    names = kept.select("canonical_name").distinct()
    return Extraction(pages, scenes, targets, cast, mentions, first_use, keep(res.entity_types(names, d, entry_catalogs), "types"), entry_catalogs, gone, parts, d)
