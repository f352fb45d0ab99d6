"""Queries over wiki pages, chapters, registry and quality, with their SQL.

The tables serve as layers: ``chapters`` is bronze, ``silver`` holds parsed chapters,
``mentions``, ``registry``, ``disguises`` and ``redirects`` the entity side. Categories are
made from the types in ``registry`` and ``canon_list``, so that category rules apply.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import wikitext as w
from loreline.functions.categories import category_type
from loreline.operators import mentions as m
from loreline.operators import quality as q
from loreline.operators import registry as r
from loreline.operators import resolve as res
from loreline.operators import silver as s
from loreline.plans.extraction import Extraction, extract_entities
from loreline.plans.sql_pages import ORACLES  # noqa: F401
from loreline.session import table
from loreline.sources.wiki_api import batches

# Stand-ins for what a maintainer keeps by hand.
CATEGORY_OF = {"Character": "Characters", "Place": "Islands", "Group": "Crews", "Ship": "Ships", "Devil Fruit": "Paramecia", "Weapon": "Swords", "Object": "Artifacts", "Unknown": "Terms"}
OVERRIDES = (("Kestrel Bay", "Place"), ("Old Pellam", "Character"), ("Harbor Watch", "Group"))
CONCEPTS = (("Reef Corsairs",), ("Tinder Cove",))
AT = 100  # the chapter of registry_at


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The last written page of each chapter."""
    good = table(spark, d, "chapters").where("number > 0 AND wikitext IS NOT NULL")
    return s.upsert_bronze(good)


def dimensions(spark: SparkSession, d: str) -> res.Dimensions:
    reg, canon = table(spark, d, "registry"), table(spark, d, "canon_list")
    kinds = reg.groupBy("canonical_name").agg(F.max("entity_type").alias("t"))
    lookup = F.create_map(*(F.lit(x) for p in CATEGORY_OF.items() for x in p))
    named = kinds.where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("title"), F.element_at(lookup, F.col("t")).alias("c"))
    apart = canon.where(F.col("canonical_name").contains("/")).select(F.col("canonical_name").alias("title"), F.element_at(lookup, F.col("entity_type")).alias("c"))
    lists = reg.where("catalog IS NOT NULL").select(F.col("catalog").alias("title"), F.lit("Lists").alias("c"))
    cats = named.unionByName(lists).unionByName(apart).where("c IS NOT NULL").groupBy("title").agg(F.array_sort(F.collect_set("c")).alias("categories"))
    red = table(spark, d, "redirects").where("canonical_name IS NOT NULL AND redirect IS NOT NULL").groupBy("redirect").agg(F.min("canonical_name").alias("canonical_name"))
    of = lambda kind: canon.where(F.col("entity_type") == kind).select(F.col("canonical_name").alias("name"))
    fruits = canon.where("entity_type = 'Devil Fruit'").select(F.col("canonical_name").alias("name"), F.concat(F.lit("The "), F.trim("canonical_name"), F.lit(" fruit")).alias("english"), F.col("entry_id").cast("long").alias("pos"))
    return res.Dimensions(
        categories=cats, redirects=red, disguises=disguises(spark, d),
        overrides=spark.createDataFrame(OVERRIDES, "canonical_name string, entity_type string"), concepts=spark.createDataFrame(CONCEPTS, "name string"),
        characters=of("Character"), places=of("Place"), fruits=fruits)


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """(number, wikitext): the pages and, as pages seldom hold such, links to sections,
    subpages and list pages made of the names of registry and canon_list."""
    reg, n = table(spark, d, "registry").where("canonical_name IS NOT NULL"), F.col("canonical_name")
    apart = table(spark, d, "canon_list").where(n.contains("/")).select(F.array(n, F.concat(n, F.lit("#History"))).alias("t"))
    parts = reg.select(F.array(F.concat(n, F.lit("/Early life")), F.concat(n, F.lit("#Abilities"))).alias("t"))
    c = F.col("catalog")
    listed = reg.where("catalog IS NOT NULL").select(F.array(
        c, F.concat(c, F.lit("#"), F.replace(n, F.lit(" "), F.lit("_"))), F.concat(c, F.lit("/Part two#"), n), F.concat(c, F.lit("#Unlisted "), n)).alias("t"))
    made = apart.unionByName(parts).unionByName(listed).select(F.lit(0).alias("number"), F.explode("t").alias("t"))
    return pages(spark, d).select("number", "wikitext").unionByName(made.select("number", F.concat(F.lit("[["), "t", F.lit("]]")).alias("wikitext")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with a name, exact copies once."""
    return table(spark, d, "mentions").where("canonical_name IS NOT NULL AND chapter IS NOT NULL").distinct()


def known(spark: SparkSession, d: str) -> DataFrame:
    """Mentions under the names readers knew: disguises resolved."""
    items = facts(spark, d).select("mention_id", "canonical_name", "alias", "chapter")
    return res.resolve_items(items, res.empty_dimensions(spark, disguises=disguises(spark, d)))


def cast_table(spark: SparkSession, d: str) -> DataFrame:
    """Who appears in silver chapters, exact copies once."""
    once = table(spark, d, "silver").select(F.col("number").alias("chapter"), "arc", "characters").distinct()
    rows = once.select("chapter", F.inline("characters")).where("name IS NOT NULL")
    return rows.select(F.col("name").alias("canonical_name"), "chapter", F.coalesce("on_panel", F.lit(False)).alias("appearance"), F.lit(False).alias("grouped"))


def disguises(spark: SparkSession, d: str) -> DataFrame:
    """Disguises, those not revealed so far (null) included."""
    return table(spark, d, "disguises").distinct()


def types_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registry").where("canonical_name IS NOT NULL").groupBy("canonical_name").agg(F.max("entity_type").alias("entity_type"))


def extraction(spark: SparkSession, d: str) -> Extraction:
    return extract_entities(pages(spark, d), dimensions(spark, d))


# -- pages ----------------------------------------------------------------------------------------


def upsert_bronze(spark, d):
    return pages(spark, d).select("number", "revid", "timestamp", "line_no", F.md5("wikitext").alias("digest"))


def incremental_skip(spark, d):
    return s.incremental_skip(pages(spark, d), table(spark, d, "state")).select("number", "revid")


def batch_titles(spark, d):
    return batches(pages(spark, d).select("number")).select("batch", F.array_join("titles", "|").alias("titles"))


def section(spark, d):
    t = F.col("wikitext")
    return pages(spark, d).select("number", *(w.section(t, h).alias(h.split()[0].lower()) for h in ("Short Summary", "Long Summary", "Characters")))


def links(spark, d):
    return res.page_links(pages(spark, d)).select("number", F.col("pos").cast("long").alias("pos"), "target", "label")


def canonical_name(spark, d):
    t = res.page_links(pages(spark, d)).select("target").distinct()
    return t.select("target", w.canonical_name(F.col("target")).alias("canonical_name"), w.page_title(F.col("target")).alias("page_title"))


def scenes(spark, d):
    return m.scenes_of(pages(spark, d)).select("chapter", F.col("scene").cast("long").alias("scene"), "text")


def scenes_per_chapter(spark, d):
    p = pages(spark, d)
    return q.scenes_per_chapter(p, m.scenes_of(p))


def parse_chapter(spark, d):
    c = s.parse_chapters(pages(spark, d))
    return c.select("number", "title", "jname", "arc", "revision_id", "revised_at", "short_summary", F.array_join("notes", "\n").alias("notes"), "complete", F.length("long_summary").cast("long").alias("size"))


def strip_markup(spark, d):
    return pages(spark, d).select("number", w.strip_markup(w.section(F.col("wikitext"), "Long Summary")).alias("text"))


def parse_characters(spark, d):
    c = s.parse_chapters(pages(spark, d))
    rows = c.select("number", F.posexplode("characters").alias("pos", "c"))
    return rows.select("number", F.col("c.name").alias("name"), F.col("c.faction").alias("faction"), F.col("c.on_panel").alias("on_panel"), F.array_join("c.annotations", "|").alias("annotations"), F.col("c.label").alias("label"))


def parse_groups(spark, d):
    rows = m.cast_rows(pages(spark, d)).where("grouped")
    return rows.select(F.col("chapter").alias("number"), F.col("target").alias("faction"))


def name_tokens(spark, d):
    names = table(spark, d, "canon_list").select("entry_id", F.explode(w.name_tokens(F.col("canonical_name"))).alias("token"))
    return names


def word_count(spark, d):
    once = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return once.select("doc_id", w.word_count(F.col("text")).cast("long").alias("words"))


def dataset_names(spark, d):
    """Names and epithets of every entry as data sets write them: 'A (x) [C]', 'A [C]' or ' A '."""
    n, kind = F.col("canonical_name"), F.col("entity_type")
    epithet = F.concat(F.lit(" ["), kind, F.lit("]"))
    raw = F.when(kind == "Character", F.concat(n, F.lit(" (x)"), epithet)).when(kind == "Place", F.concat(n, epithet)).otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    main, epithets = w.dataset_names(raw)
    return table(spark, d, "canon_list").select("entry_id", F.array_join(F.array_sort(main), "|").alias("names"), F.array_join(epithets, "|").alias("epithets"))


# -- links and names --------------------------------------------------------------------------------


def parts_of_pages(spark, d):
    return res.parts_of_pages(linked_pages(spark, d))


def link_target(spark, d):
    p, dim = linked_pages(spark, d), dimensions(spark, d)
    targets = res.page_links(p).select("target").distinct()
    return res.link_targets(targets, dim.categories, res.catalogs(res.parts_of_pages(p), dim.categories))


def link_mentions(spark, d):
    p, dim = pages(spark, d), dimensions(spark, d)
    sc = m.scenes_of(p)
    targets = res.link_targets(sc.select(F.explode(w.links(F.col("text"))).alias("l")).select("l.target"), dim.categories, res.catalogs(res.parts_of_pages(p), dim.categories))
    return m.link_mentions(sc, targets, dim.common_words).groupBy("chapter", "canonical_name", "alias").agg(F.count(F.lit(1)).alias("n"))


def cast(spark, d):
    p, dim = pages(spark, d), dimensions(spark, d)
    rows = m.cast_rows(p)
    targets = res.link_targets(rows.select("target"), dim.categories, res.catalogs(res.parts_of_pages(p), dim.categories))
    return m.cast(rows, targets).select("chapter", "canonical_name", "appearance", "grouped", "alias")


def category_types(spark, d):
    c = dimensions(spark, d).categories
    return c.select("title", category_type(F.col("categories")).alias("entity_type"))


def lexicon_types(spark, d):
    """Types of names and of epithets: every character carries its first word as one."""
    dim = dimensions(spark, d)
    named = F.concat("name", F.lit(" ["), F.split("name", " ")[0], F.lit("]"))
    return res.lexicon_types(replace(dim, characters=dim.characters.select(named.alias("name"))))


def keep(spark, d):
    names = table(spark, d, "mentions").where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name"))
    return res.keep_names(names, dimensions(spark, d))


def excluded_names(spark, d):
    dim = dimensions(spark, d)
    names = table(spark, d, "mentions").where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name"))
    gone = res.keep_names(names, dim).where("excluded").select("name")
    return q.excluded_names(gone, dim.categories).select("canonical_name", F.array_join("categories", "|").alias("categories"))


def resolve_disguise(spark, d):
    items = facts(spark, d).select("mention_id", "canonical_name", "alias", "chapter")
    dim = res.empty_dimensions(spark, disguises=disguises(spark, d))
    return res.resolve_items(items, dim).select("mention_id", "canonical_name", "alias")


def resolve_redirect(spark, d):
    red = table(spark, d, "redirects").where("redirect IS NOT NULL").select(F.col("redirect").alias("canonical_name"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("chapter"), "redirect_id").distinct()
    dim = res.empty_dimensions(spark, redirects=dimensions(spark, d).redirects)
    return res.resolve_items(red, dim).select("redirect_id", "canonical_name", "alias")


def resolve_english(spark, d):
    dim = dimensions(spark, d)
    items = dim.fruits.select("english", F.col("english").alias("canonical_name"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("chapter")).distinct()
    return res.resolve_items(items, res.empty_dimensions(spark, fruits=dim.fruits)).select("english", "canonical_name")


def resolve_all(spark, d):
    """Redirect, English name and disguise in one go."""
    dim, none = dimensions(spark, d), F.lit(None).cast("string").alias("alias")
    items = facts(spark, d).select(F.col("mention_id").alias("id"), F.lit("m").alias("kind"), "canonical_name", "alias", "chapter")
    red = table(spark, d, "redirects").where("redirect IS NOT NULL").select("redirect_id", "redirect").distinct()
    items = items.unionByName(red.select(F.col("redirect_id").alias("id"), F.lit("r").alias("kind"), F.col("redirect").alias("canonical_name"), none, F.lit(1).alias("chapter")))
    items = items.unionByName(dim.fruits.select(F.col("pos").alias("id"), F.lit("e").alias("kind"), F.col("english").alias("canonical_name"), F.lit("Fruit").alias("alias"), F.lit(1).alias("chapter")))
    return res.resolve_items(items, dim).select("id", "kind", "canonical_name", "alias")


def entity_types(spark, d):
    entry = table(spark, d, "registry").where("catalog IS NOT NULL").groupBy("canonical_name").agg(F.min("catalog").alias("catalog"))
    return res.entity_types(facts(spark, d).select("canonical_name"), dimensions(spark, d), entry)


def entry_catalogs(spark, d):
    return facts(spark, d).where("catalog IS NOT NULL").groupBy("canonical_name").agg(F.min("catalog").alias("catalog"))


def pages_without_categories(spark, d):
    entries = entry_catalogs(spark, d)
    return res.pages_without_categories(res.parts_of_pages(linked_pages(spark, d)), entries, dimensions(spark, d).categories)


# -- registry ------------------------------------------------------------------------------------------


def alias_first_use(spark, d):
    return m.alias_first_use(facts(spark, d))


def disguise_alias_date(spark, d):
    return m.with_disguises(m.alias_first_use(known(spark, d)), disguises(spark, d))


def mention_steps(spark, d):
    return r.mention_steps(known(spark, d), cast_table(spark, d))


def disguise_merge(spark, d):
    return r.disguise_merge(r.mention_steps(known(spark, d)), disguises(spark, d))


def registry(spark, d):
    return r.registry(r.mention_steps(known(spark, d), cast_table(spark, d)), disguises(spark, d))


def registry_at(spark, d):
    return r.registry_at(registry(spark, d), AT)


def aliases_asof(spark, d):
    f = known(spark, d)
    rows = r.mention_steps(f).select("canonical_name", F.col("chapter").alias("valid_from"))
    return r.aliases_asof(rows, m.with_disguises(m.alias_first_use(f), disguises(spark, d))).select("canonical_name", "valid_from", F.array_join("aliases", "|").alias("aliases"))


def registry_from_pages(spark, d):
    out = extraction(spark, d).registry()
    return out.withColumn("aliases", F.array_join("aliases", "|"))


def quality_from_pages(spark, d):
    return extraction(spark, d).quality().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def alias_match(spark, d):
    return extraction(spark, d).mentions.where("source = 'alias_match'").groupBy("chapter", "canonical_name", "surface").agg(F.count(F.lit(1)).alias("n"))


def disguise_candidates(spark, d):
    return extraction(spark, d).disguise_candidates()


# -- quality -------------------------------------------------------------------------------------------


def mention_totals(spark, d):
    return q.mention_totals(facts(spark, d))


def mentions_by_source(spark, d):
    return q.mentions_by_source(facts(spark, d))


def unknown_mention_share(spark, d):
    return q.unknown_mention_share(facts(spark, d), types_table(spark, d)).select(F.round("share", 6).alias("share"))


def top_entities(spark, d):
    return q.top_entities(q.mention_totals(facts(spark, d)), types_table(spark, d))


def unknown_entities(spark, d):
    return q.unknown_entities(q.mention_totals(facts(spark, d)), types_table(spark, d))


def recall_proxy(spark, d):
    arcs = table(spark, d, "silver").groupBy(F.col("number").alias("chapter")).agg(F.coalesce(F.min("arc"), F.lit(w.UNKNOWN_ARC)).alias("arc"))
    return q.recall_proxy(cast_table(spark, d), facts(spark, d), arcs).select("arc", F.round("recall", 6).alias("recall"), "appearances")


def precision_proxy(spark, d):
    return q.precision_proxy(q.checked_matches(facts(spark, d), cast_table(spark, d))).select(F.round("precision", 6).alias("precision"))


def suspicious_aliases(spark, d):
    return q.suspicious_aliases(q.checked_matches(facts(spark, d), cast_table(spark, d)))


# -- checks ----------------------------------------------------------------------------------------------


def validate_rows(spark, d):
    return s.validate_rows(table(spark, d, "chapters"))


def validate_bronze(spark, d):
    """Every line as JSON, in eight forms by turns: as it is, with a mistyped field, with
    nulls written out, as an array, broken."""
    c = table(spark, d, "chapters")
    fields = ("number", "revid", "timestamp", "wikitext")

    def line(**other):
        return F.to_json(F.struct(*(other.get(f, F.col(f)).alias(f) for f in fields)))

    def typed(name, value):
        return line(**{name: F.when(F.col(name).isNotNull(), value)})

    forms = [
        line(), typed("number", F.col("number").cast("string")), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("[1, 2]"), line().substr(F.lit(1), F.length(line()) - 1),
        typed("revid", F.col("revid") > 0), typed("wikitext", F.lit(0.5)), typed("timestamp", F.lit(20260101))]
    turn = F.pmod("line_no", F.lit(len(forms)))
    value = F.coalesce(*(F.when(turn == i, f) for i, f in enumerate(forms)))
    return s.validate_bronze(c.select("line_no", value.alias("value"))).select("line_no", "error")


def bronze_duplicates(spark, d):
    return s.bronze_duplicates(table(spark, d, "chapters"))


def silver_files(spark, d) -> DataFrame:
    once = table(spark, d, "silver").dropDuplicates(["number"])
    return once.select(F.format_string("chapter_%04d.md", "number").alias("file_name"), s.render_markdown().alias("value"))


def render_markdown(spark, d):
    """The whole file of every chapter, and apart its front matter as far as the SQL has it."""
    return silver_files(spark, d).select("file_name", F.regexp_extract("value", r"(?s)^(---\n.*?)\nsource: ", 1).alias("head"), "value")


def validate_silver(spark, d):
    return s.validate_silver(silver_files(spark, d))


def check_files(spark, d):
    return s.check_files(silver_files(spark, d)).select("file_name", "number", F.array_join("problems", "; ").alias("problems"), F.col("words").cast("long").alias("words"))


def last_chapter(spark: SparkSession, d: str) -> int:
    """The greatest number that bronze has a line of: chapters 1 to this one are expected."""
    return table(spark, d, "chapters").where("number > 0").agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first().n


def missing_chapters(spark, d):
    return s.missing_chapters(table(spark, d, "silver").select("number").distinct(), last_chapter(spark, d))


def word_stats(spark, d):
    once = table(spark, d, "silver").select("number", "long_summary").distinct()
    return s.word_stats(once.select(w.word_count(F.col("long_summary")).cast("long").alias("words")))


def gate(spark, d):
    return s.gate(s.check_files(silver_files(spark, d)), last_chapter(spark, d))


_ALL = (
    upsert_bronze, incremental_skip, batch_titles, section, links, canonical_name, scenes, scenes_per_chapter, parse_chapter, strip_markup, parse_characters, parse_groups,
    name_tokens, word_count, dataset_names, parts_of_pages, link_target, link_mentions, cast, category_types, lexicon_types, keep, excluded_names, resolve_disguise, resolve_redirect,
    resolve_english, resolve_all,
    entity_types, entry_catalogs, pages_without_categories, alias_first_use, disguise_alias_date, mention_steps, disguise_merge, registry, registry_at, aliases_asof,
    registry_from_pages, quality_from_pages, alias_match, disguise_candidates, mention_totals, mentions_by_source, unknown_mention_share, top_entities, unknown_entities,
    recall_proxy, precision_proxy, suspicious_aliases, validate_rows, validate_bronze, bronze_duplicates, render_markdown, validate_silver, check_files, missing_chapters,
    word_stats, gate,
)
QUERIES = {f.__name__: f for f in _ALL}


