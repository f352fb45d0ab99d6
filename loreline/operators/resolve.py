"""What a link names: articles, their parts, catalog entries, redirects and disguises."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import wikitext as w
from loreline.functions.categories import COMMON_WORDS, ENTITY_TYPES, category_type, excluded_by_category, is_catalog_entry
from loreline.functions.dialect import blank_to_null, strip


@dataclass(frozen=True)
class Dimensions:
    """What comes from outside the pages.

    categories: (title, categories); redirects: (redirect, canonical_name); disguises:
    (alias, canonical_name, revelation; null: not revealed so far); overrides: (canonical_name, entity_type);
    concepts: (name); characters, places: (name); fruits: (name, english, pos).
    Keys are distinct; Spark broadcasts a table where its size at run time allows it.
    """

    categories: DataFrame
    redirects: DataFrame
    disguises: DataFrame
    overrides: DataFrame
    concepts: DataFrame
    characters: DataFrame
    places: DataFrame
    fruits: DataFrame
    common_words: tuple[str, ...] = tuple(COMMON_WORDS)


def empty_dimensions(spark: SparkSession, **given: DataFrame) -> Dimensions:
    def none(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema)

    schemas = {
        "categories": "title string, categories array<string>", "redirects": "redirect string, canonical_name string",
        "disguises": "alias string, canonical_name string, revelation int", "overrides": "canonical_name string, entity_type string",
        "concepts": "name string", "characters": "name string", "places": "name string", "fruits": "name string, english string, pos long"}
    return Dimensions(**{k: given.get(k, none(s)) for k, s in schemas.items()}, **({"common_words": given["common_words"]} if "common_words" in given else {}))


def page_links(pages: DataFrame, text: str = "wikitext", keep: tuple[str, ...] = ("number",)) -> DataFrame:
    """(..., pos, target, label): every link of a text column."""
    return pages.select(*keep, F.posexplode(w.links(F.col(text))).alias("pos", "l")).select(*keep, "pos", "l.target", "l.label")


def parts_of_pages(pages: DataFrame) -> DataFrame:
    """(name, kind): pages linked by a section or subpage ('parent'), and such subpages ('subpage')."""
    targets = page_links(pages).select("target").distinct()
    t = F.col("target")
    rows = targets.select(w.canonical_name(t).alias("parent"), w.page_title(F.substring_index(t, "#", 1)).alias("page"), t.contains("#").alias("has"))
    rows = rows.where(F.col("parent").isNotNull() & ((F.col("page") != F.col("parent")) | F.col("has")))
    kinds = F.array(F.struct(F.col("parent").alias("name"), F.lit("parent").alias("kind")), F.when(F.col("page") != F.col("parent"), F.struct(F.col("page").alias("name"), F.lit("subpage").alias("kind"))))
    return rows.select(F.explode(kinds).alias("x")).where("x IS NOT NULL").select("x.name", "x.kind").distinct()


def catalogs(parts: DataFrame, categories: DataFrame) -> DataFrame:
    """(catalog): parents in the category of list pages."""
    lists = categories.where(F.array_contains("categories", "Lists")).select(F.col("title").alias("catalog"))
    return parts.where("kind = 'parent'").select(F.col("name").alias("catalog")).distinct().join(lists, "catalog", "left_semi")


def link_targets(targets: DataFrame, categories: DataFrame, catalog: DataFrame) -> DataFrame:
    """(target, canonical_name, own, catalog) of each distinct target that names an entity.

    Targets are resolved once each and joined back to their links by the caller.
    """
    t = F.col("target")
    rows = targets.select("target").distinct().select(
        "target", w.canonical_name(t).alias("parent"), w.page_title(F.substring_index(t, "#", 1)).alias("page"), t.contains("#").alias("has"),
        strip(F.replace(F.when(t.contains("#"), F.regexp_replace(t, "^[^#]*#", "")).otherwise(F.lit("")), F.lit("_"), F.lit(" "))).alias("entry"))
    rows = rows.where("parent IS NOT NULL")
    rows = rows.join(catalog.select(F.col("catalog").alias("parent"), F.lit(True).alias("listed")), "parent", "left")
    rows = rows.join(categories.select(F.col("title").alias("entry"), F.col("categories").alias("entry_categories")), "entry", "left")
    rows = rows.join(categories.select(F.col("title").alias("page"), category_type(F.col("categories")).alias("page_type")), "page", "left")
    listed = F.coalesce("listed", F.lit(False))
    entry = (F.col("entry") != "") & is_catalog_entry(F.col("entry_categories"))
    apart = (F.col("page") != F.col("parent")) & F.col("page_type").isNotNull()
    name = F.when(listed, F.when(entry, F.col("entry"))).when(apart, F.col("page")).otherwise(F.col("parent"))
    own = F.when(listed, True).when(apart, ~F.col("has")).otherwise((F.col("page") == F.col("parent")) & ~F.col("has"))
    return rows.select("target", name.alias("canonical_name"), own.alias("own"), F.when(listed, F.col("parent")).alias("catalog")).where("canonical_name IS NOT NULL")


def lexicon_types(d: Dimensions) -> DataFrame:
    """(name, entity_type) where exactly one data set claims a name; epithets only where no
    data set has the name as a main one."""
    rows = None
    for table, kind in ((d.characters, "Character"), (d.places, "Place"), (d.fruits, "Devil Fruit")):
        names, epithets = w.dataset_names(F.col("name"))
        both = table.select(F.lit(kind).alias("entity_type"), names.alias("m"), epithets.alias("e"))
        rows = both if rows is None else rows.unionByName(both)
    main = rows.select("entity_type", F.explode("m").alias("name"))
    epithet = rows.select("entity_type", F.explode("e").alias("name")).join(main.select("name").distinct(), "name", "left_anti")

    def single(x: DataFrame) -> DataFrame:
        g = x.groupBy("name").agg(F.min("entity_type").alias("entity_type"), F.max("entity_type").alias("other"))
        return g.where("entity_type = other").select("name", "entity_type")

    return single(main).unionByName(single(epithet.select("entity_type", "name")))


def lexicon_english(d: Dimensions) -> DataFrame:
    """(english, canonical_name): English name to the shortest main name; the later entry wins."""
    names, _ = w.dataset_names(F.col("name"))
    rows = d.fruits.select(blank_to_null(strip(F.col("english"))).alias("english"), "pos", F.explode(names).alias("name")).where("english IS NOT NULL")
    best = rows.groupBy("english", "pos").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))
    return best.groupBy("english").agg(F.max_by("name", "pos").alias("canonical_name"))


def resolve_items(items: DataFrame, d: Dimensions) -> DataFrame:
    """Items (canonical_name, alias, chapter, ...) after redirect, English name and
    disguise, one hop each and in this order. A disguise whose revelation is null is not
    revealed so far and hides at every chapter. Other columns stay."""
    rest = [c for c in items.columns if c not in ("canonical_name", "alias")]
    to = d.redirects.select(F.col("redirect").alias("canonical_name"), F.col("canonical_name").alias("_to"))
    x = items.join(to, "canonical_name", "left")
    x = x.select(*rest, F.coalesce("_to", "canonical_name").alias("canonical_name"), F.when(F.col("_to").isNotNull(), F.coalesce("alias", "canonical_name")).otherwise(F.col("alias")).alias("alias"))
    english = lexicon_english(d).select(F.col("english").alias("canonical_name"), F.col("canonical_name").alias("_to"))
    x = x.join(english, "canonical_name", "left").select(*rest, F.coalesce("_to", "canonical_name").alias("canonical_name"), "alias")
    masks = d.disguises.select("canonical_name", "alias", F.coalesce(F.col("revelation"), F.lit(2**31 - 1)).alias("_until"))
    x = x.join(masks, ["canonical_name", "alias"], "left")
    hidden = F.coalesce(F.col("chapter") < F.col("_until"), F.lit(False))
    return x.select(*rest, F.when(hidden, F.col("alias")).otherwise(F.col("canonical_name")).alias("canonical_name"), F.when(~hidden, F.col("alias")).alias("alias"))


def keep_names(names: DataFrame, d: Dimensions) -> DataFrame:
    """(name, kept, excluded): concepts and names that their categories exclude are not
    kept; a type override saves a name from its categories."""
    rows = names.select("name").distinct()
    rows = rows.join(d.concepts.select("name", F.lit(True).alias("concept")).distinct(), "name", "left")
    rows = rows.join(d.overrides.select(F.col("canonical_name").alias("name"), F.lit(True).alias("override")).distinct(), "name", "left")
    rows = rows.join(d.categories.select(F.col("title").alias("name"), "categories"), "name", "left")
    excluded = F.col("concept").isNull() & F.col("override").isNull() & excluded_by_category(F.col("categories"))
    return rows.select("name", (F.col("concept").isNull() & ~excluded).alias("kept"), excluded.alias("excluded"))


def kept_items(items: DataFrame, d: Dimensions) -> tuple[DataFrame, DataFrame]:
    """(items whose name and catalog are kept, excluded names).

    A catalog counts as met only with an entry that is kept itself.
    """
    names = items.select(F.explode(F.array("canonical_name", "catalog")).alias("name")).where("name IS NOT NULL")
    verdict = keep_names(names, d)
    own = verdict.select(F.col("name").alias("canonical_name"), F.col("kept").alias("_k"), F.col("excluded").alias("_e"))
    cat = verdict.select(F.col("name").alias("catalog"), F.col("kept").alias("_ck"), F.col("excluded").alias("_ce"))
    x = items.join(own, "canonical_name").join(cat, "catalog", "left")
    gone = x.select(F.when(F.col("_e"), F.col("canonical_name")).when(F.col("_k") & F.col("_ce"), F.col("catalog")).alias("name")).where("name IS NOT NULL").distinct()
    return x.where(F.col("_k") & F.coalesce("_ck", F.lit(True))).select(*items.columns), gone


def entity_types(names: DataFrame, d: Dimensions, entry_catalogs: DataFrame) -> DataFrame:
    """(canonical_name, entity_type): override, data set, own categories, its catalog's
    categories, else Unknown; a disguise is a character. An override outside the known
    types is an error."""
    bad = d.overrides.where(~F.col("entity_type").isin(*ENTITY_TYPES)).select("entity_type").limit(3).collect()
    if bad:
        raise ValueError(f"entity types unknown in overrides: {[r.entity_type for r in bad]}")
    n = names.select("canonical_name").distinct()
    n = n.join(d.overrides.select("canonical_name", F.col("entity_type").alias("o")), "canonical_name", "left")
    n = n.join(lexicon_types(d).select(F.col("name").alias("canonical_name"), F.col("entity_type").alias("l")), "canonical_name", "left")
    n = n.join(d.categories.select(F.col("title").alias("canonical_name"), category_type(F.col("categories")).alias("c")), "canonical_name", "left")
    n = n.join(entry_catalogs, "canonical_name", "left")
    n = n.join(d.categories.select(F.col("title").alias("catalog"), category_type(F.col("categories")).alias("k")), "catalog", "left")
    n = n.join(d.disguises.select(F.col("alias").alias("canonical_name"), F.lit("Character").alias("m")).distinct(), "canonical_name", "left")
    return n.select("canonical_name", F.coalesce("m", "o", "l", "c", "k", F.lit("Unknown")).alias("entity_type"))


def pages_without_categories(parts: DataFrame, entry_catalogs: DataFrame, categories: DataFrame) -> DataFrame:
    """(name): pages whose categories decide something and are not known."""
    wanted = parts.select("name").unionByName(entry_catalogs.select(F.col("canonical_name").alias("name"))).distinct()
    return wanted.join(categories.select(F.col("title").alias("name")), "name", "left_anti")
