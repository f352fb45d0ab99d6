"""From pages to registry and quality report, on invented pages worked out by hand."""

import pytest

from loreline.operators import resolve as res
from loreline.plans.extraction import extract_entities

CATEGORIES = {
    "Sea Beasts": ["Animal Species", "Lists"], "Gull Post": ["Animal Species", "Lists"], "Fleet Ranks": ["Lists", "Occupations"], "Blue Ape": ["Animal Species Subpages"],
    "Salt Kingdom": ["Kingdoms"], "Salt": ["Kingdoms"], "Doctor Vane/Lilac": ["Characters"], "Old Fleet": ["Fleets"], "Admiral": ["Positions"], "Doctor Vane": ["Characters"],
}


def page(number, summary, characters="", notes=""):
    return number, f"==Long Summary==\n{summary}\n==Quick References==\n===Chapter Notes===\n{notes}\n===Characters===\n{characters}\n==Site Navigation==\n{{{{Tide Arc}}}}\n"


def extract(spark, *pages, **dims):
    frame = spark.createDataFrame(list(pages), "number int, wikitext string")
    make = {
        "categories": lambda x: spark.createDataFrame(list(x.items()), "title string, categories array<string>"),
        "characters": lambda x: spark.createDataFrame([(n,) for n in x], "name string"), "places": lambda x: spark.createDataFrame([(n,) for n in x], "name string"),
        "fruits": lambda x: spark.createDataFrame([(n, e, i) for i, (n, e) in enumerate(x)], "name string, english string, pos long"),
        "redirects": lambda x: spark.createDataFrame(list(x.items()), "redirect string, canonical_name string"),
        "disguises": lambda x: spark.createDataFrame(x, "alias string, canonical_name string, revelation int"),
    }
    return extract_entities(frame, res.empty_dimensions(spark, **{k: make[k](v) for k, v in dims.items()}), cut_lineage=True)


@pytest.fixture(scope="module")
def at(spark):
    def rows(out, t):
        held = out.registry().where(f"valid_from <= {t} AND (valid_to IS NULL OR valid_to >= {t})")
        return {r.canonical_name: r for r in held.collect()}

    return rows


def test_catalog_entries_subpages_and_titles(spark, at):
    out = extract(
        spark,
        page(1, "[[Ann Lee|Ann]] flees a [[Sea Beasts/Salt Saga#Bananafish|Bananafish]] as a [[Sea Beasts#Gull Post|Gull Post]] lands.", "! [[Sea Beasts|Animals]]\n*[[Sea Beasts/Salt Saga#Bananafish|Bananafish]]"),
        page(2, "The [[Bananafish]] eats a [[Sea Beasts|fish]] and an [[Fleet Ranks#Ensign|ensign]] meets [[Doctor Vane/Lilac|Lilac]]. Lilac agrees."),
        page(3, "In [[Salt Kingdom|Salt]], [[Sea Beasts/Salt Saga#Salt|camels]] rest near a [[Sea Beasts/War#Blue Ape|Blue Ape]] and [[Doctor Vane/Inventions|a thing]]."),
        categories=CATEGORIES)
    one, two, three = at(out, 1), at(out, 2), at(out, 3)
    assert (one["Bananafish"].entity_type, one["Bananafish"].catalog) == ("Object", "Sea Beasts")
    assert (two["Bananafish"].first_chapter_seen, two["Bananafish"].last_chapter_seen, two["Bananafish"].mention_count) == (1, 2, 2)
    assert one["Gull Post"].catalog == "Sea Beasts" and "Sea Beasts" not in three and not {"Ensign", "Fleet Ranks", "Salt"} & set(three)
    assert three["Blue Ape"].catalog == "Sea Beasts" and three["Salt Kingdom"].catalog is None
    lilac = two["Doctor Vane/Lilac"]
    assert (lilac.entity_type, lilac.mention_count, lilac.aliases) == ("Character", 2, ["Lilac"])
    assert "Doctor Vane/Inventions" not in three and three["Doctor Vane"].aliases == []
    missing = {r.name for r in out.pages_without_categories().collect()}
    assert "Bananafish" in missing and not {"Blue Ape", "Ensign"} & missing


def test_alias_matches_are_dated_case_sensitive_and_of_linked_entities(spark, at):
    out = extract(
        spark, page(1, "[[Edward Gale]] watches. White Gale shouts, Edward Gale's men run."),
        page(2, "[[Edward Gale|White Gale]] returns. The White Gale roars, white gale; Edward Gale sleeps. WhiteGale no. White Gale’s coat."),
        page(3, "White Gale is named without a link."), characters=["Edward Gale [White Gale]"])
    assert at(out, 1)["Edward Gale"].mention_count == 2
    assert at(out, 2)["Edward Gale"].mention_count == 2 + 4
    assert at(out, 3)["Edward Gale"].mention_count == 6
    assert {r.source: r.n for r in out.mentions.groupBy("source").count().withColumnRenamed("count", "n").collect()} == {"link": 2, "alias_match": 4}


def test_a_form_of_two_entities_is_nobodys_and_the_longest_form_wins(spark):
    out = extract(spark, page(1, "[[Ann Lee|Red]] and [[Bob Ray|Red]] meet. Red smiles. [[Ann]] waits; Ann Lee waves."))
    got = sorted((r.canonical_name, r.surface) for r in out.mentions.where("source = 'alias_match'").collect())
    assert got == [("Ann Lee", "Ann Lee")]


def test_types_of_data_sets_epithets_and_english_names(spark, at):
    out = extract(
        spark, page(1, "[[Queen]] and [[Bentham]] at [[Sphinx]] in [[Dawn Isle]] by [[Tofu no Mi]]."), page(2, "He ate the [[Tofu Fruit]]. [[Admiral|The Admiral]] saw it."),
        characters=["Scien [Queen]", "Bentham (Bon) [Mr]", "Sphinx"], places=["Sphinx", "Dawn Isle"], fruits=[(" Tofu no Mi (Awake)", "Tofu Fruit")], categories=CATEGORIES)
    got = {n: r.entity_type for n, r in at(out, 2).items()}
    assert got == {"Queen": "Character", "Bentham": "Character", "Sphinx": "Unknown", "Dawn Isle": "Place", "Tofu no Mi": "Devil Fruit"}
    assert at(out, 2)["Tofu no Mi"].mention_count == 2
    assert [r.name for r in out.excluded.collect()] == ["Admiral"]


def test_redirects_and_disguises_to_their_revelation(spark, at):
    out = extract(
        spark, page(1, "[[Ann Lee|Mask]] hides. Mask runs."), page(4, "[[Ann L]] is Mask: [[Ann Lee|Mask]] bows."), page(6, "[[Bob Ray|Hood]] sings."),
        redirects={"Ann L": "Ann Lee"}, disguises=[("Mask", "Ann Lee", 4), ("Hood", "Bob Ray", None)])
    one, four, six = at(out, 1), at(out, 4), at(out, 6)
    assert "Ann Lee" not in one and (one["Mask"].mention_count, one["Mask"].entity_type, one["Mask"].valid_to) == (2, "Character", 3)
    assert "Mask" not in four and four["Ann Lee"].mention_count == 2 + 1 + 2 and four["Ann Lee"].first_chapter_seen == 1
    assert four["Ann Lee"].aliases == ["Ann L", "Mask"] and "Hood" in six and "Bob Ray" not in six


def test_disguise_candidates_and_quality(spark):
    out = extract(
        spark, page(1, "[[Ann Lee|Red]] and [[Ann Lee|Miss Lee]] and [[Grey Port|Home]]. Red laughs.", "*[[Ann Lee]]\n*[[Cid]] ''(cover)''"), page(2, "[[Ann Lee|Red]]. Red leaves.", "*[[Bob Ray]]"))
    assert [tuple(r) for r in out.disguise_candidates().collect()] == [("Red", "Ann Lee", 2, 1, 2, None)]
    q = out.quality().first()
    assert q.mentions_by_source == {"alias_match": 2, "link": 4} and q.scenes_per_chapter == {1: 1, 2: 1}
    assert q.recall_proxy == 0.5 and q.recall_proxy_per_arc == {"Tide Arc": 0.5} and q.precision_proxy == 0.5
    assert [(s.alias, s.canonical_name, s.matches, s.outside_cast) for s in q.suspicious_aliases] == [("Red", "Ann Lee", 2, 1)]
    assert q.unknown_mention_share == 1.0 and [e.canonical_name for e in q.unknown_entities][:1] == ["Ann Lee"]


def test_no_pages(spark):
    out = extract(spark, page(1, ""))
    assert out.registry().count() == 0 and out.quality().first().mentions_by_source == {"alias_match": 0, "link": 0}
