import pytest

from loreline.operators import resolve as res
from loreline.plans.queries_pages import QUERIES

MENTIONS = "mention_id long, canonical_name string, chapter int, alias string, source string, surface string, catalog string"
REGISTRY = "canonical_name string, entity_type string, catalog string, aliases array<string>, valid_from int, valid_to int"
DISGUISES = "alias string, canonical_name string, revelation int"


@pytest.fixture
def d(tables):
    from test_check_files import SILVER, row

    mentions = [
        (1, "Ann", 3, "Mask", "link", None, None), (2, "Ann", 90, "Mask", "link", None, None), (3, "Ann", 5, "Annie", "link", None, None),
        (4, "Bob", 3, "Hood", "link", None, None), (5, "Bob", 7, "Hood", "link", None, None),
    ]
    return tables(
        mentions=(mentions, MENTIONS), disguises=([("Mask", "Ann", None), ("Mask", "Ann", None), ("Hood", "Bob", 7)], DISGUISES), silver=([row(3)], SILVER),
        registry=([("Ann", "Character", None, None, 3, None)], REGISTRY))


def rows(spark, name, d):
    return sorted(tuple(r) for r in QUERIES[name](spark, d).collect())


def test_a_disguise_not_revealed_hides_at_every_chapter(spark, d):
    assert rows(spark, "resolve_disguise", d) == [(1, "Mask", None), (2, "Mask", None), (3, "Ann", "Annie"), (4, "Hood", None), (5, "Bob", "Hood")]


def test_its_steps_stay_under_the_alias_and_are_not_merged(spark, d):
    assert rows(spark, "mention_steps", d) == [("Ann", 3, 0), ("Ann", 5, 1), ("Bob", 7, 1), ("Hood", 3, 1), ("Mask", 3, 1), ("Mask", 90, 1)]
    assert rows(spark, "disguise_merge", d) == [("Bob", 7, 1, 3, 3)]
    got = [r for r in rows(spark, "registry", d) if r[0] in ("Mask", "Hood")]
    assert got == [("Hood", 3, 6, 3, 3, 1), ("Mask", 3, 89, 3, 3, 1), ("Mask", 90, None, 3, 90, 2)]
    assert [r for r in rows(spark, "registry_at", d) if r[0] != "Bob"] == [("Ann", 5, None, 3, 5, 1), ("Mask", 90, None, 3, 90, 2)]


def test_it_is_no_alias_of_its_entity(spark, d):
    assert rows(spark, "disguise_alias_date", d) == [("Ann", "Annie", 5), ("Bob", "Hood", 7)]
    assert rows(spark, "aliases_asof", d) == [("Ann", 5, "Annie"), ("Bob", 7, "Hood"), ("Hood", 3, ""), ("Mask", 3, ""), ("Mask", 90, "")]


def test_it_is_a_character(spark):
    names = spark.createDataFrame([("Mask",), ("Rock",)], "canonical_name string")
    dim = res.empty_dimensions(spark, disguises=spark.createDataFrame([("Mask", "Ann", None)], DISGUISES))
    got = res.entity_types(names, dim, spark.createDataFrame([], "canonical_name string, catalog string")).collect()
    assert sorted(map(tuple, got)) == [("Mask", "Character"), ("Rock", "Unknown")]
