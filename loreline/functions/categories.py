"""Entity types out of wiki categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
ENTITY_TYPES = ("Character", "Group", "Place", "Ship", "Devil Fruit", "Weapon", "Object", UNKNOWN)
LISTS, TERMS, TITLES = "Lists", "Terms", ("Positions", "Occupations")
# Categories that give a type, the first rule that fits holds.
RULES = (
    ("Devil Fruit", r"^(Paramecia|Zoan|Logia|Mythical Zoan|Ancient Zoan|Shown Devil Fruits)$|\bDevil Fruits\b"),
    ("Ship", r"\bShips\b"),
    ("Weapon", r"\b(Swords|Blades|Weapons|Polearms|Guns)\b"),
    ("Place", r"(Locations|Islands|Kingdoms|Towns and Cities|Villages|Landmarks|Buildings|Castles|Prisons|Oceans|Bases|Bars and Restaurants|Seas|Territories|Regions)$"),
    ("Character", r"Characters$|^Characters Aged|^Humans$|Users$|Swordsmen$|^Talking Animals$|^Children$|(Captains|Officers|Ministers|Prisoners|Slaves|Residents|Cooks|Staff|Antagonists|Hybrids)$"),
    ("Group", r"(Groups|Crews|Fleets|Families|Regimes|Organizations|Alliance|Military Forces)$"),
    ("Object", r"(Technology|Artifacts|Literature|Substances|Minerals|Animal Species|Vehicles|Sea Trains|By-Products|Plants|Creations)$"),
)
# Words an alias does not begin with.
COMMON_WORDS = (
    "a an the this that these those some any every each all both another other such he she it they we you i him her them us me "
    "his hers its their theirs our your my who whom whose what which there here"
).split()


def category_type(categories: Column) -> Column:
    """Type by the first rule that any category fits; null if none does or there are none."""
    def fits(pattern: str) -> Column:
        return F.exists(categories, lambda c: c.rlike(pattern))

    return reduce(lambda rest, rule: F.when(fits(rule[1]), rule[0]).otherwise(rest), reversed(RULES), F.lit(None).cast("string"))


def is_catalog_entry(categories: Column) -> Column:
    """May a section of that name be an entry: it has no page, or one within the catalog."""
    c = F.coalesce(categories, F.array().cast("array<string>"))
    return (F.size(c) == 0) | F.array_contains(c, LISTS) | F.exists(c, lambda x: x.endswith("Subpages"))


def excluded_by_category(categories: Column) -> Column:
    """Is it a title or notion, never an entity?"""
    c = F.coalesce(categories, F.array().cast("array<string>"))
    titles = F.arrays_overlap(c, F.array(*map(F.lit, TITLES)))
    return titles | (F.array_contains(c, TERMS) & ~category_type(c).eqNullSafe(F.lit("Group")))
