"""What a reader knew of an entity at a chapter: name, and registry version in force."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.operators.asof import change_history, last_known
from loreline.session import materialise

ATTRIBUTES = ("valid_from", "entity_type", "aliases")


def version_timeline(registry: DataFrame) -> DataFrame:
    """(canonical_name, at, valid_from): the version in force from chapter ``at`` on.

    In force at t is the version with the greatest valid_from <= t whose valid_to is null
    or >= t; valid_from is null where none is. Versions may overlap, be left open or leave
    gaps. Repeated rows count once; of several rows for one name and valid_from the one
    that holds longest counts. Rows without name or valid_from are left out.

    Versions stream through in key order. The open ones are held on a stack from which
    every version that a later one outlasts is taken, so it holds nested versions only.
    """
    last = F.max(F.coalesce(F.col("valid_to").cast("long"), F.lit(2**62))).alias("valid_to")
    versions = registry.where("canonical_name IS NOT NULL AND valid_from IS NOT NULL").groupBy("canonical_name", "valid_from").agg(last)
    versions = versions.repartition("canonical_name").sortWithinPartitions("canonical_name", "valid_from")
    return versions.mapInPandas(_timeline, "canonical_name string, at long, valid_from long")


def _timeline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name: str | None = None
    stack: list[tuple[int, int]] = []  # (valid_from, valid_to), valid_to falling upwards

    def expire(out: list, before: int) -> None:
        """Emit what happens at the ends of versions that end before ``before``."""
        while stack and stack[-1][1] + 1 < before:
            end = stack.pop()[1] + 1
            out.append((name, end, stack[-1][0] if stack else None))

    for batch in batches:
        out: list[tuple] = []
        for who, start, end in zip(batch["canonical_name"], batch["valid_from"], batch["valid_to"]):
            if who != name:
                expire(out, 2**61)
                name, stack = who, []
            if end < start:
                continue
            expire(out, start)
            while stack and stack[-1][1] <= end:
                stack.pop()
            stack.append((start, end))
            out.append((name, start, start))
        yield _frame(out)
    out = []
    expire(out, 2**61)
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["canonical_name", "at", "valid_from"])
    return out.astype({"at": "int64", "valid_from": "Int64"})


def attribute_histories(registry: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> dict[str, DataFrame]:
    """One change history (entity, at, value) per attribute of the version in force."""
    line = version_timeline(registry)
    rest = [a for a in attributes if a != "valid_from"]
    if rest:
        facts = registry.groupBy("canonical_name", F.col("valid_from").cast("long").alias("valid_from")).agg(*(F.min(a).alias(a) for a in rest))
        line = line.join(facts, ["canonical_name", "valid_from"], "left")
    line = materialise(line, "timeline")
    return {a: change_history(line, "canonical_name", "at", F.col(a)) for a in attributes}


def known_mentions(mentions: DataFrame, registry: DataFrame, disguises: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Every mention with the name known at its chapter and the attributes in force then.

    Columns: mention_id, canonical_name, chapter, known_name, registered (is
    canonical_name in the registry), latest (greatest valid_from of known_name) and the
    attributes, null where nothing is known. The known name is the alias where (name,
    alias) is a disguise whose revelation is null or later than the chapter. Mentions that
    repeat a row come out once; null names or chapters match nothing. Empty tables give no
    rows (mentions) or no attributes. Other columns are ignored.
    """
    names = registry.where("canonical_name IS NOT NULL AND valid_from IS NOT NULL").groupBy("canonical_name").agg(F.max("valid_from").cast("long").alias("latest"))
    masks = (
        disguises.where("alias IS NOT NULL AND canonical_name IS NOT NULL")
        .groupBy("alias", "canonical_name").agg(F.max(F.coalesce(F.col("revelation"), F.lit(2**31 - 1))).alias("until"))
        .join(names.select("canonical_name", F.lit(True).alias("real_registered")), "canonical_name", "left")
    )
    m = mentions.select("mention_id", "canonical_name", "chapter", "alias").join(masks, ["canonical_name", "alias"], "left")
    masked = F.coalesce(F.col("chapter") < F.col("until"), F.lit(False))
    probes = m.select(
        F.when(masked, F.col("alias")).otherwise(F.col("canonical_name")).alias("entity"), F.col("chapter").cast("long").alias("at"),
        "mention_id", F.when(masked, F.col("canonical_name")).alias("real_name"),
        F.when(masked, F.coalesce("real_registered", F.lit(False))).alias("real_registered"),
    )
    always = F.lit(-(2**40)).cast("long").alias("at")
    ever = names.select(F.col("canonical_name").alias("entity"), always, F.col("latest").alias("value"))
    got = last_known(attribute_histories(registry, attributes) | {"latest": ever}, probes)
    registered = F.coalesce("real_registered", F.col("latest").isNotNull())
    return got.select(
        "mention_id", F.coalesce("real_name", "entity").alias("canonical_name"), F.col("entity").alias("known_name"), F.col("at").alias("chapter"),
        registered.alias("registered"), "latest", *attributes)
