"""Attributes as known at event time.

Each attribute keeps a change history of its own, (entity, at, value) rows only where it
changes. Probes (entity, at) meet each history in a last-known match of their own; the
matches, one narrow row per probe and attribute, are pivoted back to one row per probe. No
table of versions with all attributes is ever built, so attributes may change at
different times.

Time is cut into blocks. A history gives each block its changes, at most ``block`` of
them, and the value carried into it. Probes are shuffled once, by entity and block; every
match and the pivot run on that one partitioning. A pair of entity and block with more
than ``per_part`` probes is split in parts by a hash of the probe, and its few changes are
repeated for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.session import materialise

BLOCK = 512
PER_PART = 1 << 20
MOST_HOT = 10_000


def change_history(timeline: DataFrame, entity: str, at: str, value: Column) -> DataFrame:
    """(entity, at, value) with rows only where ``value`` differs from the one before.

    timeline: one row per entity and time at which anything may have changed.
    """
    rows = timeline.select(F.col(entity).alias("entity"), F.col(at).alias("at"), value.alias("value"))
    w = Window.partitionBy("entity").orderBy("at")
    same = F.lag("value").over(w).eqNullSafe(F.col("value")) & (F.row_number().over(w) > 1)
    return rows.withColumn("_same", same).where("NOT _same").drop("_same")


def last_known(histories: dict[str, DataFrame], probes: DataFrame, block: int = BLOCK, per_part: int = PER_PART) -> DataFrame:
    """The distinct rows of ``probes`` with one more column per attribute.

    histories: attribute -> (entity, at, value), at most one row per entity and time, so
    an entity's history is bounded by the times there are; a null value says the attribute
    is unknown from then on. probes: entity, at and any other columns but those of the
    attributes and block, part. Probes before the first change get null, a change at the
    very time of a probe counts. Probes with a null entity or time, and histories without
    rows, give nulls.
    """
    own = probes.columns
    clash = ({"block", "part", "_n", *histories} & set(own)) | ({"entity", "at", "block", "part"} & set(histories))
    if clash:
        raise ValueError(f"column names taken: {sorted(clash)}")
    bucket = F.floor(F.col("at") / F.lit(block)).cast("long")
    asked = probes.where("entity IS NOT NULL AND at IS NOT NULL").withColumn("block", bucket).where("block IS NOT NULL")
    wanted = materialise(asked.groupBy("entity", "block").agg(F.count(F.lit(1)).alias("_n")), "wanted")
    total = wanted.agg(F.sum("_n").alias("n")).first().n or 0
    size = max(per_part, total // MOST_HOT)  # at most MOST_HOT pairs can hold more than this
    hot = wanted.where(F.col("_n") > size).select("entity", "block", F.ceil(F.col("_n") / size).alias("_parts"))
    keys = ["entity", "block"]
    if hot.limit(1).count():
        keys.append("part")
        asked = asked.join(F.broadcast(hot), ["entity", "block"], "left")
        asked = asked.withColumn("part", F.pmod(F.xxhash64(*own), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    asked = asked.repartition(*keys)
    types = {n: dict(h.dtypes)["value"] for n, h in histories.items()}
    matches = [asked.select(*own, *keys[1:], *(F.lit(None).cast(t).alias(n) for n, t in types.items()))]
    for name, history in histories.items():
        held = _held_by_block(history, wanted, bucket, size if "part" in keys else None)
        last = F.coalesce(F.try_element_at(F.filter("changes", lambda c: c["at"] <= F.col("at")), F.lit(-1)), F.col("carried"))
        met = asked.join(held, keys).select(*own, *keys[1:], *((last["value"] if n == name else F.lit(None).cast(t)).alias(n) for n, t in types.items()))
        matches.append(met.where(F.col(name).isNotNull()))
    long = reduce(DataFrame.unionByName, matches)
    wide = long.groupBy(*own, *keys[1:]).agg(*(F.max(n).alias(n) for n in histories)).select(*own, *histories)
    rest = probes.where("entity IS NULL OR at IS NULL").distinct().select(*own, *(F.lit(None).cast(t).alias(n) for n, t in types.items()))
    return wide.unionByName(rest)


def _held_by_block(history: DataFrame, wanted: DataFrame, bucket: Column, per_part: int | None) -> DataFrame:
    """(entity, block, changes, carried) for the wanted blocks, with ``per_part`` once for
    each part: a block's changes in order and the last change before it."""
    change = F.struct(F.col("at").cast("long").alias("at"), "value")
    rows = history.where("entity IS NOT NULL AND at IS NOT NULL").select("entity", bucket.alias("block"), change.alias("c"), F.lit(None).cast("long").alias("_n"))
    blank = F.lit(None).cast(dict(rows.dtypes)["c"])
    # A change history comes out of a window by entity; with the wanted blocks brought to the
    # same partitioning the union keeps it, and what follows shuffles nothing.
    both = rows.unionByName(wanted.select("entity", "block", blank.alias("c"), "_n").repartition("entity"))
    blocks = both.groupBy("entity", "block").agg(F.sort_array(F.collect_list("c")).alias("changes"), F.max("_n").alias("_n"))
    before = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.when(F.size("changes") > 0, F.element_at("changes", -1))
    out = blocks.withColumn("carried", F.last(newest, ignorenulls=True).over(before)).where("_n IS NOT NULL AND (size(changes) > 0 OR carried IS NOT NULL)")
    if per_part is None:
        return out.select("entity", "block", "changes", "carried")
    parts = F.when(F.col("_n") > per_part, F.ceil(F.col("_n") / per_part)).otherwise(F.lit(1).cast("long"))
    return out.select("entity", "block", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "changes", "carried")
