"""Filling containers of fixed capacity by the sum-of-squares rule.

Each document goes where the sum over gaps of the squared number of open containers with
that gap becomes smallest. Documents are dealt to shards by hash and every shard is packed
in one stream that holds counts by gap only. Containers that a shard leaves with much room
are opened and their documents packed again in as many shards as they need, until they
fit in one shard or packing them again no longer closes half of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.session import materialise

PER_SHARD = 50_000  # items a shard is to hold
ROOM = 0.02  # a container with a larger part unused is packed again while that helps
_ROWS = "item long, part int, tokens long, level int, shard long, container long, room long"


class SumOfSquares:
    """Open containers by gap, and the choice of the next place."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.open: dict[int, list[int]] = {}
        self.gaps: list[int] = []  # gaps that open containers have, rising

    def place(self, size: int) -> int:
        """Container for an item of ``size`` (1 to capacity). Ties: the tightest place, a
        new container last."""
        cap, boxes, gaps = self.capacity, self.open, self.gaps
        best, least = None, None
        for i in range(bisect_left(gaps, size), len(gaps)):
            gap = gaps[i]
            left = boxes.get(gap - size)
            cost = (2 * (len(left) if left else 0) + 1 if gap > size else 0) - 2 * len(boxes[gap]) + 1
            if least is None or cost < least:
                best, least = gap, cost
        fresh = boxes.get(cap - size)
        new = (2 * (len(fresh) if fresh else 0) + 1) if size < cap else 0
        if best is None or least > new:
            box, rest = self.made, cap - size
            self.made += 1
        else:
            box, rest = boxes[best].pop(), best - size
            if not boxes[best]:
                del boxes[best]
                del gaps[bisect_left(gaps, best)]
        if rest:
            if rest in boxes:
                boxes[rest].append(box)
            else:
                boxes[rest] = [box]
                insort(gaps, rest)
        return box

    def leftovers(self) -> Iterator[tuple[int, int]]:
        """(container, room) of every container not full."""
        for gap in self.gaps:
            for box in self.open[gap]:
                yield box, gap


def _pack(capacity: int, level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Items in, placements out; after a shard a row (item null) for each container with room."""
    columns = [c.split()[0] for c in _ROWS.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"item": "Int64", "part": "Int32", "tokens": "Int64", "room": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, SumOfSquares(capacity)
        for b in batches:
            out: list[tuple] = []
            for item, part, tokens, shard in zip(b["item"], b["part"], b["tokens"], b["shard"]):
                if shard != now:
                    if now is not None:
                        out.extend((None, None, None, level, now, box, room) for box, room in state.leftovers())
                    now, state = shard, SumOfSquares(capacity)
                out.append((item, part, tokens, level, shard, state.place(int(tokens)), None))
            yield frame(out)
        if now is not None:
            yield frame([(None, None, None, level, now, box, room) for box, room in state.leftovers()])

    return run


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(item, part, tokens): items cut only where they exceed the capacity, into full parts
    and a rest. Part n holds the tokens from n * capacity on."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    parts = sizes.select("item", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select("item", "part", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part").cast("long") * capacity).alias("tokens"))


def pack(sizes: DataFrame, capacity: int, per_shard: int = PER_SHARD) -> DataFrame:
    """(item, part, tokens, container): every item of ``sizes`` (item, tokens) in a container.

    No container holds more than ``capacity``; items without tokens or with null keys are
    left out, ids must be distinct. A level deals its items to shards of about
    ``per_shard``, whatever is left, so no task grows with the input; levels end when one
    shard held all, or when over half of a level's items came out in containers with room
    (as when every item is larger than half a container), since another deal of like
    items would do no better. Each level has at most half the items of the one before.
    The result is the same for the same items in any order and for any loss of executors.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    todo = pieces(sizes.where("item IS NOT NULL AND tokens > 0"), capacity)
    count, level, done = todo.count(), 0, []
    while True:
        shards = max(1, -(-count // per_shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("item", "part", F.lit(level)), F.lit(shards)))
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("item", "part"), "item", "part")
        placed = materialise(dealt.mapInPandas(_pack(capacity, level), _ROWS), "packed")
        items = placed.where("item IS NOT NULL")
        if shards == 1:
            done.append(items)
            break
        loose = placed.where(F.col("item").isNull() & (F.col("room") > int(ROOM * capacity))).select("shard", "container")
        again = materialise(items.join(loose, ["shard", "container"], "left_semi").select("item", "part", "tokens"), "loose")
        left = again.count()
        if 2 * left > count or not left:
            done.append(items)
            break
        done.append(items.join(loose, ["shard", "container"], "left_anti"))
        todo, count, level = again, left, level + 1
    name = F.concat_ws("-", "level", "shard", "container").alias("container")
    whole = None
    for d in done:
        part = d.select("item", "part", "tokens", name)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def fill_rates(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill): how full the containers are on the whole."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.try_divide(F.sum("tokens"), F.count(F.lit(1)) * capacity), 6).alias("fill"))
