"""Mixing sources to target shares of all tokens.

Each source's documents, in pseudorandom order, are one stream of tokens cut into blocks
of a fixed length. The output's slots are dealt to shards, and every shard draws its
counts by source from a multinomial under the condition that the totals come out: the
totals are split down a binary tree over the shards, each split an exact draw without
replacement whose seed is its node, so that every shard finds its own counts and first
slots alone. A source's slots run through pseudorandom permutations of its block indices,
one a pass, and slots meet blocks in a join by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SLOTS_PER_SHARD = 4096
TREE = 2**28  # slots that one tree of draws deals; more are cut into equal trees first
PER_BUCKET = 100_000


def token_blocks(sizes: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(source, block, doc_id, start, stop): which tokens of which documents make a block.

    sizes: (doc_id, source, tokens). Running sums are taken in two levels, over buckets and
    within them, so a large source is not one task.
    """
    n = max(1, sizes.count() // PER_BUCKET)
    at = F.xxhash64("doc_id", F.lit(seed))
    rows = sizes.where("source IS NOT NULL").select("doc_id", "source", "tokens", at.alias("h"), F.pmod(at, F.lit(n)).alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "bucket"])
    placed = placed.select("source", "doc_id", "tokens", (F.col("base") + F.col("before")).alias("o"))
    first, last = F.floor(F.col("o") / block), F.floor((F.col("o") + F.col("tokens") - 1) / block)
    spread = placed.select("source", "doc_id", "tokens", "o", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("o"))
    stop = F.least(F.col("tokens"), (F.col("block") + 1) * block - F.col("o"))
    return spread.select("source", "block", "doc_id", start.alias("start"), stop.alias("stop"))


def slot_totals(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, block: int = BLOCK) -> dict[str, int]:
    """Slots of each source, so that its tokens are its share of ``total`` as nearly as
    whole blocks and max_repeats allow.

    A slot counts as the source's mean tokens a block, as its last block may be short.
    Without ``total``, as many tokens as let every source that has any reach its share.
    With more, what the repeats of a source do not allow goes to the others by weight, so
    the shares stay as near to the targets as they can.
    """
    weight = {s: w for s, (w, r) in targets.items() if w > 0 and r > 0 and tokens.get(s, 0) > 0}
    if not weight:
        return {}
    blocks = {s: -(-tokens[s] // block) for s in weight}
    cap = {s: tokens[s] * targets[s][1] for s in weight}
    whole = sum(weight.values())
    total = min(cap[s] * whole / weight[s] for s in weight) if total is None else min(total, sum(cap.values()))
    fixed: dict[str, float] = {}
    while True:
        rest, free = total - sum(fixed.values()), {s: w for s, w in weight.items() if s not in fixed}
        over = [s for s, w in free.items() if rest * w / sum(free.values()) > cap[s] * (1 + 1e-12)]
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    wanted = fixed | {s: rest * w / sum(free.values()) for s, w in free.items()}
    return {s: min(round(wanted[s] * blocks[s] / tokens[s]), blocks[s] * targets[s][1]) for s in weight}


# -- draws ---------------------------------------------------------------------------------


def trees(totals: dict[str, int]) -> tuple[int, int]:
    """(trees, most shards of one): how ``totals`` are cut before any draw."""
    slots = sum(totals.values())
    n = max(1, -(-slots // TREE))
    return n, -(-max((sum(_share(t, n, g) for t in totals.values()) for g in {0, n - 1}), default=0) // SLOTS_PER_SHARD) + 1


def _share(total: int, n: int, g: int) -> int:
    return total * (g + 1) // n - total * g // n


@lru_cache(maxsize=4096)
def _split(counts: tuple[int, ...], left: int, key: tuple[int, ...]) -> tuple[int, ...]:
    """How many of each source go to the ``left`` slots of a node, drawn without replacement."""
    rng, out = np.random.default_rng(key), []
    rest = sum(counts)
    for k in counts:
        rest -= k
        got = int(rng.hypergeometric(k, rest, left)) if left and k else 0
        out.append(got)
        left -= got
    return tuple(out)


def shard_draw(totals: tuple[int, ...], n: int, g: int, j: int, per_shard: int, seed: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(first slot, slots) of each source in shard ``j`` of tree ``g`` of ``n``."""
    first = tuple(t * g // n for t in totals)
    counts = tuple(_share(t, n, g) for t in totals)
    lo, hi = 0, -(-sum(counts) // per_shard)
    if j >= hi:
        return first, tuple(0 for _ in totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(counts, (mid - lo) * per_shard, (seed, g, lo, hi))
        if j < mid:
            hi, counts = mid, left
        else:
            first, counts, lo = tuple(a + b for a, b in zip(first, left)), tuple(a - b for a, b in zip(counts, left)), mid
    return first, counts


def shard_draws(spark, totals: dict[str, int], per_shard: int = SLOTS_PER_SHARD, seed: int = 11) -> DataFrame:
    """(shard, source, a, n): first slot and slots of every source in every shard, drawn
    where the shard is; nothing but the totals by source comes from the driver."""
    names, counts = tuple(sorted(totals)), tuple(totals[s] for s in sorted(totals))
    n, most = trees(totals)
    most = max(most, -(-(max(sum(_share(t, n, g) for t in counts) for g in {0, n - 1}) if counts else 0) // per_shard) + 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard in b["id"].tolist():
                first, got = shard_draw(counts, n, shard // most, shard % most, per_shard, seed)
                out += [(shard, s, a, k) for s, a, k in zip(names, first, got) if k]
            yield pd.DataFrame(out, columns=["shard", "source", "a", "n"])

    return spark.range(n * most).mapInPandas(draw, "shard long, source string, a long, n long")


def permuted(k: Column, n: Column, key: Column) -> Column:
    """Place of ``k`` in a pseudorandom permutation of 0..n-1 that ``key`` picks: a Feistel
    network over the next power of four, walked until it falls inside."""

    @F.pandas_udf("long")
    def walk(k: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        x, size, salt = k.to_numpy(np.uint64), n.to_numpy(np.uint64), key.to_numpy(np.int64).view(np.uint64)
        if not len(x):
            return pd.Series([], dtype="int64")
        half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2)).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        todo = np.ones(len(x), dtype=bool)
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for r in range(4):
                mixed = (right + salt[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((mixed >> np.uint64(32)) & mask[todo])
            x[todo] = (left << half[todo]) | right
            todo = x >= size
        return pd.Series(x.astype("int64"))

    return walk(k, n, key)


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(shard, place, source, block, pass_no, doc_id, start, stop): the mixed selection.

    sizes: (doc_id, source, tokens); targets: (source, weight, max_repeats). Rows of one
    (shard, place) make a block and belong together; ``pass_no`` counts how often the
    block came before. Sources without a target, with weight or repeats of 0 or null, or
    without documents do not occur; repeated target rows count once. total: tokens wanted;
    by default as many as all shares can be reached with.
    """
    spark = sizes.sparkSession
    parts = token_blocks(sizes, block, seed)
    # A row a target source comes to the driver: its weight, its repeats and its tokens.
    have = {r.source: r.n for r in sizes.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("n")).join(targets.select("source").distinct(), "source").collect()}
    wanted = {r.source: (r.weight or 0.0, r.max_repeats or 0) for r in targets.where("source IS NOT NULL").distinct().collect()}
    totals = slot_totals(have, wanted, total, block)
    blocks = spark.createDataFrame([(s, -(-have[s] // block)) for s in totals], "source string, blocks long")
    drawn = shard_draws(spark, totals, seed=seed).join(F.broadcast(blocks), "source")
    k = F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("k")
    filled = drawn.select("shard", "source", "blocks", k)
    nth = F.floor(F.col("k") / F.col("blocks"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64("source", nth, F.lit(seed)))
    filled = filled.select("shard", F.xxhash64("shard", "source", "k", F.lit(seed)).alias("place"), "source", nth.alias("pass_no"), index.alias("block"))
    return filled.join(parts, ["source", "block"]).select("shard", "place", "source", "block", "pass_no", "doc_id", "start", "stop")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, tokens, share, documents, most_passes) for every target source."""
    by_doc = mixed.groupBy("source", "doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("tokens"), (F.max("pass_no") + 1).alias("passes"))
    got = by_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("passes").alias("most_passes"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    out = targets.distinct().join(got, "source", "left").join(F.broadcast(whole))
    return out.select("source", "weight", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)), 6).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"))
