import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loreline.llm import mixing
from loreline.llm.packing import SumOfSquares, fill_rates, pack
from loreline.llm.tokens import document_sizes

ITEMS = "item long, tokens long"


def check(rows, items, capacity):
    """Every token of every item once, nothing split that fits, no container too full."""
    whole, box = Counter(), Counter()
    for r in rows:
        whole[r.item] += r.tokens
        box[r.container] += r.tokens
    assert whole == Counter({i: n for i, n in items if n and n > 0}) and max(box.values(), default=0) <= capacity
    parts = Counter(r.item for r in rows)
    assert all(parts[i] == -(-n // capacity) for i, n in items if n and n > 0)
    return box


@pytest.mark.parametrize(("capacity", "per_shard"), [(100, 10_000), (100, 50), (37, 90)])
def test_all_items_whole_and_no_container_too_full(spark, capacity, per_shard):
    r = random.Random(3)
    items = [(i, r.choice([r.randint(1, 40), r.randint(1, 250)])) for i in range(600)] + [(900, 0)]
    df = spark.createDataFrame(items, ITEMS).withColumn("container", F.lit("clash"))
    rows = pack(df, capacity, per_shard).collect()
    box = check(rows, items, capacity)
    assert sum(box.values()) / (len(box) * capacity) > 0.93
    again = pack(df.orderBy(F.desc("item")), capacity, per_shard).collect()
    assert {(x.item, x.part, x.container) for x in rows} == {(x.item, x.part, x.container) for x in again}


def test_items_over_half_a_container_never_meet_in_one_task(spark):
    items = [(i, 60) for i in range(2000)]
    rows = pack(spark.createDataFrame(items, ITEMS), 100, per_shard=100).collect()
    assert len(check(rows, items, 100)) == 2000
    shards = Counter(r.container.rsplit("-", 1)[0] for r in rows)
    assert max(shards.values()) < 200 and len(shards) == 20


def test_sum_of_squares_is_the_rule():
    r, capacity = random.Random(5), 23
    state, gaps = SumOfSquares(capacity), {}
    for _ in range(300):
        size = r.randint(1, capacity)
        before = Counter(g for g in gaps.values() if g)
        cost = lambda old, new: sum(n * n for n in (before + Counter([new]) - Counter([old] if old else [])).values()) - (0 if new else (before + Counter([0]) - before)[0] and 1)
        squares = {old: sum(n * n for g, n in (before - Counter([old]) + (Counter([old - size]) if old > size else Counter())).items()) for old in before if old >= size}
        fresh = sum(n * n for n in (before + (Counter([capacity - size]) if size < capacity else Counter())).values())
        box = state.place(size)
        got = squares[gaps[box]] if box in gaps else fresh
        assert got == min([fresh, *squares.values()])
        gaps[box] = gaps.get(box, capacity) - size
    assert cost


def test_empty_and_bad_input(spark):
    assert pack(spark.createDataFrame([], ITEMS), 10).count() == 0
    assert pack(spark.createDataFrame([(None, 3), (1, None), (2, 0)], ITEMS), 10).count() == 0
    assert fill_rates(pack(spark.createDataFrame([], ITEMS), 10), 10).first().fill is None
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], ITEMS), 0)


def test_sizes_count_repeats_once_and_leave_blank_texts_out(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (4, "x " * 3000, None), (None, "x", "s")]
    got = {r.doc_id: r.tokens for r in document_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == {1, 4} and got[1] == 3


# -- mixing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_shard", [16, 100, 4096])
def test_draws_add_up_and_slots_are_used_once(spark, per_shard):
    totals = {"a": 1000, "b": 0, "c": 37, "d": 5000}
    rows = mixing.shard_draws(spark, totals, per_shard).collect()
    used = {s: sorted(x for r in rows if r.source == s for x in range(r.a, r.a + r.n)) for s in totals}
    assert used == {s: list(range(n)) for s, n in totals.items()}
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n
    assert max(sizes.values()) <= per_shard and len(sizes) == -(-6037 // per_shard)


def test_more_slots_than_a_tree(monkeypatch, spark):
    monkeypatch.setattr(mixing, "TREE", 500)
    totals = {"a": 1001, "b": 399}
    n, _ = mixing.trees(totals)
    assert n == 3
    rows = mixing.shard_draws(spark, totals, 64).collect()
    for s, t in totals.items():
        assert sorted(x for r in rows if r.source == s for x in range(r.a, r.a + r.n)) == list(range(t))


def test_counts_vary_as_a_multinomial(spark):
    rows = mixing.shard_draws(spark, {"a": 20_000, "b": 20_000}, 100).where("source = 'a'").collect()
    n = [r.n for r in rows]
    mean = sum(n) / len(n)
    spread = sum((x - mean) ** 2 for x in n) / len(n)
    assert abs(mean - 50) < 0.01 and 18 < spread < 33  # 100 draws of one in two: 25


SIZES, TARGETS = "doc_id long, source string, tokens long", "source string, weight double, max_repeats int"


def mixed(spark, total=None):
    r = random.Random(2)
    docs = [(i, s, r.randint(5, 900)) for i, s in enumerate(["big"] * 300 + ["mid"] * 120 + ["small"] * 30 + ["unwanted"] * 40)] + [(999, None, 50)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("small", 0.2, 4), ("absent", 0.1, 3), ("unwanted", None, 2)]
    a, b = spark.createDataFrame(docs, SIZES), spark.createDataFrame(targets, TARGETS)
    return docs, b, mixing.mix(a, b, total)


def test_shares_are_reached_and_repeats_kept(spark):
    docs, targets, got = mixed(spark)
    rows = got.collect()
    assert {r.source for r in rows} == {"big", "mid", "small"}
    use, size = Counter(), {i: n for i, _, n in docs}
    for r in rows:
        assert 0 <= r.start < r.stop <= size[r.doc_id]
        for x in range(r.start, r.stop, 1):
            use[r.doc_id, x] += 1
    limit = {"big": 1, "mid": 2, "small": 4}
    source = {i: s for i, s, _ in docs}
    assert all(n <= limit[source[i]] for (i, _), n in use.items())
    shares = {r.source: r.share for r in mixing.reached_shares(got, targets).collect()}
    assert abs(shares["big"] - 0.5) < 0.01 and abs(shares["mid"] - 0.3) < 0.01 and abs(shares["small"] - 0.2) < 0.01
    assert shares["absent"] == shares["unwanted"] == 0.0


def test_blocks_hold_every_token_of_a_source_once(spark):
    sizes = spark.createDataFrame([(i, "s", 1 + i * 37 % 700) for i in range(80)], SIZES)
    rows = mixing.token_blocks(sizes, 64).collect()
    per = Counter()
    for r in rows:
        per[r.block] += r.stop - r.start
    assert sum(per.values()) == sum(1 + i * 37 % 700 for i in range(80)) and set(list(per.values())) - {64} <= {per[max(per)]}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SIZES)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(none, targets).count() == 0 and mixing.mix(none, targets.limit(0)).count() == 0
    assert mixing.slot_totals({}, {"a": (1.0, 1)}) == {}
