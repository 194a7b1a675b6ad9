import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm.packing import best_fit_decreasing, pack


def brute(sizes, capacity):
    """Best fit decreasing by looking at every bin; the number of bins."""
    rests, full = [], 0
    for s in sizes:
        f, r = divmod(s, capacity) if s > capacity else (0, s)
        full += f
        if r or not f:
            rests.append(r)
    bins = []
    for r in sorted(rests, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= r]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= r
        else:
            bins.append(capacity - r)
    return full + len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 30))
def test_packs_as_brute_force(sizes, capacity):
    pieces = best_fit_decreasing(sizes, capacity)
    load, parts = defaultdict(int), defaultdict(list)
    for p in pieces:
        load[p.container] += p.size
        parts[p.item].append(p)
    assert all(v <= capacity for v in load.values())
    for k, s in enumerate(sizes):
        own = sorted(parts[k], key=lambda p: p.piece)
        assert sum(p.size for p in own) == s and (len(own) == 1 or s > capacity)
        assert [p.start for p in own] == [p.piece * capacity for p in own]
    assert len(load) == brute(sizes, capacity)


SCHEMA = "doc_id long, text string, n_tokens long, shard int, capacity int"


def test_frame(spark):
    rng = random.Random(3)
    rows = [(k, "a b", rng.randrange(0, 700), 1, 1) for k in range(500)] + [(500, "one, two", None, 1, 1), (501, None, None, 1, 1), (502, "", -4, 1, 1), (503, "w " * 30_000, None, 1, 1), (1, "a b", 3, 1, 1), (None, "x", 5, 1, 1), (None, "y", 5, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    packs = spark.createDataFrame([("small", 512), ("small", 512), ("large", 2048), (None, 5), ("bad", 0), ("bad2", None)], "pack_name string, capacity_tokens long")
    out = pack(docs, packs, shard=100).collect()
    for name, capacity in (("small", 512), ("large", 2048)):
        mine = [r for r in out if r.pack_name == name]
        assert {r.doc_id for r in mine} == {r[0] for r in rows}
        load = defaultdict(int)
        for r in mine:
            load[r.container] += r.tokens
        assert max(load.values()) <= capacity
        assert [r.tokens for r in mine if r.doc_id == 500] == [3] and [r.tokens for r in mine if r.doc_id in (501, 502)] == [0, 0]
        assert sum(r.tokens for r in mine if r.doc_id == 503) == 30_000 and sum(r.doc_id is None for r in mine) == 2
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    assert {r.pack_name for r in out} == {"small", "large"}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    packs = spark.createDataFrame([("a", 4)], "pack_name string, capacity_tokens long")
    assert pack(docs, packs).count() == 0
    assert pack(spark.createDataFrame([(1, "x", 1, 1, 1)], SCHEMA), packs.limit(0)).count() == 0


def test_memory_goes_by_rooms_that_occur():
    sizes = [10**9 - 7, 5, 2, 3 * 10**9, 7]
    out = best_fit_decreasing(sizes, 10**9)
    assert sum(p.size for p in out) == sum(sizes) and len({p.container for p in out}) == 5
    assert next(p.container for p in out if p.item == 4) == next(p.container for p in out if p.item == 0)
