"""Packing: capacity, wholeness, tightness against the lower bound, and the edges."""

import math
import random
from collections import Counter

import pytest

from quillon.llm.packing import fill_containers, pack


@pytest.mark.parametrize("seed", range(6))
def test_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice((50, 100, 2048))
    counts = Counter(rng.randrange(1, capacity + 1) if rng.random() < 0.3 else rng.randrange(1, capacity // 3) for _ in range(3000))
    used = Counter()
    for times, bins in pack(dict(counts), capacity):
        assert times > 0 and sum(s * n for s, n in bins.items()) <= capacity
        for s, n in bins.items():
            used[s] += n * times
    assert used == counts


def test_tight():
    rng = random.Random(1)
    counts = Counter(int(min(2047, rng.lognormvariate(5, 1)) + 1) for _ in range(20000))
    total = sum(s * n for s, n in counts.items())
    assert sum(t for t, _ in pack(dict(counts), 2048)) <= math.ceil(total / 2048) * 1.005


def test_two_fit_beats_greedy():
    # greedy takes 6 + 3; the smallest item makes way for 2 + 2
    assert pack({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


def test_containers(spark, make):
    rng = random.Random(2)
    rows = [(i, rng.choice((0, None, 5, 99, 100, 101, 350, rng.randrange(1, 100)))) for i in range(400)] + [(None, 7), (1000, 10**6)]
    got = fill_containers(make(rows, "id long, n long"), 100).collect()
    load, pieces = Counter(), {}
    for r in got:
        load[r.container] += r["size"]
        pieces.setdefault(r.id, []).append(r)
    assert max(load.values()) <= 100 and set(load) == set(range(max(load) + 1))
    for i, n in rows:
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r["size"] for r in own) == (n or 0)
        assert len(own) == max(1, math.ceil((n or 0) / 100)) and [r.start for r in own] == [100 * k for k in range(len(own))]


def test_edges(spark, make):
    assert fill_containers(make([], "id long, n long"), 10).count() == 0
    assert [r.container for r in fill_containers(make([(1, 0), (2, None)], "id long, n long"), 10).collect()] == [0, 0]
    with pytest.raises(ValueError):
        fill_containers(make([(1, 1)], "id long, n long"), 0)


def test_same_size_everywhere(spark, make):
    got = fill_containers(spark.range(1000).selectExpr("id", "4L AS n"), 10).collect()
    assert Counter(Counter(r.container for r in got).values()) == {2: 500}
