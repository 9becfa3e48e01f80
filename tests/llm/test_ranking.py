"""Rank aggregation against brute force, with groups cut in slices and without."""

import random

import pytest

from quillon.llm import ranking as r

SCORES = {"a": True, "b": False}
SCHEMA = "q string, i int, a double, b double, position string"


def rows(seed, n=120):
    rng = random.Random(seed)
    value = lambda: rng.choice((None, float("nan"), 1.0, 2.0, rng.gauss(0, 10**6)))
    out = [(rng.choice(("x", "y", None)), i, value(), value(), "clash") for i in range(n)]
    return out + out[:10]


def brute(data):
    groups = {}
    for q, i, a, b, _ in set(map(lambda x: (x[0], x[1], None if x[2] != x[2] else x[2], None if x[3] != x[3] else x[3], 0), data)):
        groups.setdefault(q, {})[i] = (a, b)
    out = {}
    for q, items in groups.items():
        for i, own in items.items():
            norm = []
            for k, up in enumerate((True, False)):
                if own[k] is None:
                    continue
                have = [v[k] for v in items.values() if v[k] is not None]
                better = sum((x > own[k]) if up else (x < own[k]) for x in have)
                norm.append((better + (have.count(own[k]) + 1) / 2) / len(have))
            norm.sort()
            if len(norm) == 2:
                rho = 2 * min(1, 2 * norm[0] * (1 - norm[0]) + norm[0] ** 2, norm[1] ** 2)
            else:
                rho = norm[0] if norm else 1.0
            out[q, i] = (round(rho, 12), round(sum(norm) / len(norm) if norm else 2.0, 12), i)
    places = {}
    for q in groups:
        for n, (_, i) in enumerate(sorted((v, k[1]) for k, v in out.items() if k[0] == q), 1):
            places[q, i] = (min(1.0, out[q, i][0]), n)
    return places


@pytest.mark.parametrize("limit", [20_000, 5])
def test_against_brute_force(spark, make, monkeypatch, limit):
    monkeypatch.setattr(r, "GROUP_ROWS", limit)
    monkeypatch.setattr(r, "SLICES", 8)
    data = rows(limit)
    got = {(x.q, x.i): (x.significance, x.position) for x in r.aggregate_ranks(make(data, SCHEMA), ["q"], "i", SCORES).collect()}
    want = brute(data)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-9)
        assert got[k][1] == want[k][1], k


def test_beaten_and_empty(spark, make):
    df = make([("q", i, float(i), float(-i), "") for i in range(10)], SCHEMA)
    got = {x.i: x for x in r.aggregate_ranks(df, ["q"], "i", SCORES).collect()}
    assert got[9].position == 1 and got[9].a_beaten == got[9].b_beaten == 9 and got[0].position == 10
    assert r.aggregate_ranks(df.limit(0), ["q"], "i", SCORES).count() == 0
    one = r.aggregate_ranks(df.limit(1), ["q"], "i", SCORES).first()
    assert one.position == 1 and one.significance == 1.0
