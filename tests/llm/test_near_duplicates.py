"""Near-duplicates against brute force, with hot groups, and the parts on their own."""

import random

import numpy as np
import pytest

from quillon.llm import near_duplicates as n


def words(rng, k):
    return "".join(chr(0x4E00 + rng.randrange(3000)) if rng.random() < 0.5 else rng.choice("abcdefgh 123，。\n") for _ in range(k))


def edited(rng, t, share):
    t = list(t)
    for _ in range(int(len(t) * share)):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice(([], ["X"], [t[i], "Y"]))
    return "".join(t)


def corpus(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(150, 700)) for _ in range(60)]
    rows = [(f"a{i:03}", t) for i, t in enumerate(base)]
    for k in range(60):
        rows.append((f"b{k:03}", edited(rng, rng.choice(base), rng.choice((0.005, 0.02, 0.04)))))
    moved = base[0][len(base[0]) // 2 :] + base[0][: len(base[0]) // 2]
    rows += [("m", moved), ("up", base[1].upper()), ("sp", " ".join(base[2])), ("null", None), ("blank", " "), ("short", base[3][:90]), (None, base[4]), ("a000", base[0])]
    rows += [(f"h{k:03}", base[5]) for k in range(40)] + [(f"g{k:03}", edited(rng, base[6], 0.004)) for k in range(40)]
    return rows


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def brute(rows):
    texts = {i: n.normal(t) for i, t in rows if i is not None and n.normal(t)}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items()}
    ids = sorted(sets)
    out = {}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.7 * (len(sets[i]) + len(sets[j]) - both):
                out[i, j] = (both / (len(sets[i]) + len(sets[j]) - both), frozenset((texts[i], texts[j])))
    return out


@pytest.mark.parametrize("block", [64, 4])
def test_pairs_and_groups(spark, make, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "PARTNERS", block)
    rows = corpus(block)
    df = make([(i, t, "clash", "clash") for i, t in rows], "id string, t string, c string, key string")
    got = {(r.id_a, r.id_b) for r in n.near_duplicate_pairs(df, "id", "t").collect()}
    want = brute(rows)
    assert not got - set(want)
    lost = {want[p][1] for p in set(want) - got}  # different texts; copies are lost with them
    assert all(want[p][0] < 0.8 for p in set(want) - got)
    assert len(lost) <= 0.03 * len({v[1] for v in want.values()}), sorted(set(want) - got)[:5]
    groups = {r.id: r for r in n.near_duplicate_groups(df, "id", "t").collect()}
    assert set(groups) == {i for i, _ in rows if i}
    assert all(groups[a]["class"] == groups[b]["class"] for a, b in got)
    assert groups["short"]["class"] is None and groups["null"].links == 0 and groups["h000"].copies >= 41


def test_empty(spark, make):
    df = make([], "id string, t string")
    assert n.near_duplicate_pairs(df, "id", "t").count() == 0 and n.near_duplicate_groups(df, "id", "t").count() == 0


def test_components(spark, make):
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 101), (7, 3)]
    got = {r.node: r.root for r in n.components(make(edges, "a long, b long")).collect()}
    assert got == {**{i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_banded_distance():
    rng = random.Random(3)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    pairs = [(t := "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80))), edited(rng, t, 0.1) or "z") for _ in range(80)]
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    exact = [full(a, b) for a, b in pairs]
    assert n.banded_distances([code(a) for a, _ in pairs], [code(b) for _, b in pairs], np.full(80, 99)).tolist() == exact
    low = n.banded_distances([code(a) for a, _ in pairs], [code(b) for _, b in pairs], np.full(80, 3)).tolist()
    assert low == [d if d <= 3 else -1 for d in exact]


def test_verified_by_alignment_then_exactly():
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = words(rng, rng.randrange(100, 500)).replace("\n", "")
        kind = rng.randrange(5)
        if kind == 0:
            b = edited(rng, a, rng.choice((0.01, 0.03, 0.06)))
        elif kind == 1:
            i, k = rng.randrange(len(a)), rng.randrange(1, 200)
            b = a[:i] + words(rng, k) + a[i:]
        elif kind == 2:
            i, k = rng.randrange(len(a)), rng.randrange(1, 60)
            b = a[:i] + a[i + k :]
        elif kind == 3:
            i = rng.randrange(len(a))
            b = a[i:] + a[:i]
        else:
            b = rng.choice((a, words(rng, len(a)), a[:5] * 30, a * 2))
        pairs.append((a, b))
    pairs += [("abcde" * 40, "abcde" * 60), ("x" * 200, "x" * 150), ("x" * 200, "y" * 200), ("𠀀" * 120 + "a" * 60, "a" * 60 + "𠀀" * 120)]
    similar, bound, certified = n.verified([a for a, _ in pairs], [b for _, b in pairs])
    assert similar.tolist() == [jaccard(a, b) >= 0.7 for a, b in pairs]
    assert not (certified & ~similar).any() and certified.sum() > 0.5 * similar.sum()
    assert n._similar(__import__("pyarrow").array([], "string"), __import__("pyarrow").array([], "string")).to_pylist() == []


def test_order_counts_in_ordered_sketches():
    rng = random.Random(5)
    a = words(rng, 600)
    moved = a[300:] + a[:300]
    keys, owner = n.sketches([a, moved, edited(rng, a, 0.01)])
    of = [set(keys[owner == i].tolist()) for i in range(3)]
    assert 0 < len(of[0] & of[1]) < len(of[0] & of[2])


def test_moved_parts_share_a_sketch():
    def moved(rng, size=600, part=60):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size))
        parts = [a[i : i + part] for i in range(0, size, part)]
        rng.shuffle(parts)
        b = "".join(parts)
        while True:
            i = rng.randrange(size)
            c = b[:i] + "#" + b[i + 1 :]
            if jaccard(a, c) < 0.76:
                return a, b
            b = c

    rng = random.Random(11)
    keys, owners = n.sketches([t for _ in range(150) for t in moved(rng)])
    held = [set() for _ in range(300)]
    for key, owner in zip(keys.tolist(), owners.tolist()):
        held[owner].add(key)
    assert sum(not held[2 * i] & held[2 * i + 1] for i in range(150)) <= 3
