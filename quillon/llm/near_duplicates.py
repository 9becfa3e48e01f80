"""Near-duplicate texts by Order MinHash with alignment-certified verification.

Candidates: the occurrence-labelled k-mers of a text are dealt to ``SAMPLES`` samples by an independent
hash; of each sample the minima are kept in the order of the text, and the sequence is the sample's
sketch.  Texts that share a sketch are candidates.  A second reading of the samples, with more minima
and without their order, keeps the pairs whose parts were moved.  Verification: pairs are aligned first,
without their common beginning and end, in a band and under the limit that their set sizes give: d edits
touch at most k*d k-mers, and none outside the stretch that differs.  Where that isn't enough, the k-mers
that align within the band are counted.  Both give lower bounds of the similarity and certify most links;
only of the pairs that stay uncertified is the exact Jaccard similarity of the k-mer sets computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import durable, stored

#: Fixed values of the data's statement: substring length, similarity and least length of a text.
K, THRESHOLD, LEAST_CHARS = 5, 0.7, 100
#: Deals and samples a deal; minima kept in order, and kept without order; least k-mers of a sample in use.
DEALS, CLASSES, ORDERED, UNORDERED, LEAST_KMERS = 2, 16, 6, 8, 4
#: Half width of the alignment band, and pairs aligned side by side.
BAND, SIDE_BY_SIDE, ROWS_AT_ONCE = 16, 256, 1 << 16
#: A group's rows are paired in blocks of this many, and a text meets its partners in blocks of so many, so that no task pairs a whole hot group.
BLOCK, PARTNERS = 64, 1024
#: Characters sketched at once, pairs and their characters verified at once, and bits of a hash that give way to a text's number.
SKETCH_CHARS, MOST_AT_ONCE, PAIR_CHARS, _ROOM = 60_000, 2_000, 2_000_000, 12

_PRIME, _A, _B, _C = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _B
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    return h


def kmer_hashes(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Of all k-mers of all texts, in order: hash and text number."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    full = max(0, len(codes) - k + 1)
    h = codes[:full].copy()
    for i in range(1, k):
        h *= _PRIME
        h += codes[i : full + i]
    own = np.ones(full, bool)
    ends = np.cumsum(sizes)
    over = (ends[:, None] - np.arange(1, k)[None, :]).ravel()  # k-mers that would run into the next text
    own[over[(over >= 0) & (over < full)]] = False
    count = np.maximum(sizes - k + 1, 0)
    return _mix(h[own]), np.repeat(np.arange(len(texts), dtype=np.uint64), count)


def _packed(number: np.ndarray, h: np.ndarray, most: int) -> tuple[np.ndarray, np.uint64]:
    """Number (at most ``most``), then the leading bits of a 32-bit hash for which there is room, then the place, sorted; and the place's width."""
    low = len(h).bit_length()
    lead = min(32, 64 - low - most.bit_length())
    return np.sort(number << np.uint64(lead + low) | (h >> np.uint64(32 - lead)) << np.uint64(low) | np.arange(len(h), dtype=np.uint64)), np.uint64(low)


def labelled_kmers(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Of all k-mers of all texts, in order: hash, labelled by how often the k-mer stood in its text before, and text number."""
    h, text = kmer_hashes(texts, k)
    if not len(h):
        return h, text
    packed, low = _packed(text, h >> np.uint64(32), len(texts))
    again = np.flatnonzero(packed[1:] >> low == packed[:-1] >> low) + 1
    if len(again):
        first = np.flatnonzero(np.diff(again, prepend=-1) != 1)
        nth = np.arange(len(again)) - np.repeat(first, np.diff(first, append=len(again))) + 1
        h[(packed[again] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)] += nth.astype(np.uint64) * _C
    return h, text


def sketches(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all samples of all texts and the number of the text each belongs to."""
    label, text = labelled_kmers(texts, k)
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if not len(label):
        return keys[0], owners[0]
    most = max(ORDERED, UNORDERED)
    for deal in range(DEALS):
        g = _mix(label ^ _mix(np.array([deal * 7919 + 1], np.uint64)))
        group = text * np.uint64(CLASSES) + (g & np.uint64(CLASSES - 1))
        packed, low = _packed(group, g >> np.uint64(32), len(texts) * CLASSES)
        place = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        own = group[place]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(starts, append=len(own))
        starts, size = starts[size >= LEAST_KMERS], size[size >= LEAST_KMERS]
        salt = _mix(own[starts] % np.uint64(CLASSES) + np.uint64(1000 * deal + 17))
        owner = (own[starts] // np.uint64(CLASSES)).astype(np.int64)
        held = np.arange(most)[None, :] < size[:, None]
        minima = np.where(held, place[np.minimum(starts[:, None] + np.arange(most)[None, :], len(place) - 1)], len(label))
        padded = np.append(label, np.uint64(0))
        for keep, ordered in ((ORDERED, True), (UNORDERED, False)):
            at = np.sort(minima[:, :keep], axis=1) if ordered else minima[:, :keep]
            terms = padded[at] + ((np.arange(keep, dtype=np.uint64) + np.uint64(1)) * _C if ordered else np.uint64(0))
            key = _mix((_mix(terms) * (at < len(label))).sum(1) + np.uint64(ordered)) ^ salt
            keys.append(key >> np.uint64(8))
            owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], limits: np.ndarray, band: int = BAND) -> np.ndarray:
    """Edit distances of pairs of code arrays as far as the band around the diagonal and the limits reach.

    An upper bound of the distance, exact where the best path keeps to the band; -1 where it is over the
    pair's limit.  Pairs are aligned side by side and dropped once their whole row is over the limit.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, width = int(n.max(initial=0)), 2 * band + 1
    kind, far = (np.int16, 1 << 14) if rows + band < 1 << 13 else (np.int32, 1 << 28)
    left = np.full((rows, len(a)), 0xFFFFFFFF, np.uint32)
    right = np.full((len(a), rows + width + 1), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(zip(a, b)):
        left[: len(x), i] = x
        y = y[: rows + band]
        right[i, band : band + len(y)] = y
    col = np.arange(width, dtype=kind)
    d = np.where(col >= band, col - band, far)[None, :].repeat(len(a), 0).astype(kind)
    out = np.full(len(a), -1, np.int32)
    at = m - n + band
    live = np.flatnonzero((at >= 0) & (at < width) & (limits >= 0))
    left, right, d = left[:, live], right[live], d[live]
    for i in range(rows + 1):
        ended = n[live] == i
        if ended.any():
            own = live[ended]
            got = d[ended, at[own]].astype(np.int32)
            out[own] = np.where(got <= limits[own], got, -1)
        if i % 16 == 0 or ended.any():
            stay = ~ended & (d.min(1, initial=far) <= limits[live])
            if not stay.any():
                break
            if not stay.all():
                live, left, right, d = live[stay], left[:, stay], right[stay], d[stay]
        best = d + (right[:, i : i + width] != left[i][:, None])
        best[:, :-1] = np.minimum(best[:, :-1], d[:, 1:] + 1)
        if i < band:
            best[:, band - i - 1] = i + 1
            best[:, : band - i - 1] = far
        d = np.minimum.accumulate(best - col, axis=1) + col
    return out


def kmer_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted k-mer hashes of each text, once each, end to end, and where each text's begin."""
    h, text = kmer_hashes(texts)
    h >>= np.uint64(_ROOM)
    h |= text << np.uint64(64 - _ROOM)
    h.sort()
    if len(h):
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h & np.uint64((1 << (64 - _ROOM)) - 1), np.searchsorted(h, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(64 - _ROOM))


def shared_kmers(sets: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of text numbers: the size of the intersection of their k-mer sets."""

    def tagged(side: np.ndarray) -> np.ndarray:
        size = starts[side + 1] - starts[side]
        at = np.arange(int(size.sum())) + np.repeat(starts[side] - (np.cumsum(size) - size), size)
        return sets[at] | np.repeat(np.arange(len(side), dtype=np.uint64), size) << np.uint64(64 - _ROOM)

    both = np.concatenate((tagged(left), tagged(right)))
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    return np.bincount((twice >> np.uint64(64 - _ROOM)).astype(np.int64), minlength=len(left))


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two code arrays without their common beginning and end."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    head = int(differ.argmax()) if differ.any() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    tail = int(differ.argmax()) if n and differ.any() else n
    return a[: len(a) - tail], b[: len(b) - tail]


def unaligned_kmers(a: np.ndarray, b: np.ndarray, band: int = BAND) -> int:
    """Places of the first text whose k-mer isn't aligned: that stands in the other text at none of the places within the band
    around the diagonal of both beginnings or of both ends."""
    least = len(a)
    for centre in sorted({0, len(b) - len(a)}):
        lost = 0
        for s in range(0, len(a) - K + 1, ROWS_AT_ONCE):
            own = a[s : s + ROWS_AT_ONCE + K - 1]
            at = np.arange(s + centre - band, s + centre + band + len(own))
            near = np.where((at >= 0) & (at < len(b)), b[np.clip(at, 0, len(b) - 1)], 0xFFFFFFFF)
            same = np.lib.stride_tricks.sliding_window_view(near, 2 * band + 1)[: len(own)] == own[:, None]
            whole = same[: len(own) - K + 1].copy()
            for k in range(1, K):
                whole &= same[k : len(own) - K + 1 + k]
            lost += int((~whole.any(1)).sum())
        least = min(least, lost)
    return least


def verified(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of texts: whether they reach the similarity, the bound of their edit distance (-1: over the limit), and whether
    the alignment certified them.

    Sizes of the k-mer sets bound the similarity from above and set the alignment's limit.  What the edit distance doesn't
    certify, the k-mers that align within the band may; only of the other pairs is the exact similarity computed.
    """
    number = {t: i for i, t in enumerate(dict.fromkeys((*left, *right)))}
    a, b = np.array([number[t] for t in left], np.int64), np.array([number[t] for t in right], np.int64)
    texts = list(number)
    sets, starts = kmer_sets(texts)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.diff(starts)
    most, least, both = np.maximum(size[a], size[b]), np.minimum(size[a], size[b]), size[a] + size[b]
    similar, bound, certified = np.zeros(len(a), bool), np.full(len(a), -1, np.int32), np.zeros(len(a), bool)
    able = np.flatnonzero(least >= THRESHOLD * most)
    if not len(able):
        return similar, bound, certified
    mid = [_trimmed(codes[a[i]], codes[b[i]]) for i in able]
    inner = np.array([[len(x), len(y)] for x, y in mid])
    limits = np.floor((most - THRESHOLD * both / (1 + THRESHOLD))[able] / K).astype(np.int64)
    limits[np.abs(inner[:, 0] - inner[:, 1]) > limits] = -1
    order = np.argsort(inner[:, 0], kind="stable")
    order = order[limits[order] >= 0]
    for s in range(0, len(order), SIDE_BY_SIDE):
        own = order[s : s + SIDE_BY_SIDE]
        bound[able[own]] = banded_distances([mid[i][0] for i in own], [mid[i][1] for i in own], limits[own])
    # k-mers of either text that the alignment leaves untouched: all but K for each edit, or all outside the one stretch that differs
    edits = np.where(bound[able] >= 0, bound[able].astype(np.int64) * K, 1 << 40)
    touched = np.where(inner.max(1)[:, None] > 0, inner + K - 1, 0)
    shared = np.maximum(size[a[able]] - np.minimum(edits, touched[:, 0]), size[b[able]] - np.minimum(edits, touched[:, 1]))
    sure = shared >= THRESHOLD * (both[able] - shared)
    for j in np.flatnonzero(~sure):  # many edits close together, or far ones: count the k-mers that align
        i = able[j]
        got = size[a[i]] - unaligned_kmers(codes[a[i]], codes[b[i]])
        sure[j] = got >= THRESHOLD * (both[i] - got)
    certified[able[sure]] = similar[able[sure]] = True
    rest = able[~sure]
    shared = shared_kmers(sets, starts, a[rest], b[rest])
    similar[rest] = shared >= THRESHOLD * (both[rest] - shared)
    return similar, bound, certified


def _similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Of pairs of texts: whether they reach the similarity, and the bound of the edit distance (null: over the limit)."""
    a, b = left.to_pylist(), right.to_pylist()
    out, at = [], 0
    while at < len(a):
        end, chars = at, 0
        while end < len(a) and end - at < MOST_AT_ONCE and (end == at or chars + len(a[end]) + len(b[end]) <= PAIR_CHARS):
            chars += len(a[end]) + len(b[end])
            end += 1
        out.append(verified(a[at:end], b[at:end])[:2])
        at = end
    similar, bound = (np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in ((0, bool), (1, np.int32)))
    return pa.StructArray.from_arrays([pa.array(similar), pa.array(bound, pa.int32(), mask=bound < 0)], ["similar", "distance"])


def normal(text: str | None) -> str | None:
    """Lower case without white space; null where too short to be compared."""
    if text is None or len(text) < LEAST_CHARS:
        return None
    text = text.lower()
    for space in " \t\n\r":
        text = text.replace(space, "")
    return text if len(text) >= LEAST_CHARS else None


def normalised(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, c, norm`` of each row whose text is long enough, stored: the normalised text, its long hash and its short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            own = [i for i, t in enumerate(texts) if t is not None]
            texts = [texts[i] for i in own]
            hashes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            short = np.frombuffer(b"".join(h[:8] for h in hashes), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), pa.array(hashes, pa.binary()), pa.array(short), pa.array(texts, pa.string())], ["id", "h", "c", "norm"])

    return stored(df.select(id_col, text_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, h binary, c bigint, norm string"))


def _keys(texts: DataFrame) -> DataFrame:
    """``key, c``: the sketches of each text (of copies within a batch once) and its short hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            hashes, texts, at = np.array(list(new), np.int64), list(new.values()), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= SKETCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                keys, owner = sketches(texts[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(hashes[at:end][owner])], ["key", "c"])
                at = end

    return texts.select("c", "norm").mapInArrow(run, "key bigint, c bigint")


def _cells(df: DataFrame, key: str, item: str) -> DataFrame:
    """Rows of a group of ``n`` dealt to blocks of about ``BLOCK``, once for every block that they meet: ``lo, hi, own`` added."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64(item, F.lit(7)), blocks).cast("int")).otherwise(0)
    met = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select(key, item, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")


def _within(df: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs ``i < j`` of items of one group of ``df(key, item, n)``; a large group meets block by block, in as many join keys."""
    cell = _cells(df, key, item).alias("x")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (key, "lo", "hi")])
    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own"))
    return cell.join(cell.alias("y"), same & (F.col(f"x.{item}") < F.col(f"y.{item}")) & once).select(F.col(f"x.{item}").alias("i"), F.col(f"y.{item}").alias("j"))


def candidates(texts: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of short text hashes that share a sketch, once each."""
    shared = _keys(texts).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n > 1")
    shared = durable(shared.groupBy("key", "c").agg(F.max("n").alias("n")))
    return _within(shared, "key", "c").distinct().withColumnsRenamed({"i": "a", "j": "b"})


def links(texts: DataFrame) -> DataFrame:
    """Verified links ``ha, hb, distance`` between different texts of ``normalised`` (long hashes, ``ha < hb``), once each.

    A text with many partners is dealt, with them, to as many join keys as it has blocks of partners.
    """
    pairs = durable(candidates(texts))
    partners = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("blocks"))
    hot = partners.where("blocks > 1")
    rep = texts.select("c", "h", "norm").join(partners, "c").dropDuplicates(["c", "h"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def dealt(df: DataFrame, side: str, other: str) -> DataFrame:
        of = hot.select(F.col("c").alias(side), F.col("blocks").alias(f"{side}s"))
        block = F.coalesce(F.pmod(F.xxhash64(other, F.lit(11)), F.col(f"{side}s")), F.lit(0)).cast("int")
        return df.join(of, side, "left").withColumn(f"{side}_block", block).drop(f"{side}s")

    def text(side: str, n: int) -> DataFrame:
        return rep.select(F.col("c").alias(side), F.col("block").alias(f"{side}_block"), F.col("h").alias(f"h{n}"), F.col("norm").alias(f"n{n}"))

    verdict = F.arrow_udf(_similar, "struct<similar: boolean, distance: int>")
    both = dealt(dealt(pairs, "a", "b"), "b", "a").join(text("a", 1), ["a", "a_block"]).join(text("b", 2), ["b", "b_block"])
    both = both.withColumn("v", verdict("n1", "n2")).where("v.similar and h1 <> h2")
    return both.select(F.least("h1", "h2").alias("ha"), F.greatest("h1", "h2").alias("hb"), F.col("v.distance").alias("distance"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of different ids whose texts reach the similarity, copies included.

    Null, blank and short texts (under ``LEAST_CHARS`` normalised characters) and null ids pair with
    nothing; repeated rows of an id count once; an empty table gives no pairs; other columns aren't read.
    Many copies of a text are dealt to blocks, so that no task pairs all of them with each other or with another text's.
    """
    texts = normalised(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    found = links(texts).select("ha", "hb")
    members = texts.select("id", "h").distinct()
    hot = members.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = durable(members.join(hot, "h", "left").withColumn("n", F.coalesce("n", F.lit(1))))
    alike = _within(members.where("n > 1"), "h", "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("id", F.lit(7)), blocks)).otherwise(0).cast("int"))
    large = placed.where("blocks > 1").select("h", "blocks").distinct()

    def side(h: str, n: int) -> DataFrame:
        return placed.select(F.col("h").alias(h), F.col("block").alias(f"b{n}"), F.col("id").alias(f"i{n}"))

    met = durable(found)
    for h, n in (("ha", 1), ("hb", 2)):
        met = met.join(large.withColumnsRenamed({"h": h, "blocks": "m"}), h, "left").withColumn(f"b{n}", F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1))).drop("m")
    apart = met.join(side("ha", 1), ["ha", "b1"]).join(side("hb", 2), ["hb", "b2"]).where("i1 <> i2")
    ordered = apart.select(F.least("i1", "i2").alias("i"), F.greatest("i1", "i2").alias("j")).unionByName(alike)
    return ordered.distinct().withColumnsRenamed({"i": "id_a", "j": "id_b"})


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component of ``edges(a, b)``, by large and small stars."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = durable(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = new


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct id: ``id``, ``class`` (the group's least text hash), ``links`` (verified links of
    its text to other texts), ``copies`` (ids that hold the same normalised text, itself included).

    Null and short texts are a group of their own (class null, no links, one copy).
    """
    df = df.where(F.col(id_col).isNotNull())
    texts = normalised(df, id_col, text_col)
    found = durable(links(texts))
    roots = components(found.select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    degree = found.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    held = texts.select("id", "h").unionByName(df.select(F.col(id_col).alias("id"), F.lit(None).cast("binary").alias("h")))
    ids = held.groupBy("id").agg(F.max("h").alias("h"))
    copies = ids.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    of_text = copies.join(degree, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    return ids.join(of_text, "h", "left").select(
        "id", F.lower(F.hex(F.coalesce("root", "h"))).alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "page_content")
    return pairs.withColumnsRenamed({"id_a": "chunk_id_a", "id_b": "chunk_id_b"})


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "page_content")
    return groups.withColumnRenamed("id", "chunk_id")
