"""Nearest neighbours: exact in blocks, and by inverted lists fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.sampling import hash_sample
from quillon.functions.scores import cosine_distance, inner_product, squared_l2

#: Queries and vectors of one block of the exact search.
QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
#: Bound of the sample the lists' centres are fitted on, and the rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 20_000, 12
#: Largest set of centres that is broadcast.
MOST_CENTRE_BYTES = 64 << 20


def top_k(index: DataFrame, query: list[float], k: int = 30, metric: str = "l2sq") -> DataFrame:
    """``vec_id, distance`` of the ``k`` nearest vectors to one query; ties by id; null vectors are left out."""
    q = F.lit([float(x) for x in query])
    d = {"l2sq": squared_l2, "cosine": cosine_distance, "ip": lambda a, b: -inner_product(a, b)}[metric](F.col("embedding"), q)
    return index.where(F.col("embedding").isNotNull()).select("vec_id", d.alias("distance")).orderBy("distance", "vec_id").limit(k)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        q, v = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    dots = q @ v.T
    if metric == "l2sq":
        return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * dots, 0)
    return 1 - dots if metric == "cosine" else -dots


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least distances of each row, ties by id."""
    if d.shape[1] > 4 * k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        return np.stack([np.pad(x[np.lexsort((ids[x], r[x]))][:k], (0, 0)) for r, x in ((r, np.flatnonzero(r <= e)) for r, e in zip(d, edge[:, 0]))])
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
    return order[:, :k]


def _blocks(df: DataFrame, size: int, prefix: str, salt: int) -> tuple[DataFrame, int]:
    """Rows dealt to blocks of about ``size`` by the hash of their id."""
    n = max(1, -(-df.count() // size))
    return df.withColumn(f"_{prefix}", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")), n


def knn_batch(index: DataFrame, queries: DataFrame, k: int = 30, metric: str = "l2sq") -> DataFrame:
    """``qid, rank, vec_id, distance``: the ``k`` nearest of ``index(vec_id, embedding)`` for every query, exactly.

    Queries and vectors are dealt to blocks; each pair of blocks is one matrix product in one task that
    passes on only its ``k`` best for each query, so what is shuffled afterwards is ``k`` rows a query and
    vector block.  Nothing is broadcast.  Ties by id; null vectors are left out.
    """
    vectors, _ = _blocks(index.where(F.col("embedding").isNotNull()).select("vec_id", "embedding"), VECTOR_BLOCK, "v", 1)
    asked, nq = _blocks(queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding"), QUERY_BLOCK, "q", 2)
    _, nv = vectors, vectors.agg(F.max("_v")).first()[0]
    left = vectors.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = asked.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(nv or 0))))

    def pair(q: pa.Table, v: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
        if not len(q) or not len(v):
            return schema.empty_table()
        mat = lambda t: np.stack([np.asarray(x, np.float64) for x in t["embedding"].to_pylist()])
        ids = v["vec_id"].to_numpy()
        d = _distances(mat(q), mat(v), metric)
        best = _nearest(d, ids, min(k, d.shape[1]))
        return pa.table([np.repeat(q["vec_id"].to_numpy(), best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()], schema=schema)

    pairs = right.groupBy("_q", "_v").cogroup(left.groupBy("_q", "_v")).applyInArrow(pair, "qid bigint, vec_id bigint, distance double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")


class Lists:
    """Inverted lists: centres, and the assignment of vectors to their nearest centre."""

    def __init__(self, centres: np.ndarray):
        if centres.nbytes > MOST_CENTRE_BYTES:
            raise ValueError("these centres are too large to be broadcast")
        self.centres = centres

    @classmethod
    def fit(cls, index: DataFrame, lists: int, seed: int = 1) -> Lists:
        """Centres by k-means on a sample of at most ``FIT_ROWS`` rows; an empty index has none."""
        rows = hash_sample(index.where(F.col("embedding").isNotNull()).select("vec_id", "embedding"), ["vec_id"], FIT_ROWS).collect()
        x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], np.float64)
        if not len(x):
            return cls(np.empty((0, 0)))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(FIT_ROUNDS):
            near = _distances(x, c, "l2sq").argmin(1)
            c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return cls(c)

    def assign(self, df: DataFrame, probes: int = 1) -> DataFrame:
        """``df(vec_id, embedding)`` with ``list``: the nearest ``probes`` centres of each row."""
        centres = df.sparkSession.sparkContext.broadcast(self.centres)  # of checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b) or not len(centres.value):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in b.column(1).to_pylist()])
                near = np.argsort(_distances(x, centres.value, "l2sq"), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(b)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "list"])

        kept = df.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
        return kept.mapInArrow(run, "vec_id bigint, embedding array<float>, list int")


def knn_lists(index: DataFrame, queries: DataFrame, lists: Lists, probes: int, k: int = 30, salt: int = 8) -> DataFrame:
    """``qid, rank, vec_id, distance`` from the ``probes`` nearest lists of each query.

    Every row is indexed; lists are salted, so that a list that holds much of the table is searched by
    several tasks, each passing on its ``k`` best.
    """
    v = lists.assign(index).withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(salt)).cast("int"))
    q = lists.assign(queries, probes).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        mat = lambda t: np.stack([np.asarray(x, np.float64) for x in t["embedding"].to_pylist()])
        ids, d = b["vec_id"].to_numpy(), _distances(mat(a), mat(b), "l2sq")
        best = _nearest(d, ids, min(k, d.shape[1]))
        return pa.table([np.repeat(a["vec_id"].to_numpy(), best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()], schema=schema)

    found = q.groupBy("list", "_s").cogroup(v.groupBy("list", "_s")).applyInArrow(search, "qid bigint, vec_id bigint, distance double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")
