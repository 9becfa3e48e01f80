"""One ranking from several differently-scaled scores: robust rank aggregation.

Scores enter only by their ranks inside the group, so no score rules by its range.  Under the null
hypothesis that the scores order an item at random, its normalised ranks are uniform and the k-th
smallest of m follows Beta(k, m - k + 1); an item's significance is the smallest of the m
probabilities, corrected by the factor m.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups over this many rows are ranked in slices between their own quantiles, each slice a task's share.
GROUP_ROWS = 20_000
SLICES = 64
#: Fixed value: the scores of a candidate and whether a higher one is better.
SCORES = {"llm_score": True, "distance": False, "combined_score": True}


def _ranks(df: DataFrame, keys: list[str], scores: dict[str, bool], parts: dict[str, list[str]]) -> DataFrame:
    """Per score: ``<score>_better``, rows of the slice strictly better, and ``<score>_ties``, rows as good, itself included."""
    for c, up in scores.items():
        order = F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_last()
        w = W.partitionBy(*parts[c]).orderBy(order)
        df = df.withColumn(f"{c}_better", F.when(F.col(c).isNotNull(), (F.rank().over(w) - 1).cast("long")))
        df = df.withColumn(f"{c}_ties", F.when(F.col(c).isNotNull(), F.count(F.lit(1)).over(W.partitionBy(*parts[c], c)).cast("long")))
    return df


def group_ranks(df: DataFrame, keys: list[str], scores: dict[str, bool]) -> DataFrame:
    """``df`` with ``<score>_better``, ``<score>_ties`` and ``<score>_n`` (rows that have the score) within the group.

    NaN counts as missing; a missing score has null ranks.  Groups up to ``GROUP_ROWS`` are ranked by one
    window; a larger group is cut at its own quantiles, ranked slice by slice, and each slice's ranks are
    shifted by the sizes of the better slices, so no task holds a whole hot group.
    """
    for c in scores:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c).cast("double")))
    fractions = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"{c}_n") for c in scores], *[F.percentile_approx(c, fractions, 1000).alias(f"_q_{c}") for c in scores]
    )
    small = sizes.where(F.col("_rows") <= GROUP_ROWS).drop(*[f"_q_{c}" for c in scores])
    large = sizes.where(F.col("_rows") > GROUP_ROWS)
    on = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    join = lambda s: df.alias("d").join(s.alias("s"), on).select("d.*", *[f"s.{c}" for c in s.columns if c not in keys])
    cold = _ranks(join(small), keys, scores, {c: keys for c in scores})
    hot = join(large)
    for c, up in scores.items():
        own = F.col(c)
        at = F.size(F.filter(f"_q_{c}", lambda q: q < own))  # noqa: B023
        hot = hot.withColumn(f"_s_{c}", F.when(F.col(c).isNotNull(), F.lit(SLICES) - at if up else at).otherwise(-1))
    hot = _ranks(hot.drop(*[f"_q_{c}" for c in scores]), keys, scores, {c: [*keys, f"_s_{c}"] for c in scores})
    for c in scores:
        s = f"_s_{c}"
        counts = hot.where(F.col(c).isNotNull()).groupBy(*keys, s).agg(F.max(F.col(f"{c}_better") + F.col(f"{c}_ties")).alias("_k"))
        shift = counts.withColumn("_before", F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy(s).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_k")
        cond = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, s)])
        hot = hot.alias("d").join(shift.alias("s"), cond, "left").select("d.*", "s._before")
        hot = hot.withColumn(f"{c}_better", F.col(f"{c}_better") + F.col("_before")).drop("_before")
    return cold.unionByName(hot.select(*cold.columns)).drop("_rows")


def _tail(k: int, m: int, r: Column) -> Column:
    """Probability that the k-th smallest of m uniform values is at most r."""
    terms = [F.lit(float(comb(m, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1)]
    return reduce(lambda a, b: a + b, terms)


def aggregate_ranks(df: DataFrame, keys: list[str], item: str, scores: dict[str, bool]) -> DataFrame:
    """One ranking of ``item`` in each group of ``keys`` from several scores (true: higher is better).

    Gives the keys, the item, the scores, ``<score>_rank`` (normalised mean rank in (0, 1]; null where the
    score is missing), ``<score>_beaten`` (rows of the group that have the score and are strictly worse),
    ``<score>_n``, ``significance`` (corrected minimum of the beta probabilities, 1 where an item has no
    score) and ``position`` (1-based; ties in significance by mean rank, then by item).  Repeated rows of an
    item (same key) count once; a null key is a group of its own; an item that lacks scores is judged by
    those it has.  Other columns are not carried.
    """
    ties = [F.max(F.when(~F.isnan(c.cast("double")), c.cast("double"))).alias(n) for n, c in ((n, F.col(n)) for n in scores)]
    one = df.groupBy(*keys, item).agg(*ties)
    ranked = group_ranks(one, keys, scores)
    for c in scores:
        ranked = ranked.withColumn(f"{c}_rank", (F.col(f"{c}_better") + (F.col(f"{c}_ties") + 1) / 2) / F.col(f"{c}_n"))
        ranked = ranked.withColumn(f"{c}_beaten", F.col(f"{c}_n") - F.col(f"{c}_better") - F.col(f"{c}_ties"))
    sorted_ranks = F.array_sort(F.filter(F.array(*[f"{c}_rank" for c in scores]), lambda x: x.isNotNull()))
    ranked = ranked.withColumn("_r", sorted_ranks)
    rho = F.lit(1.0)
    for m in range(len(scores), 0, -1):
        least = F.least(*[_tail(k, m, F.get("_r", F.lit(k - 1))) for k in range(1, m + 1)], F.lit(1.0)) if m > 1 else F.get("_r", F.lit(0))
        rho = F.when(F.size("_r") == m, m * least).otherwise(rho)
    mean = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_r"), F.lit(1))
    ranked = ranked.withColumn("_rho", F.round(rho, 12)).withColumn("_mean", F.round(F.when(F.size("_r") == 0, F.lit(2.0)).otherwise(mean), 12))
    return _positions(ranked, keys, item).select(
        *keys, item, *scores, *[f"{c}_{x}" for c in scores for x in ("rank", "beaten", "n")], F.least("_rho", F.lit(1.0)).alias("significance"), "position"
    )


def _positions(ranked: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Positions by (significance, mean rank, item): in large groups by slices of the
    significance and the sizes of the slices before; only items of equal significance must share a task."""
    m = sum(c.endswith("_n") for c in ranked.columns)
    slice_ = F.when(F.col("_big"), F.floor(F.col("_rho") / m * 65535).cast("int")).otherwise(0)
    n = F.greatest(*[F.col(c) for c in ranked.columns if c.endswith("_n")])
    sliced = ranked.withColumn("_big", F.coalesce(n, F.lit(0)) > GROUP_ROWS).withColumn("_slice", slice_)
    own = sliced.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("_rho", "_mean", item)))
    sizes = sliced.where("_big").groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_k"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cond = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_slice")])
    joined = own.alias("d").join(shift.alias("s"), cond, "left").select("d.*", "s._before")
    return joined.withColumn("position", (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("long"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/reranked.parquet").select("qid", "rank_no", *SCORES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates strictly better than at least 80 % of the others on each score, from the operator's ranks."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in SCORES])
    ranked = aggregate_ranks(_candidates(spark, sf_dir).where(complete), ["qid"], "rank_no", SCORES)
    n = F.col("llm_score_n")
    ahead = reduce(lambda a, b: a & b, [F.col(f"{c}_beaten") * 5 >= (n - 1) * 4 for c in SCORES])
    return ranked.where((n >= 5) & ahead).select("qid", "rank_no")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined order of every question's candidates, those with missing scores included."""
    ranked = aggregate_ranks(_candidates(spark, sf_dir), ["qid"], "rank_no", SCORES)
    return ranked.select("qid", "rank_no", F.round("significance", 6).alias("significance"), "position")


def _r(c: str, up: bool) -> str:
    d = "DESC" if up else "ASC"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY qid ORDER BY {c} {d} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY qid, {c}) + 1) / 2.0)"
        f" / count({c}) OVER (PARTITION BY qid) END AS {c[0]}r"
    )


SQL = {
    "p4_found": """
WITH d AS (SELECT DISTINCT qid, rank_no, llm_score, distance, combined_score FROM reranked
           WHERE llm_score IS NOT NULL AND distance IS NOT NULL AND combined_score IS NOT NULL),
c AS (SELECT a.qid, a.rank_no, count(*) AS others, count(*) FILTER (WHERE a.llm_score > b.llm_score) AS x,
        count(*) FILTER (WHERE a.distance < b.distance) AS y, count(*) FILTER (WHERE a.combined_score > b.combined_score) AS z
      FROM d a JOIN d b ON a.qid = b.qid AND a.rank_no <> b.rank_no GROUP BY ALL)
SELECT qid, rank_no FROM c WHERE others >= 4 AND 5 * x >= 4 * others AND 5 * y >= 4 * others AND 5 * z >= 4 * others""",
    "p4_ranking": f"""
WITH d AS (SELECT qid, rank_no, max(llm_score) AS llm_score, max(distance) AS distance, max(combined_score) AS combined_score FROM reranked GROUP BY ALL),
r AS (SELECT qid, rank_no, {', '.join(_r(c, up) for c, up in SCORES.items())} FROM d),
s AS (SELECT *, list_sort(list_filter([lr, dr, cr], lambda x: x IS NOT NULL)) AS v FROM r),
p AS (SELECT qid, rank_no, v, CASE len(v)
  WHEN 3 THEN 3 * least(1.0, 3*v[1]*(1-v[1])**2 + 3*v[1]**2*(1-v[1]) + v[1]**3, 3*v[2]**2*(1-v[2]) + v[2]**3, v[3]**3)
  WHEN 2 THEN 2 * least(1.0, 2*v[1]*(1-v[1]) + v[1]**2, v[2]**2) WHEN 1 THEN v[1] ELSE 1.0 END AS rho FROM s)
SELECT qid, rank_no, round(least(rho, 1.0), 6) AS significance,
  row_number() OVER (PARTITION BY qid ORDER BY round(rho, 12), round(CASE WHEN len(v) = 0 THEN 2.0 ELSE list_sum(v) / len(v) END, 12), rank_no) AS position
FROM p""",
}
