"""Deterministic top-k: score descending, NaN last, ties by smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(score: str = "score", ident: str = "id") -> list[Column]:
    """The total order of hits.  Spark sorts NaN as the largest, so it has a key of its own."""
    return [F.isnan(score).asc(), F.desc(score), F.asc(ident)]


def select(hits: DataFrame, k: int, score: str = "score", ident: str = "id") -> DataFrame:
    """The k best of all hits, repeated ones too; none if k is 0 or less."""
    return hits.orderBy(*order(score, ident)).limit(max(k, 0))


def top_k(hits: DataFrame, k: int, by: list[str], score: str = "score", ident: str = "id", rank: str = "rank") -> DataFrame:
    """The k best of each group with their rank from 1; the planner keeps k a task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order(score, ident))
    return hits.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= max(k, 0))


def cutoff(hits: DataFrame, k: int, by: list[str], score: str = "score", ident: str = "id") -> DataFrame:
    """The weakest kept hit of each group that has k of them; other groups have no row."""
    return top_k(hits, k, by, score, ident).where(F.col("rank") == k)


def recall_at_k(got: DataFrame, truth: DataFrame, k: int, by: str = "query_id", ident: str = "id", rank: str = "rank") -> DataFrame:
    """One row, `recall`: distinct ids in both top k, over k, averaged over the queries of got; 0 without queries or with k <= 0."""
    if k <= 0:
        return got.sparkSession.range(1).select(F.lit(0.0).alias("recall"))
    own = got.where(F.col(rank) <= k).select(by, ident).distinct()
    real = truth.where(F.col(rank) <= k).select(by, ident).distinct()
    hits = own.join(real, [by, ident], "left_semi").groupBy(by).agg(F.count("*").alias("n"))
    every = got.select(by).distinct().join(hits, by, "left")
    return every.agg(F.coalesce(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))), F.lit(0.0)).alias("recall"))
