"""Ranked search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import numbers, text
from kinweave.operators.ranking import global_rank


def top(df: DataFrame, score: str, *ids: str, k: int = 20) -> DataFrame:
    """The k best rows; ids make the order total."""
    return df.orderBy(F.desc(score), *ids).limit(k)


def nearest(vectors: DataFrame, query_id: int, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score by cosine with the vector of ``query_id``; only positive scores; the query itself is a candidate."""
    query = vectors.where(F.col(key) == query_id).select(F.col(column).alias("q")).limit(1)
    scored = vectors.withColumn("q", query.scalar()).select(key, F.round(numbers.cosine(F.col(column), F.col("q")), 6).alias("score")).where("score > 0")
    return top(scored, "score", key, k=k)


def rerank(df: DataFrame, query: str, body: str, key: str) -> DataFrame:
    """Share of the query's words that a text has, four decimals; ties by key."""
    q = F.array_distinct(text.words(F.lit(query)))
    score = F.round(F.size(F.array_intersect(q, F.array_distinct(text.words(F.col(body))))) / F.size(q), 4)
    return global_rank(df.select(key, score.alias("rerank")), F.desc("rerank"), key)
