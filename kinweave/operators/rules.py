"""Joins, aggregates and rule sets that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_join(left: DataFrame, right: DataFrame, left_keys: tuple[str, str], right_key: str) -> DataFrame:
    """Rows of left whose one or other key meets right: a union of two equi-joins, each row once."""
    found = [left.join(right.withColumnRenamed(right_key, k), k, "left_semi").select(left.columns) for k in left_keys]
    return found[0].union(found[1]).distinct()


def interval(parent_from: str, parent_to: str, child_from: str, child_to: str, year: float = 365.2425) -> tuple[Column, Column, Column]:
    """Lower, upper and middle age in years at the child's birth."""
    lower = F.greatest(F.lit(0.0), F.datediff(child_from, parent_to) / year)
    upper = F.datediff(child_to, parent_from) / year
    return lower, upper, (lower + upper) / 2


QUALIFIES = ("returnflag = 'A'", "identity_unreviewed"), ("line > 5", "claim_unsupported"), ("linestatus = 'O' AND line > 3", "evidence_missing"), ("parent_from > parent_to OR child_from > child_to", "dates_invalid"), ("child_to < parent_from", "chronology_invalid")


def qualified(edges: DataFrame) -> DataFrame:
    """edges with ``reason``: the first exclusion that holds, else qualified."""
    ladder = None
    for condition, reason in QUALIFIES:
        ladder = (F.when if ladder is None else ladder.when)(F.expr(condition), reason)
    return edges.withColumn("reason", ladder.otherwise("qualified"))
