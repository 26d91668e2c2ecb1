"""Constraints as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A constraint does not hold."""


def duplicate_keys(df: DataFrame, keys: list[str], submission: str | None = None) -> DataFrame:
    """(keys, n[, submissions]) of keys that several rows have."""
    more = [F.count_distinct(submission).alias("submissions")] if submission else []
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *more).where("n > 1")


def not_one_to_one(df: DataFrame, left: str, right: str) -> DataFrame:
    """(side, value, partners) of values of either column that go with several of the other."""
    a = df.groupBy(F.lit(left).alias("side"), F.col(left).cast("string").alias("value")).agg(F.count_distinct(right).alias("partners"))
    b = df.groupBy(F.lit(right).alias("side"), F.col(right).cast("string").alias("value")).agg(F.count_distinct(left).alias("partners"))
    return a.unionByName(b).where("partners > 1")


def missing_parents(child: DataFrame, foreign: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """(foreign, n): foreign keys without a parent and how many rows have each; keys with a null part name none."""
    named = child
    for c in foreign:
        named = named.where(F.col(c).isNotNull())
    refs = named.groupBy(*foreign).agg(F.count("*").alias("n"))
    parents = parent.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(keys))).distinct()
    cond = F.lit(True)
    for i, c in enumerate(foreign):
        cond = cond & (F.col(c) == F.col(f"_p{i}"))
    return refs.join(parents, cond, "left_anti")


def require_none(violations: DataFrame, message: str, most: int = 5) -> None:
    """Raise with the first few violations if there are any."""
    found = violations.limit(most).collect()
    if found:
        raise IntegrityError(f"{message}: {[tuple(r) for r in found]}")
