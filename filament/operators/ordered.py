"""Order-dependent joins and folds with an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """df with the order of its rows as they are read. Write the result before it is read twice."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the last by order, nulls first. Null keys are keys."""
    return _pick(df, keys, [F.col(o).desc_nulls_last() if isinstance(o, str) else o for o in order])


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the first by order, nulls last. Null keys are keys."""
    return _pick(df, keys, [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The window keeps only the top row of a key on each side of the shuffle (a window group limit), so hot keys shrink before it."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def filled(*columns: str) -> Column:
    """Whether all these columns hold a text that is not blank."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    return out


def lookup(df: DataFrame, side: DataFrame, on: dict[str, str], name: str, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """df with a struct column name of the side's row whose keys are equal; null for a miss or a blank key.

    on: df column -> side column. Of several side rows of a key the last by order holds.
    """
    keys = list(on.values())
    rows = last_wins(side, keys, order or [c for c in side.columns if c not in keys] or keys)
    fields = [F.col(c) for c in columns or side.columns if c != "ord"]
    rows = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*fields).alias(name))
    cond = filled(*on)
    for i, c in enumerate(on):
        cond = cond & (df[c] == F.col(f"_k{i}"))
    return df.join(rows, cond, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def collected(df: DataFrame, keys: list[str], value: Column, order: list[str], name: str) -> DataFrame:
    """(keys, name): the values of each key in order, repeated ones kept."""
    tagged = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
    return df.groupBy(*keys).agg(F.transform(tagged, lambda x: x["value"]).alias(name))


def first_contained(df: DataFrame, side: DataFrame, text: str, token: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with the first side row (by order) whose token stands in the text; rows without one keep nulls. Blank tokens stand nowhere.

    The text's pieces of each length that tokens have (a few) are joined with the tokens by
    equality, so that no row meets all tokens. keys tell df's rows apart.
    """
    some = side.where(F.col(token) != "")
    lengths = sorted(r[0] for r in some.select(F.char_length(token)).distinct().collect())
    at = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
    none = F.array().cast("array<string>")
    pieces = F.array_distinct(F.concat(none, *(F.when(F.char_length(text) >= n, at(n)).otherwise(none) for n in lengths)))
    hits = df.select(*keys, F.explode(pieces).alias("_piece")).join(some, F.col("_piece") == F.col(token))
    first = first_wins(hits.drop("_piece"), keys, order).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(first, cond, "left").drop(*(f"_k_{k}" for k in keys))
