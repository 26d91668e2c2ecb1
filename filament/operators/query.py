"""Queries over file documents: pages, counts, distinct values and point lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filament.operators.filters import leaf_paths, matching, path_values

PAGE_SIZE, MOST = 25, 500
KEY = ("id_namespace", "local_id")


def files(docs: DataFrame, tree: Any = None, page: int = 0, page_size: int = PAGE_SIZE, key: tuple[str, ...] = KEY) -> DataFrame:
    """A page of the matching documents, by key. Pages count from 0; a size is 1 to 500.

    Only the page's rows reach a sort: the limit and offset make it a top-k.
    """
    if page < 0 or not 1 <= page_size <= MOST:
        raise ValueError(f"page must be 0 or more, page_size 1 to {MOST}")
    return docs.where(matching(tree, docs.schema)).orderBy(*key).offset(page * page_size).limit(page_size)


def files_with_total(docs: DataFrame, tree: Any = None, page: int = 0, page_size: int = PAGE_SIZE, key: tuple[str, ...] = KEY) -> DataFrame:
    """(total_count, items) in one row: how many documents match, whatever the page, and the page's documents by key."""
    fields = F.struct(*docs.columns)
    items = files(docs, tree, page, page_size, key).select(F.struct(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), fields.alias("doc")).alias("x"))  # a page at most
    items = items.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["doc"]).alias("items"))
    kind = items.schema["items"].dataType
    both = file_count(docs, tree).withColumn("items", F.lit(None).cast(kind)).unionByName(items.withColumn("total_count", F.lit(None).cast("long")))
    return both.agg(F.max("total_count").alias("total_count"), F.first("items", ignorenulls=True).alias("items"))


def file(docs: DataFrame, key: dict[str, Any]) -> DataFrame:
    """The document with a key; no row if there is none."""
    condition = F.lit(True)
    for c, v in key.items():
        condition = condition & (F.col(c) == F.lit(v))
    return docs.where(condition).limit(1)


# The fields that distinct_fields() answers.
DISTINCT_FIELDS = frozenset({
    "dcc.id", "dcc.dcc_name", "dcc.dcc_abbreviation", "data_type.id", "data_type.name", "assay_type.id", "assay_type.name", "file_format.id", "file_format.name",
    "compression_format", "mime_type", "analysis_type", "genome_assembly", "genome_annotation", "output_type", "status", "data_access_level",
    "extra.encode.annotation_type", "extra.encode.organism", "extra.encode.assembly",
})


def distinct_fields(docs: DataFrame, fields: list[str], tree: Any = None, allowed: frozenset[str] = DISTINCT_FIELDS) -> DataFrame:
    """(place, field, values): a row a field in the order of the request, with its distinct values in order; no values give an empty list.

    The fields that are allowed are small vocabularies, so their values fit into a row.
    """
    asked = docs.sparkSession.createDataFrame([(i, f) for i, f in enumerate(fields)], "place int, field string")
    found = distinct_values(docs, list(dict.fromkeys(fields)), tree, set(allowed)).groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return asked.join(found, "field", "left").select("place", "field", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def file_count(docs: DataFrame, tree: Any = None) -> DataFrame:
    """(total_count) of the matching documents."""
    return docs.where(matching(tree, docs.schema)).agg(F.count("*").alias("total_count"))


def distinct_values(docs: DataFrame, fields: list[str], tree: Any = None, allowed: set[str] | None = None) -> DataFrame:
    """(field, value) once each, of all fields in one pass; nulls are left out. Fields that are not allowed raise ValueError."""
    known = set(leaf_paths(docs.schema)) if allowed is None else allowed
    if unknown := set(fields) - known:
        raise ValueError(f"not queryable: {sorted(unknown)}")

    def named(name: str) -> Column:
        return F.transform(path_values(docs.schema, name), lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value")))

    pairs = F.concat(*map(named, fields))
    rows = docs.where(matching(tree, docs.schema)).select(F.explode(pairs).alias("x")).select("x.*")
    return rows.where(F.col("value").isNotNull()).distinct()


def of_submissions(docs: DataFrame, submissions: list[str] | None) -> DataFrame:
    """The documents of some submissions; None is all."""
    return docs if submissions is None else docs.where(F.col("submission").isin(*submissions))


def keyset_page(df: DataFrame, key: str, after: Any, size: int) -> DataFrame:
    """The size rows that follow a key."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def first_of(sources: list[DataFrame], condition: Column, columns: list[str]) -> DataFrame:
    """The row that meets a condition in the first source that has one."""
    out = None
    for rank, df in enumerate(sources):
        part = df.where(condition).select(*columns, F.lit(rank).alias("_rank"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("_rank", *columns).limit(1).drop("_rank")


def coverage(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, total, covered, percent): rows of each group that have a value."""
    covered = F.count(column)
    return df.groupBy(by).agg(F.count("*").alias("total"), covered.alias("covered"), F.round(covered * 100.0 / F.count("*"), 4).alias("percent"))


def distribution(df: DataFrame, column: str, configured: list[str] | None = None) -> DataFrame:
    """(value, n): rows by value, configured values with 0 if there are none."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if not configured:
        return counts
    seed = df.sparkSession.createDataFrame([(v,) for v in configured], "value string").select("value", F.lit(0).cast("long").alias("n"))
    return counts.unionByName(seed).groupBy("value").agg(F.sum("n").alias("n"))
