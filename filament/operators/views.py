"""Analytic views over the flattened tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["id_namespace", "local_id"]


def file_view(t: dict[str, DataFrame]) -> DataFrame:
    """One row a file, with term names and every extension column."""
    out = t["file"].join(t["dcc"].select("submission", "dcc_abbreviation"), "submission")
    for name in ("file_format", "data_type", "assay_type"):
        terms = t[name].select(F.col("id").alias(name), F.col("name").alias(f"{name}_name"))
        out = out.join(terms, name, "left")
    for name in ("file_extra_fourdn", "file_extra_encode", "file_extra_hubmap"):
        out = out.join(t[name], KEY, "left")
    return out


def _side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"{name}_{k}") for k in KEY), *columns)


#: Rows of each side in a block of fanned().
BLOCK = 1024


def _blocks(df: DataFrame, on: list[str], name: str) -> DataFrame:
    """(on, _name, name): the rows of each key as lists of up to BLOCK structs, which are numbered."""
    rest = [c for c in df.columns if c not in on]
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(*rest))
    return df.withColumn(f"_{name}", F.floor((nth - 1) / BLOCK)).groupBy(*on, f"_{name}").agg(F.collect_list(F.struct(*rest)).alias(name))


def fanned(left: DataFrame, right: DataFrame, on: list[str], each: DataFrame) -> DataFrame:
    """left with each's row of its key and all of right's rows of its key, nulls if there are none: for keys of which both sides have many rows. Both have other columns beside the key.

    Blocks of rows are joined, dealt to tasks evenly however many rows a key has, and only then
    multiplied out; of a block, a row of right comes with all of left in turn.
    """
    blocks = _blocks(left, on, "left").join(each, on).join(_blocks(right, on, "right"), on, "left")
    blocks = blocks.repartition(8 * left.sparkSession.sparkContext.defaultParallelism, *on, "_left", "_right")
    more = [c for c in each.columns if c not in on]
    return blocks.select(*on, *more, "left", F.inline_outer("right")).select("*", F.inline("left")).drop("left")


def file_biosample_view(t: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """A row a file, collection, biosample and subject: files repeat, so sizes must not be summed over it. columns: only these, of files none but their key."""
    pair = lambda s: [f"{s}_{k}" for k in KEY]
    only = lambda df: df.select(*(c for c in df.columns if columns is None or c in (*columns, *pair("collection"))))
    held = t["file_in_collection"]
    if columns is None:
        held = _side(t["file"], "file", "submission", "filename", F.col("accession_id").alias("file_accession_id")).join(held, pair("file"))
    c = _side(t["collection"], "collection", F.col("name").alias("collection_name"), "experiment_type")
    # a collection's members are put together once; the join with the files that hold it is the last, and nothing is looked up in its rows
    own = t["biosample_in_collection"].join(_side(t["biosample"], "biosample", F.col("anatomy").alias("anatomy_id")), pair("biosample"), "left")
    own = own.join(t["anatomy"].select(F.col("id").alias("anatomy_id"), F.col("name").alias("anatomy_name")), "anatomy_id", "left")
    own = own.join(t["biosample_from_subject"], pair("biosample"), "left").join(_side(t["subject"], "subject", "taxonomy"), pair("subject"), "left")
    taxa = t["ncbi_taxonomy"].select(F.col("id").alias("taxonomy"), F.col("name").alias("taxonomy_name"))
    own = own.join(taxa, "taxonomy", "left").drop("taxonomy")
    out = fanned(only(held), only(own), pair("collection"), only(c))
    return out if columns is None else out.select(*columns)


def subject_demographics_view(t: dict[str, DataFrame]) -> DataFrame:
    """Sex, age and race of each subject with where each comes from; a unit only for ages from the extension."""
    races = t["subject_race"].groupBy(*(F.col(f"subject_{k}").alias(k) for k in KEY)).agg(F.array_sort(F.collect_list("race")).alias("races"))
    x = t["subject_extra_hubmap"].select(*KEY, F.col("sex").alias("x_sex"), "age_value", "age_unit", F.col("race").alias("x_race"))
    s = t["subject"].join(x, KEY, "left").join(races, KEY, "left")

    def source(*pairs: tuple[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for c, name in reversed(pairs):
            out = F.when(F.col(c).isNotNull(), F.lit(name)).otherwise(out)
        return out

    return s.select(
        *KEY,
        "submission",
        F.coalesce("sex", "x_sex").alias("sex"),
        source(("sex", "subject"), ("x_sex", "subject_extra_hubmap")).alias("sex_source"),
        F.coalesce("age_at_enrollment", "age_at_sampling", "age_value").alias("age"),
        source(("age_at_enrollment", "subject.age_at_enrollment"), ("age_at_sampling", "subject.age_at_sampling"), ("age_value", "subject_extra_hubmap.age_value")).alias("age_source"),
        F.when(F.col("age_at_enrollment").isNull() & F.col("age_at_sampling").isNull(), F.col("age_unit")).alias("age_unit"),
        F.coalesce(F.col("races"), F.when(F.col("x_race").isNotNull(), F.array("x_race"))).alias("race"),
        source(("races", "subject_race"), ("x_race", "subject_extra_hubmap")).alias("race_source"),
        "ethnicity",
    )
