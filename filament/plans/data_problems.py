"""The queries p1_ to p6_: general data problems over the file-metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filament.operators import nested, packed, profile, references, snapshots, timestamps
from filament.runtime import fold_key, is_blank, prepare, table


# ------------------------------------------------------------------ 1 stamps
def _clocks(spark: SparkSession, d: str) -> DataFrame:
    """(submission, time_zone, date_order), one row a centre: its last row holds."""
    dcc = table(spark, d, "c2m2_dcc").where(~is_blank(F.col("submission")))
    w = Window.partitionBy("submission_key").orderBy(F.col("load_no").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    last = dcc.select(fold_key(F.col("submission")).alias("submission_key"), "load_no", "row_id", "time_zone", "date_order").withColumn("nth", F.row_number().over(w))
    return last.where("nth = 1").select("submission_key", F.trim("time_zone").alias("time_zone"), F.trim("date_order").alias("date_order"))


def stamps(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, stamp, utc_stamp) of every creation_time that is not blank and every stamp in a counter name."""
    prepare(spark)
    files = table(spark, d, "c2m2_file").select(F.lit("c2m2_file").alias("table_name"), "row_id", "submission", F.col("creation_time").alias("stamp"))
    stats = table(spark, d, "dump_stat").select(F.lit("dump_stat").alias("table_name"), "row_id", "submission", timestamps.stamp_beside_label(F.col("name")).alias("stamp"))
    rows = files.unionByName(stats).where(~is_blank(F.col("stamp"))).withColumn("submission_key", fold_key(F.col("submission")))
    rows = rows.join(_clocks(spark, d), "submission_key", "left")
    return rows.select("table_name", "row_id", "stamp", timestamps.utc_stamp(F.col("stamp"), F.col("time_zone"), F.col("date_order")).alias("utc_stamp"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = stamps(spark, d)
    as_it_should_be = F.col("stamp").rlike(timestamps.EXACT) & (F.col("utc_stamp") != "none")
    return s.where(~as_it_should_be).select("table_name", "row_id", "utc_stamp")


# ------------------------------------------------------------------ 2 packed fields
PACKED_FIELDS = {"derived_from": False, "controlled_by": False, "audit_warning": True}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    found = packed.split_packed(table(spark, d, "file_extra_encode"), "row_id", PACKED_FIELDS, least=2)
    return found.select("row_id", "field_name", "ordinal", "item_value")


# ------------------------------------------------------------------ 3 orphan references
def _references(spark: SparkSession, d: str) -> list[references.Reference]:
    prepare(spark)
    dcc, project, collection, file = (table(spark, d, f"c2m2_{t}") for t in ("dcc", "project", "collection", "file"))
    centres = references.Target("c2m2_dcc", dcc, "submission")
    projects = references.Target("c2m2_project", project, "local_id", "id_namespace")
    collections = references.Target("c2m2_collection", collection, "local_id", "id_namespace")
    return [
        references.Reference("c2m2_project", project, "submission", centres),
        references.Reference("c2m2_file", file, "project_local_id", projects, "project_id_namespace"),
        references.Reference("c2m2_file", file, "bundle_collection_local_id", collections, "bundle_collection_id_namespace"),
        references.Reference("c2m2_dcc", dcc, "project_local_id", projects, "project_id_namespace"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(_references(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_references(spark, d))


# ------------------------------------------------------------------ 4 profiles
def _profile(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    files, stats, terms = table(spark, d, "c2m2_file"), table(spark, d, "dump_stat"), table(spark, d, "vocab_term")
    of = lambda c: terms.where(F.col("column_name") == c).select("term")
    return profile.profile([
        profile.ProfiledColumn("c2m2_file", files, "genome_assembly", terms=of("genome_assembly")),
        profile.ProfiledColumn("c2m2_file", files, "data_access_level", terms=of("data_access_level")),
        profile.ProfiledColumn("dump_stat", stats, "value", numeric=True),
    ])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.out_of_line(_profile(spark, d))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    m = _profile(spark, d)
    return m.select("table_name", "column_name", "load_no", "rows", "blanks", "distinct_values", "violations", F.round("entropy", 6).alias("entropy"), F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "median", F.round("shift", 6).alias("shift"))


# ------------------------------------------------------------------ 5 nested records
CHILDREN = {
    "collection": (["collections"], "local_id"),
    "biosample": (["collections", "biosamples"], "local_id"),
    "collection_subject": (["collections", "subjects"], "local_id"),
    "biosample_subject": (["collections", "biosamples", "subjects"], "local_id"),
    "extra_file": (["extra.fourdn.extra_files"], "href"),
}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    df = table(spark, d, "file_document")
    paths = {"/".join(p).replace(".", "/"): name for p, name in CHILDREN.values()}
    schema, texts = nested.read_once(df, "record_id", "payload", list(paths), [f"{p}/{name}" for p, name in paths.items()])
    records = nested.shaped_records(texts, "record_id", "text", schema)
    out = None
    for kind, (path, name) in CHILDREN.items():
        t = nested.child_table(records, "record_id", path)
        own = _text_member(t, name)
        t = t.select("record_id", F.lit(kind).alias("child_kind"), "place", F.coalesce(own, F.lit("")).alias("child_key"))
        out = t if out is None else out.unionByName(t)
    return out


def _text_member(t: DataFrame, name: str) -> Column:
    """item.name as text, whatever the merged schema made of it; null if it has no such member."""
    kinds = {f.name: f.dataType for f in t.schema["item"].dataType.fields}
    if name not in kinds:
        return F.lit(None).cast("string")
    c = F.col(f"item.{name}")
    return c if kinds[name].simpleString() == "string" else F.coalesce(c[nested.PLAIN], F.to_json(c)) if kinds[name].simpleString().startswith("struct") else F.to_json(c)


# ------------------------------------------------------------------ 6 snapshots
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    files = table(spark, d, "c2m2_file")
    values = {
        "md5": snapshots.text_value(F.col("md5")),
        "status": snapshots.text_value(F.col("status")),
        "size_in_bytes": snapshots.number_value(F.col("size_in_bytes")),
    }
    return snapshots.snapshot_changes(files, ["id_namespace", "local_id"], values).select("id_namespace", "local_id", "load_no", "change_kind")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_counts, p4_found, p4_profile, p5_found, p6_found)}
