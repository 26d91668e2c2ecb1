"""Genomic interval and alignment files: reading, sorting, checking and range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filament.runtime import persisted

#: Column of the start position by format, counted from 0; other columns are plain text.
START_COLUMN = {"bed": 1, "narrowpeak": 1, "broadpeak": 1, "vcf": 1, "gff": 3, "gff3": 3, "gtf": 3, "sam": 3}
CHROM_COLUMN = {"sam": 2}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no, file): the lines of text files, gzip ones too; line_no orders the lines of a file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def parsed(lines: DataFrame, fmt: str) -> DataFrame:
    """Lines with chrom, start and is_header; blank lines are left out, lines without a start get null."""
    header = "@" if fmt == "sam" else "#"
    fields = F.split("line", "\t")
    at = START_COLUMN[fmt]
    out = lines.where(F.col("line").rlike(r"\S")).withColumn("is_header", F.col("line").startswith(header))
    return out.withColumns(
        {
            "chrom": F.when(~F.col("is_header"), F.get(fields, F.lit(CHROM_COLUMN.get(fmt, 0)))),
            "start": F.when(~F.col("is_header"), F.get(fields, F.lit(at)).try_cast("bigint")),
        }
    )


def sorted_records(records: DataFrame) -> DataFrame:
    """Records by chrom (bytewise), start and the whole line, as sort -k1,1 -k2,2n gives them; headers first, in their order.

    A range exchange sorts in parallel; each task holds one range.
    """
    line_no = F.when(F.col("is_header"), F.col("line_no")) if "line_no" in records.columns else F.lit(None)
    return records.orderBy(~F.col("is_header"), line_no, "chrom", F.coalesce("start", F.lit(0)), "line")


def coordinate_sorted(records: DataFrame) -> DataFrame:
    """Alignment records by the order of the reference names in the header (@SQ), unmapped (*) last, then position."""
    names = records.where(F.col("line").startswith("@SQ")).select(F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("name"), "line_no")
    rank = names.select(F.col("name").alias("_name"), F.row_number().over(Window.orderBy("line_no")).alias("_rank"))  # as many rows as references
    body = records.join(rank, F.col("chrom") == F.col("_name"), "left")
    return body.orderBy(~F.col("is_header"), F.when(F.col("is_header"), F.col("line_no")), F.col("_rank").asc_nulls_last(), "start", "line").drop("_name", "_rank")


def bad_headers(records: DataFrame) -> DataFrame:
    """Header lines of the kinds @HD, @SQ, @RG and @PG without a tab."""
    return records.where(F.col("line").rlike(r"^@(HD|SQ|RG|PG)") & ~F.col("line").contains("\t"))


def data_lines(records: DataFrame) -> DataFrame:
    """(n): lines that are no header and not blank."""
    return records.where(~F.col("is_header")).agg(F.count("*").alias("n"))


def unsorted(df: DataFrame, group: list[str], order: str, ref: str, pos: str, first: int | None = None) -> DataFrame:
    """(group, out_of_order): how often a position falls below the one before it on the same reference.

    first: only so many records of each group by order, as a probe; null looks at all. The
    records are compared within ranges of (group, order), and the ends of the ranges with
    each other, so that a large group is the work of many tasks.
    """
    rows = df.select(*group, F.col(order).alias("_at"), F.col(ref).alias("_ref"), F.col(pos).alias("_pos"))
    if first is not None:  # the limit of a rank takes effect before the shuffle, too
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_at"))).where(F.col("_n") <= first).drop("_n")
    rows = persisted(rows.repartitionByRange(*group, "_at").withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*group, "_range").orderBy("_at")
    below = (F.col("_ref") == F.lag("_ref").over(w)) & (F.col("_pos") < F.lag("_pos").over(w))
    inside = rows.withColumn("_bad", below).groupBy(*group).agg(F.count(F.when(F.col("_bad"), 1)).alias("n"))
    this = F.struct("_ref", "_pos")
    ends = rows.groupBy(*group, "_range").agg(F.min_by(this, "_at").alias("head"), F.max_by(this, "_at").alias("tail"))  # a few rows a group: as many as ranges
    prior = F.lag("tail").over(Window.partitionBy(*group).orderBy("_range"))
    crossing = (F.col("head._ref") == F.col("_prior._ref")) & (F.col("head._pos") < F.col("_prior._pos"))
    between = ends.withColumn("_prior", prior).groupBy(*group).agg(F.count(F.when(crossing, 1)).alias("n"))
    return inside.unionByName(between).groupBy(*group).agg(F.sum("n").alias("out_of_order"))


def overlapping(df: DataFrame, windows: DataFrame, group: str, start: str, end: str, bin_size: int) -> DataFrame:
    """Pairs of records and windows (group, w_start, w_end, further columns) that overlap: start < w_end and end > w_start.

    Both sides are cut into bins of bin_size and joined on them, so that no record meets all
    windows; a pair that shares several bins is kept in the first of them.
    """
    lo = lambda c: F.floor(F.col(c) / bin_size)
    hi = lambda c: F.floor((F.col(c) - 1) / bin_size)
    r = df.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(lo(start), hi(end))))
    w = windows.where("w_end > w_start").withColumn("_wbin", F.explode(F.sequence(lo("w_start"), hi("w_end")))).withColumnRenamed(group, "_group")
    joined = r.join(w, (F.col(group) == F.col("_group")) & (F.col("_bin") == F.col("_wbin")) & (F.col(start) < F.col("w_end")) & (F.col(end) > F.col("w_start")))
    return joined.where(F.col("_bin") == F.greatest(lo(start), lo("w_start"))).drop("_bin", "_wbin", "_group")


def write_indexed(records: DataFrame, path: str, partitions: int) -> None:
    """Body records as Parquet in range order of chrom and start: row-group statistics then serve range reads."""
    body = records.where(~F.col("is_header"))
    body.repartitionByRange(partitions, "chrom", "start").sortWithinPartitions("chrom", "start", "line").write.mode("overwrite").parquet(path)


def gtf_to_gff3(attributes: Column) -> Column:
    """GTF attributes (key "value";) as GFF3 ones (key=value;): the attribute rewrite only, no change of features."""
    return F.regexp_replace(F.regexp_replace(attributes, r'(\w+) "([^"]*)"', "$1=$2"), r";\s*", ";")


def looks_processable(head: Column) -> Column:
    """Whether the first bytes of a file are gzip, or text: UTF-8 without NUL; other binary files are not."""
    start = F.substring(head, 1, 512)
    gz = F.startswith(start, F.lit(b"\x1f\x8b"))
    text = F.lit(False)
    for cut in range(4):  # the 512th byte may be inside a character
        text = text | F.is_valid_utf8(F.substring(start, F.lit(1), F.octet_length(start) - cut).cast("string"))
    return gz | (~F.contains(start, F.lit(b"\x00")) & text)
