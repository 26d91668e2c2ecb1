"""Sources: datapackage folders, tab-separated metadata, search payloads and artifacts."""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filament.functions import scalars

R = TypeVar("R")


# ------------------------------------------------------------------ fetching
def with_retries(fetch: Callable[[], R], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> R:
    """The result of a call, tried again after 1, 2, 4 … seconds if it fails."""
    for i in range(attempts):
        try:
            return fetch()
        except OSError:
            if i == attempts - 1:
                raise
            sleep(2**i)
    raise ValueError("no attempts")


def offset_pages(fetch: Callable[[int, int], dict], size: int = 1000) -> Iterator[dict]:
    """Pages of a search by offset until its total is reached or a page is empty."""
    at = 0
    while True:
        page = fetch(at, size)
        yield page
        n = len(page.get("@graph", []))
        at += n
        if not n or at >= page.get("total", 0):
            return


def keyset_pages(fetch: Callable[[list | None, int], dict], size: int = 1000) -> Iterator[dict]:
    """Pages of a search that continue after the last hit's sort key, until a page is short."""
    after = None
    while True:
        page = fetch(after, size)
        hits = page.get("hits", {}).get("hits", [])
        if hits:
            yield page
        if len(hits) < size:
            return
        after = hits[-1]["sort"]


def accession_batches(accessions: Iterable[str], size: int = 100) -> list[list[str]]:
    """Distinct accessions in order, in batches."""
    every = sorted(set(accessions))
    return [every[i : i + size] for i in range(0, len(every), size)]


class PageSource(DataSource):
    """Saved search pages as a table (page, value), a partition for each file; damaged pages are skipped.

    spark.dataSource.register(PageSource); spark.read.format("search_pages").option("folder", …).load()
    """

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "page string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["folder"])


class _PageReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.value), encoding="utf-8") as f:
            text = f.read()
        try:
            json.loads(text)
        except ValueError:
            return
        yield partition.value, text


# ------------------------------------------------------------------ archives and folders
def extract_archive(archive: str, folder: str) -> str:
    """Unpack a ZIP into a cleared folder after testing it; a broken one is deleted, and ValueError raised. Names must stay inside."""
    try:
        with zipfile.ZipFile(archive) as z:
            if (bad := z.testzip()) is not None:
                raise zipfile.BadZipFile(f"{bad} is damaged")
            root = os.path.realpath(folder)
            for name in z.namelist():
                if not os.path.realpath(os.path.join(folder, name)).startswith(root + os.sep):
                    raise zipfile.BadZipFile(f"{name} leads outside")
            shutil.rmtree(folder, ignore_errors=True)
            os.makedirs(folder)
            z.extractall(folder)
    except zipfile.BadZipFile as e:
        os.unlink(archive)
        raise ValueError(f"{archive}: {e}") from e
    return folder


def read_delimited(spark: SparkSession, path: str, submission: str, table: str) -> DataFrame:
    """A quoted CSV or TSV table, all text with blanks as "", plus submission and table."""
    sep = "," if path.endswith(".csv") else "\t"
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns), F.lit(submission).alias("submission"), F.lit(table).alias("table"))
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_datapackage(spark: SparkSession, folder: str, submission: str, public: bool = False) -> dict[str, DataFrame]:
    """Tables of a folder by file stem: its .csv and .tsv files, or those of its first subfolder that does not begin with __."""
    names = lambda d: sorted(n for n in os.listdir(d) if n.endswith((".csv", ".tsv")))
    if not names(folder):
        inner = sorted(n for n in os.listdir(folder) if os.path.isdir(os.path.join(folder, n)) and not n.startswith("__"))
        folder = os.path.join(folder, inner[0]) if inner else folder
    out = {}
    for name in names(folder):
        stem = name.rpartition(".")[0]
        df = read_delimited(spark, os.path.join(folder, name), submission, stem)
        out[stem] = df.withColumn("data_access_level", F.lit("public")) if public and stem == "file" else df
    return out


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of JSON lines: rows that are no object of the schema's types are passed over, with their text; so are damaged files."""
    wide = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    lines = spark.read.option("ignoreCorruptFiles", True).text(path).where(F.col("value").rlike(r"\S"))
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}).alias("d"))
    bad = F.col("d").isNull() | F.col("d._rejected").isNotNull()
    return rows.where(~bad).select("d.*").drop("_rejected"), rows.where(bad).select(F.col("value").alias("text"))


# ------------------------------------------------------------------ unquoted metadata lines
def metadata_rows(lines: DataFrame, header: list[str]) -> DataFrame:
    """Lines (value) of unquoted tab-separated metadata as columns: short rows have nulls, long ones are cut, blank lines and the header are left out."""
    text = F.regexp_replace("value", r"[\r\n]+\z", "")
    rows = lines.select(text.alias("value")).where(F.col("value").rlike(r"\S") & (F.col("value") != "\t".join(header)))
    fields = F.split("value", "\t", -1)
    return rows.select(*(F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(header)))


def metadata_header(spark: SparkSession, path: str) -> list[str]:
    """Column names: the first line that is not blank."""
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).limit(1).collect()
    return first[0].value.rstrip("\r\n").split("\t") if first else []


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_rows(spark.read.text(path), metadata_header(spark, path))


def stream_metadata(spark: SparkSession, folder: str, header: list[str], files_per_batch: int = 1) -> DataFrame:
    return metadata_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), header)


# ------------------------------------------------------------------ search payloads
FILE_SEARCH = (
    "`@graph` array<struct<accession:string,genome_assembly:string,file_type:string,file_type_detailed:string,"
    "track_and_facet_info:struct<condition:string,biosource_name:string,dataset:string,experiment_type:string,assay_info:string,replicate_info:string>,"
    "extra_files:array<struct<href:string,md5sum:string,file_size:string,file_format:string>>>>"
)


def file_search(payloads: DataFrame) -> DataFrame:
    """Pages (value) of file search results as one row a file; files without accession are left out, of repeated ones the fields agree."""
    rows = payloads.select(F.inline(F.from_json("value", FILE_SEARCH)["@graph"]))
    rows = rows.withColumn("accession", scalars.normalize_accession(F.col("accession"))).where(F.col("accession").isNotNull())
    files = F.transform("extra_files", lambda e: F.struct(e["href"].alias("href"), e["md5sum"].alias("md5sum"), e["file_size"].alias("file_size"), scalars.display_title(e["file_format"]).alias("file_format")))
    kept = F.filter(files, lambda e: F.coalesce(e["href"], e["md5sum"], e["file_size"], e["file_format"]).isNotNull())
    return rows.select("accession", "genome_assembly", "file_type", "file_type_detailed", "track_and_facet_info.*", kept.alias("extra_files"))


EXPERIMENT_SEARCH = "`@graph` array<map<string,string>>, total int"


def experiment_search(payloads: DataFrame) -> DataFrame:
    """(accession, display_title, experiment_type, targeted_factor, protocol): pages of experiments, numbers as text, blank fields left out; the last of an accession holds."""
    rows = payloads.withColumn("page", F.monotonically_increasing_id()).select("page", F.posexplode(F.from_json("value", EXPERIMENT_SEARCH)["@graph"]).alias("i", "m"))
    m = F.map_filter("m", lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    rows = rows.withColumn("m", m).withColumn("accession", scalars.normalize_accession(F.try_element_at("m", F.lit("accession")))).where(F.col("accession").isNotNull())
    factor = F.transform(F.from_json(F.try_element_at("m", F.lit("targeted_factor")), "array<string>"), scalars.display_title)
    value = F.struct(
        F.try_element_at("m", F.lit("display_title")).alias("display_title"),
        scalars.display_title(F.try_element_at("m", F.lit("experiment_type"))).alias("experiment_type"),
        factor.alias("targeted_factor"),
        F.map_filter("m", lambda k, v: ~k.isin("accession", "display_title", "experiment_type", "targeted_factor")).alias("protocol"),
    )
    return rows.groupBy("accession").agg(F.max_by(value, F.struct("page", "i")).alias("x")).select("accession", "x.*")


DATASET_SEARCH = (
    "hits struct<hits:array<struct<_source:struct<doi_url:string,dataset_type:string,pipeline:string,processing:string,group_name:string,analyte_class:string,visualization:boolean,"
    "`vitessce-hints`:array<string>,metadata:string,data_access_level:string,files:array<struct<rel_path:string,is_data_product:boolean>>,donor:struct<uuid:string,mapped_metadata:string>,"
    "ingest_metadata:struct<workflow_description:string>>,sort:array<string>>>>"
)


def dataset_search(payloads: DataFrame) -> DataFrame:
    """Pages (value) of dataset search results as one row a dataset with a DOI, its assembly read from the workflow description."""
    rows = payloads.select(F.explode(F.from_json("value", DATASET_SEARCH)["hits"]["hits"]).alias("h")).select("h._source.*")
    return rows.where(scalars.nonempty(F.col("doi_url")).isNotNull()).withColumn("genome_assembly", scalars.genome_assembly(F.col("ingest_metadata.workflow_description")))


def access_url(methods) -> Column:
    """URL of the first access method (type, url) that is https or s3 and has one."""
    return F.try_element_at(F.filter(methods, lambda m: m["type"].isin("https", "s3") & (F.coalesce(m["url"], F.lit("")) != "")), F.lit(1))["url"]


# ------------------------------------------------------------------ bytes and artifacts
def fetch_atomically(source: str, target: str) -> str:
    """Copy a file under a .part name and rename it when complete."""
    part = f"{target}.part"
    shutil.copyfile(source, part)
    os.replace(part, target)
    return target


def peek(path: str, most: int = 256 * 1024) -> bytes:
    """The first bytes of a file, unpacked if it is gzip."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    with gzip.open(path) if packed else open(path, "rb") as f:
        return f.read(most)


@dataclass
class ArtifactStore:
    """Tables by cache key (dcc/local_id/kind/md5-vN) under a root; there when complete, and written once."""

    spark: SparkSession
    root: str

    def path(self, key: str) -> str:
        if not re.fullmatch(r"[a-z0-9._-]+/[^/\\\x00]+/[a-z]+/[0-9a-f]{32}-v\d+", key):
            raise ValueError(f"no cache key: {key}")
        return f"{self.root}/{key}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        p, fs = self._fs(f"{self.path(key)}/_SUCCESS")
        return bool(fs.exists(p))

    def put(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(key))

    def get(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(key))

    def delete(self, key: str) -> bool:
        p, fs = self._fs(self.path(key))
        return bool(fs.delete(p, True))

    def once(self, key: str, make) -> DataFrame:
        """The artifact of a key, made if it is not there: a run that was cut off starts after its last complete stage."""
        if not self.has(key):
            self.put(key, make())
        return self.get(key)
