"""What every operator needs from the session: worker imports, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Lazy(Mapping):
    """Values by name, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], Any]]) -> None:
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> Any:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, other: Mapping[str, Any]) -> dict[str, Any]:
        return dict(self) | dict(other)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure there is a checkpoint folder.

    The folder named by spark.checkpoint.dir is taken as it is; only a session in local
    mode that names none gets a temporary one.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    shared_dir(spark)
    if hasattr(spark, "_filament_scratch"):
        clean_scratch(spark, unused=True)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_filament_dir", None)
        if named is None:
            folder = tempfile.mkdtemp(prefix="filament-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            named = "file://" + folder
            spark._filament_dir = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/filament/{what}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it goes with the intermediate tables at the end of the process, or by clean_scratch()."""
    _begin(spark)
    path = scratch_path(spark, what)
    spark._filament_scratch[path] = None
    return path


def _begin(spark: SparkSession) -> None:
    if not hasattr(spark, "_filament_scratch"):
        spark._filament_scratch = {}
        atexit.register(_at_end, spark)


def clean_scratch(spark: SparkSession, unused: bool = False) -> int:
    """Delete the intermediate tables of this session, or only those that no result refers to any more; how many there were."""
    held = getattr(spark, "_filament_scratch", {})
    gone = [path for path, used in held.items() if not unused or (used is not None and used.get() is None)]
    for path in gone:
        deleted(spark, path)
        del held[path]
    return len(gone)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that are there, the newest last."""
    return list(getattr(spark, "_filament_scratch", {}))


def persisted(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table (in folders by some columns) in the shared folder and read it back: it outlives lost executors.

    The table is deleted once nothing refers to it: its file index is held weakly, results
    that read the table hold it through their plans, and each later call (and the end of the
    process) deletes the tables whose index is gone.
    """
    spark = df.sparkSession
    _begin(spark)
    clean_scratch(spark, unused=True)
    path = scratch_path(spark, what)
    spark._filament_scratch[path] = None
    return tied(written(df, path, by), path)


def tied(df: DataFrame, path: str) -> DataFrame:
    """A table that was read, whose intermediate folder goes when nothing refers to the table any more."""
    spark = df.sparkSession
    spark._filament_scratch[path] = spark._jvm.java.lang.ref.WeakReference(df._jdf.queryExecution().analyzed().relation().location())
    return df


def written(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df at a path and read it back. With by, only the folders that df has rows of are replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(spark: SparkSession) -> None:
    try:
        clean_scratch(spark)
    except Exception:  # the session was stopped before
        pass


def once(spark: SparkSession, what: str, folder: str, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from tables of a folder, written once a session; made anew if one of their files changes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    state = []
    for t in tables:
        path = hadoop.Path(f"{folder}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        state += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in [fs.getFileStatus(path), *fs.listStatus(path)])
    kept = spark.__dict__.setdefault("_filament_once", {})
    if (what, folder) not in kept or kept[what, folder][0] != state or kept[what, folder][2] not in scratch_tables(spark):
        df = persisted(make(), what)
        kept[what, folder] = (state, df, scratch_tables(spark)[-1])
    return kept[what, folder][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def fold_key(c: Column) -> Column:
    """A key without surrounding white space and letter case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""))
