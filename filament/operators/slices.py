"""Slices of a table replaced, upserted and updated without mutable rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_slice(slice_of: dict[str, str | None]) -> Column:
    """Whether a row is in a slice (dotted column -> value); None means that the column has no value."""
    inside = F.lit(True)
    for c, v in slice_of.items():
        inside = inside & (F.col(c).isNull() if v is None else F.coalesce(F.col(c) == v, F.lit(False)))
    return inside


def replace_slice(old: DataFrame, new: DataFrame, slice_of: dict[str, str | None]) -> DataFrame:
    """old without the rows of a slice, and the new rows."""
    return old.where(~in_slice(slice_of)).unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def stamp(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """df with values set where a condition holds."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def write_slices(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the slices that df has rows of; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_slice(spark, path: str, slice_of: dict[str, str]) -> bool:
    """Remove a slice's folder: what a clean load without rows does. False if there is none."""
    part = "/".join(f"{k}={v}" for k, v in slice_of.items())
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path) and fs.delete(jvm_path, True))


def changes_between(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change): keys that were added, dropped or updated (any of columns differs) from old to new; keys are unique."""
    a = old.select(*keys, F.struct(*columns).alias("_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("dropped")).when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("updated"))
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str) -> str:
    """Write df as a new version under path and make it the current one by an atomic rename; readers need no lock.

    A run that fails leaves an unnamed folder that is deleted, and the version before in place.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{path}/{version}")
    except Exception:
        p, fs = _fs(spark, f"{path}/{version}")
        fs.delete(p, True)
        raise
    p, fs = _fs(spark, f"{path}/_next-{version}")
    out = fs.create(p, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    replace = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    full = fs.makeQualified(p)
    hadoop.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()).rename(full, fs.makeQualified(_fs(spark, f"{path}/CURRENT")[0]), replace)
    return version


def move(spark, source: str, target: str) -> None:
    """Rename a file into a folder that is made if it is not there."""
    old, fs = _fs(spark, source)
    new, _ = _fs(spark, target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{source} cannot be moved")


def replace_folder(spark, part: str, path: str) -> None:
    """Put a folder in place of another one: the old one steps aside, and comes back if the new one cannot take its place."""
    new, fs = _fs(spark, part)
    target, _ = _fs(spark, path)
    aside, _ = _fs(spark, f"{part}-old")
    had = fs.exists(target)
    fs.mkdirs(target.getParent())
    if had and not fs.rename(target, aside):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(new, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"{path} cannot be written")
    if had:
        fs.delete(aside, True)


#: Seconds after which a lock whose owner has not refreshed it may be taken over.
LOCK_STALE = 3600.0


class Lock:
    """A lock that one owner at a time holds, as a file that is made by an exclusive create; a stale one is taken over.

    Of several who find it stale one takes it: the stale file is renamed first, which only one can do.
    """

    def __init__(self, spark, path: str, owner: str, stale: float = LOCK_STALE) -> None:
        self.path, self.fs = _fs(spark, path)
        self.owner, self.stale = owner, stale

    def _write(self, overwrite: bool) -> None:
        out = self.fs.create(self.path, overwrite)
        out.write(bytearray(self.owner.encode()))
        out.close()

    def holder(self) -> str | None:
        """The owner, None if nobody holds it."""
        if not self.fs.exists(self.path):
            return None
        data = self.fs.open(self.path)
        text = bytes(data.readAllBytes()).decode()
        data.close()
        return text

    def acquire(self, now: float | None = None) -> bool:
        """Take the lock; False if another owner holds it and was there less than stale seconds ago."""
        if self.holder() == self.owner:
            return self.refresh()
        if self.fs.exists(self.path):
            age = (time.time() if now is None else now) - self.fs.getFileStatus(self.path).getModificationTime() / 1000
            if age <= self.stale:
                return False
            aside = self.path.suffix(f"-{uuid.uuid4().hex}")
            if not self.fs.rename(self.path, aside):
                return False
            self.fs.delete(aside, False)
        try:
            self._write(False)
        except Exception:  # another owner was faster
            return False
        return self.holder() == self.owner

    def refresh(self) -> bool:
        """Keep the lock from growing stale; False if it is no longer held."""
        if self.holder() != self.owner:
            return False
        self._write(True)
        return True

    def release(self) -> bool:
        """Give the lock back; False if it was not held."""
        return self.holder() == self.owner and bool(self.fs.delete(self.path, False))


def read_current(spark, path: str) -> DataFrame:
    """The version that is current when this is called; it stays readable while later ones are published."""
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def write_clustered(df: DataFrame, path: str, by: str, key: str, filters: tuple[str, ...] = ()) -> None:
    """Parquet in place of indexes: partitions by one column, rows in order of key (row-group statistics), Bloom filters on further columns."""
    # ranges of both columns, so that one large partition is written by many tasks
    writer = df.repartitionByRange(by, key).sortWithinPartitions(by, key).write.mode("overwrite").partitionBy(by)
    for c in filters:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
