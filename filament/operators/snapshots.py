"""What was added, removed or changed between consecutive full snapshots.

Every key has an ordinal that it keeps. A snapshot is a compressed bitmap of ordinals, cut
into chunks, beside column vectors aligned with the bitmap: bitmap AND-NOT gives additions
and removals, comparing the vectors gives the changes among common keys. The last snapshot's
bitmaps and vectors are kept, so the next snapshot is all that has to be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filament.runtime import children, is_blank, persisted, written

#: Ordinals in a chunk; a task holds one chunk of two snapshots at a time, however many there are.
CHUNK_BITS = 15
#: Ordinals from which a container is a bitset instead of a sorted array.
DENSE = 1 << (CHUNK_BITS - 4)


class Bitmap:
    """A chunk's set of ordinals: a sorted uint16 array while sparse, packed bits when dense."""

    __slots__ = ("array", "bits")

    def __init__(self, ordinals: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        if bits is None and len(ordinals) < DENSE:
            self.array, self.bits = np.unique(ordinals).astype(np.uint16), None
        elif bits is None:
            flags = np.zeros(1 << CHUNK_BITS, bool)
            flags[ordinals] = True
            self.array, self.bits = None, np.packbits(flags)
        else:
            self.array, self.bits = None, bits

    def ordinals(self) -> np.ndarray:
        return self.array if self.bits is None else np.flatnonzero(np.unpackbits(self.bits)).astype(np.uint16)

    def packed(self) -> bytes:
        """The set as bytes: packed bits if dense, else the sorted array."""
        return (b"b" + self.bits.tobytes()) if self.bits is not None else (b"a" + self.array.tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Bitmap:
        if data[:1] == b"b":
            return cls(bits=np.frombuffer(data, np.uint8, offset=1))
        return cls(np.frombuffer(data, np.uint16, offset=1))

    def __contains_all(self, ordinals: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.isin(ordinals, self.array, assume_unique=True)
        return (self.bits[ordinals >> 3] >> (7 - (ordinals & 7)) & 1).astype(bool)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """Ordinals of this set that other lacks."""
        if self.bits is not None and other.bits is not None:
            return Bitmap(bits=self.bits & ~other.bits).ordinals()
        own = self.ordinals()
        return own[~other.__contains_all(own)]

    def both(self, other: Bitmap) -> np.ndarray:
        if self.bits is not None and other.bits is not None:
            return Bitmap(bits=self.bits & other.bits).ordinals()
        own = self.ordinals()
        return own[other.__contains_all(own)]


def text_value(c: Column) -> Column:
    """A text as it is compared: trimmed, without letter case; null for any blank."""
    return F.when(~is_blank(c), F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")))


def number_value(c: Column) -> Column:
    """A number as it is compared, however written (sign, leading zeros, groups of thousands, decimals, exponent); null for none."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    grouped = t.rlike(r"^[+-]?\d{1,3}([, _  ]\d{3})+(\.\d*)?\z")
    plain = F.when(grouped, F.regexp_replace(t, "[, _  ]", "")).otherwise(t)
    exact = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?\z"), plain.try_cast("decimal(38,6)").cast("string"))
    return exact


@dataclass
class Chunk:
    """A chunk's way through the snapshots: bitmap and vectors of the last one, and the places that changed."""

    number: int
    width: int
    loads: list[int]  # the snapshots in order; the first one is what the others are compared with
    at: int = -1
    bitmap: Bitmap | None = None
    vectors: list[np.ndarray] = field(default_factory=list)
    out: list[tuple[int, str, np.ndarray]] = field(default_factory=list)

    def snapshot(self, load: int, low: np.ndarray, digests: list[np.ndarray]) -> None:
        """Take the chunk's keys in a snapshot; those between it and the last one taken have none."""
        self.until(self.loads.index(load))
        now, vectors = Bitmap(low), []
        for d in digests:
            v = np.zeros(1 << CHUNK_BITS, np.int64)
            v[low] = d
            vectors.append(v)
        if self.bitmap is not None:
            common = now.both(self.bitmap)
            differ = np.zeros(len(common), bool)
            for x, y in zip(self.vectors, vectors, strict=True):
                differ |= x[common] != y[common]
            self.out += [(load, "added", now.and_not(self.bitmap)), (load, "removed", self.bitmap.and_not(now)), (load, "changed", common[differ])]
        self.at, self.bitmap, self.vectors = self.at + 1, now, vectors

    def until(self, stop: int) -> None:
        """Go on to a snapshot through those in which the chunk has no key."""
        none = np.zeros(0, np.uint16)
        while self.at + 1 < stop:
            self.snapshot(self.loads[self.at + 1], none, [np.zeros(0, np.int64)] * self.width)

    def end(self) -> Iterator[tuple]:
        """Rows of STEP: the changes, and the last snapshot's state."""
        self.until(len(self.loads))
        for load, kind, places in self.out:
            if len(places):
                yield self.number, load, kind, places.astype(np.int32), None, None
        own = self.bitmap.ordinals()
        yield self.number, self.loads[-1], STATE, None, self.bitmap.packed(), [v[own].tobytes() for v in self.vectors]


STATE = "state"
STEP = "chunk long, load int, change_kind string, places array<int>, bitmap binary, vectors array<binary>"
_STEP = pa.schema([("chunk", pa.int64()), ("load", pa.int32()), ("change_kind", pa.string()), ("places", pa.list_(pa.int32())), ("bitmap", pa.binary()), ("vectors", pa.list_(pa.binary()))])


def _steps(rows: DataFrame, width: int, loads: list[int]) -> DataFrame:
    """STEP of (chunk, load, low, d0, …): each task goes through its chunks one after another, and through each one's snapshots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk | None = None
        pending: list[list[np.ndarray]] = []  # of the snapshot that is being read
        load = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STEP, strict=True)], schema=_STEP)

        def taken() -> None:
            low, *digests = (np.concatenate(x) for x in zip(*pending, strict=True))
            chunk.snapshot(load, low, digests)
            pending.clear()

        for batch in batches:
            of, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = [batch.column(i).to_numpy() for i in range(2, 3 + width)]
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1])) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(of)), strict=True):
                if a == b:
                    continue
                if pending and (of[a] != chunk.number or at[a] != load):
                    taken()
                if chunk is None or of[a] != chunk.number:
                    if chunk is not None:
                        yield table(list(chunk.end()))
                    chunk = Chunk(int(of[a]), width, loads)
                load = int(at[a])
                pending.append([v[a:b] for v in values])
        if chunk is not None:
            taken()
            yield table(list(chunk.end()))

    return rows.repartition("chunk").sortWithinPartitions("chunk", "load").mapInArrow(run, STEP)


def _state_rows(states: DataFrame, width: int) -> DataFrame:
    """(chunk, load, low, d0, …) of kept states."""
    schema = pa.schema([("chunk", pa.int64()), ("load", pa.int32()), ("low", pa.int32()), *((f"d{i}", pa.int64()) for i in range(width))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low = Bitmap.unpacked(r["bitmap"]).ordinals().astype(np.int32)
                columns = [np.full(len(low), r["chunk"]), np.full(len(low), r["load"], np.int32), low, *(np.frombuffer(v, np.int64) for v in r["vectors"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = ", ".join(f"d{i} long" for i in range(width))
    return states.select("chunk", "load", "bitmap", "vectors").mapInArrow(read, f"chunk long, load int, low int, {kinds}")


class Kept:
    """Ordinals and last snapshot of a table in a folder: for each version the ordinals it gave out and the steps it took."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """The snapshots up to which each version goes; one that was cut off has no steps and does not count."""
        return sorted(int(n.removeprefix("upto=")) for n in children(self.spark, self.path) if "_SUCCESS" in children(self.spark, f"{self.path}/{n}/steps"))

    def ordinals(self, kinds: str) -> DataFrame | None:
        paths = [f"{self.path}/upto={n}/ordinals" for n in self.versions()]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else None


def snapshot_changes(df: DataFrame, key: list[str], values: dict[str, Column], load: str = "load_no", last_by: tuple[str, ...] = ("received_at", "row_id"), kept: str | None = None) -> DataFrame:
    """(key..., load, change_kind): added, removed and changed keys between consecutive loads present.

    values: the compared columns by name, as expressions that give equal results for what is
    no change; null equals null. Of several rows of a key in a load the last by last_by holds,
    nulls first. Null key parts make a key like any other. Rows without a load are left out.
    The load is the later one's; the first load has no changes. An empty table has none.

    kept: folder in which ordinals and the last snapshot are kept. Snapshots up to the last
    one there are not read again; the result has the changes of the new ones, the first of
    them against the kept one. Without a folder all snapshots are new. A call that was cut
    off leaves the folder as it was; two calls must not write to one folder at a time.

    Values are compared as 64-bit digests in vectors, each only with the same key's next one.
    """
    spark, width = df.sparkSession, len(values)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    store = Kept(spark, kept) if kept else None
    last = max(store.versions(), default=None) if store else None
    df = df.where(F.col(load).isNotNull() if last is None else F.col(load) > last)
    loads = sorted(r[0] for r in df.select(F.col(load).cast("int")).distinct().collect())  # as many as deliveries
    if not loads:
        return spark.createDataFrame([], f"{names}, `{load}` int, change_kind string")
    keep = (lambda x, what: persisted(x, what)) if kept is None else (lambda x, what: written(x, f"{kept}/upto={loads[-1]}/{what}"))

    # one row a key with what it has in each new snapshot; keys without an ordinal come first in each partition
    digests = [F.xxhash64(F.lit(i), v, v.isNull()) for i, v in enumerate(values.values())]
    latest = df.groupBy(*key, F.col(load).cast("int").alias("_load")).agg(F.max(F.struct(*last_by, F.array(*digests).alias("_digests"))).getField("_digests").alias("_digests"))
    per_key = latest.groupBy(*key).agg(F.collect_list(F.struct("_load", "_digests")).alias("_snaps"))
    known = store.ordinals(f"{names}, ordinal long") if last is not None else None
    if known is None:
        per_key = per_key.withColumn("_known", F.lit(None).cast("long"))
    else:
        a, b = per_key.alias("a"), known.alias("b")
        per_key = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "left").select("a.*", F.col("b.ordinal").alias("_known")).sortWithinPartitions(F.col("_known").isNotNull())
    per_key = persisted(per_key.withColumn("_place", F.monotonically_increasing_id()), "snapshot-keys")

    # new ordinals continue the kept ones without a gap
    first = known.agg(F.max("ordinal")).first()[0] + 1 if known is not None and not known.isEmpty() else 0
    fresh = per_key.where(F.col("_known").isNull())
    task, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in fresh.groupBy(task.alias("task")).agg(F.max(row) + 1).collect())  # as many as tasks
    upto = np.cumsum([first, *(n for _, n in sizes)]).tolist()
    begins = spark.createDataFrame([(t, b) for (t, _), b in zip(sizes, upto, strict=False)], "_task long, _begin long")
    placed = per_key.join(F.broadcast(begins), task == F.col("_task"), "left").withColumn("ordinal", F.coalesce("_known", F.col("_begin") + row))
    given = keep(placed.where(F.col("_known").isNull()).select(*key, "ordinal"), "ordinals")

    rows = placed.select("ordinal", F.explode("_snaps").alias("s"))
    chunk, low = F.shiftright("ordinal", CHUNK_BITS).alias("chunk"), F.col("ordinal").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("low")
    rows = rows.select(chunk, F.col("s._load").alias("load"), low, *(F.col("s._digests")[i].alias(f"d{i}") for i in range(width)))
    if last is not None:
        before = spark.read.schema(STEP).parquet(f"{kept}/upto={last}/steps").where(F.col("change_kind") == STATE)
        rows = rows.unionByName(_state_rows(before, width))
    steps = keep(_steps(rows, width, loads if last is None else [last, *loads]), "steps")

    changes = steps.where(F.col("change_kind") != STATE).select("chunk", "load", "change_kind", F.explode("places").alias("place"))
    changes = changes.select((F.shiftleft("chunk", CHUNK_BITS) + F.col("place")).alias("ordinal"), F.col("load").alias(load), "change_kind")
    every = given if known is None else known.unionByName(given)
    return changes.join(every, "ordinal").select(*key, load, "change_kind")
