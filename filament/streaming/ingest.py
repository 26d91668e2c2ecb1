"""Micro-batch ingest of metadata files into slices of a table.

Each slice (phase) is read as a stream of its files into a folder beside the table, a part a
micro-batch, so that a batch that is run again replaces itself. When the stream has ended the
folder takes the slice's place as a whole, or the slice is cleared if there were no rows. A
phase that fails leaves its slice as it was, keeps its error and does not stop the others.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from filament.operators.slices import Lock, drop_slice, move, replace_folder
from filament.runtime import children, deleted, shared_dir


@dataclass
class Phase:
    """stream: its rows as a streaming DataFrame; slice_of: the partition columns' values."""

    name: str
    stream: Callable[[SparkSession], DataFrame]
    slice_of: dict[str, str]


@dataclass
class PhaseResult:
    name: str
    rows: int = 0
    error: str | None = None


def ingest(spark: SparkSession, phases: list[Phase], path: str, budget_s: float = 3600.0) -> list[PhaseResult]:
    """Run the phases in order under one time budget, and report each; raises after the last one if any failed."""
    end, out = time.monotonic() + budget_s, []
    for phase in phases:
        result = PhaseResult(phase.name)
        out.append(result)
        try:
            left = end - time.monotonic()
            if left <= 0:
                raise TimeoutError("the time for all phases is spent")
            _run(spark, phase, path, left, result)
        except Exception as e:
            result.error = f"{type(e).__name__}: {e}"[:1024]
    failed = [r for r in out if r.error]
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(out)} phases failed, first {failed[0].name}: {failed[0].error}")
    return out


def synchronise(spark: SparkSession, centres: dict[str, list[Phase]], path: str, owner: str, budget_s: float = 3600.0) -> dict[str, str | None]:
    """Ingest centre by centre in the order given, under one lock and time budget; the error of each, None if it went well.

    A centre that fails does not stop those after it. RuntimeError if another owner holds the lock.
    """
    lock = Lock(spark, f"{path}/_sync-lock", owner)
    if not lock.acquire():
        raise RuntimeError(f"{path} is being synchronised by {lock.holder()}")
    end, out = time.monotonic() + budget_s, {}
    try:
        for name, phases in centres.items():
            try:
                ingest(spark, phases, path, end - time.monotonic())
                out[name] = None
            except Exception as e:
                out[name] = f"{type(e).__name__}: {e}"[:1024]
            lock.refresh()
    finally:
        lock.release()
    return out


def _run(spark: SparkSession, phase: Phase, path: str, seconds: float, result: PhaseResult) -> None:
    part = "/".join(f"{k}={v}" for k, v in phase.slice_of.items())

    stage = f"{path}/_ingest-{uuid.uuid4().hex}"  # readers of the table pass over names that begin so
    checkpoint = f"{shared_dir(spark)}/ingest/{phase.name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stage}/batch-{n}")

    try:
        query = phase.stream(spark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(int(seconds) + 1):
            query.stop()
            raise TimeoutError(f"{phase.name} took longer than {seconds:.0f} s")
        parts = [f"{stage}/{n}" for n in children(spark, stage)]
        result.rows = spark.read.parquet(*parts).count() if parts else 0
        if not result.rows:
            drop_slice(spark, path, phase.slice_of)
            return
        whole = f"{stage}/whole"
        for i, p in enumerate(parts):
            for name in children(spark, p):
                if name.endswith(".parquet"):
                    move(spark, f"{p}/{name}", f"{whole}/{i}-{name}")
        replace_folder(spark, whole, f"{path}/{part}")
    finally:
        deleted(spark, stage)
        deleted(spark, checkpoint)
