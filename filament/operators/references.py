"""Orphan references: keys that name no record of another table in the load concerned.

References are pre-aggregated by key and load, so a key that holds a third of all rows is a
few rows before anything is shuffled on it. The keys are anti-joined with the records they
may name, and the orphan keys lead back to their rows: heavy ones through a broadcast (their
number is bounded, see HEAVY_SHARE), the others through a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filament.runtime import fold_key, is_blank, persisted

#: A key with more than this share of all references is heavy. At most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.001
#: Keys with no more references than this are never heavy.
HEAVY_LEAST = 1_000


@dataclass(frozen=True)
class Target:
    """Records that may be named: a key of one or two columns, valid from load_no until removed_load_no."""

    name: str
    df: DataFrame
    key: str
    namespace: str | None = None


@dataclass(frozen=True)
class Reference:
    """A field of a table whose text names a record of a target; with the namespace column beside it if the target has one."""

    table_name: str
    df: DataFrame
    field: str
    target: Target
    namespace: str | None = None

    @property
    def label(self) -> str:
        return f"{self.table_name}.{self.field}"


def _rows(refs: list[Reference]) -> DataFrame:
    """(label, load_no, row_id, ns, key, named) of each reference that is not blank, keys folded; each table is read once."""
    out = None
    for df in dict.fromkeys(r.df for r in refs):
        own = [r for r in refs if r.df is df]
        long = df.select(
            F.col("load_no").cast("int").alias("load_no"),
            F.col("row_id").cast("long").alias("row_id"),
            F.explode(
                F.array(
                    *(
                        F.struct(
                            F.lit(r.label).alias("label"),
                            (F.col(r.namespace).cast("string") if r.namespace else F.lit("")).alias("ns"),
                            F.col(r.field).cast("string").alias("key"),
                        )
                        for r in own
                    )
                )
            ).alias("x"),
        ).select("load_no", "row_id", "x.*")
        rows = long.where(~is_blank(F.col("key"))).select("label", "load_no", "row_id", fold_key(F.col("ns")).alias("ns"), fold_key(F.col("key")).alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _targets(refs: list[Reference]) -> DataFrame:
    """(label, ns, key, since, until), one row a key and span of loads."""
    out = None
    for r in refs:
        t = r.target
        rows = t.df.where(~is_blank(F.col(t.key))).select(
            F.lit(r.label).alias("label"),
            (fold_key(F.col(t.namespace)) if t.namespace else F.lit("")).alias("ns"),
            fold_key(F.col(t.key)).alias("key"),
            F.col("load_no").cast("int").alias("since"),
            F.col("removed_load_no").cast("int").alias("until"),
        )
        rows = rows.where(F.col("ns").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _checked_keys(refs: list[Reference]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All references by row; (label, load_no, ns, key, n, heavy) of the orphan keys; the same of all keys."""
    rows = _rows(refs)
    keys = persisted(rows.groupBy("label", "load_no", "ns", "key").agg(F.count("*").alias("n")), "reference-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    keys = keys.withColumn("heavy", F.col("n") > F.lit(max(HEAVY_LEAST, int(total * HEAVY_SHARE))))
    targets = _targets(refs)

    def orphans(k: DataFrame, t: DataFrame) -> DataFrame:
        k, t = k.alias("k"), t.alias("t")
        return k.join(
            t,
            (F.col("k.label") == F.col("t.label"))
            & (F.col("k.ns") == F.col("t.ns"))
            & (F.col("k.key") == F.col("t.key"))
            & (F.col("t.since") <= F.col("k.load_no"))
            & (F.col("t.until").isNull() | (F.col("t.until") > F.col("k.load_no"))),
            "left_anti",
        )

    # heavy keys, bounded in number, go to the targets; the others are shuffled to them
    few = F.broadcast(keys.where("heavy").select("label", "ns", "key").distinct())
    heavy = orphans(keys.where("heavy"), targets.join(few, ["label", "ns", "key"], "left_semi"))
    light = orphans(keys.where("not heavy"), targets)
    return rows, persisted(heavy.unionByName(light), "orphan-keys"), keys


def orphan_references(refs: list[Reference]) -> DataFrame:
    """(table_name, field_name, load_no, row_id) of each reference that names no record.

    A reference is orphan if its field is not blank and no record of the target with that
    key has load_no <= the reference's and removed_load_no null or greater than it. Letter
    case and surrounding white space do not count; a null namespace, and a null load_no,
    matches nothing. Repeated rows are each reported. Empty tables: an empty referring
    table has no orphans, with an empty target all references are orphans.
    """
    rows, orphans, keys = _checked_keys(refs)
    of = ["label", "load_no", "ns", "key"]

    def on(a: str, b: str) -> list:
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) if c == "load_no" else F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in of]

    lost = orphans.where("heavy").select(*of, F.lit(True).alias("lost"))
    hot = keys.where(F.col("heavy") & F.col("ns").isNotNull()).alias("k").join(F.broadcast(lost).alias("l"), on("k", "l"), "left")
    hot = hot.select("k.label", "k.load_no", "k.ns", "k.key", F.coalesce("l.lost", F.lit(False)).alias("lost"))

    nameless = rows.where(F.col("ns").isNull())
    named = rows.where(F.col("ns").isNotNull()).alias("a").join(F.broadcast(hot).alias("h"), on("a", "h"), "left").select("a.*", "h.lost")
    light = orphans.where(~F.col("heavy") & F.col("ns").isNotNull()).select(*of)
    rest = named.where(F.col("lost").isNull()).alias("r").join(light.alias("o"), on("r", "o"), "left_semi")
    found = nameless.unionByName(named.where("lost").drop("lost")).unionByName(rest.drop("lost"))
    names = F.split("label", r"\.", 2)
    return found.select(names[0].alias("table_name"), names[1].alias("field_name"), "load_no", "row_id")


def orphan_counts(refs: list[Reference]) -> DataFrame:
    """(table_name, field_name, load_no, orphan_references, orphan_keys) by table, field and load, from the pre-aggregated keys."""
    _, orphans, _ = _checked_keys(refs)
    names = F.split("label", r"\.", 2)
    return (
        orphans.groupBy("label", "load_no")
        .agg(F.sum("n").alias("orphan_references"), F.count("*").alias("orphan_keys"))
        .select(names[0].alias("table_name"), names[1].alias("field_name"), "load_no", "orphan_references", "orphan_keys")
    )
