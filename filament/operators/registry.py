"""Entity registries: the first copy of a key holds, later copies that differ are conflicts.

Copies are rows with an order and a stub flag (a stub names a key without knowing its
attributes). Kept is the first real copy, else the first stub. Every real copy after the
kept one that differs in a column is a conflict; stubs are never compared.

Equal copies may come counted, as one row with their number (_n) and the first one's order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filament.operators.ordered import first_wins


@dataclass(frozen=True)
class Registry:
    """copies: keys, columns, ord and stub of one table; _n, how many equal ones a row stands for, if they are counted. each: then gives the copies one by one."""

    name: str
    copies: DataFrame
    keys: tuple[str, ...]
    each: Callable[[], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.copies.columns if c not in (*self.keys, "ord", "stub", "_n")]

    @property
    def _number(self) -> Column:
        return F.coalesce(F.sum("_n"), F.lit(0)) if "_n" in self.copies.columns else F.count("*")

    def rows(self) -> DataFrame:
        """The kept copy of each key."""
        return first_wins(self.copies, list(self.keys), ["stub", "ord"]).drop("ord", "stub", "_n")

    def _compared(self) -> DataFrame:
        """Real copies after the first, with the first one's columns beside theirs. The first ones are joined, so a hot key's copies stay spread."""
        real = self.copies.where(~F.col("stub"))
        first = first_wins(real, list(self.keys), ["ord"])
        kept = first.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), F.col("ord").alias("_first"), F.struct(*self.columns).alias("_kept"))
        cond = F.col("ord") > F.col("_first")
        for i, k in enumerate(self.keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return real.join(kept, cond).drop(*(f"_k{i}" for i in range(len(self.keys))))

    def _differs(self) -> Column:
        return ~F.struct(*self.columns).eqNullSafe(F.col("_kept"))

    def conflicts(self) -> DataFrame:
        """(table_name, conflicts): how many real copies differ from the kept one."""
        return self._compared().where(self._differs()).agg(F.lit(self.name).alias("table_name"), self._number.alias("conflicts"))

    def conflict_samples(self, most: int = 1000) -> DataFrame:
        """(table_name, natural_key, column_name, kept_value, discarded_value) of the first most differing columns, by order."""
        if self.each:
            return replace(self, copies=self.each(), each=None).conflict_samples(most)
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_kept.{c}").cast("string").alias("kept_value"), F.col(c).cast("string").alias("discarded_value"), (~F.col(c).eqNullSafe(F.col(f"_kept.{c}"))).alias("differs")) for c in self.columns))
        rows = self._compared().select(F.concat_ws("|", *(F.col(k).cast("string") for k in self.keys)).alias("natural_key"), "ord", F.posexplode(pairs).alias("nth", "x"))
        found = rows.where("x.differs").orderBy("ord", "natural_key", "nth").limit(most)
        return found.select(F.lit(self.name).alias("table_name"), "natural_key", "x.column_name", "x.kept_value", "x.discarded_value")

    def summary(self) -> DataFrame:
        """(table_name, rows, conflicts, stubs_created, stubs_surviving) in one row.

        Equal copies are counted together first, so that a hot key's copies are few rows
        before they meet; what differs from the first real copy is all real copies but its equals.
        """
        value = F.struct(*self.columns) if self.columns else F.lit(0)
        real = lambda c: F.when(~F.col("stub"), c)
        same = self.copies.withColumn("_value", value).groupBy(*self.keys, "stub", "_value").agg(self._number.alias("n"), F.min("ord").alias("first"))
        per_key = same.groupBy(*self.keys).agg(
            F.coalesce(F.sum(real(F.col("n"))), F.lit(0)).alias("reals"),
            F.coalesce(F.min_by(real(F.col("n")), real(F.col("first"))), F.lit(0)).alias("kept"),
            F.min_by("stub", "first").alias("stub_first"),
        )
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return per_key.agg(
            F.lit(self.name).alias("table_name"),
            F.count("*").alias("rows"),
            total(F.col("reals") - F.col("kept")).alias("conflicts"),
            F.count(F.when(F.col("stub_first"), 1)).alias("stubs_created"),
            F.count(F.when(F.col("reals") == 0, 1)).alias("stubs_surviving"),
        )

    def two_submissions(self, submission: str = "submission") -> DataFrame:
        """Keys that occur under more than one submission, stubs included."""
        n = F.count_distinct(submission)
        return self.copies.groupBy(*self.keys).agg(n.alias("submissions")).where("submissions > 1")

    def stubs_created(self) -> DataFrame:
        """(stubs_created): keys whose first copy is a stub."""
        return first_wins(self.copies, list(self.keys), ["ord"]).where("stub").agg(F.count("*").alias("stubs_created"))

    def stubs_surviving(self) -> DataFrame:
        """(stubs_surviving): keys without a real copy."""
        return self.copies.groupBy(*self.keys).agg(F.bool_and("stub").alias("only")).where("only").agg(F.count("*").alias("stubs_surviving"))
