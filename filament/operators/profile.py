"""Column profiles by load from maintained value counts.

What is kept of a column is a table of its values with their counts, and the metrics of each
load. A load is counted once; the signed differences from the kept counts are its deltas, and
the counts plus these deltas are the counts to keep. Null rates, distinct counts, ranges,
medians, entropy, pattern violations and distribution changes are exact functions of a
load's counts and deltas, so the rows of a load are never read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filament.runtime import children, deleted, is_blank, persisted, scratch_folder, tied, written


@dataclass(frozen=True)
class ProfiledColumn:
    """A text or (numeric=True) whole-number column; terms: its accepted texts, none meaning any."""

    table_name: str
    df: DataFrame
    column: str
    numeric: bool = False
    terms: DataFrame | None = None  # one column, term


RANGE = (0, 10**15)
_OF = ["table_name", "column_name", "value"]
_BY = ["table_name", "column_name", "load_no"]
#: What is kept of a load: every value that it or the load before has, how often the load has it, and how many more than the load before.
COUNTS = "column_name string, value string, n long, delta long, load_no int, table_name string"
METRICS = (
    "column_name string, prior_load_no int, numeric boolean, rows long, blanks long, distinct_values long, violations long, low long, high long, entropy double, shift double, median double, load_no int, table_name string"
)


def value_counts(cols: list[ProfiledColumn], after: dict[str, int] | None = None) -> DataFrame:
    """(table_name, column_name, load_no, value, n): how often each value occurs in each load; value null for blanks.

    after: by table, the load after which loads are counted. Blank texts count as one null
    value; rows with a null load_no belong to no load. Each table is read once, for all its columns.
    """
    out = None
    for df in dict.fromkeys(c.df for c in cols):
        own = [c for c in cols if c.df is df]
        last = (after or {}).get(own[0].table_name)
        rows = df.where(F.col("load_no").isNotNull() if last is None else F.col("load_no") > last)

        def text(c: ProfiledColumn) -> Column:
            raw = F.col(c.column).cast("string")
            return raw if c.numeric else F.when(~is_blank(raw), raw)

        pairs = F.array(*(F.struct(F.lit(c.column).alias("column_name"), text(c).alias("value")) for c in own))
        long = rows.select(F.lit(own[0].table_name).alias("table_name"), F.col("load_no").cast("int").alias("load_no"), F.explode(pairs).alias("x")).select("table_name", "load_no", "x.*")
        counts = long.groupBy("table_name", "column_name", "load_no", "value").agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def applied(kept: DataFrame | None, counts: DataFrame) -> DataFrame:
    """(table_name, column_name, value, n, delta): the counts to keep after a load, and its signed deltas.

    kept: the counts before, in the same form (None before the first load). counts: those of
    the load. A value that the load no longer has stays with n = 0 and its negative delta
    until the next load.
    """
    signed = counts.select(*_OF, F.lit(0).cast("long").alias("before"), F.col("n").alias("delta"))
    if kept is not None:
        signed = signed.unionByName(kept.where("n <> 0").select(*_OF, F.col("n").alias("before"), (-F.col("n")).alias("delta")))
    sums = signed.groupBy(*_OF).agg(F.sum("before").alias("before"), F.sum("delta").alias("delta"))
    return sums.select(*_OF, (F.col("before") + F.col("delta")).alias("n"), "delta")


class Kept:
    """Counts and metrics of a set of columns in a folder, by load and table. Two calls must not write to one folder at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def loads(self) -> dict[str, list[int]]:
        """Loads whose metrics are there, by table."""
        out: dict[str, list[int]] = {}
        for load in children(self.spark, f"{self.path}/metrics"):
            if load.startswith("load_no="):
                for table in children(self.spark, f"{self.path}/metrics/{load}"):
                    out.setdefault(table.removeprefix("table_name="), []).append(int(load.removeprefix("load_no=")))
        return {t: sorted(n) for t, n in out.items()}

    def counts(self, table: str, load: int) -> DataFrame:
        at = f"{self.path}/counts"
        return self.spark.read.schema(COUNTS).option("basePath", at).parquet(f"{at}/load_no={load}/table_name={table}")

    def metrics(self) -> DataFrame:
        if not self.loads():
            return self.spark.createDataFrame([], METRICS)
        return self.spark.read.schema(METRICS).parquet(f"{self.path}/metrics")


def apply_loads(cols: list[ProfiledColumn], kept: Kept, only: int | None = None) -> DataFrame:
    """The kept metrics of all loads, after the loads that are new in the tables were applied one after another.

    Loads up to the last kept one of a table are taken as known; its rows are not read. All
    new loads are counted in one pass, then each is applied to the counts that the one before
    left. Of the counts only those of each table's last load stay. A call that was cut off
    leaves the kept loads as they were. only: apply this load alone; ValueError if it is not later than the kept ones.
    """
    known = kept.loads()
    if only is not None:
        if any(n >= only for c in cols for n in known.get(c.table_name, [])[-1:]):
            raise ValueError(f"load {only} is not later than the kept ones")
        one = {c.df: c.df.where(F.col("load_no") == only) for c in cols}
        cols = [ProfiledColumn(c.table_name, one[c.df], c.column, c.numeric, c.terms) for c in cols]
    counts = persisted(value_counts(cols, {t: n[-1] for t, n in known.items()}), "value-counts", ("load_no",))
    new: dict[int, list[str]] = {}
    for t, n in counts.select("table_name", "load_no").distinct().collect():  # as many as deliveries
        new.setdefault(n, []).append(t)
    last, prior = {t: n[-1] for t, n in known.items()}, []
    for load in sorted(new):
        before = None
        for t in new[load]:
            if t in last:
                part = kept.counts(t, last[t])
                before = part if before is None else before.unionByName(part)
            prior.append((t, load, last.get(t)))
            last[t] = load
        changes = applied(before, counts.where(F.col("load_no") == load)).withColumn("load_no", F.lit(load))
        written(changes, f"{kept.path}/counts", ("load_no", "table_name"))
    if new:
        at = f"{kept.path}/counts"
        every = kept.spark.read.schema(COUNTS).option("basePath", at).parquet(*(f"{at}/load_no={n}" for n in sorted(new)))
        written(_metrics(cols, every.where(_any_of(prior)), prior), f"{kept.path}/metrics", ("load_no", "table_name"))
        for t, n, m in prior:
            if m is not None and m != last[t]:
                deleted(kept.spark, f"{at}/load_no={m}/table_name={t}")
    return kept.metrics()


def _any_of(prior: list[tuple[str, int, int | None]]) -> Column:
    return F.concat_ws("/", "load_no", "table_name").isin([f"{n}/{t}" for t, n, _ in prior])


def medians(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., median): exact median of value, each taken n times; the mean of the two middle ones if there are two.

    counts: by..., value (long, 0 to RANGE[1]) and n. The middle ranks are found digit by digit in base 2^17 from the
    top, so that no step holds more than 2^17 buckets a group, however many values there are.
    """
    spark = counts.sparkSession
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in by)
    # ranks: of each group one or two, as want (the rank asked for), rank below prefix, and prefix; as few as groups, so the driver takes them
    ranks = [(*r[:-1], want, want, 0) for r in counts.groupBy(*by).agg(F.sum("n")).collect() for want in {(r[-1] + 1) // 2, r[-1] // 2 + 1}]
    for shift in (34, 17, 0):
        asked = F.broadcast(spark.createDataFrame(ranks, f"{kinds}, want long, rank long, prefix long"))
        own = counts.withColumn("prefix", F.shiftright("value", shift + 17)).withColumn("bucket", F.shiftright("value", shift))
        buckets = own.join(asked.select(*by, "prefix").distinct(), [*by, "prefix"]).groupBy(*by, "prefix", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        steps = buckets.withColumn("upto", F.sum("n").over(w)).join(asked, [*by, "prefix"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        ranks = [tuple(r) for r in steps.select(*by, "want", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.col("bucket").alias("prefix")).collect()]
    return spark.createDataFrame(ranks, f"{kinds}, want long, rank long, value long").groupBy(*by).agg(F.avg(F.col("value").cast("double")).alias("median"))


def _metrics(cols: list[ProfiledColumn], changes: DataFrame, prior: list[tuple[str, int, int | None]]) -> DataFrame:
    """METRICS of the loads of some changes; prior: table, load and the load before."""
    terms = None
    for c in cols:
        if c.terms is not None:
            own = c.terms.select(F.lit(c.table_name).alias("table_name"), F.lit(c.column).alias("column_name"), F.col("term").alias("value")).distinct()
            terms = own if terms is None else terms.unionByName(own)
    known = changes.withColumn("accepted", F.lit(None).cast("boolean"))
    if terms is not None:
        known = changes.join(terms.withColumn("accepted", F.lit(True)), _OF, "left")
    which = lambda p: F.concat_ws("/", "table_name", "column_name").isin([f"{c.table_name}/{c.column}" for c in cols if p(c)])
    known = known.withColumn("numeric", which(lambda c: c.numeric))
    number = F.when(F.col("numeric"), F.expr("try_cast(value as bigint)"))
    inside = number.between(*map(F.lit, RANGE))
    filled = F.col("value").isNotNull()
    violating = filled & F.when(F.col("numeric"), ~F.coalesce(inside, F.lit(False))).otherwise(which(lambda c: c.terms is not None) & F.col("accepted").isNull())
    n, there = F.col("n"), F.col("n") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base = known.groupBy(*_BY, "numeric").agg(
        F.sum("n").alias("rows"),
        total(F.when(~filled, n)).alias("blanks"),
        F.count(F.when(filled & there, 1)).alias("distinct_values"),
        total(F.when(violating, n)).alias("violations"),
        F.sum(F.when(filled & there, n * F.log2(n))).alias("nlogn"),
        F.min(F.when(there, number)).alias("low"),
        F.max(F.when(there, number)).alias("high"),
        total(F.when(filled, n - F.col("delta"))).alias("prior_filled"),
    )
    full = F.col("rows") - F.col("blanks")
    before = F.try_element_at(F.create_map(*(F.lit(x) for t, k, m in prior for x in (f"{k}/{t}", -1 if m is None else m))), F.concat_ws("/", "load_no", "table_name"))
    base = base.withColumns({"entropy": F.when(full > 0, F.log2(full) - F.col("nlogn") / full), "prior_load_no": F.nullif(before, F.lit(-1))}).drop("nlogn")
    base = persisted(base, "profile")  # a row a column and load

    totals = F.broadcast(base.where((full > 0) & (F.col("prior_filled") > 0)).select(*_BY, full.alias("filled"), "prior_filled"))
    moved = F.abs(F.col("n") / F.col("filled") - (F.col("n") - F.col("delta")) / F.col("prior_filled"))
    shift = changes.where(filled).join(totals, _BY).groupBy(*_BY).agg((F.sum(moved) / 2).alias("shift"))
    middle = medians(changes.withColumn("numeric", which(lambda c: c.numeric)).where(inside & there).select(*_BY, number.alias("value"), "n"), _BY)
    out = base.join(F.broadcast(shift), _BY, "left").join(F.broadcast(middle), _BY, "left")
    return out.select(*(f.split(" ")[0] for f in METRICS.split(", ")))


def profile(cols: list[ProfiledColumn], kept: str | None = None) -> DataFrame:
    """Exact metrics of each column in each load.

    (table_name, column_name, load_no, prior_load_no, numeric, rows, blanks, distinct_values,
    violations (texts that are no accepted term, numbers outside RANGE), entropy (bits, over
    the values that are not blank), low and high (numbers), median (of the numbers within
    RANGE) and shift (half the sum of absolute differences of the values' shares from the
    load before)). Blank texts and nulls are blanks. The first load has a null
    prior_load_no and shift; shift is null, too, where either load has only blanks. Rows
    with a null load_no belong to no load. Empty tables have no rows.

    kept: folder in which counts and metrics are kept from call to call, see apply_loads();
    without one the fold begins with nothing, in a folder of its own.
    """
    spark = cols[0].df.sparkSession
    if kept is not None:
        return apply_loads(cols, Kept(spark, kept))
    own = Kept(spark, scratch_folder(spark, "profile"))
    metrics = apply_loads(cols, own)
    return tied(metrics, own.path) if own.loads() else metrics


def out_of_line(m: DataFrame, null_rate: float = 0.20, violating: float = 0.05, shift: float = 0.25, factor: float = 3.0) -> DataFrame:
    """(table_name, column_name, load_no, finding): the loads in which a column leaves its limits, from the metrics of profile().

    null_rate: the share of blanks differs from the prior load's by more. pattern (texts with
    accepted terms) and range (numbers): more than violating of the values not blank.
    distribution: shift exceeds it (texts), or the medians differ by more than factor
    (numbers; a median of 0 beside another differs by any factor). Nothing is compared with
    a load that is not there, nor with one that has only blanks.
    """
    prior = m.select("table_name", "column_name", F.col("load_no").alias("prior_load_no"), (F.col("blanks") / F.col("rows")).alias("prior_rate"), F.col("median").alias("prior_median"))
    both = m.join(F.broadcast(prior), ["table_name", "column_name", "prior_load_no"], "left")
    filled = F.col("rows") - F.col("blanks")
    is_number = F.col("numeric")
    lower, upper = F.least("median", "prior_median"), F.greatest("median", "prior_median")
    wide = F.col("median").isNotNull() & F.col("prior_median").isNotNull() & (upper > lower * factor)
    bad = (filled > 0) & (F.col("violations") > filled * violating)
    findings = F.array_compact(
        F.array(
            F.when(F.abs(F.col("blanks") / F.col("rows") - F.col("prior_rate")) > null_rate, F.lit("null_rate")),
            F.when(bad, F.when(is_number, F.lit("range")).otherwise(F.lit("pattern"))),
            F.when(F.when(is_number, wide).otherwise(F.col("shift") > shift), F.lit("distribution")),
        )
    )
    return both.select("table_name", "column_name", "load_no", F.explode(findings).alias("finding"))
