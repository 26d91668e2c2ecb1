"""Sparse contact matrices: bins and pixels, coarsening, and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filament.functions import scalars

TILE = 256


def ladder(base: int, genome_length: int, tile: int = TILE) -> list[int]:
    """Bin sizes that double from base until the genome fits into one tile; at least the base."""
    out, most = [base], -(-genome_length // tile)
    while out[-1] < most:
        out.append(out[-1] * 2)
    return out


def make_bins(chroms: DataFrame, size: int) -> DataFrame:
    """(bin_id, chrom, start, end) of chroms (chrom, length, ord): bins restart with each chromosome, the last one may be short."""
    n = F.ceil(F.col("length") / size)
    offset = F.coalesce(F.sum(n).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as chromosomes
    placed = chroms.withColumn("offset", offset).select("chrom", "length", "offset", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return placed.select((F.col("offset") + F.col("i")).alias("bin_id"), "chrom", (F.col("i") * size).alias("start"), F.least((F.col("i") + 1) * size, F.col("length")).alias("end"))


def coarsen(pixels: DataFrame, bins: DataFrame, coarse: DataFrame) -> DataFrame:
    """Pixels (bin1_id, bin2_id, count) summed over the coarser bins that cover their bins, kept in the upper triangle.

    bins, coarse: as make_bins gives them, of fixed size each; variable bins are refused.
    Sums are combined before the shuffle.
    """
    if bins.where((F.col("start") % F.lit(bins.agg(F.max(F.col("end") - F.col("start"))).first()[0])) != 0).limit(1).count():
        raise ValueError("bins of variable size cannot be coarsened")
    width = coarse.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    key = coarse.select(F.col("bin_id").alias("c_id"), F.col("chrom").alias("c_chrom"), F.floor(F.col("start") / width).alias("_at"))
    fine = bins.withColumn("at", F.floor(F.col("start") / width)).alias("f")
    mapping = fine.join(key.alias("k"), (F.col("f.chrom") == F.col("k.c_chrom")) & (F.col("f.at") == F.col("k._at"))).select("f.bin_id", "k.c_id")
    one = mapping.select(F.col("bin_id").alias("bin1_id"), F.col("c_id").alias("_1"))
    two = mapping.select(F.col("bin_id").alias("bin2_id"), F.col("c_id").alias("_2"))
    moved = pixels.join(one, "bin1_id").join(two, "bin2_id")
    return moved.groupBy(F.least("_1", "_2").alias("bin1_id"), F.greatest("_1", "_2").alias("bin2_id")).agg(F.sum("count").alias("count"))


def symmetric(pixels: DataFrame) -> DataFrame:
    """Pixels of the whole matrix: those off the diagonal also the other way round."""
    both = F.when(F.col("bin1_id") == F.col("bin2_id"), F.array(F.struct("bin1_id", "bin2_id"))).otherwise(F.array(F.struct("bin1_id", "bin2_id"), F.struct(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"))))
    rest = [c for c in pixels.columns if c not in ("bin1_id", "bin2_id")]
    return pixels.select(F.explode(both).alias("p"), *rest).select("p.*", *rest)


def balanced(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Pixels with value = count * weight1 * weight2; null where a bin has no weight."""
    w = lambda i: bins.select(F.col("bin_id").alias(f"bin{i}_id"), F.col("weight").alias(f"_w{i}"))
    return pixels.join(w(1), "bin1_id", "left").join(w(2), "bin2_id", "left").withColumn("value", F.col("count") * F.col("_w1") * F.col("_w2")).drop("_w1", "_w2")


def tile_window(pixels: DataFrame, x: int, y: int, tile: int = TILE) -> DataFrame:
    """(row, col, …) of the pixels of the whole matrix that lie in a tile; the filters reach the scan on both triangles."""
    lo1, lo2 = y * tile, x * tile
    inside = lambda a, b: F.col(a).between(lo1, lo1 + tile - 1) & F.col(b).between(lo2, lo2 + tile - 1)
    near = pixels.where(inside("bin1_id", "bin2_id") | inside("bin2_id", "bin1_id"))
    whole = symmetric(near).where(inside("bin1_id", "bin2_id"))
    rest = [c for c in pixels.columns if c not in ("bin1_id", "bin2_id")]
    return whole.select((F.col("bin1_id") - lo1).alias("row"), (F.col("bin2_id") - lo2).alias("col"), *rest)


def dense_tile(window: DataFrame, value: str = "count", tile: int = TILE) -> DataFrame:
    """(block, min_value, max_value, size): a tile's values row by row, float32 little-endian in base64; cells without pixel are 0.

    A tile has tile * tile cells at most, whatever the matrix.
    """
    import base64

    import numpy as np
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((tile, tile), "<f4")
        block[pdf["row"], pdf["col"]] = pdf["v"].fillna(np.nan)
        return pd.DataFrame({"block": [base64.b64encode(block.tobytes()).decode()], "min_value": [float(np.nanmin(block))], "max_value": [float(np.nanmax(block))], "size": [block.size]})

    cells = window.select("row", "col", F.col(value).cast("double").alias("v"))
    return cells.groupBy().applyInPandas(pack, "block string, min_value double, max_value double, size int")


def tileset_info(bins: DataFrame, resolutions: list[int], uid: str, name: str, coordinates: str | None = None) -> dict:
    """Description of a tileset: its resolutions, chromosome sizes (as many as chromosomes), extent and tile size."""
    sizes = [(r.chrom, r.length) for r in bins.groupBy("chrom").agg(F.max("end").alias("length"), F.min("bin_id").alias("at")).orderBy("at").collect()]
    total = sum(n for _, n in sizes)
    info = {"uuid": uid, "name": name, "datatype": "matrix", "tile_size": TILE, "resolutions": resolutions, "chromsizes": sizes, "min_pos": [0, 0], "max_pos": [total, total]}
    return info | ({"coordSystem": coordinates} if coordinates else {})


def links_in_tile(links: DataFrame, start: int, end: int) -> DataFrame:
    """Interactions (a_start, a_end, b_start, b_end) of which either end overlaps a window."""
    hit = lambda s: (F.col(f"{s}_start") < end) & (F.col(f"{s}_end") > start)
    return links.where(hit("a") | hit("b"))


def rectangles_in_tile(links: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Interactions whose rectangle (a across, b down) overlaps a window."""
    return links.where((F.col("a_start") < x[1]) & (F.col("a_end") > x[0]) & (F.col("b_start") < y[1]) & (F.col("b_end") > y[0]))


def tile_requests(ids: DataFrame, column: str, order: str) -> DataFrame:
    """(uid, tiles): the requested tiles (uid.z.x.y) of each tileset in order; ids that are none are left out."""
    good = ids.where(F.col(column).rlike(r"^[A-Za-z0-9_-]+(\.\d+){1,3}$"))
    tagged = F.array_sort(F.collect_list(F.struct(order, column)))
    return good.groupBy(F.substring_index(column, ".", 1).alias("uid")).agg(F.transform(tagged, lambda x: x[column]).alias("tiles"))


def requested_tiles(ids: DataFrame, column: str, tilesets: DataFrame) -> DataFrame:
    """ids with uid, z, x, y, balancing, bin_size and error: one row a requested tile (uid.z.x.y, or uid.z.x.y.balancing), whatever its id.

    tilesets: uid, resolutions, extent (in the units of bins) and balancing columns. z = 0 is
    the coarsest resolution. An id that cannot be served has the reason as error, and no
    bin_size unless only its position or balancing is wrong; the others of a request stay whole.
    """
    pattern = r"\A([A-Za-z0-9_:-]+)\.(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:\.([A-Za-z_]\w*))?\z"
    good = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    part = lambda i: F.when(good, F.nullif(F.regexp_extract(column, pattern, i), F.lit("")))
    asked = ids.withColumns({"uid": part(1), "z": part(2).cast("int"), "x": part(3).cast("long"), "y": part(4).cast("long"), "balancing": part(5)})
    known = tilesets.select(F.col("uid").alias("_uid"), F.array_sort("resolutions").alias("_r"), F.col("extent").alias("_extent"), F.col("balancing").alias("_columns"))
    out = asked.join(known, F.col("uid") == F.col("_uid"), "left")
    bin_size = F.get("_r", F.size("_r") - 1 - F.col("z"))
    tiles = F.ceil(F.col("_extent") / (bin_size * TILE))
    error = (
        F.when(F.col("uid").isNull(), "malformed tile id")
        .when(F.col("_uid").isNull(), "no such tileset")
        .when(bin_size.isNull(), "no such zoom level")
        .when((F.col("x") >= tiles) | (F.col("y") >= tiles), "no such position")
        .when(F.col("balancing").isNotNull() & ~F.array_contains("_columns", F.col("balancing")), "no such balancing column")
    )
    return out.withColumns({"error": error, "bin_size": bin_size}).drop("_uid", "_r", "_extent", "_columns")


#: Bytes a matrix file may have to be prepared.
MOST_BYTES = 20 << 30


def within_cap(size: Column, most: int = MOST_BYTES) -> Column:
    """Whether a file of a size (a number or its text) may be prepared; an unknown size may."""
    return F.coalesce(scalars.parse_int(size.cast("string")) <= most, F.lit(True))


def pyramid(levels: dict[int, DataFrame], chroms: DataFrame) -> dict[int, DataFrame]:
    """Pixels by bin size for all zoom levels: as they are if there are several, else coarsened from the only one along ladder()."""
    if len(levels) != 1:
        return levels
    (base, pixels), = levels.items()
    total = chroms.agg(F.sum("length")).first()[0] or 0
    out, fine = {base: pixels}, make_bins(chroms, base)
    for size in ladder(base, total)[1:]:
        out[size] = coarsen(pixels, fine, make_bins(chroms, size))
    return out
