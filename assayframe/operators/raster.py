"""Rasters as cell tables: cells (raster_id, row, col, x, y, b1, ...) and meta (raster_id, width, height, bands, crs, a..f,
nodata). x and y are cell centres: x = a (col + 1/2) + b (row + 1/2) + c, y = d (col + 1/2) + e (row + 1/2) + f."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crs import projected

KEYS = ["raster_id", "row", "col", "x", "y"]


def band_names(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c.startswith("b") and c[1:].isdigit()]


def raster_info(cells: DataFrame, meta: DataFrame, verbose: bool = False) -> DataFrame:
    """raster_id, width, height, bands, crs; verbose adds transform, nodata, bounds and band-1 statistics (2 places)."""
    out = meta.select("raster_id", "width", "height", "bands", "crs", *(["a", "b", "c", "d", "e", "f", "nodata"] if verbose else []))
    if not verbose:
        return out
    b1 = F.col("b1")
    stats = cells.groupBy("raster_id").agg(F.min(b1).alias("min"), F.max(b1).alias("max"), F.round(F.avg(b1), 2).alias("mean"), F.round(F.stddev_pop(b1), 2).alias("std"))
    out = out.join(stats, "raster_id", "left")
    right, low = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    return out.withColumns({"left": F.col("c"), "bottom": low, "right": right, "top": F.col("f")})


def select_bands(cells: DataFrame, bands: list[int]) -> DataFrame:
    """The bands by their numbers from 1, renumbered in the given order."""
    have = band_names(cells)
    if bad := [b for b in bands if not 1 <= b <= len(have)]:
        raise ValueError(f"no such bands: {bad}")
    return cells.select(*KEYS, *[F.col(f"b{b}").alias(f"b{i}") for i, b in enumerate(bands, 1)])


def band_math(cells: DataFrame, expression: str | Column) -> DataFrame:
    """One float band b1 from Spark SQL text (or a Column) over b1..bN; a true condition is 1, NaN and infinity null."""
    value = F.expr(expression) if isinstance(expression, str) else expression
    out = value.cast("float")
    return cells.select(*KEYS, F.when(F.isnan(out) | (F.abs(out) == float("inf")), None).otherwise(out).alias("b1"))


def _box(box: tuple, systems: tuple | None) -> list[Column]:
    """Bounds of the box in a raster's own system."""
    x0, y0, x1, y1 = map(F.lit, map(float, box))
    if systems and systems[0] != systems[1]:
        corners = [projected(x, y, *systems) for x in (x0, x1) for y in (y0, y1)]
        x0, x1 = F.least(*[c[0] for c in corners]), F.greatest(*[c[0] for c in corners])
        y0, y1 = F.least(*[c[1] for c in corners]), F.greatest(*[c[1] for c in corners])
    return [x0, y0, x1, y1]


def _windows(meta: DataFrame, box: tuple, crs: str | None) -> DataFrame:
    """meta with the box in each raster's system (_x0, _y0, _x1, _y1) and the window of cells it touches (_row, _col, and
    _height, _width, which may be 0). Systems are few, one plan part each."""
    codes = [None] if crs is None else [r["crs"] for r in meta.select("crs").distinct().collect()]
    out = None
    for code in codes:
        own = meta if crs is None else meta.where(F.col("crs").eqNullSafe(code))
        own = own.withColumns(dict(zip(("_x0", "_y0", "_x1", "_y1"), _box(box, crs and (crs, code)))))
        first = lambda at, c, a: F.greatest(F.floor((F.col(at) - F.col(c)) / F.col(a)), F.lit(0))
        last = lambda at, c, a, n: F.least(F.ceil((F.col(at) - F.col(c)) / F.col(a)), F.col(n))
        own = own.withColumns({"_col": first("_x0", "c", "a"), "_row": first("_y1", "f", "e")})
        own = own.withColumns({"_width": F.greatest(last("_x1", "c", "a", "width") - F.col("_col"), F.lit(0)), "_height": F.greatest(last("_y0", "f", "e", "height") - F.col("_row"), F.lit(0))})
        out = own if out is None else out.unionByName(own)
    return out


def clip_to_extent(cells: DataFrame, meta: DataFrame, box: tuple[float, float, float, float], crs: str | None = None, outside: str = "drop") -> DataFrame:
    """Cells whose centre lies in the box (min_x, min_y, max_x, max_y), with row and col counted in the clipped window.

    The window holds all cells that the box touches; outside="null" keeps its other cells with null bands, as clip_meta
    describes it. The box may be in another system: its corners are projected. A box beyond every cell gives no rows.
    """
    if outside not in ("drop", "null"):
        raise ValueError(f"outside must be drop or null, not {outside!r}")
    rows = cells.join(_windows(meta, box, crs).select("raster_id", *[f"_{k}" for k in ("x0", "y0", "x1", "y1", "row", "col", "width", "height")]), "raster_id")
    rows = rows.where("row >= _row AND row < _row + _height AND col >= _col AND col < _col + _width")
    inside = F.expr("x BETWEEN _x0 AND _x1 AND y BETWEEN _y0 AND _y1")
    rows = rows.where(inside) if outside == "drop" else rows.withColumns({b: F.when(inside, F.col(b)) for b in band_names(cells)})
    return rows.select("raster_id", (F.col("row") - F.col("_row")).cast("int").alias("row"), (F.col("col") - F.col("_col")).cast("int").alias("col"), "x", "y", *band_names(cells))


def clip_meta(meta: DataFrame, box: tuple[float, float, float, float], crs: str | None = None) -> DataFrame:
    """meta of the clipped rasters: the window's size and its shifted origin; rasters that the box misses are left out."""
    w = _windows(meta, box, crs).where("_width > 0 AND _height > 0")
    new = {"width": F.col("_width").cast("int"), "height": F.col("_height").cast("int"), "c": F.expr("c + a * _col + b * _row"), "f": F.expr("f + d * _col + e * _row")}
    return w.withColumns(new).select(*meta.columns)


#: Cells of a tile's side.
TILE = 64


def tiled(cells: DataFrame, reach: int, side: int = TILE) -> DataFrame:
    """cells with _tr, _tc: each cell in its tile and, if it is no further than reach from another, there too.

    Tiles of 64 x 64 cells with a halo of one send 1.06 rows a cell through the shuffle, with a halo of three 1.2.
    """
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    return cells.withColumn("_tr", F.explode(near("row"))).withColumn("_tc", F.explode(near("col")))


class _Tile:
    """A tile's cells on a grid with its halo; home marks the table's rows that lie in the tile itself."""

    def __init__(self, table, reach: int, bands: list[str], side: int = TILE):
        number = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        self.table = table
        self.top, self.left = int(number("_tr")[0]) * side, int(number("_tc")[0]) * side
        row, col = number("row").astype(np.int64) - self.top, number("col").astype(np.int64) - self.left
        self.home = (row >= 0) & (row < side) & (col >= 0) & (col < side)
        self.row, self.col = row[self.home], col[self.home]
        wide = (side + 2 * reach, side + 2 * reach)
        self.there = np.zeros(wide, bool)
        self.there[row + reach, col + reach] = True
        self.values = []
        for b in bands:  # nan is a null cell or none
            grid = np.full(wide, np.nan)
            grid[row + reach, col + reach] = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
            self.values.append(grid)

    def cells(self, grid: np.ndarray):
        """The tile's own cells with b1 from a grid without halo; nan is null."""
        own = self.table.filter(pa.array(self.home)).select(KEYS)
        value = grid[self.row, self.col]
        return own.append_column("b1", pa.array(value, mask=np.isnan(value)))


def _cell_schema(cells: DataFrame) -> str:
    return ", ".join(f"{c} {dict(cells.dtypes)[c]}" for c in KEYS) + ", b1 double"


def sobel_gradient(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """b1 = sqrt((gx^2 + gy^2) / 2) of band 1 by Sobel kernels, edges reflected; null cells make their neighbours null, and
    cells that the table lacks count as 0.

    Works on tiles with a halo of one cell, so every cell is shuffled once, those at tile borders twice.
    """

    def slopes(table):
        tile = _Tile(table, 1, ["b1"])
        there, v = tile.there, tile.values[0]
        height, width = (int(table.column(c)[0].as_py()) for c in ("height", "width"))
        edges = [(0 - tile.top, 1), (height - tile.top + 1, -1)], [(0 - tile.left, 1), (width - tile.left + 1, -1)]
        for axis, lines in enumerate(edges):  # a border line also stands for its mirror image one step outside
            for outside, inward in lines:
                if 0 <= outside < TILE + 2 and 0 <= outside + inward < TILE + 2:
                    for grid in (there, v):
                        line = grid.swapaxes(0, axis)
                        line[outside] = line[outside + inward]
        hole = there & np.isnan(v)
        v = np.where(there & ~hole, v, 0.0)
        part = lambda g, i, j: g[1 + i : 1 + i + TILE, 1 + j : 1 + j + TILE]
        smooth, gx, gy, holes = {-1: 0.25, 0: 0.5, 1: 0.25}, 0.0, 0.0, np.zeros((TILE, TILE), bool)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                gy, gx = gy + i * smooth[j] * part(v, i, j), gx + j * smooth[i] * part(v, i, j)
                holes |= part(hole, i, j)
        return tile.cells(np.where(holes, np.nan, np.sqrt((gx * gx + gy * gy) / 2)))

    rows = tiled(cells.select(*KEYS, "b1").join(meta.select("raster_id", "width", "height"), "raster_id"), 1)
    return rows.groupBy("raster_id", "_tr", "_tc").applyInArrow(slopes, _cell_schema(cells))


def texture_entropy(cells: DataFrame, radius: int = 3) -> DataFrame:
    """b1 = entropy (bits) of band 1, scaled to 0..255 and rounded (halves to even), in the disk around each cell; null
    counts as 0. A flat raster is an error.

    Works on tiles with a halo of the radius.
    """
    filled = cells.select(*KEYS, F.coalesce(F.col("b1").cast("double"), F.lit(0.0)).alias("v"))
    span = filled.groupBy("raster_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.when(F.col("hi") == F.col("lo"), F.raise_error(F.lit("a flat raster has no texture")))
    grey = F.coalesce(flat.cast("double"), F.rint((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255))
    rows = tiled(filled.join(span, "raster_id").select(*KEYS, grey.alias("g")), radius)
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]

    def entropies(table):
        tile = _Tile(table, radius, ["g"])
        part = lambda i, j: tile.values[0][radius + i : radius + i + TILE, radius + j : radius + j + TILE]
        near = np.sort(np.stack([part(i, j) for i, j in disk]).reshape(len(disk), -1), axis=0)  # absent cells last
        total = np.maximum((~np.isnan(near)).sum(axis=0), 1)
        bits, run = np.zeros(near.shape[1]), np.zeros(near.shape[1])
        for k in range(len(disk)):  # -sum p log p = log N - sum n log n / N, a run of equal values at a time
            run = run + 1
            last = near[k] != (near[k + 1] if k + 1 < len(disk) else np.nan)
            last &= ~np.isnan(near[k])
            bits += np.where(last, run * np.log2(run), 0.0)
            run = np.where(last, 0.0, run)
        return tile.cells((np.log2(total) - bits / total).reshape(TILE, TILE))

    return rows.groupBy("raster_id", "_tr", "_tc").applyInArrow(entropies, _cell_schema(cells))


def resample(cells: DataFrame, meta: DataFrame, scale: float) -> tuple[DataFrame, DataFrame]:
    """(cells, meta) of int(width * scale) x int(height * scale) cells, bilinear; the kernel widens when shrinking.

    Each source cell goes to the target tiles within the kernel's reach, one for most; a tile's weights are two matrices,
    one for its rows and one for its columns. A target that only reaches cells the table lacks gets no row.
    """
    if scale <= 0:
        raise ValueError("the scale must be positive")
    new = meta.withColumns({"width": F.floor(F.col("width") * scale).cast("int"), "height": F.floor(F.col("height") * scale).cast("int")})
    old = meta.select("raster_id", F.col("width").alias("ow"), F.col("height").alias("oh"), *"abcdef")
    size = old.join(new.select("raster_id", F.col("width").alias("nw"), F.col("height").alias("nh")), "raster_id").withColumns({"sx": F.col("nw") / F.col("ow"), "sy": F.col("nh") / F.col("oh")})
    side, bands = max(1, int(TILE * min(1.0, scale))), band_names(cells)

    def tiles(c: str, s: str, n: str) -> Column:
        """Target tiles that hold a target in reach of a source cell."""
        reach = F.greatest(F.lit(1.0), 1 / F.col(s)) * F.col(s)
        centre = (F.col(c) + 0.5) * F.col(s) - 0.5
        lo, hi = F.greatest(F.ceil(centre - reach), F.lit(0)), F.least(F.floor(centre + reach), F.col(n) - 1)
        return F.when(lo <= hi, F.sequence(F.floor(lo / side), F.floor(hi / side))).otherwise(F.array().cast("array<bigint>"))

    rows = cells.select("raster_id", "row", "col", *bands).join(size.select("raster_id", "sx", "sy", "nw", "nh"), "raster_id")
    rows = rows.withColumn("_tr", F.explode(tiles("row", "sy", "nh"))).withColumn("_tc", F.explode(tiles("col", "sx", "nw")))

    def weights(first: int, n: int, s: float, low: int, high: int) -> np.ndarray:
        """Of the source lines low..high for the target lines from first on."""
        target = np.arange(first, min(first + side, n))
        return np.maximum(0, 1 - np.abs((target[:, None] + 0.5) / s - 0.5 - np.arange(low, high + 1)) / max(1.0, 1 / s))

    def averaged(table):
        number = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        one = lambda c: table.column(c)[0].as_py()
        row, col, top, left = number("row").astype(np.int64), number("col").astype(np.int64), one("_tr") * side, one("_tc") * side
        down = weights(top, one("nh"), one("sy"), row.min(), row.max())
        across = weights(left, one("nw"), one("sx"), col.min(), col.max())
        there = np.zeros((down.shape[1], across.shape[1]))
        there[row - row.min(), col - col.min()] = 1
        i, j = np.nonzero(down @ there @ across.T > 0)
        cells = [pa.array([one("raster_id")] * len(i), table.schema.field("raster_id").type), pa.array((i + top).astype(np.int32)), pa.array((j + left).astype(np.int32))]
        for b in bands:
            value, known = np.zeros(there.shape), np.zeros(there.shape)
            x = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
            value[row - row.min(), col - col.min()], known[row - row.min(), col - col.min()] = np.nan_to_num(x), ~np.isnan(x)
            total, weight = (down @ value @ across.T)[i, j], (down @ known @ across.T)[i, j]
            cells.append(pa.array(total / np.where(weight > 0, weight, 1), mask=weight <= 0))
        return pa.Table.from_arrays(cells, names=["raster_id", "row", "col", *bands])

    kinds = f"raster_id {dict(cells.dtypes)['raster_id']}, row int, col int, " + ", ".join(f"{b} double" for b in bands)
    out = rows.groupBy("raster_id", "_tr", "_tc").applyInArrow(averaged, kinds)
    turned = size.select("raster_id", (F.col("a") / F.col("sx")).alias("a"), (F.col("b") / F.col("sy")).alias("b"), "c", (F.col("d") / F.col("sx")).alias("d"), (F.col("e") / F.col("sy")).alias("e"), "f")
    out = out.join(turned, "raster_id")
    x = F.col("a") * (F.col("col") + 0.5) + F.col("b") * (F.col("row") + 0.5) + F.col("c")
    y = F.col("d") * (F.col("col") + 0.5) + F.col("e") * (F.col("row") + 0.5) + F.col("f")
    return out.select("raster_id", "row", "col", x.alias("x"), y.alias("y"), *bands), new.drop(*"abcdef").join(turned, "raster_id").select(*meta.columns)


def _quads(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(raster_id, i, j, and for each band its four cells band_0 .. band_3 at (i, j), (i, j + 1), (i + 1, j), (i + 1, j + 1)),
    for every i, j that has one of them."""

    def corners(table):
        tile = _Tile(table, 1, bands)
        pick = lambda g, k: g[1 + k // 2 : 1 + k // 2 + TILE, 1 + k % 2 : 1 + k % 2 + TILE]
        i, j = np.nonzero(np.logical_or.reduce([pick(tile.there, k) for k in range(4)]))
        out = [pa.array([table.column("raster_id")[0].as_py()] * len(i), table.schema.field("raster_id").type), pa.array(i + tile.top), pa.array(j + tile.left)]
        for v in tile.values:
            for k in range(4):
                x = pick(v, k)[i, j]
                out.append(pa.array(x, mask=np.isnan(x)))
        return pa.Table.from_arrays(out, names=["raster_id", "i", "j", *[f"{b}_{k}" for b in bands for k in range(4)]])

    kinds = f"raster_id {dict(cells.dtypes)['raster_id']}, i long, j long, " + ", ".join(f"{b}_{k} double" for b in bands for k in range(4))
    return tiled(cells.select("raster_id", "row", "col", *bands), 1).groupBy("raster_id", "_tr", "_tc").applyInArrow(corners, kinds)


def align_grids(cells: DataFrame, meta: DataFrame, reference: DataFrame) -> DataFrame:
    """Every source raster on the grid of reference (one meta row), bilinear; raster_id stays the source's.

    Target cells come from the reference's size; each finds its four neighbours in one row of the source's quads, which are
    made on tiles. Sources are parted by their systems, which are few.
    """
    target, bands = reference.first(), band_names(cells)
    spark = cells.sparkSession
    grid = spark.range(target["width"] * target["height"]).select((F.col("id") / target["width"]).cast("int").alias("row"), (F.col("id") % target["width"]).cast("int").alias("col"))
    x = target["a"] * (F.col("col") + 0.5) + target["b"] * (F.col("row") + 0.5) + target["c"]
    y = target["d"] * (F.col("col") + 0.5) + target["e"] * (F.col("row") + 0.5) + target["f"]
    grid = grid.withColumns({"x": x, "y": y})
    placed = None
    for code in [r["crs"] for r in meta.select("crs").distinct().collect()]:
        sources = meta.where(F.col("crs").eqNullSafe(code)).select("raster_id", *"abcdef")
        sx, sy = projected(F.col("x"), F.col("y"), target["crs"], code)
        one = grid.withColumns({"_sx": sx, "_sy": sy}).crossJoin(sources)  # as many rows as the result has
        one = one.withColumns({"u": F.expr("(e * (_sx - c) - b * (_sy - f)) / (a * e - b * d) - 0.5"), "v": F.expr("(a * (_sy - f) - d * (_sx - c)) / (a * e - b * d) - 0.5")})
        one = one.select("raster_id", "row", "col", "x", "y", "u", "v")
        placed = one if placed is None else placed.union(one)
    if placed is None:
        return cells.limit(0)
    near = placed.withColumns({"i": F.floor("v"), "j": F.floor("u")}).join(_quads(cells, bands), ["raster_id", "i", "j"], "left")
    down, across = F.col("v") - F.col("i"), F.col("u") - F.col("j")
    shares = [(1 - down) * (1 - across), (1 - down) * across, down * (1 - across), down * across]

    def mean(b: str) -> Column:
        """Of the neighbours that have a value, by their shares."""
        total = lambda f: sum((F.coalesce(f(w, F.col(f"{b}_{k}")), F.lit(0.0)) for k, w in enumerate(shares)), F.lit(0.0))
        return F.try_divide(total(lambda w, x: w * x), total(lambda w, x: F.when(x.isNotNull(), w))).alias(b)

    return near.select(*KEYS, *[mean(b) for b in bands])
