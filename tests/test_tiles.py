"""Raster operators over many tiles against whole-array versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import raster

H, W = 150, 131


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(4)
    v = rng.normal(50, 20, (H, W))
    v[rng.random((H, W)) < 0.01] = np.nan
    return v


@pytest.fixture(scope="module")
def table(spark, grid):
    rows = [(n, i, j, 5.0 + 10 * j, -5.0 - 10 * i, None if math.isnan(x) else float(x), float(i)) for n in ("r", "s") for i in range(H) for j in range(W) for x in [grid[i, j] + (n == "s")]]
    cells = spark.createDataFrame(rows, "raster_id string, row int, col int, x double, y double, b1 double, b2 double").repartition(5)
    meta = spark.createDataFrame([(n, W, H, 2, "EPSG:32750", 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, None) for n in ("r", "s")], "raster_id string, width int, height int, bands int, crs string, a double, b double, c double, d double, e double, f double, nodata double")
    return cells, meta


def whole(df, name, band="b1", shape=(H, W)):
    out = np.full(shape, np.inf)
    for r in df.where(F.col("raster_id") == name).collect():
        assert np.isinf(out[r.row, r.col])
        out[r.row, r.col] = np.nan if r[band] is None else r[band]
    return out


def test_sobel(table, grid):
    pad = np.pad(grid, 1, mode="symmetric")
    gx = sum(j * s * pad[1 + i : 1 + i + H, 1 + j : 1 + j + W] for i, s in ((-1, 0.25), (0, 0.5), (1, 0.25)) for j in (-1, 0, 1))
    gy = sum(i * s * pad[1 + i : 1 + i + H, 1 + j : 1 + j + W] for j, s in ((-1, 0.25), (0, 0.5), (1, 0.25)) for i in (-1, 0, 1))
    # a null cell leaves its neighbours null also where its weight is zero
    hole = np.isnan(sum(pad[1 + i : 1 + i + H, 1 + j : 1 + j + W] for i in (-1, 0, 1) for j in (-1, 0, 1)))
    want = np.where(hole, np.nan, np.sqrt((gx**2 + gy**2) / 2))
    out = raster.sobel_gradient(*table)
    assert np.allclose(whole(out, "r"), want, equal_nan=True) and np.allclose(whole(out, "s"), want, equal_nan=True)


def test_entropy(table, grid):
    v = np.nan_to_num(grid)
    g = np.rint((v - v.min()) / (v.max() - v.min()) * 255)
    want = np.zeros((H, W))
    disk = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    for r in range(H):
        for c in range(W):
            _, n = np.unique([g[r + i, c + j] for i, j in disk if 0 <= r + i < H and 0 <= c + j < W], return_counts=True)
            want[r, c] = -(n / n.sum() * np.log2(n / n.sum())).sum()
    assert np.allclose(whole(raster.texture_entropy(table[0]), "r"), want)


@pytest.mark.parametrize("scale", [0.5, 0.31, 1.7, 0.02])
def test_resample(table, grid, scale):
    h, w = int(H * scale), int(W * scale)

    def weights(n, old):
        s = n / old
        return np.maximum(0, 1 - np.abs((np.arange(n)[:, None] + 0.5) / s - 0.5 - np.arange(old)) / max(1, 1 / s))

    down, across, known = weights(h, H), weights(w, W), ~np.isnan(grid)
    want = (down @ np.nan_to_num(grid) @ across.T) / (down @ known @ across.T)
    out, new = raster.resample(*table, scale)
    assert np.allclose(whole(out, "r", shape=(h, w)), want, equal_nan=True)
    assert np.allclose(whole(out, "s", "b2", (h, w)), (down @ np.arange(H)[:, None] * np.ones(w)) / down.sum(axis=1)[:, None])
    m = new.where("raster_id = 'r'").first()
    assert (m.width, m.height) == (w, h) and abs(m.a * w - 10.0 * W) < 1e-9


def test_align(table, grid):
    cells, meta = table
    target = meta.where("raster_id = 'r'").withColumns({"a": F.lit(7.0), "e": F.lit(-13.0), "c": F.lit(-40.0), "f": F.lit(25.0), "width": F.lit(210), "height": F.lit(120)})
    got = whole(raster.align_grids(cells, meta, target), "r", shape=(120, 210))
    u = (7.0 * (np.arange(210) + 0.5) - 40.0) / 10 - 0.5
    v = (25.0 - 13.0 * (np.arange(120) + 0.5)) / -10 - 0.5
    down = np.maximum(0, 1 - np.abs(v[:, None] - np.arange(H)))
    across = np.maximum(0, 1 - np.abs(u[:, None] - np.arange(W)))
    with np.errstate(invalid="ignore"):
        want = (down @ np.nan_to_num(grid) @ across.T) / (down @ ~np.isnan(grid) @ across.T)
    assert np.allclose(got, want, equal_nan=True)


def test_tiles_shuffle_little(table):
    cells = table[0].where("raster_id = 'r' AND row < 128 AND col < 128")
    n = cells.count()
    assert raster.tiled(cells, 1).count() < 1.1 * n and raster.tiled(cells, 3).count() < 1.25 * n
