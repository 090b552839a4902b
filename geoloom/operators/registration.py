"""Co-registration of pixel tables: shifts of tiles by phase correlation, a scene's shift with its gate, resampling.

Pixels are rows (key, row_no, col_no, values); repeated ones are averaged. A scene of any size is cut into tiles of TILE pixels a
side, each of which one task compares: masked pixels take the tile's mean, a Hann window takes the borders' edge away, the
normalised cross-power spectrum (of the frequencies that have power) peaks at the whole shift, and a matrix transform of the spectrum around it, ``upsample`` steps a
pixel, the fraction. Tiles with little texture, few valid pixels or a faint peak tell nothing and are left out; the scene's shift
is the median of the others, by ranges (``aggregates.percentiles``), and passes if its length is within the gate.

A shift is what the moving scene has to be moved by to lie on the reference. ``shifted`` resamples: each pixel is the bilinear mean
of the four at its place before the shift, places beyond the grid being those at its edge; where some of the four are missing the
others count alone, and a pixel with none of them is left out.

Null values and null flags are masked. A scene without a telling tile has null shifts and doesn't pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.aggregates import percentiles
from geoloom.operators.lineage import table

TILE = 64
LEAST_VALID = 0.5
LEAST_PEAK = 0.2
#: Frequencies that are weaker, against the strongest, hold the window's leakage and noise, and are left out.
LEAST_POWER = 0.01
LEAST_TEXTURE = 1e-6
MOST_SHIFT_PX = 0.5  # the gate, in pixels


def filled(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The values less the mean of the unmasked, which masked ones take, under a Hann window."""
    mean = values[mask].mean() if mask.any() else 0.0
    windows = [np.hanning(n + 2)[1:-1] for n in values.shape]
    return np.where(mask, values - mean, 0.0) * windows[0][:, None] * windows[1][None, :]


def phase_shift(reference: np.ndarray, moving: np.ndarray, upsample: int = 20) -> tuple[float, float, float]:
    """(dy, dx, height of the peak from 0 to 1) of two windowed grids."""
    cross = np.fft.fft2(reference) * np.conj(np.fft.fft2(moving))
    size = np.abs(cross)
    cross = np.where(size > size.max() * LEAST_POWER, cross / np.maximum(size, 1e-300), 0)
    surface = np.fft.ifft2(cross).real * cross.size / max(1, np.count_nonzero(cross))
    at = np.unravel_index(surface.argmax(), surface.shape)
    whole = [p - n if p > n // 2 else p for p, n in zip(at, surface.shape, strict=True)]
    found, peak = [float(x) for x in whole], surface.max()
    if upsample > 1:
        # the inverse transform at fractions of a pixel, 1.5 pixels to either side
        steps = np.arange(-int(1.5 * upsample), int(1.5 * upsample) + 1) / upsample
        grids = [np.exp(2j * np.pi * np.outer(w + steps, np.fft.fftfreq(n))) for w, n in zip(whole, surface.shape, strict=True)]
        fine = (grids[0] @ cross @ grids[1].T).real / max(1, np.count_nonzero(cross))
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        found, peak = [whole[0] + steps[i], whole[1] + steps[j]], max(peak, fine.max())
    return found[0], found[1], float(peak)


TILE_ROWS = "tile_row long, tile_col long, dy double, dx double, peak double, texture double, valid double"


def tile_shifts(pixels: DataFrame, reference: str, moving: str, valid: Column | None = None, key: str = "cell", size: int = TILE, upsample: int = 20, row: str = "row_no", col: str = "col_no") -> DataFrame:
    """key, and TILE_ROWS of each tile: its shift, the peak, the lesser standard deviation, and the share of its pixels that are
    valid in both. Tiles at a scene's far edges are as small as what is left there."""
    ok = F.coalesce(F.lit(True) if valid is None else valid, F.lit(False))
    one = pixels.groupBy(key, row, col).agg(F.avg(F.when(ok, F.col(reference).cast("double"))).alias("ref"), F.avg(F.when(ok, F.col(moving).cast("double"))).alias("mov"))
    tiles = one.withColumns({"tile_row": F.floor(F.col(row) / size), "tile_col": F.floor(F.col(col) / size)})

    def compare(keys, rows):
        r, c = (rows[x].to_numpy() for x in (row, col))
        r, c = r - r.min(), c - c.min()
        grids = []
        for name in ("ref", "mov"):
            grid = np.full((r.max() + 1, c.max() + 1), np.nan)
            grid[r, c] = rows[name]
            grids.append(grid)
        mask = ~np.isnan(grids[0]) & ~np.isnan(grids[1])
        texture = min(float(g[mask].std()) for g in grids) if mask.any() else 0.0
        dy = dx = peak = float("nan")
        if texture > 0 and min(mask.shape) > 1:
            dy, dx, peak = phase_shift(*(filled(g, mask) for g in grids), upsample)
        return pd.DataFrame([(*keys, dy, dx, peak, texture, float(mask.mean()))], columns=[key, *(x.split()[0] for x in TILE_ROWS.split(", "))])

    return tiles.groupBy(key, "tile_row", "tile_col").applyInPandas(compare, f"{key} {dict(pixels.dtypes)[key]}, {TILE_ROWS}")


def telling(texture: float = LEAST_TEXTURE, peak: float = LEAST_PEAK, valid: float = LEAST_VALID) -> Column:
    """Whether a tile's shift counts."""
    return (F.col("texture") >= texture) & (F.col("peak") >= peak) & (F.col("valid") >= valid) & ~F.isnan("dy")


def scene_shifts(tiles: DataFrame, key: str = "cell", counts: Column | None = None, most: float = MOST_SHIFT_PX) -> DataFrame:
    """key, tiles, used, dy, dx, residual_px, passes: the medians of the telling tiles (counts), and whether they are within most."""
    tiles = table(tiles.withColumn("used", counts if counts is not None else telling()), "tile-shifts")
    used = tiles.where("used")
    found = percentiles(used, "dy", {"dy": 0.5}, key).join(percentiles(used, "dx", {"dx": 0.5}, key), key)
    out = tiles.groupBy(key).agg(F.count("*").alias("tiles"), F.count_if(F.col("used")).alias("used")).join(found, key, "left")
    out = out.withColumn("residual_px", F.hypot("dy", "dx"))
    return out.withColumn("passes", F.coalesce(F.col("residual_px") <= most, F.lit(False)))


def shifted(pixels: DataFrame, shifts: DataFrame, value: str, key: str = "cell", row: str = "row_no", col: str = "col_no") -> DataFrame:
    """key, row, col, value of the pixels (each place once) of the scenes in shifts (key, dy, dx), moved by these."""
    at = pixels.select(key, F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("v"))
    edge = at.groupBy(key).agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"))
    moves = shifts.select(key, "dy", "dx").join(edge, key)
    to = at.select(key, "r", "c").join(moves, key)
    y = F.greatest(F.least(F.col("r") - F.col("dy"), F.col("bottom")), F.col("top"))
    x = F.greatest(F.least(F.col("c") - F.col("dx"), F.col("right")), F.col("left"))
    to = to.withColumns({"y": y, "x": x})
    part = lambda p, i, j: F.struct((F.floor("y") + i).alias("r"), (F.floor("x") + j).alias("c"), p.alias("p"))
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    four = F.array(part((1 - fy) * (1 - fx), 0, 0), part((1 - fy) * fx, 0, 1), part(fy * (1 - fx), 1, 0), part(fy * fx, 1, 1))
    wanted = to.select(key, F.col("r").alias(row), F.col("c").alias(col), F.explode(F.filter(four, lambda s: s.p > 0)).alias("s")).select(key, row, col, "s.*")
    met = wanted.join(at.where("v IS NOT NULL"), [key, "r", "c"])
    return met.groupBy(key, row, col).agg((F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias(value))
