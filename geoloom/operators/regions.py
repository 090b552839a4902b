"""Regions of a mask: connected pixels under one label over any number of tiles, their measures and outlines.

Tiles of TILE pixels a side are labelled from runs of pixels in a row that touch runs of the row before, all tiles of a batch at once. Labels of
pixels that face each other over a tile's border are edges of a table, whose connected components name the regions; so no task sees
more than a tile, and a region over many tiles is one. Only border pixels take part in that. A region's outline is made of the sides
of its pixels that face no pixel of it: outer rings run with the region on their left (rows upwards), holes the other way.

Pixels are rows (key, row_no, col_no); repeated rows count once. A region is named by its key and its first pixel, by row and then
column. Outlines are traced by region, from its sides: as many rows as its border is long meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.discovery import connected
from geoloom.operators.lineage import table
from geoloom.operators.overlay import RINGS

TILE = 256


def tile_labels(rows: np.ndarray, cols: np.ndarray, diagonal: bool, tiles: np.ndarray | None = None) -> np.ndarray:
    """A number for each pixel of a tile: equal for connected ones. tiles: a number of each pixel's tile, for many tiles at once."""
    tiles = np.zeros(len(rows), np.int64) if tiles is None else tiles
    order = np.lexsort((cols, rows, tiles))
    starts, of_run = run_labels(tiles[order], rows[order], cols[order], diagonal)
    out = np.empty(len(rows), np.int64)
    out[order] = np.repeat(of_run, np.diff(np.append(starts, len(rows))))
    return out


def run_labels(tiles: np.ndarray, rows: np.ndarray, cols: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pixels in order of tile, row and column, each once: where runs start, and the first run of those connected with each."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, r, c = (np.unique(tiles, return_inverse=True)[1], rows - rows.min() + 1, cols - cols.min() + 1)
    line, wide = t * (r.max() + 1) + r, c.max() + 3
    starts = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (c[1:] != c[:-1] + 1)))
    stops = np.append(starts[1:], len(r)) - 1
    low, high, above = line[starts] * wide + c[starts], line[starts] * wide + c[stops], wide
    # runs don't overlap, so both their ends are in order: those of the row before that touch a run lie side by side
    first, last = np.searchsorted(high, low - above - diagonal), np.searchsorted(low, high - above + diagonal, side="right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    label = np.arange(len(starts))
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := label[label], label):
            label = far
    return starts, label


def regions(mask: DataFrame, key: str = "cell", size: int = TILE, diagonal: bool = False) -> DataFrame:
    """key, row_no, col_no, region of the pixels in mask (key, row_no, col_no). diagonal: corners connect too."""
    pixels = mask.select(key, F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"))
    tile = [F.floor(F.col("row_no") / size).alias("tile_row"), F.floor(F.col("col_no") / size).alias("tile_col")]
    tiles = pixels.select(key, *tile, "row_no", "col_no").where("row_no is not null and col_no is not null")
    tiles = tiles.repartition(key, "tile_row", "tile_col").sortWithinPartitions(key, "tile_row", "tile_col", "row_no", "col_no")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles are rows side by side; the last one of a batch waits for the next batch."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.concat_batches([held, batch]) if held is not None else batch
            if held is None or not len(held):
                continue
            marks = [held.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), *(c.to_numpy() for c in held.columns[1:])]
            new = np.append(True, np.any([m[1:] != m[:-1] for m in marks[:3]], axis=0))
            stop = int(np.flatnonzero(new)[-1]) if batch is not None else len(held)
            some, held = held.slice(0, stop), held.slice(stop)
            once = np.flatnonzero(new[:stop] | np.append(True, np.any([m[1:stop] != m[: max(stop - 1, 0)] for m in marks[3:]], axis=0))[:stop]) if stop else np.zeros(0, np.int64)
            if not len(once):
                continue
            number, rows, cols = np.cumsum(new)[once], marks[3][once], marks[4][once]
            starts, own = run_labels(number, rows - marks[1][once] * size, cols - marks[2][once] * size, diagonal)
            first = np.repeat(starts[own], np.diff(np.append(starts, len(once))))
            columns = [some.column(0).take(pa.array(once)), *(pa.array(x) for x in (rows, cols, rows[first], cols[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "row_no", "col_no", "first_row", "first_col"])

    labelled = tiles.mapInArrow(label, f"{key} {dict(pixels.dtypes)[key]}, row_no long, col_no long, first_row long, first_col long")
    digits = lambda x: F.lpad((F.col(x) + 10**9).cast("string"), 10, "0")
    named = F.concat_ws("|", F.col(key).cast("string"), F.concat_ws(",", digits("first_row"), digits("first_col")))  # first pixels are in order as text too
    labelled = table(labelled.select(key, "row_no", "col_no", named.alias("part")), "region-tiles")

    at = lambda axis, step: F.pmod(F.col(axis), F.lit(size)) == (size - 1 if step > 0 else 0)
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    met = None
    for dr, dc in steps:
        over = (at("row_no", dr) if dr else F.lit(False)) | (at("col_no", dc) if dc else F.lit(False))
        side = labelled.where(over).select(key, (F.col("row_no") + dr).alias("row_no"), (F.col("col_no") + dc).alias("col_no"), F.col("part").alias("a"))
        found = side.join(labelled.select(key, "row_no", "col_no", F.col("part").alias("b")), [key, "row_no", "col_no"]).select("a", "b").where("a <> b")
        met = found if met is None else met.unionByName(found)
    names = connected(met.distinct(), "a", "b").select(F.col("id").alias("part"), "component")
    return labelled.join(names, "part", "left").select(key, "row_no", "col_no", F.coalesce("component", "part").alias("region"))


def measures(labelled: DataFrame, key: str = "cell") -> DataFrame:
    """key, region, pixels, top, left, bottom, right of each region."""
    corners = (F.min("row_no").alias("top"), F.min("col_no").alias("left"), F.max("row_no").alias("bottom"), F.max("col_no").alias("right"))
    return labelled.groupBy(key, "region").agg(F.count("*").alias("pixels"), *corners)


def outlines(labelled: DataFrame, key: str = "cell") -> DataFrame:
    """key, region, rings: the region's rings along pixel sides, x by columns and y by rows."""
    near = labelled.select(key, "region", F.explode(F.array(*(F.struct((F.col("row_no") + a).alias("row_no"), (F.col("col_no") + b).alias("col_no"), F.lit(s).alias("side")) for a, b, s in ((0, 1, 0), (1, 0, 1), (0, -1, 2), (-1, 0, 3))))).alias("n")).select(key, "region", "n.*")
    # a side is open if the pixel beyond it is not of the region
    free = near.join(labelled.select(key, "region", "row_no", "col_no"), [key, "region", "row_no", "col_no"], "left_anti")
    r, c = F.col("row_no"), F.col("col_no")
    ends = F.when(F.col("side") == 0, F.struct(c.alias("x1"), r.alias("y1"), c.alias("x2"), (r + 1).alias("y2")))
    ends = ends.when(F.col("side") == 1, F.struct((c + 1).alias("x1"), r.alias("y1"), c.alias("x2"), r.alias("y2")))
    ends = ends.when(F.col("side") == 2, F.struct((c + 1).alias("x1"), (r + 1).alias("y1"), (c + 1).alias("x2"), r.alias("y2")))
    ends = ends.otherwise(F.struct(c.alias("x1"), (r + 1).alias("y1"), (c + 1).alias("x2"), (r + 1).alias("y2")))
    sides = free.select(key, "region", ends.alias("e")).select(key, "region", "e.*")

    def trace(keys, rows):
        going: dict[tuple, list[tuple]] = {}
        for x1, y1, x2, y2 in sorted(zip(rows.x1, rows.y1, rows.x2, rows.y2, strict=True)):
            going.setdefault((x1, y1), []).append((x2, y2))
        rings = []
        while going:
            at = start = min(going)
            ring, came = [start], None
            while True:
                choices = going[at]
                # where two pixels touch at a corner the ring turns to the side it came from, so that rings don't cross
                turn = lambda to: 0 if came is None else (came[0] * (to[1] - at[1]) - came[1] * (to[0] - at[0]))  # noqa: B023, E731
                to = max(choices, key=turn)
                choices.remove(to)
                if not choices:
                    del going[at]
                came, at = (to[0] - at[0], to[1] - at[1]), to
                ring.append(at)
                if at == start:
                    break
            kept = [p for p, a, b in zip(ring[:-1], [ring[-2], *ring[:-2]], ring[1:], strict=True) if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
            rings.append([{"x": float(x), "y": float(y)} for x, y in [*kept, kept[0]]])
        return pd.DataFrame([{key: keys[0], "region": keys[1], "rings": rings}])

    return sides.groupBy(key, "region").applyInPandas(trace, f"{key} {dict(labelled.dtypes)[key]}, region string, rings {RINGS}")
