"""Classes of pixels by colour, texture and what is known of their place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators import growth
from sitelens.operators.numbering import number

# Classes with the kernels that open and close them, the blur's and the texture's weights, the share of smooth pixels.
KERNELS = {"water": (3, 9), "bunker": (3, 5), "green": (3, 7), "fairway": (5, 11), "tee": (3, 5), "soft_grass": (3, 7)}
BLUR, SMOOTH, QUANTILE = np.array([1, 4, 6, 4, 1]), np.array([0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]), 0.55
#: Kinds of what is known of a place.
KINDS = ["water", "bunker", "green", "tee", "fairway", "cart_path", "exclude", "boundary"]
_RIM = len(BLUR) // 2 + len(SMOOTH) // 2


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) in whole numbers, as 8-bit image libraries give them."""
    v = F.greatest(r, g, b)
    span = v - F.least(r, g, b)
    per = lambda whole, by: F.when(by == 0, 0).otherwise(F.rint(F.lit(whole * 4096.0) / by)).cast("int")
    s = F.shiftright(span * per(255, v) + 2048, 12)
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * span).otherwise(r - g + 4 * span)
    h = F.shiftright(turn * per(30, span) + 2048, 12)
    return F.when(h < 0, h + 180).otherwise(h), s, v


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Lightness and the green-to-red axis, rounded to 0 to 255; within 1 of libraries that use tables."""
    flat = [F.when(c > 0.04045 * 255, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / (255.0 * 12.92)) for c in (r, g, b)]
    x = (flat[0] * 0.412453 + flat[1] * 0.357580 + flat[2] * 0.180423) / 0.950456
    y = flat[0] * 0.212671 + flat[1] * 0.715160 + flat[2] * 0.072169
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)
    light = F.when(y > 0.008856, F.pow(y, F.lit(1 / 3)) * 116 - 16).otherwise(y * 903.3)
    return F.rint(light * 2.55), F.rint((root(x) - root(y)) * 500 + 128)


def vegetation(r: Column, g: Column) -> Column:
    return (g - r) / (g + r + 1e-6)


def _mirrored(size: int, start: int, low: int, high: int) -> np.ndarray:
    """Of each place of an array from start on, the place that it mirrors at the edges low and high of the image."""
    c = np.arange(start, start + size)
    c = np.where(c < low, 2 * low - c, c)
    c = np.where(c > high, 2 * high - c, c)
    return np.clip(c, max(low, start), min(high, start + size - 1)) - start


def _along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis] - len(weights) + 1
    return sum(w * a.take(range(k, k + n), axis) for k, w in enumerate(weights))


def with_bounds(pixels: DataFrame) -> DataFrame:
    """pixels with the bounds x0, y0, x1, y1 of their image (key)."""
    b = pixels.groupBy("key").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return pixels.join(b, "key")


def textured(pixels: DataFrame, tile: int = growth.TILE) -> DataFrame:
    """Whole images pixels(key, x, y, r, g, b) with tex, the smoothed square of what a blur takes away; images mirror at their edges.
    Missing pixels count as black; of repeated ones any stays."""
    cols = ["key", "x", "y", "r", "g", "b"]
    px = with_bounds(pixels.select(F.col("key").cast("long").alias("key"), *[F.col(c).cast("long").alias(c) for c in "xy"], *[F.col(c).cast("int").alias(c) for c in "rgb"]).dropna().dropDuplicates(["key", "x", "y"]))
    px = px.withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b")))

    def tile_of(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, x0, y0 = growth._dense(frame, _RIM, tile)
        side = tile + 2 * _RIM
        a = np.zeros((side, side), np.int64)
        a[j, i] = frame["gray"].to_numpy()
        low_x, low_y, high_x, high_y = (int(frame[c].iloc[0]) for c in ("x0", "y0", "x1", "y1"))
        a = a[_mirrored(side, y0, low_y, high_y)][:, _mirrored(side, x0, low_x, high_x)]
        blurred = (_along(_along(a, BLUR, 0), BLUR, 1) + 128) >> 8
        inner = len(BLUR) // 2
        tex = _along(_along((a[inner:-inner, inner:-inner] - blurred).astype(float) ** 2, SMOOTH, 0), SMOOTH, 1)
        own = (i >= _RIM) & (i < _RIM + tile) & (j >= _RIM) & (j < _RIM + tile)
        return frame.loc[own, cols].assign(tex=tex[j[own] - _RIM, i[own] - _RIM])

    return growth.in_tiles(px, _RIM, tile).groupBy("key", "tx", "ty").applyInPandas(tile_of, "key long, x long, y long, r int, g int, b int, tex double")


def quantiles(rows: DataFrame, column: str, share: float) -> DataFrame:
    """(key, bound): the share's quantile of a column, between the two nearest values; rows are ranked without gathering a key."""
    placed = number(rows.select("key", column), [column], "_n", "key")
    size = rows.groupBy("key").agg(((F.count("*") - 1) * share + 1).alias("_at"))
    near = placed.join(size, "key").where((F.col("_n") == F.floor("_at")) | (F.col("_n") == F.ceil("_at")))
    low, high = F.min(column), F.max(column)
    return near.groupBy("key").agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("bound"))


def cleaned(pixels: DataFrame, tile: int = growth.TILE) -> DataFrame:
    """Pixels (key, x, y, x0, y0, x1, y1, classes) whose classes are opened, then closed; the image's edge takes nothing away. One
    shuffle for all classes."""
    rim = max(2 * (a // 2 + b // 2) for a, b in KERNELS.values())

    def tile_of(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, x0, y0 = growth._dense(frame, rim, tile)
        there = np.zeros((tile + 2 * rim,) * 2, bool)
        there[j, i] = True
        own = (i >= rim) & (i < rim + tile) & (j >= rim) & (j < rim + tile)
        out = frame.loc[own, ["key", "x", "y"]]
        for name, (a, b) in KERNELS.items():
            m = np.zeros_like(there)
            m[j, i] = frame[name].to_numpy()
            shrink = lambda m, k: growth.eroded(m | ~there, growth.ellipse(k), True) & there
            grow = lambda m, k: growth.dilated(m, growth.ellipse(k)) & there
            m = shrink(grow(grow(shrink(m, a), a), b), b)
            out[name] = m[j[own], i[own]]
        return out

    flags = ", ".join(f"{c} boolean" for c in KERNELS)
    return growth.in_tiles(pixels, rim, tile).groupBy("key", "tx", "ty").applyInPandas(tile_of, f"key long, x long, y long, {flags}")


def classes(pixels: DataFrame, known: DataFrame | None = None, tile: int = growth.TILE) -> DataFrame:
    """(key, x, y, classes as booleans) of images pixels(key, x, y, r, g, b); a pixel may be of several classes or of none.

    known(key, x, y, kind): places where a class is expected have weaker conditions for it, cart paths are no sand, excluded places
    are of no class, and where an image has a boundary only places within it are of any."""
    t = textured(pixels, tile)
    r, g = F.col("r"), F.col("g")
    (h, s, v), (light, a) = hsv(r, g, F.col("b")), lab(r, g, F.col("b"))
    t = t.join(quantiles(t, "tex", QUANTILE), "key").withColumns({"h": h, "s": s, "v": v, "light": light, "a": a, "veg": vegetation(r, g)})
    if known is None:
        t = t.withColumns({f"_{k}": F.lit(k == "boundary") for k in KINDS})
    else:
        at = known.groupBy("key", "x", "y").agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in KINDS])
        bounded = known.where("kind = 'boundary'").select("key", F.lit(True).alias("_bounded")).distinct()
        t = t.join(at, ["key", "x", "y"], "left").join(bounded, "key", "left")
        t = t.withColumns({f"_{k}": F.coalesce(F.col(f"_{k}"), F.lit(False)) for k in KINDS}).withColumn("_boundary", F.col("_boundary") | F.col("_bounded").isNull())
    c = lambda text: F.expr(text)
    t = t.withColumn("water", c("(v < 20 AND tex < 70 AND light < 32) OR (_water AND v < 55 AND tex < 160)"))
    t = t.withColumn("bunker", c("NOT water AND ((v > 165 AND veg < 0 AND h >= 8 AND h < 36 AND s > 35 AND r > 150 AND light > 150) OR (_bunker AND v > 140 AND veg < 0.06))"))
    t = t.withColumn("green", c("NOT water AND NOT bunker AND ((veg > 0.175 AND h BETWEEN 48 AND 85 AND s > 65 AND v > 75 AND v < 190 AND g > r + 20 AND (128 - a) / 128 > 0.04) OR (_green AND veg > 0.08 AND g > r + 8))"))
    t = t.withColumn("tee", c("(green AND tex < bound) OR (_tee AND veg > 0.06 AND NOT water AND NOT bunker)"))
    t = t.withColumn("soft_grass", c("v > 80 AND v < 205 AND h BETWEEN 20 AND 90 AND g + 8 >= r AND NOT water AND NOT bunker"))
    t = t.withColumn("fairway", c("soft_grass AND ((NOT green AND (veg > 0.03 OR (h BETWEEN 30 AND 75 AND v > 100))) OR _fairway)"))
    fine = c("_boundary AND NOT _exclude")
    t = t.withColumns({k: F.col(k) & fine & (~F.col("_cart_path") if k == "bunker" else F.lit(True)) for k in KERNELS})
    return cleaned(with_bounds(t.select("key", "x", "y", *KERNELS)), tile)
