"""Arithmetic on arrays that recognition and indexing need, without the models: decoding, reading order, sizes, sharpness."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes that the image encoder takes; fixed values.
SIDE, PATCHES, PATCH = 48, 2_520, 16


def ctc_text(steps, probabilities, alphabet: list[str]) -> tuple[str, float]:
    """(text, mean probability of its characters) from the best class of each step; class 0 is blank, a repeated class counts once."""
    steps, p = np.asarray(steps, np.int64), np.asarray(probabilities, np.float64)
    kept = np.flatnonzero((steps > 0) & (steps < len(alphabet)) & (np.diff(steps, prepend=-1) != 0))
    return "".join(alphabet[i] for i in steps[kept]), float(p[kept].mean()) if len(kept) else 0.0


def ctc_decode(alphabet: list[str]):
    """A pandas UDF of ctc_text over arrays of classes and probabilities."""

    @F.pandas_udf("struct<text:string,score:double>")
    def run(steps: pd.Series, probabilities: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ctc_text(s, p, alphabet) for s, p in zip(steps, probabilities)], columns=["text", "score"])

    return run


def reading_lines(boxes: Column | str) -> Column:
    """Text of boxes (structs text, left, top, right, bottom) in reading order: a line is what lies at most half a box's
    height from the line's first box, by mean height; its parts go from left to right."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    middle = lambda x: (x["top"] + x["bottom"]) / 2.0
    height = lambda x: x["bottom"].cast("double") - x["top"]
    ordered = F.sort_array(F.transform(b, lambda x: F.struct(middle(x).alias("y"), x["left"].cast("double").alias("x"), height(x).alias("h"), x["text"].alias("text"))))
    part = lambda x: F.struct(x["x"].alias("x"), x["text"].alias("text"))
    line = lambda x: F.struct(x["y"].alias("y"), x["h"].alias("h"), F.array(part(x)).alias("parts"))
    none = F.array().cast("array<struct<y:double,h:double,parts:array<struct<x:double,text:string>>>>")

    def place(lines: Column, x: Column) -> Column:
        last = F.element_at(lines, -1)
        joined = F.struct(last["y"].alias("y"), last["h"].alias("h"), F.concat(last["parts"], F.array(part(x))).alias("parts"))
        same = (F.size(lines) > 0) & (F.abs(x["y"] - F.try_element_at(lines, F.lit(-1))["y"]) <= F.greatest(F.try_element_at(lines, F.lit(-1))["h"], x["h"]) * 0.5)
        return F.when(same, F.concat(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)), F.array(joined))).otherwise(F.concat(lines, F.array(line(x))))

    text = lambda one: F.concat_ws(" ", F.transform(F.sort_array(one["parts"]), lambda p: p["text"]))
    return F.concat_ws("\n", F.transform(F.aggregate(ordered, none, place), text))


def processing_size(height, width) -> tuple[Column, Column]:
    """(height, width) for the encoder: about the same aspect, multiples of SIDE, at most PATCHES patches."""
    h, w = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (height, width))
    scale = F.sqrt(F.lit(float(PATCHES * PATCH * PATCH)) / (h * w))
    longest = F.lit(PATCHES * PATCH * PATCH // (SIDE * SIDE) * SIDE)
    fit = lambda x: (F.floor(scale * x / SIDE) * SIDE).cast("int")
    along = lambda a, b: F.least((F.floor(a / b) * SIDE).cast("int"), longest)
    flat, thin = fit(h) == 0, fit(w) == 0
    return F.when(flat, SIDE).when(thin, along(h, w)).otherwise(fit(h)), F.when(flat, along(w, h)).when(thin, SIDE).otherwise(fit(w))


def sharpness(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of a luminance image, as 8-bit values around 128; its rim is taken as it is."""
    x = np.asarray(grey, np.int32)
    edges = x.copy()
    if min(x.shape) > 2:
        edges[1:-1, 1:-1] = np.clip(x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1] + 128, 0, 255)
    return float(edges.astype(np.float32).var())


def unclipped(points: np.ndarray, ratio: float = 1.5) -> np.ndarray:
    """A rectangle's corners moved outwards by area * ratio / perimeter on each side."""
    p = np.asarray(points, np.float64)
    along, down = p[1] - p[0], p[3] - p[0]
    w, h = np.linalg.norm(along), np.linalg.norm(down)
    if not w or not h:
        return p
    by = w * h * ratio / (2 * (w + h))
    a, d = along / w * by, down / h * by
    return p + np.array([-a - d, a - d, a + d, d - a])


def corners(points: np.ndarray) -> np.ndarray:
    """A rectangle's corners in their order around its centre, clockwise as seen, from the upper left one on."""
    p = np.asarray(points, np.float64)
    out = p - p.mean(0)
    around = p[np.argsort(np.arctan2(out[:, 1], out[:, 0]), kind="stable")]
    return np.roll(around, -int(around.sum(1).argmin()), axis=0)
