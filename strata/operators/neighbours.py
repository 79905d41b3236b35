"""Nearest neighbours among vectors: a few examples held by every task, or pairs found through cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.shared import written

HELD_BYTES = 64 << 20  # of examples that every task may hold
PIVOTS, ASKED_ROWS, MET_ROWS = 4_096, 1_024, 4_096
COPY, ROUNDS, AXES = 1_000, 3, 32  # what a copied vector costs in products; rounds of centring; coordinates that a bound is made of

TOP = "array<struct<sim:double,other:long,label:string>>"


def _best(ids: np.ndarray, vectors: np.ndarray, others: np.ndarray, held: np.ndarray, labels: np.ndarray, most: int, earlier: bool, least: float) -> list[list[dict]]:
    """For each of ids its ``most`` best of the others by inner product, ties to the smaller one; never itself, with ``earlier`` only smaller ids."""
    sims = vectors @ held.T
    able = (others[None, :] < ids[:, None]) if earlier else (others[None, :] != ids[:, None])
    able &= sims >= least
    out = []
    for row, fine in zip(sims, able):
        at = np.flatnonzero(fine)
        if len(at) > 4 * most:
            at = at[row[at] >= np.partition(row[at], len(at) - most)[len(at) - most]]
        at = at[np.lexsort((others[at], -row[at]))][:most]
        out.append([{"sim": float(row[j]), "other": int(others[j]), "label": labels[j]} for j in at])
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def nearest_examples(items: DataFrame, examples: DataFrame, most: int = 5, least: float = -math.inf) -> DataFrame:
    """(id, top) of items (id, vec): the best of the examples (id, label, vec) of the same length whose product is at least ``least``, as an array of (sim, other, label).

    Examples of at most HELD_BYTES together, counted first, go to every task, and items aren't moved.
    More of them are met through pivots, as in near_earlier.
    """
    own = written(_doubles(examples.where(F.col("vec").isNotNull()).select("id", "vec", "label")))
    size = own.agg(F.sum(F.size("vec") * 8 + 64)).first()[0] or 0
    if size > HELD_BYTES:
        asked = written(_doubles(items.where(F.col("vec").isNotNull()).select("id", "vec")))
        met = own.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= most + 1).drop("r")
        found = _meet(asked.withColumn("label", F.lit(None).cast("string")), met, _layouts(own, least), least, most, False)
        top = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("other").alias("o"), F.col("label").alias("l"))))  # ``most`` for each block that the item met
        best = found.groupBy("id").agg(F.slice(top, 1, most).alias("top"))
        best = best.select("id", F.transform("top", lambda t: F.struct((-t["s"]).alias("sim"), t["o"].alias("other"), t["l"].alias("label"))).alias("top"))
        return asked.select("id").join(best, "id", "left").select("id", F.coalesce("top", F.array().cast(TOP)).alias("top"))
    by_size: dict[int, list] = {}
    for r in own.collect():  # HELD_BYTES at most
        by_size.setdefault(len(r.vec), []).append(r)
    held = {d: (np.array([r.id for r in rs], np.int64), np.array([r.vec for r in rs]).reshape(len(rs), d), np.array([r.label for r in rs], object)) for d, rs in by_size.items()}
    shared = items.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            top: list = [[] for _ in range(len(pdf))]
            sizes = pdf["vec"].map(len).to_numpy()
            for d in np.unique(sizes) if len(pdf) else []:
                if int(d) in shared.value:
                    own = np.flatnonzero(sizes == d)
                    for first in range(0, len(own), ASKED_ROWS):
                        at = own[first : first + ASKED_ROWS]
                        found = _best(pdf["id"].to_numpy()[at], _matrix(pdf["vec"].iloc[at]), *shared.value[int(d)], most, False, least)
                        for i, best in zip(at, found):
                            top[i] = best
            yield pd.DataFrame({"id": pdf["id"], "top": top})

    return items.where(F.col("vec").isNotNull()).select("id", "vec").mapInPandas(run, f"id long, top {TOP}")


def near_earlier(rows: DataFrame, threshold: float, most: int = 1, since: int | None = None) -> DataFrame:
    """(id, other, sim): for each row (id, vec), or those from id ``since`` on, the ``most`` smaller ids most like it, at the threshold or above, the smaller id first among equals.

    Exact. A row asks in the cell of the pivot nearest to its direction. A product of t between rows with norms m and n takes
    directions no farther apart than r = sqrt(2 - 2 t / (m n)); a row is met in those cells alone whose half-space, the side of their pivot
    against its own nearest one, begins within r of it, m being the largest norm that asks there. So a long vector widens its
    own cell only. Of equal vectors the smallest id is met alone, at most ``most`` of them. A sample tells which number of pivots
    is the cheapest in products and copies: where directions crowd nowhere there are few or one, and all products that no
    bound rejects are computed, as nothing less would be exact. Cells are cut into blocks of bounded size, and each
    block of askers meets each block of the cell: first by the coordinates along main axes and the norms of what is left, which
    bound the product, then, where the bound allows it, whole. Only the best leave a block.
    """
    own = written(_doubles(rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).select("id", "vec")).withColumn("label", F.lit(None).cast("string")))
    met = own.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= most).drop("r")
    found = _meet(own if since is None else own.where(F.col("id") >= since), met, _layouts(own, threshold), threshold, most, True)
    if most == 1:
        best = found.groupBy("id").agg(F.max(F.struct("sim", (-F.col("other")).alias("o"))).alias("m"))
        return best.select("id", (-F.col("m.o")).alias("other"), F.col("m.sim").alias("sim"))
    ranks = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("r", F.row_number().over(ranks)).where(F.col("r") <= most).select("id", "other", "sim")


def _doubles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms); a zero vector has no direction and stays."""
    norm = np.sqrt((vectors**2).sum(1))
    return vectors / np.where(norm > 0, norm, 1.0)[:, None], norm


@dataclass(frozen=True)
class Layout:
    """Of vectors of one length: pivots (unit vectors, a row each) and main axes (a column each)."""

    pivots: np.ndarray
    axes: np.ndarray

    def homes(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each, and the squared distances to all."""
        far = np.maximum(0.0, (units**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2.0 * units @ self.pivots.T)
        return far.argmin(1), far

    def cells(self, units: np.ndarray, norms: np.ndarray, longest: np.ndarray, threshold: float) -> np.ndarray:
        """By row and cell, whether a row that asks there can reach the threshold with it; longest: the largest norm that asks in each cell."""
        home, far = self.homes(units)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(threshold > 0, threshold / (norms[:, None] * longest), -1.0)
        radius = np.sqrt(2.0 - 2.0 * np.clip(cosine, -1.0, 1.0)) * (1 + 1e-9) + 1e-6
        size = (self.pivots**2).sum(1)  # 1, or 0 for a zero vector
        apart = np.sqrt(np.maximum(0.0, size[:, None] + size - 2.0 * self.pivots @ self.pivots.T))
        ahead = far - far[np.arange(len(units)), home][:, None]
        return (ahead <= 2.0 * radius * apart[home] + 1e-6) & (cosine <= 1 + 1e-9)


def _centred(units: np.ndarray, n: int) -> np.ndarray:
    """n pivots: the first n of the sample, moved for some rounds to the middle of those nearest to them."""
    pivots = units[:n]
    for _ in range(ROUNDS if n > 1 else 0):
        home = Layout(pivots, pivots.T).homes(units)[0]
        middle = np.zeros_like(pivots)
        np.add.at(middle, home, units)
        middle, size = _directions(middle)
        pivots = np.where(size[:, None] > 0, middle, pivots)
    return pivots


def _layouts(rows: DataFrame, threshold: float) -> dict[int, Layout]:
    """By vector length, from a sample of at most PIVOTS vectors by their hash: main axes, and the number of pivots (a quarter
    of the sample, half of that, and so on) that costs least, a copy of a vector counting as COPY products."""
    chosen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec"), "id").limit(PIVOTS).select("vec").collect():
        chosen.setdefault(len(r.vec), []).append(r.vec)
    share, out = rows.count() / max(1, sum(map(len, chosen.values()))), {}
    for d, vectors in chosen.items():
        sample = np.array(vectors).reshape(len(vectors), d)
        units, norms = _directions(sample)
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :AXES]
        total, best = len(units) * share, math.inf
        n = max(1, len(units) // 4)  # a pivot is the middle of some at least
        while n:
            layout = Layout(_centred(units, n), axes)
            home, longest = layout.homes(units)[0], np.zeros(n)
            np.maximum.at(longest, home, norms)
            met = layout.cells(units, norms, longest, threshold)
            products = float((np.bincount(home, minlength=n) * met.sum(0)).sum()) / len(units) ** 2 * total
            cost = products + COPY * float(met.sum(1).mean())  # for each row
            if cost < best:
                out[d], best = layout, cost
            n //= 2
    return out


def _placed(rows: DataFrame, layouts: dict[int, Layout], threshold: float = 0.0, longest: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """rows (id, label, vec) with dim, norm and cell: a row's home, or with ``longest`` (by length and cell) each cell where it is met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, size = [[] for _ in range(len(pdf))], pdf["vec"].map(len).to_numpy()
            norm = np.zeros(len(pdf))
            for d in np.unique(size) if len(pdf) else []:
                at = np.flatnonzero(size == d)
                layout = layouts.get(int(d))
                units, norm[at] = _directions(_matrix(pdf["vec"].iloc[at]).reshape(len(at), int(d)))
                if layout is None:  # no row of this length on the other side
                    continue
                if longest is None:
                    found = [[h] for h in layout.homes(units)[0].tolist()]
                else:
                    asking = np.array([longest.get((int(d), c), -1.0) for c in range(len(layout.pivots))])
                    found = [np.flatnonzero(row).tolist() for row in layout.cells(units, norm[at], np.maximum(asking, 0.0), threshold) & (asking >= 0)]
                for i, own in zip(at, found):
                    cells[i] = own
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "dim": size, "norm": norm, "cells": cells, "vec": pdf["vec"]})

    found = rows.select("id", "label", "vec").mapInPandas(run, "id long, label string, dim int, norm double, cells array<long>, vec array<double>")
    return found.select("id", "label", "dim", "norm", F.explode("cells").alias("cell"), "vec")


def in_cells(askers: DataFrame, held: DataFrame, layouts: dict[int, Layout], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(askers, held) with their cells; cells where nobody asks hold nothing."""
    asked = written(_placed(askers, layouts))
    longest = {(r["dim"], r["cell"]): r["n"] for r in asked.groupBy("dim", "cell").agg(F.max("norm").alias("n")).collect()}  # a row for each pivot at most
    return asked, written(_placed(held, layouts, threshold, longest))


def _reaching(a: np.ndarray, b: np.ndarray, able: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, product) of the able pairs at the threshold or above. Coordinates on the axes and the norms of the rest reject pairs first."""
    (along_a, along_b), rest = (a @ axes, b @ axes), lambda v, p: np.sqrt(np.maximum(0.0, (v**2).sum(1) - (p**2).sum(1)))
    slack = 1e-9 * (1.0 + np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max()))
    able = able & (along_a @ along_b.T + np.outer(rest(a, along_a), rest(b, along_b)) >= threshold - slack)
    row, other = np.nonzero(able)
    if 8 * len(row) < able.size:
        sims = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[row[k : k + 65_536]], b[other[k : k + 65_536]]) for k in range(0, len(row), 65_536))])
    else:
        sims = (a @ b.T)[row, other]
    fine = sims >= threshold
    return row[fine], other[fine], sims[fine]


def _meet(askers: DataFrame, held: DataFrame, layouts: dict[int, Layout], threshold: float, most: int, earlier: bool) -> DataFrame:
    """(id, other, label, sim): the best of each block that an asker meets in its cell."""
    left, right = in_cells(askers, held, layouts, threshold)
    right = right.select("dim", "cell", F.col("id").alias("other"), "label", F.col("vec").alias("held"))
    blocks = lambda df, rows, name: df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(rows))).alias(name))
    counted = written(blocks(left, ASKED_ROWS, "blocks").join(blocks(right, MET_ROWS, "parts"), ["dim", "cell"]))  # a row for each cell
    again = counted.select(*(F.col(c).alias(c) for c in counted.columns))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = left.join(counted, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("part", every("parts")).select("dim", "cell", "block", "part", "id", "vec")
    right = right.join(again, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("other"), "parts")).withColumn("block", every("blocks")).select("dim", "cell", "block", "part", "other", "label", "held")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": [], "other": [], "label": [], "sim": []})
        if len(a) and len(b):
            ids, others = a["id"].to_numpy(), b["other"].to_numpy()
            able = others[None, :] < ids[:, None] if earlier else others[None, :] != ids[:, None]
            row, other, sim = _reaching(_matrix(a["vec"]), _matrix(b["held"]), able, layouts[int(a["dim"].iloc[0])].axes, threshold)
            order = np.lexsort((others[other], -sim, row))
            row, other, sim = row[order], other[order], sim[order]
            first = np.searchsorted(row, row)  # where a row's best begins
            kept = np.arange(len(row)) - first < most
            out = pd.DataFrame({"id": ids[row[kept]], "other": others[other[kept]], "label": b["label"].to_numpy(object)[other[kept]], "sim": sim[kept]})
        return out.astype({"id": "int64", "other": "int64", "label": object, "sim": "float64"})

    keys = ("dim", "cell", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "id long, other long, label string, sim double")
