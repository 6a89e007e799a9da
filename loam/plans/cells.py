"""Vectors in cells of two levels, as many as the rows ask for, with the angles that bound what a cell can hold.

Coarse centres, about the square root of the number of cells, are fitted on a bounded sample and sent to all tasks;
every coarse cell gets fine centres of its own, fitted on a bounded sample of its rows and kept as a table. Each
row is assigned and measured: a cell's radius is the widest angle between its centre and any of its rows. By
the triangle inequality a vector at most an angle w away from some row of a cell lies within the cell's radius plus w of its
centre; ``reach`` finds these cells, coarse ones first. Vectors without direction have cells of their own (coarse -1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.materialize import keep, small_side

#: Rows a fine cell should hold, and rows that coarse centres and the fine centres of one coarse cell are fitted on at most.
CELL_ROWS, SAMPLE, FINE_SAMPLE = 512, 16_384, 8_192
#: Numbers that coarse centres are fitted on at most: longer vectors have smaller samples.
SAMPLE_VALUES = SAMPLE * 64
#: Rows that are assigned, or looked up, together.
PART_ROWS = 20_000
ROUNDS = 8
#: Angles are widened by this, as the arc cosine loses digits near 0.
SLACK = 1e-6


def unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centres_of(u: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of unit vectors by a few rounds of spherical k-means."""
    c = u[:: max(1, len(u) // max(1, wanted))][:wanted]
    for _ in range(ROUNDS):
        best = np.argmax(u @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, u)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return c


def angles(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ c.T, -1, 1))


def _no_rows(columns: list[str]) -> pd.DataFrame:
    """No rows, of columns that Arrow takes for any type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _by_length(vectors: pd.Series, known: dict[int, np.ndarray]):
    """Places, unit vectors by length; those without direction, or of a length without centres, as None."""
    sizes = vectors.map(len).to_numpy()
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        u = unit(vectors.to_numpy()[at]) if dims else np.zeros((len(at), 0))
        seen = u.any(axis=1) & (dims in known)
        if (~seen).any():
            yield int(dims), at[~seen], None
        if seen.any():
            yield int(dims), at[seen], u[seen]


@dataclass
class Cells:
    coarse: dict[int, np.ndarray]  # centres by vector length
    wide: dict[tuple[int, int], float]  # radius of each coarse cell that has rows
    fine: DataFrame  # dims, coarse, fine, centre, radius, n
    rows: DataFrame  # the given columns with dims, coarse, fine, held (rows of the cell)

    @staticmethod
    def fit(rows: DataFrame, cell_rows: int | None = None) -> Cells:
        """Cells of rows with a column ``vec`` of doubles; other columns (``id`` among them) pass."""
        rows = rows.where(F.size("vec") > 0)
        n = rows.count()
        cells = max(1, n // (cell_rows or CELL_ROWS))
        share = F.least(F.lit(SAMPLE), SAMPLE_VALUES / F.size("vec")) / max(n, 1)
        # drawn row by row: the smallest rows of every partition would all come to the driver
        drawn = rows.select("id", "vec", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
        sample = drawn.toPandas().sort_values(["h", "id"])["vec"]  # about SAMPLE rows and SAMPLE_VALUES numbers at most
        coarse = {}
        for dims in sorted({len(v) for v in sample}):
            own = [v for v in sample if len(v) == dims and np.any(v)]
            if own:
                coarse[dims] = centres_of(unit(own), max(1, round(np.sqrt(cells * len(own) / len(sample)))))

        def to_coarse(batches):
            for pdf in batches:
                cell, far, length = np.full(len(pdf), -1), np.full(len(pdf), np.pi), pdf["vec"].map(len).to_numpy()
                for dims, at, u in _by_length(pdf["vec"], coarse):
                    if u is not None:
                        a = angles(u, coarse[dims])
                        cell[at], far[at] = np.argmin(a, axis=1), a.min(axis=1)
                yield pdf.assign(dims=length, coarse=cell, far=far)

        ddl = ", ".join(f"`{k}` {v}" for k, v in rows.dtypes)
        homed = keep(rows.mapInPandas(to_coarse, f"{ddl}, dims int, coarse int, far double"), "coarse")
        # a row a coarse cell: about the square root of the number of cells
        sizes = homed.groupBy("dims", "coarse").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        wide = {(r["dims"], r["coarse"]): r["far"] for r in sizes}
        table = homed.sparkSession.createDataFrame([(r["dims"], r["coarse"], r["n"]) for r in sizes], "dims int, coarse int, n long")
        per_cell = cell_rows or CELL_ROWS

        def split(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            wanted = max(1, int(pdf["n"].iloc[0]) // per_cell)
            c = centres_of(unit(pdf["vec"]), min(wanted, len(pdf))) if keys[1] >= 0 else np.zeros((1, keys[0]))
            return pd.DataFrame({"dims": keys[0], "coarse": keys[1], "fine": np.arange(len(c)), "centre": list(c)})

        drawn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < (FINE_SAMPLE / F.col("n") * (1 << 30))
        some = homed.select("id", "vec", "dims", "coarse").join(F.broadcast(table), ["dims", "coarse"]).where(drawn)
        fine = keep(some.groupBy("dims", "coarse").applyInPandas(split, "dims int, coarse int, fine int, centre array<double>"), "fine")
        parts = table.select("dims", "coarse", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
        salted = homed.drop("far").join(F.broadcast(parts), ["dims", "coarse"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")).drop("parts")
        given = [c for c, _ in rows.dtypes]

        def to_fine(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = left[[*given, "dims", "coarse"]]
            if not len(left):
                return _no_rows([*given, "dims", "coarse", "fine", "far"])
            if not len(right) or keys[1] < 0:
                return out.assign(fine=0, far=np.pi)
            right = right.sort_values("fine")
            a = angles(unit(left["vec"]), np.stack(right["centre"].to_list()))
            return out.assign(fine=right["fine"].to_numpy()[np.argmin(a, axis=1)], far=a.min(axis=1))

        spread = fine.join(F.broadcast(parts), ["dims", "coarse"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        placed = salted.groupBy("dims", "coarse", "part").cogroup(spread.groupBy("dims", "coarse", "part")).applyInPandas(to_fine, f"{ddl}, dims int, coarse int, fine int, far double")
        placed = keep(placed, "cells")
        held = placed.groupBy("dims", "coarse", "fine").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        table = keep(fine.join(held, ["dims", "coarse", "fine"]), "fine-cells")
        sized = table.select("dims", "coarse", "fine", F.col("n").alias("held"))
        return Cells(coarse, wide, table, placed.drop("far").join(small_side(sized), ["dims", "coarse", "fine"]))

    def reach(self, asked: DataFrame, nearest: int | None = None) -> DataFrame:
        """``asked`` (id, vec, widest, other columns) with every cell (coarse, fine) that may hold a row within the angle ``widest``, the
        angle to its centre (``ang``), its radius and its rows (``n``).

        ``nearest``: only the cells of so many nearest coarse cells, whatever the angle.
        """
        coarse, wide = self.coarse, self.wide

        def to_coarse(batches):
            for pdf in batches:
                rows, cells = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
                for dims, at, u in _by_length(pdf["vec"], coarse):
                    held = [c for d, c in wide if d == dims]
                    if u is None:
                        rows.append(np.repeat(at, len(held)))
                        cells.append(np.tile(np.array(held, dtype=int), len(at)))
                        continue
                    seen = np.array([c for c in held if c >= 0], dtype=int)
                    a = angles(u, coarse[dims][seen])
                    near = a <= np.array([wide[dims, c] for c in seen])[None, :] + pdf["widest"].to_numpy()[at][:, None] + SLACK
                    if nearest is not None:
                        near = np.zeros_like(near)
                        np.put_along_axis(near, np.argsort(a, axis=1)[:, :nearest], True, axis=1)
                    i, j = np.nonzero(near)
                    rows += [at[i], at] if -1 in held else [at[i]]
                    cells += [seen[j], np.full(len(at), -1)] if -1 in held else [seen[j]]
                i, c = np.concatenate(rows), np.concatenate(cells)
                if len(i):
                    yield pdf.iloc[i].assign(dims=pdf["vec"].map(len).to_numpy()[i], coarse=c)

        ddl = ", ".join(f"`{k}` {v}" for k, v in asked.dtypes)
        sent = asked.mapInPandas(to_coarse, f"{ddl}, dims int, coarse int")
        # a coarse cell may be asked by any number of vectors: they are dealt over parts, each with the cell's centres
        parts = max(1, -(-self.rows.count() // (max(1, len(self.wide)) * PART_ROWS)))
        salted = sent.withColumn("part", F.pmod(F.xxhash64("id", "coarse"), F.lit(parts)).cast("int"))
        centres = self.fine.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        given = [c for c, _ in asked.dtypes]

        def to_fine(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = [*given, "dims", "coarse", "fine", "ang", "radius", "n"]
            if not len(left) or not len(right):
                return _no_rows(columns)
            u, blind = unit(left["vec"]), keys[1] < 0
            a = np.zeros((len(left), len(right))) if blind else angles(u, np.stack(right["centre"].to_list()))
            a[~u.any(axis=1)] = 0
            near = a <= right["radius"].to_numpy()[None, :] + left["widest"].to_numpy()[:, None] + SLACK
            i, j = np.nonzero(near if nearest is None and not blind else np.ones_like(near, dtype=bool))
            other = right.iloc[j].reset_index(drop=True)
            out = left[given].iloc[i].reset_index(drop=True)
            out = out.assign(dims=keys[0], coarse=keys[1], fine=other["fine"], ang=a[i, j], radius=other["radius"], n=other["n"])[columns]
            return out if len(out) else _no_rows(columns)

        grouped = salted.groupBy("dims", "coarse", "part").cogroup(centres.groupBy("dims", "coarse", "part"))
        return grouped.applyInPandas(to_fine, f"{ddl}, dims int, coarse int, fine int, ang double, radius double, n long")
