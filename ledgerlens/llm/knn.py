"""Exact top-k search as a Voronoi join.

A bounded sample of the vectors are pivots; every vector belongs to the cell of its nearest
one. A summary per cell (rows, radius) bounds the score of any of its vectors with a query:
``q . x <= q . pivot + |q| * radius``. A first pass solves each query in its most promising
cells and so finds a score that its k-th best reaches at least; the query is then sent only to
the cells whose bound reaches that score, and each is solved locally. Cells are cut into
blocks of bounded size, and queries into groups, so a vector that many rows share, or a
cell that holds a third of them, is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import batches, bounded, staged

SCALE = 64
#: Pivots (a bounded sample); vectors of a block; queries of a group.
PIVOTS, BLOCK, GROUP = 64, 8_192, 4_096
#: Pairs of a block and a group that asks there up to which they are broadcast; about 2 MB.
BROADCAST_ROWS = 100_000

#: Components must fit here, so that products and their sums are exact as doubles.
LARGEST = float(1 << 53)

_HIT = "query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not
    finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & usable, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def matrix(rows: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which add nothing."""
    width = max(1, max(map(len, rows), default=1)) if width is None else width
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(queries: pd.Series, data: pd.Series) -> np.ndarray:
    """Inner products as whole numbers, exact also where doubles are not; one beyond a long counts
    as the largest or smallest long."""
    width = max(1, max(map(len, queries), default=1), max(map(len, data), default=1))
    q, x = matrix(queries, width), matrix(data, width)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < LARGEST:
        return (q @ x.T).astype(np.int64)
    wide = lambda rows: np.array([[int(v) for v in row] + [0] * (width - len(row)) for row in rows], dtype=object).reshape(len(rows), width)
    exact = wide(queries) @ wide(data).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


@dataclass(frozen=True)
class Cells:
    """Pivots with, per cell, its rows, radius and number of blocks."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    def fitted(self, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and pivots at the same width."""
        width = max(self.pivots.shape[1], max(map(len, rows), default=1))
        return matrix(rows, width), np.pad(self.pivots, ((0, 0), (0, width - self.pivots.shape[1])))

    def nearest(self, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector (ties: the first) and its distance to the pivot."""
        x, p = self.fitted(rows)
        away = ((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :])
        cell = away.argmin(1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))

    def bounds(self, rows: pd.Series) -> np.ndarray:
        """Upper bounds of the scores per query and cell, with room for rounding."""
        q, p = self.fitted(rows)
        bound = q @ p.T + np.sqrt((q**2).sum(1))[:, None] * self.radius[None, :]
        return bound + 1e-9 * np.abs(bound) + 1


def _pick(distinct: DataFrame, pivots: int) -> np.ndarray:
    rows = distinct.orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    return matrix(pd.Series([r["v"] for r in rows], dtype=object))


def _assigned(cells: Cells):
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, away = cells.nearest(frame["v"])
            yield frame.assign(cell=cell, away=away)

    return assign


def _blocks_of(cells: Cells, k: int, first: bool):
    """Rows (block, query): in the first pass the cells of the best bounds that hold k rows
    together, in the second all others whose bound reaches the score found."""

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 2_000):
            bounds, out = cells.bounds(frame["v"]), []
            for i, row in enumerate(bounds):
                order = np.argsort(-row, kind="stable")
                held = np.cumsum(cells.rows[order])
                # One more than k, as the query itself may be among them.
                head = order[: int(np.searchsorted(held, k + 1)) + 1]
                if first:
                    chosen = head
                else:
                    chosen = np.setdiff1d(np.flatnonzero(row >= frame["least"].iloc[i]), head)
                out += [(int(c), b, i) for c in chosen if cells.rows[c] for b in range(int(cells.blocks[c]))]
            if out:
                where = [x[2] for x in out]
                yield pd.DataFrame(
                    {
                        "cell": [x[0] for x in out], "block": [x[1] for x in out],
                        "id": frame["id"].to_numpy()[where], "v": frame["v"].to_numpy()[where],
                        "least": frame["least"].to_numpy()[where], "grp": frame["grp"].to_numpy()[where],
                        "asked": frame["asked"].to_numpy()[where],
                    }
                )

    return sent


def _solved(k: int):
    """The best k of a block for each query sent there, if they reach its score. A vector that
    several rows have counts as often, and so does a query."""

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        data = data.sort_values("id", kind="stable")
        ids, copies = data["id"].to_numpy(dtype=np.int64), data["copies"].to_numpy(dtype=np.int64)
        for start in range(0, len(queries) if len(data) else 0, 512):
            part = queries.iloc[start : start + 512]
            scores = products(part["v"], data["v"])
            own = part["id"].to_numpy(dtype=np.int64)
            least, asked = part["least"].to_numpy(dtype=np.int64), part["asked"].to_numpy(dtype=np.int64)
            for i, row in enumerate(scores):
                fit = np.flatnonzero((row >= least[i]) & (ids != own[i]))
                if len(fit) > k:
                    # Everything above the k-th score, then ties of it by id.
                    cut = np.partition(row[fit], len(fit) - k)[len(fit) - k]
                    above, tied = fit[row[fit] > cut], fit[row[fit] == cut]
                    fit = np.concatenate([above, tied[: k - len(above)]])
                times = np.minimum(copies[fit] * asked[i], k)
                if times.max(initial=1) > 1:
                    order = np.lexsort((ids[fit], ~row[fit]))  # highest score first
                    fit = np.repeat(fit[order], times[order])[:k]
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[fit], "score": row[fit]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return solve


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner products of each
    row for which ``queries`` holds, ties to the smaller key; all of them if there are fewer.

    Vectors that are null or hold a null or non-finite component, and rows without a key,
    take no part. A query never meets its own key. Repeated rows count as often as they are
    there, each with its own vector, as data and as queries, whose hits are ranked together by
    key. Vectors of different widths are compared as if filled up with zeros.
    """
    ready = vectors.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector)).alias("v"), queries.alias("asks"))
    counted = (F.count(F.lit(1)).alias("copies"), F.count_if("asks").alias("asked"))
    ready = staged(ready.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(*counted), "vectors")
    centres = _pick(ready.select("v").distinct(), pivots)
    none = np.zeros(0)
    cells = Cells(centres, none, none, none)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = staged(ready.mapInPandas(_assigned(cells), "id long, v array<long>, copies long, asked long, cell int, away double"), "cells")
    # One row per pivot.
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    rows = np.array([found[c]["n"] if c in found else 0 for c in range(len(centres))])
    radius = np.array([found[c]["r"] if c in found else 0.0 for c in range(len(centres))])
    cells = Cells(centres, rows, radius, -(-rows // block))
    counts = F.create_map(*[x for c, n in enumerate(cells.blocks) for x in (F.lit(c), F.lit(int(n)))])
    asking = placed.where("asked > 0").select("id", "v", "asked")
    groups = max(1, -(-asking.count() // group))
    asking = asking.select("id", "v", F.lit(-(1 << 63)).cast("long").alias("least"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), "asked")
    data = placed.select("id", "v", "copies", "cell", F.pmod(F.xxhash64("id"), counts[F.col("cell")]).cast("int").alias("block"))
    sent_type = "cell int, block int, id long, v array<long>, least long, grp int, asked long"

    def hits(sent: DataFrame) -> DataFrame:
        at = ("cell", "block", "grp")
        # A block is replicated to those groups only that ask there.
        needed = bounded(staged(sent.select(*at).distinct(), "needed"), BROADCAST_ROWS)
        return sent.groupBy(*at).cogroup(data.join(needed, ["cell", "block"]).groupBy(*at)).applyInPandas(_solved(k), _HIT)

    early = staged(_best(hits(asking.mapInPandas(_blocks_of(cells, k, True), sent_type)), k), "early")
    least = early.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("reached"))
    known = asking.join(least, F.col("id") == F.col("q"), "left").select("id", "v", F.coalesce("reached", "least").alias("least"), "grp", "asked")
    late = hits(known.mapInPandas(_blocks_of(cells, k, False), sent_type))
    best = _best(early.select("query_id", "vec_id", "score").union(late), k)
    return best.select("query_id", "rank", "vec_id", "score")
