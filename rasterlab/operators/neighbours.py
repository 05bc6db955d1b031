"""Exact nearest training rows by cells around pivots.

Training rows are filed under their nearest pivot (``pivots`` rows picked by a hash of the id), and each cell keeps its radius. A row
looks first into the cells nearest to it, as many as hold ``k`` rows; by the triangle inequality its k-th distance found there rules
out every cell whose pivot is farther than that distance and the radius together, and a second round searches the rest. Cells lie together in areas of at
most ``TASK_ROWS`` rows or so (larger cells are cut by a hash), searching rows are dealt to shards of as many: a task has an area and a shard, a searching row goes
to an area once, with the cells that it visits there, and a task compares ``block_rows`` training rows at a time and hands on k rows a searching row. So rows are
sent as often as there are areas or shards, some ``3 x cores`` of both together until the bound cuts them smaller, not once per cell and block.
What is collected are the pivots and a row per cell. Where distances hardly differ (many independent
features) no cell can be ruled out and all pairs are compared, as exactness asks.

Distances are ordered by their square to nine decimals, ties by training id. Ids of the searching rows are unique. With fewer than ``k`` training
rows all of them are given, without any none.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from rasterlab.session import cut_lineage

SLACK = 1e-6  # of distances, for their rounding
TASK_ROWS = 50_000  # of either side of a task
_ROWS, _COLUMNS = 256, 4096  # compared at once
_MATRIX = _ROWS * _COLUMNS


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1), 0)


def _wanted(d2: np.ndarray, bound: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) that may be among the k smallest of a row and within its bound."""
    if d2.shape[1] > k:
        wide = ~np.isfinite(bound)
        if wide.any():
            bound = bound.copy()
            bound[wide] = np.partition(d2[wide], k - 1, axis=1)[:, k - 1]
    return np.nonzero(d2 <= (bound + slack * (1 + bound))[:, None])


def _first(row: np.ndarray, d2: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest of each row, rows in order, ties by rank."""
    order = np.lexsort((rank, d2, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return order[np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) < k]


def _meet(a: np.ndarray, visits: np.ndarray, bound: np.ndarray, b: np.ndarray, cell: np.ndarray, rank: np.ndarray, k: int, block: int):
    """(row of a, row of b, squared distance) of the k nearest within ``bound``, and the pairs compared; b is sorted by ``cell``."""
    rows, cols, d2s, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    bound = bound.copy()
    for lo in range(0, len(a), _ROWS):
        x, own = a[lo:lo + _ROWS], bound[lo:lo + _ROWS]
        row, col, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c, first, last in zip(*_runs(cell)):
            there = np.flatnonzero(visits[lo:lo + _ROWS, c])
            pairs += len(there) * (last - first)
            for at in range(first, last if len(there) else first, block):
                y = b[at:min(at + block, last)]
                raw = _squares(x[there], y)
                scale = (x[there] ** 2).sum(1).max() + (y ** 2).sum(1).max()
                i, j = _wanted(raw, own[there], k, 1e-8 + 1e-12 * scale)
                if not len(i):
                    continue
                i, j = there[i], j + at
                new = np.round(((x[i] - b[j]) ** 2).sum(1), 9)
                row, col, d2 = np.r_[row, i], np.r_[col, j], np.r_[d2, new]
                keep = _first(row, d2, rank[col], k)
                row, col, d2 = row[keep], col[keep], d2[keep]
                full = np.bincount(row, minlength=len(x)) >= k
                top = np.zeros(len(x))
                np.maximum.at(top, row, d2)
                own = np.where(full, np.minimum(own, top), own)
        rows.append(row + lo)
        cols.append(col)
        d2s.append(d2)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(d2s), pairs


def _runs(cell: np.ndarray):
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[start].tolist(), start.tolist(), [*start[1:].tolist(), len(cell)]


def _dealt(count: np.ndarray, areas: int) -> list[list[int]]:
    """Areas of the blocks of each cell: whole cells where they fit an area, all areas about equal."""
    size, load = max(1, math.ceil(count.sum() / areas)), np.zeros(areas)
    out: list[list[int]] = [[] for _ in count]
    for c in np.argsort(-count, kind="stable").tolist():
        blocks = max(1, math.ceil(count[c] / size))
        for _ in range(blocks):
            at = int(load.argmin())
            load[at] += count[c] / blocks
            out[c].append(at)
    return out


def _visits(pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, areas: list[list[int]], k: int):
    """Rows (id, x, bound) with the cells that they visit, as bits, and the areas that hold them: of the first round (bound is null) or of the second."""
    reach = np.zeros((len(pivots), 1 + max(a for own in areas for a in own)), bool)
    for c, own in enumerate(areas):
        reach[c, own] = True

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n = part.num_rows
                d = np.sqrt(_squares(part.column(1).flatten().to_numpy().reshape(n, -1), pivots))
                d[:, count == 0] = np.inf
                near = np.argsort(d, axis=1, kind="stable")
                home = np.arange(len(pivots)) < 1 + (np.cumsum(count[near], axis=1) < k).sum(axis=1)[:, None]
                go = np.zeros(d.shape, bool)
                np.put_along_axis(go, near, home, axis=1)
                bound = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                later = ~np.isnan(bound)
                with np.errstate(invalid="ignore"):
                    go[later] = (~go & (d - radius <= (bound + SLACK * (1 + bound))[:, None]))[later]
                go &= count > 0
                to, at = np.nonzero(go @ reach), np.cumsum((go @ reach).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([r.tobytes() for r in np.packbits(go, axis=1)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, at].astype(np.int32)), pa.array(to[1].astype(np.int32)))],
                    names=["id", "x", "bound", "cells", "areas"])
    return run


def nearest_rows(train: DataFrame, test: DataFrame, k: int = 5, pivots: int = 64, block_rows: int = 100_000, pairs=None, sent=None) -> DataFrame:
    """(id, tid, y, d2): the k nearest training rows of every test row. ``pairs``, ``sent``: accumulators of the pairs compared and of
    the rows that searching sends to tasks."""
    tr = train.select(F.col("id").alias("tid"), "y", vector_to_array("features").alias("x"))
    te = cut_lineage(test.select("id", vector_to_array("features").alias("x")))
    picked = tr.orderBy(F.xxhash64("tid"), "tid").limit(pivots).collect()
    kind, tkind = te.schema["id"].dataType.simpleString(), tr.schema["tid"].dataType.simpleString()
    schema = f"id {kind}, tid {tkind}, y int, d2 double"
    spark = train.sparkSession
    if not picked:
        return spark.createDataFrame([], schema)
    p = np.array([r["x"] for r in picked])

    @F.pandas_udf("cell int, r double")
    def filed(x: pd.Series) -> pd.DataFrame:
        parts = [_squares(np.stack(x.iloc[at:at + 1000].to_numpy()), p) for at in range(0, len(x), 1000)]
        d = np.concatenate(parts) if parts else np.zeros((0, len(p)))
        return pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "r": np.sqrt(d.min(axis=1))})
    tr = cut_lineage(tr.withColumn("_at", filed("x")).select("tid", F.col("y").cast("int").alias("y"), "x", F.col("_at.cell").alias("cell"), F.col("_at.r").alias("r")))
    radius, count = np.zeros(len(p)), np.zeros(len(p), np.int64)
    for r in tr.groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
    n, asking = int(count.sum()), te.count()
    tasks = max(1, min(3 * spark.sparkContext.defaultParallelism, n * asking // _MATRIX))
    areas = max(math.ceil(n / TASK_ROWS), round(math.sqrt(tasks * n / max(1, asking))), 1)
    shards = max(math.ceil(asking / TASK_ROWS), math.ceil(tasks / areas), 1)
    of = _dealt(count, areas)
    cell, shard = F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    own = F.get(F.lit(of), cell)
    rows = tr.select("tid", "y", "x", "cell", F.get(own, F.pmod(F.xxhash64("tid"), F.size(own)).cast("int")).alias("area"),
                     F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    visits, block = _visits(p, radius, count, of, k), min(block_rows, _COLUMNS)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = dict(id=left.column("id").slice(0, 0), tid=right.column("tid").slice(0, 0), y=right.column("y").slice(0, 0), d2=pa.array([], pa.float64()))
        if left.num_rows and right.num_rows:
            right = right.take(np.argsort(right.column("cell").to_numpy(), kind="stable"))
            a, b = (t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
            bits = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            bound = left.column("bound").to_numpy().astype(float)
            rank = np.empty(right.num_rows, np.int64)
            rank[pc.sort_indices(right.column("tid")).to_numpy()] = np.arange(right.num_rows)
            row, col, d2, met = _meet(a, np.unpackbits(bits, axis=1), np.where(np.isnan(bound), np.inf, bound) ** 2, b, right.column("cell").to_numpy(), rank, k, block)
            if pairs is not None:
                pairs.add(met)
            if sent is not None:
                sent.add(left.num_rows)
            out = dict(id=left.column("id").take(row), tid=right.column("tid").take(col), y=right.column("y").take(col), d2=pa.array(d2))
        return pa.table(out)

    def searched(seekers: DataFrame) -> DataFrame:
        """The k best of every (row, area) visited."""
        to = seekers.select("id", "x", "bound").mapInArrow(visits, f"id {kind}, x array<double>, bound double, cells binary, areas array<int>")
        to = to.select("id", "x", "bound", "cells", shard, F.explode("areas").alias("area"))
        on = ["area", "shard"]
        return to.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(meet, schema)

    def kept(found: DataFrame) -> DataFrame:
        best = F.slice(F.sort_array(F.collect_list(F.struct("d2", "tid", "y"))), 1, k)  # k per area
        return found.groupBy("id").agg(best.alias("near"))
    first = cut_lineage(kept(searched(te.withColumn("bound", F.lit(None).cast("double")))))
    bound = F.when(F.size("near") >= k, F.sqrt(F.element_at("near", -1)["d2"])).otherwise(F.lit(float("inf")))
    more = searched(te.join(first.select("id", bound.alias("bound")), "id"))
    flat = first.select("id", F.inline("near")).select("id", "tid", "y", "d2")
    return cut_lineage(kept(flat.unionByName(more))).select("id", F.inline("near")).select("id", "tid", "y", "d2")


def nearest_scores(train: DataFrame, test: DataFrame, k: int = 5, by_distance: bool = False, **kw) -> DataFrame:
    """(id, score): share of positive rows among the k nearest, by count or by inverse distance."""
    w = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-12)) if by_distance else F.lit(1.0)
    near = nearest_rows(train, test, k, **kw)
    return near.groupBy("id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("score"))
