"""Exact top-k inner product search as a Voronoi kNN join.

Vectors become integers floor(scale * x). Pivots, drawn from a bounded sample,
divide all rows into Voronoi cells by Euclidean distance. Summaries of a cell
are its size and radius r, those of a query group its queries' largest norm,
their largest product with each pivot and the smallest one. With p the pivot of
a cell, q.x = q.p + q.(x - p) lies within |q| * r of q.p, which gives

* a score that k rows surely reach for every query of the group (cells in order
  of their lower bounds until k + 1 rows are counted, so a query's own row is
  allowed for), and
* the best score a cell can give to the group.

A cell is sent to a group only if its best score reaches the group's sure score,
and of its rows only those far enough from the pivot to reach it themselves.
Groups and cells meet in blocks of bounded size, are solved with one matrix
product each, and only k rows a query leave a block. The bounds hold for any
pivots, so results are exact whatever the sample. A block whose largest norms
multiply to 2 ** 52 or more is multiplied in 64-bit integers, so a score is exact
wherever it fits a long; bounds leave room for the rounding of such sizes.

Equal vectors tie, and of those only the k + 1 of smallest id can be among any
query's k, so others are left out before the join, exactly; a vector repeated
very often costs no more than a few rows.

Defined results: vectors that are null, of another length than the most common
one, or hold null or non-finite components take no part; rows with a null id
neither; rows of equal id are one row of the smallest vector text; ties go to
the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import tune, written

#: Rows from which pivots are drawn. There are as many pivots as the square root of the rows, between these bounds.
SAMPLE = 4096
PIVOTS = (16, 256)
#: Queries and candidates in one block.
QUERY_BLOCK = 1024
CELL_BLOCK = 8192


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (array of longs) of the rows that take part."""
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    )
    v = good.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return v.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")


def _pivots(rows: DataFrame) -> np.ndarray:
    """Pivots of a bounded sample (rows of lowest hash)."""
    most = int(np.clip(np.sqrt(rows.count()), *PIVOTS))
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("v").collect()], dtype=np.float64)
    if not len(sample):
        return sample
    rng = np.random.Generator(np.random.PCG64(1))
    chosen = [int(rng.integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and far.max() > 0:
        # Seeds are drawn by squared distance, which follows the density of the data.
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centre = sample[chosen]
    for _ in range(8):  # a few Lloyd steps tighten the cells
        cell = ((sample[:, None, :] ** 2).sum(axis=2) - 2 * sample @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        for k in np.unique(cell):
            centre[k] = sample[cell == k].mean(axis=0)
    return centre


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """vec_id, v, cell, distance to the cell's pivot, norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for part in batches:
            if not part.num_rows:
                continue
            x = _matrix(part.column("v"))
            square = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1), 0)
            cell = square.argmin(axis=1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))  # the expanded square above cancels near a pivot
            yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(axis=1)))], names=["vec_id", "v", "cell", "far", "norm"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cell int, far double, norm double")


def _group_summary(queries: DataFrame, pivots) -> pd.DataFrame:
    """cell -> largest norm of its queries, and their smallest and largest product with each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        low, high, norm = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf), np.zeros(len(p))
        for part in batches:
            if part.num_rows:
                x, cell = _matrix(part.column("v")), part.column("cell").to_numpy()
                dot = x @ p.T
                np.minimum.at(low, cell, dot)
                np.maximum.at(high, cell, dot)
                np.maximum.at(norm, cell, part.column("norm").to_numpy())
        used = np.flatnonzero(np.isfinite(low[:, 0])) if len(p) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(norm[used]), pa.array(list(low[used]), pa.list_(pa.float64())), pa.array(list(high[used]), pa.list_(pa.float64()))], names=["cell", "norm", "low", "high"])

    rows = queries.select("v", "cell", "norm").mapInArrow(run, "cell int, norm double, low array<double>, high array<double>")
    each = rows.select("cell", "norm", "low", F.posexplode("high").alias("c", "h")).select("cell", "norm", "c", F.get("low", "c").alias("l"), "h")
    return each.groupBy("cell", "c").agg(F.max("norm").alias("norm"), F.min("l").alias("low"), F.max("h").alias("high")).toPandas()  # at most the square of PIVOTS rows


def _needed(groups: pd.DataFrame, cells: pd.DataFrame, k: int) -> list[tuple[int, int, float]]:
    """(query group, cell, least distance to the cell's pivot) of rows that can hold a result. Sizes follow PIVOTS, not the data."""
    out = []
    cells = cells.sort_values("cell")
    for g, of in groups.groupby("cell"):
        of = of.set_index("c").loc[cells["cell"]]
        norm, reach = of["norm"].max(), of["norm"].max() * cells["radius"].to_numpy()
        low, high = of["low"].to_numpy() - reach, of["high"].to_numpy()
        order = np.argsort(-low)
        enough = np.searchsorted(np.cumsum(cells["n"].to_numpy()[order]), k + 1)
        sure = low[order[enough]] if enough < len(order) else -np.inf
        # Room for the rounding of products, whose size follows the terms and not what is left of them.
        sure -= 1e-6 * (1 + abs(sure)) + 1e-12 * (np.abs(of["low"]).max() + np.abs(high).max() + reach.max()) if np.isfinite(sure) else 0
        for c, h, r in zip(cells["cell"], high, cells["radius"]):
            # q.x <= q.p + |q| * |x - p|: rows nearer to the pivot than this can't reach the sure score.
            least = (sure - h) / norm if norm > 0 else (-np.inf if h >= sure else np.inf)
            room = 1e-9 * (1 + abs(r))
            if least <= r + room:
                out.append((int(g), int(c), float(least) - room))
    return out


def _merged(asked: dict[int, int], pivots: np.ndarray) -> dict[int, int]:
    """Query cells joined with near ones to groups of about QUERY_BLOCK queries, so that data are replicated seldom."""
    left, out, group, filled = set(asked), {}, 0, 0
    at = min(left)
    while left:
        if filled and filled + asked[at] > QUERY_BLOCK:
            group, filled = group + 1, 0
        out[at] = group
        filled += asked[at]
        left.discard(at)
        if left:
            at = min(left, key=lambda c: (((pivots[c] - pivots[at]) ** 2).sum(), c))
    return out


def _solve(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["asks"]], rows[~rows["asks"]].sort_values("vec_id")
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        qi, ci = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        a, b = np.stack(q["v"].to_numpy()).astype(np.int64), np.stack(c["v"].to_numpy()).astype(np.int64)
        size = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max())
        if size(a) * size(b) < 2.0**52:
            a, b = a.astype(np.float64), b.astype(np.float64)  # every partial sum is an integer that doubles hold
        out = []
        for s in range(0, len(qi), 256):
            score = (a[s : s + 256] @ b.T).astype(np.int64)
            own = qi[s : s + 256, None] == ci[None, :]
            score[own] = np.iinfo(np.int64).min
            n = min(k, score.shape[1])
            # Candidates stand in order of id; the k-th best score bounds what can be chosen, ties included.
            least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
            for i in range(len(score)):
                at = np.flatnonzero((score[i] >= least[i]) & ~own[i])
                at = at[np.lexsort((ci[at], ~score[i][at]))][:n]
                out.append(pd.DataFrame({"query_id": np.full(len(at), qi[s + i]), "vec_id": ci[at], "score": score[i][at]}))
        return pd.concat(out, ignore_index=True)

    return run


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    tune(spark)
    rows = written(integers(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-rows")
    pivots = spark.sparkContext.broadcast(_pivots(rows))  # at most 256 vectors
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not len(pivots.value):
        return empty
    placed = written(_placed(rows, pivots), "topk-placed")
    queries = placed.where(F.col("vec_id") % every == 0)
    # Of equal vectors only k + 1 can matter. A hash names them; rows that share one without being equal
    # would cost a little pruning at most, so the vector itself is part of the key.
    first = Window.partitionBy("v").orderBy("vec_id")
    useful = written(placed.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth"), "topk-useful")
    cells = useful.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toPandas()  # a row per pivot
    groups = _group_summary(queries, pivots)
    if groups.empty:
        return empty
    asked = queries.groupBy("cell").count().toPandas().set_index("cell")["count"].to_dict()
    merged = _merged(asked, pivots.value)
    pairs: dict[tuple[int, int], float] = {}
    for g, c, least in _needed(groups, cells, k):
        pairs[merged[g], c] = min(pairs.get((merged[g], c), np.inf), least)
    size = {m: sum(asked[g] for g in asked if merged[g] == m) for m in merged.values()}
    q_blocks = {g: -(-int(n) // QUERY_BLOCK) for g, n in size.items()}
    # Small cells share a pack, so that there are as many blocks as the rows ask for, not as there are cells.
    pack, rows_of, at = {}, [0], 0
    for r in cells.sort_values("cell").itertuples():
        if rows_of[at] and rows_of[at] + r.n > CELL_BLOCK:
            rows_of.append(0)
            at += 1
        pack[int(r.cell)] = at
        rows_of[at] += int(r.n)
    c_blocks = [-(-n // CELL_BLOCK) for n in rows_of]
    home = spark.createDataFrame([(int(c), int(m)) for c, m in merged.items()], "cell int, g int")
    # Which blocks of which cells each side goes to; its size follows the square of PIVOTS, not the data.
    gives_to = spark.createDataFrame([(g, c, pack[c], q_blocks[g], c_blocks[pack[c]], least) for (g, c), least in sorted(pairs.items())], "g int, c int, p int, qb int, cb int, least double")
    asks_in = spark.createDataFrame(sorted({(g, pack[c], q_blocks[g], c_blocks[pack[c]]) for g, c in pairs}), "g int, p int, qb int, cb int")
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col(n))
    asks = queries.join(F.broadcast(home), "cell").join(F.broadcast(asks_in), "g").select("g", "p", block("qb").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb").cast("long") - 1)).alias("d"), F.lit(True).alias("asks"), "vec_id", "v")
    gives = useful.join(F.broadcast(gives_to), (F.col("cell") == F.col("c")) & (F.col("far") >= F.col("least"))).select("g", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb").cast("long") - 1)).alias("b"), block("cb").alias("d"), F.lit(False).alias("asks"), "vec_id", "v")
    found = asks.unionByName(gives).groupBy("g", "p", "b", "d").applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
