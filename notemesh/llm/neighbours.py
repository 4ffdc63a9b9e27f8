"""Problem 6: the k most similar vectors of every vector, by collision counting.

Index: a coarse partition, fitted by k-means on about FIT_ROWS vectors (those with
a small hash of their key, whatever the size of the table), puts every vector
into the cell of its nearest centroid. A vector asks its own cell and each cell
whose centroid is nearly as similar as the best one (PROBE_MARGIN).

Search in a cell: each of PROJECTIONS random directions has an array of the cell's
vectors sorted by their projection. A query finds its own place in every array
and opens a window around it; a vector that lies in the windows of at least
COLLISIONS directions is verified with its exact cosine. The windows start narrow
and grow (virtual rehashing: only what a wider window adds is read and counted)
for the queries whose k-th verified vector is too far away for the window to have
shown all nearer ones; in its own cell a query that stays unresolved opens them
entirely, so every vector gets k neighbours if there are k. A vector whose cells
hold too few others asks the next nearest cells.

Exact copies of a vector search once. Only the k+1 smallest keys of a group of
copies can be results, so larger groups don't enlarge a cell. Cells with very
many vectors or queries are split into blocks and slices of bounded size.

Defined cases: a vector is usable if it is not null, has `dim` finite values and
isn't all zero; others neither ask nor answer. Ties of cosine (to 1e-10) go to
the smaller key by code point. Repeated rows count once; if copies of a key have
different vectors, the one with the largest hash counts. Fewer than k other
usable vectors give as many rows as there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import hashed_sample, read_table

#: Rows of the sample, at least, and for each cell up to MAX_CELLS.
FIT_ROWS, FIT_PER_CELL = 20_000, 4
CELL_ROWS = 650
MAX_CELLS = 16_384
PROBE_MARGIN = 0.035
PROJECTIONS = 24
COLLISIONS = 13
#: Half widths of the windows, in units of a unit vector's projection, and the wide last step of a query's own cell.
WINDOWS = (0.3, 0.45, 0.65)
#: A vector at distance d lies in a window of half width 1.2·d with probability 0.77, and then in 13 of 24 with 0.998.
SURE = 1.2
#: Most vectors, and queries, of a cell that one task works on.
BLOCK_ROWS = 8_192
SLICE_ROWS = 32_768
#: Entries of the table of collisions that is kept at once.
TABLE = 1 << 21
#: What a cosine in single precision may be off.
SINGLE = 2e-6


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull()).where(good).select(F.col(key).alias("key"), v.cast("array<float>").alias("vec"))


def fit_cells(vectors: DataFrame, n: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length one, as rows; n/CELL_ROWS of them, between 1 and MAX_CELLS."""
    wanted = int(max(1, min(MAX_CELLS, n // CELL_ROWS)))
    rows = hashed_sample(vectors.select("key", "vec"), ["key"], max(FIT_ROWS, FIT_PER_CELL * wanted), n).toPandas().sort_values("key")
    x = np.stack(rows["vec"].to_numpy()).astype(np.float32)
    x /= np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)
    k = min(wanted, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _probes(pdf: pd.DataFrame, centroids: np.ndarray, held: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, ...]:
    """The raw vectors; row, cell, whether it is the row's own cell, and whether the row must see all of it, for each probe."""
    raw = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
    near = unit(raw).astype(np.float32) @ centroids.T
    own = np.argmax(near, axis=1)
    asked = near >= near[np.arange(len(raw)), own][:, None] - PROBE_MARGIN
    lonely = asked @ held < least if held is not None else np.zeros(len(raw), bool)
    for i in np.flatnonzero(lonely):  # too few vectors there: the next nearest cells, too
        order = np.argsort(-near[i], kind="stable")
        asked[i, order[: int(np.searchsorted(np.cumsum(held[order]), least)) + 1]] = True
    row, cell = np.nonzero(asked)
    home = cell == own[row]
    return raw, row, cell, home, home | lonely[row]


def count_cells(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        total = np.zeros((len(c), 2), np.int64)
        for pdf in batches:
            if len(pdf):
                _, row, cell, home, _ = _probes(pdf, c)
                total[:, 0] += np.bincount(cell[home], minlength=len(c))
                total[:, 1] += np.bincount(cell[(pdf["nth"].to_numpy() == 1)[row]], minlength=len(c))
        yield pd.DataFrame({"cell": np.arange(len(c)), "data": total[:, 0], "asks": total[:, 1]})

    return run


ROLE_DATA, ROLE_ASK, ROLE_HOME = 1, 2, 4


def send(shared, parts, least: int) -> Callable:
    """Rows → one row for each task that needs the vector, with its role there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, (blocks, slices, held) = shared.value, parts.value
        for pdf in batches:
            if not len(pdf):
                continue
            raw, row, cell, home, whole = _probes(pdf, c, held, least)
            asks = (pdf["nth"].to_numpy() == 1)[row]
            spread = pdf["vh"].to_numpy(np.int64).view(np.uint64)
            nb, ns = blocks[cell], slices[cell]
            split = (nb * ns) > 1
            out = [(row, cell, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), home * ROLE_DATA + asks * ROLE_ASK + whole * ROLE_HOME)]
            if split.any():
                out = [tuple(x[~split] for x in out[0])]
                b, s = (spread[row] % nb.astype(np.uint64)).astype(np.int64), ((spread[row] >> np.uint64(20)) % ns.astype(np.uint64)).astype(np.int64)
                for i in np.flatnonzero(split):
                    if home[i]:
                        out.append(tuple(np.array(x) for x in ([row[i]] * ns[i], [cell[i]] * ns[i], [b[i]] * ns[i], range(ns[i]), [ROLE_DATA] * ns[i])))
                    if asks[i]:
                        out.append(tuple(np.array(x) for x in ([row[i]] * nb[i], [cell[i]] * nb[i], range(nb[i]), [s[i]] * nb[i], [ROLE_ASK + whole[i] * ROLE_HOME] * nb[i])))
            row, cell, b, s, role = (np.concatenate(x) for x in zip(*out))
            keep = role & (ROLE_DATA | ROLE_ASK) > 0
            row, cell, b, s, role = row[keep], cell[keep], b[keep], s[keep], role[keep]
            size = raw.shape[1] * 4
            data = raw.tobytes()
            packed = [data[i * size : (i + 1) * size] for i in range(len(raw))]
            yield pd.DataFrame({"task": (cell << 40) | (b << 20) | s, "role": role.astype(np.int32), "key": pdf["key"].to_numpy()[row], "vh": pdf["vh"].to_numpy()[row], "vec": [packed[i] for i in row]})

    return run


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((dim, PROJECTIONS))


class Windows:
    """The arrays of a cell, one a direction, sorted by projection, and for some queries the windows opened so far with the collisions in them."""

    def __init__(self, data: np.ndarray):
        self.order = np.argsort(data, axis=0, kind="stable")
        self.sorted = np.take_along_axis(data, self.order, axis=0)
        self.n = len(data)

    def ask(self, queries: np.ndarray) -> None:
        self.queries = queries
        self.count = np.zeros((len(queries), self.n), np.uint8)
        place = np.stack([np.searchsorted(self.sorted[:, i], queries[:, i]) for i in range(PROJECTIONS)], axis=1)
        self.low, self.high = place, place.copy()

    def keep(self, rows: np.ndarray) -> None:
        self.queries, self.count, self.low, self.high = self.queries[rows], self.count[rows], self.low[rows], self.high[rows]

    def widen(self, width: float) -> None:
        """Grows every window to `width` on both sides; what comes in collides once more."""
        flat = self.count.reshape(-1)
        base = np.arange(len(self.queries)) * self.n
        for i in range(PROJECTIONS):
            low = np.searchsorted(self.sorted[:, i], self.queries[:, i] - width, "left")
            high = np.searchsorted(self.sorted[:, i], self.queries[:, i] + width, "right")
            begin, end = np.r_[low, self.high[:, i]], np.r_[self.low[:, i], high]
            size = end - begin
            at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            flat[np.repeat(np.r_[base, base], size) + self.order[at, i]] += 1  # a datum comes in once a direction
            self.low[:, i], self.high[:, i] = low, high

    def colliding(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.count >= COLLISIONS)


def search(pdf: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    raw = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, dim)
    x = unit(raw)
    h = (x @ directions(dim)).astype(np.float32)
    x32 = x.astype(np.float32)
    role, key, vh = pdf["role"].to_numpy(), pdf["key"].to_numpy(), pdf["vh"].to_numpy(np.int64)
    data, asks = np.flatnonzero(role & ROLE_DATA), np.flatnonzero(role & ROLE_ASK)
    if not len(data) or not len(asks):
        return pd.DataFrame({"vh": np.empty(0, np.int64), "key": np.empty(0, object), "cos": np.empty(0)})
    data = data[np.argsort(key[data], kind="stable")]  # so that a stable sort by cosine leaves ties by key
    windows = Windows(h[data])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, TABLE // len(data))
    for at in range(0, len(asks), step):
        left = asks[at : at + step]
        windows.ask(h[left])
        for width in (*WINDOWS, None):
            if width is None:
                left = left[(role[left] & ROLE_HOME) > 0]
            if not len(left):
                break
            if width is None:
                qi, di = np.divmod(np.arange(len(left) * len(data)), len(data))
            else:
                windows.widen(width)
                qi, di = windows.colliding()
            near = np.empty(len(qi), np.float32)
            for part in range(0, len(qi), 1 << 18):
                cut = slice(part, part + (1 << 18))
                near[cut] = np.einsum("ij,ij->i", x32[left[qi[cut]]], x32[data[di[cut]]])
            order = np.lexsort((-near, qi))
            qi, di, near = qi[order], di[order], near[order]
            begin = np.searchsorted(qi, np.arange(len(left) + 1))
            rank = np.arange(len(qi)) - begin[qi]
            # the k+1-th verified vector: one of them is the query itself, or a copy
            last = np.full(len(left), -1.0, np.float32)
            at_k = rank == k
            last[qi[at_k]] = near[at_k]
            top = near >= last[qi] - SINGLE
            qi, di = qi[top], di[top]
            if width is not None:
                sure = SURE * np.sqrt(np.maximum(0, 2 - 2 * last)) <= width
                if width == WINDOWS[-1]:
                    sure |= (role[left] & ROLE_HOME) == 0  # other cells show what lies within the widest window
            else:
                sure = np.ones(len(left), bool)
            take = sure[qi]
            found.append((left[qi[take]], data[di[take]]))
            if width is not None:
                windows.keep(~sure)
            left = left[~sure]
    q = np.concatenate([f[0] for f in found])
    d = np.concatenate([f[1] for f in found])
    cos = np.empty(len(q))
    for part in range(0, len(q), 1 << 17):
        cut = slice(part, part + (1 << 17))
        cos[cut] = np.einsum("ij,ij->i", x[q[cut]], x[d[cut]]).round(10)
    place = np.empty(len(pdf), np.int64)
    place[data] = np.arange(len(data))
    order = np.lexsort((place[d], -cos, q))
    q, d, cos = q[order], d[order], cos[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    keep = rank <= k
    return pd.DataFrame({"vh": vh[q[keep]], "key": key[d[keep]], "cos": cos[keep]})


def nearest(rows: DataFrame, k: int, dim: int) -> DataFrame:
    """(key, neighbour, cos): for each key of usable rows (key string, vec array<float>) the k keys with the most similar vectors.

    Vectors are moved once to bring copies together and once to their cells;
    all else moves keys and hashes only.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("vh", F.xxhash64("vec"))
    base = materialize(hashed.groupBy("key").agg(F.max("vh").alias("vh")), "keys")
    # of a group of copies only the k+1 smallest keys can be results
    order = Window.partitionBy("vh").orderBy("key")
    first = base.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    keys = first.groupBy("vh").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    distinct = hashed.groupBy("vh").agg(F.first("vec").alias("vec"))
    reps = materialize(distinct.join(keys, "vh").select("vh", "vec", F.posexplode("keys").alias("at", "key")).select("vh", "vec", "key", (F.col("at") + 1).alias("nth")), "representatives")
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "key string, neighbour string, cos double")
    c = fit_cells(reps, n)
    shared = spark.sparkContext.broadcast(c)
    counts = reps.mapInPandas(count_cells(shared), "cell long, data long, asks long").groupBy("cell").agg(F.sum("data").alias("data"), F.sum("asks").alias("asks")).toPandas()
    blocks, slices = np.ones(len(c), np.int64), np.ones(len(c), np.int64)
    blocks[counts["cell"]] = np.maximum(1, -(-counts["data"] // BLOCK_ROWS))
    slices[counts["cell"]] = np.maximum(1, -(-counts["asks"] // SLICE_ROWS))
    held = np.zeros(len(c), np.int64)
    held[counts["cell"]] = counts["data"]
    parts = spark.sparkContext.broadcast((blocks, slices, held))
    sent = reps.mapInPandas(send(shared, parts, 4 * (k + 1)), "task long, role int, key string, vh long, vec binary")
    hits = sent.groupBy("task").applyInPandas(lambda pdf: search(pdf, k, dim), "vh long, key string, cos double")
    # at most k+1 rows of each of a vector's few cells meet here
    best = hits.groupBy("vh").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("far"), "key"))), 1, k + 1).alias("best"))
    own = base.select("vh", F.col("key").alias("own")).join(best, "vh")
    one = own.select("own", F.explode(F.slice(F.filter("best", lambda x: x["key"] != F.col("own")), 1, k)).alias("b"))
    return one.select(F.col("own").alias("key"), F.col("b.key").alias("neighbour"), (-F.col("b.far")).alias("cos"))


def register(reg: Registry) -> None:
    @reg.query("p6_found")
    def p6_found(spark: SparkSession, sf: str) -> DataFrame:
        chunks = read_table(spark, sf, "chunks").where("chunk_id IS NOT NULL")
        found = nearest(usable(chunks, "chunk_id", "embedding", 96), k=5, dim=96)
        return found.select(F.col("key").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"))
