"""Exact top-k inner-product search by ball-tree branch and bound, shard by shard.

Shards. Vectors go to the cell of the nearest of at most CELLS pivots (vectors of least hash); the table of cells holds
each cell's centre, radius and number of rows, and a large cell is several shards of it, dealt by a hash of the id. A
task builds its shard's ball tree (centre and radius a node) and answers the queries that stream past in blocks. An
upper bound for a query q over a ball is q . centre + |q| radius; nodes are visited best bound first, and one is left
out for the queries whose current k-th score its bound doesn't reach. That score is shared: in a first round a query
goes to one shard of the cell with the best bound, and its k-th score there is where all other shards start from;
cells whose bound doesn't reach it never get the query. Results of the shards are merged by a ranked window of k rows a
shard.

Components become floor(scale * x), saturated to 64 bits. Vectors that are null or hold null or non-finite components,
and rows with a null id, take no part. Vectors are compared with those of the same number of components. A query's own
row is the one with its id (rows that repeat the id are left out with it; of a query id's vectors the smallest
counts). Equal scores: smaller id first. Scores are exact: float64 where all products and sums stay below 2^53, Python
integers otherwise, then saturated to 64 bits. Fewer than k candidates give fewer rows, empty tables none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import saved

#: Bytes of vectors in a shard, and its least rows; rows of a tree's leaf; queries searched at once.
SHARD_BYTES, SHARD, LEAF, QUERY_ROWS = 1 << 25, 2048, 64, 1024
#: Most cells of the vectors of one length, most numbers in the pivots of one length, and lengths that have cells (the
#: most frequent ones; vectors of another length are one cell that is always searched).
CELLS, PIVOT_NUMBERS, CELLED = 64, 1 << 22, 16
#: Most shards of a cell (more rows make larger shards), and rows that go on at once when queries are dealt.
MOST_SHARDS, ROUTED = 1 << 20, 4096
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def fixed_point(c: Column, scale: int) -> Column:
    return F.transform(c, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def takes_part(c: Column) -> Column:
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & ~F.coalesce(odd, F.lit(True))


class BallTree:
    """Over the rows of vectors (int64) with ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.largest = k, int(np.abs(vectors.astype(np.float64)).max()) if vectors.size else 0
        self.nodes: list[tuple] = []  # (centre, radius, left, right) or (centre, radius, ids, vectors)
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.points = self.vectors.astype(np.float64)
        if len(ids):
            self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        x = self.points[rows]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append(())
        same = len(rows) > 1 and bool((x == x[0]).all())
        if same:
            # of equal vectors only the smallest ids can be found: k rows of each, and one id more as a query's own go
            first = np.concatenate([[True], np.diff(self.ids[rows]) != 0])
            nth = np.cumsum(first) - 1
            rows = rows[(nth <= self.k) & (np.arange(len(rows)) - np.flatnonzero(first)[nth] < self.k)]
        if len(rows) <= LEAF or same:
            self.nodes[at] = (centre, radius, None, rows)
            return at
        a = x[((x - centre) ** 2).sum(axis=1).argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        side = x @ (b - a)
        order = np.argsort(side, kind="stable")
        half = len(rows) // 2
        left, right = np.sort(rows[order[:half]]), np.sort(rows[order[half:]])
        self.nodes[at] = (centre, radius, self._build(left), self._build(right))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of k columns, best first; LAST and NONE where there is none. floor: scores that the k-th of
        the whole search is known to reach."""
        m, k = len(queries), self.k
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))
        most = float(np.abs(q).max()) if q.size else 0.0
        exact = most * self.largest * max(1, q.shape[1]) < 2**53
        best, ids = np.full((m, k), NONE), np.full((m, k), LAST)
        kth = floor.astype(np.float64)
        if not self.nodes:
            return ids, best

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            size = float(np.sqrt((centre**2).sum())) + radius
            return q[rows] @ centre + norm[rows] * (radius + 1e-9 * size) + 1e-6

        def visit(node: int, rows: np.ndarray, upper: np.ndarray) -> None:
            rows = rows[upper >= kth[rows]]
            if not len(rows):
                return
            _, _, left, right = self.nodes[node]
            if left is None:
                if exact:
                    score = (q[rows] @ self.points[right].T).astype(np.int64)
                else:
                    full = queries[rows].astype(object) @ self.vectors[right].astype(object).T
                    score = np.array([[min(max(int(v), NONE + 1), LAST) for v in r] for r in full], np.int64).reshape(len(rows), len(right))
                who = np.broadcast_to(self.ids[right], score.shape)
                score = np.where(who == own[rows][:, None], NONE, score)
                who = np.where(score == NONE, LAST, who)
                some = (score >= kth[rows][:, None]).any(axis=1)
                rows, score, who = rows[some], score[some], who[some]
                if len(rows):
                    s, w = np.concatenate([best[rows], score], axis=1), np.concatenate([ids[rows], who], axis=1)
                    order = np.lexsort((w, ~s), axis=-1)[:, :k]  # ~s falls as s rises, without overflow
                    best[rows], ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
                    kth[rows] = np.maximum(kth[rows], best[rows][:, -1])
                return
            a, b = bound(left, rows), bound(right, rows)
            if a.sum() >= b.sum():
                visit(left, rows, a)
                visit(right, rows, bound(right, rows))
            else:
                visit(right, rows, b)
                visit(left, rows, bound(left, rows))

        rows = np.arange(m)
        visit(0, rows, bound(0, rows))
        return ids, best


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def _search(k: int):
    """Rows of one (dims, shard) stand together: vectors (role 0), then queries (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "shard", "role")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if lo == hi:
                    continue
                here, role = (int(keys[lo][0]), int(keys[lo][1])), int(keys[lo][2])
                if here != shard:
                    shard, tree, parts = here, None, []
                part = batch.slice(lo, hi - lo)
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
                if role == 0:
                    parts.append((ids, vectors))
                    continue
                if tree is None:
                    empty = (np.zeros(0, np.int64), np.zeros((0, here[0]), np.int64))
                    tree = BallTree(*(np.concatenate(x) for x in zip(*(parts or [empty]), strict=True)), k)
                    parts = []
                floor = part.column("floor").to_numpy()
                for at in range(0, len(ids), QUERY_ROWS):
                    sl = slice(at, at + QUERY_ROWS)
                    found, score = tree.search(vectors[sl], ids[sl], floor[sl])
                    r, c = np.nonzero(score > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[sl][r]), pa.array(found[r, c]), pa.array(score[r, c])], ["query_id", "vec_id", "score"])

    return run


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _celled(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivot's cell and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for d in np.unique(dims):
                p = pivots.get(int(d))
                if p is None:
                    continue
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column("vector").take(pa.array(at))).astype(np.float64)
                cell[at] = ((p**2).sum(axis=1) / 2 - x @ p.T).argmin(axis=1)
                far[at] = _distance(x, p[cell[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def _routed(pivots: dict[int, np.ndarray], cells: dict[int, tuple[np.ndarray, ...]], rest: int, first: bool):
    """Queries to shards. cells: dims -> (cell, radius, shards); rest: shards of a length without cells.

    first: to one shard, of the cell with the best bound. Else to all others whose cell's bound reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, floor = (batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "vec_id", "floor"))
            row, to = [], []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) in cells:
                    cell, radius, shards = cells[int(d)]
                    centre = pivots[int(d)][cell]
                    q = _matrix(batch.column("vector").take(pa.array(at))).astype(np.float64)
                    size = _distance(centre, 0.0) + radius
                    upper = q @ centre.T + _distance(q, 0.0)[:, None] * (radius + 1e-9 * size) + 1e-6
                else:
                    cell, shards, upper = np.zeros(1, np.int64), np.array([rest]), np.full((len(at), 1), np.inf)
                best = upper.argmax(axis=1)
                own = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % shards[best]
                if first:
                    row.append(at)
                    to.append(cell[best] * MOST_SHARDS + own)
                    continue
                for c in range(len(cell)):
                    ask = np.flatnonzero(upper[:, c] >= floor[at].astype(np.float64))
                    which = np.tile(np.arange(shards[c]), len(ask))
                    who = np.repeat(ask, shards[c])
                    other = (best[who] != c) | (own[who] != which)
                    row.append(at[who[other]])
                    to.append(cell[c] * MOST_SHARDS + which[other])
            rows, shard = np.concatenate(row) if row else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64)
            for lo in range(0, len(rows), ROUTED):
                part = batch.take(pa.array(rows[lo : lo + ROUTED]))
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard[lo : lo + ROUTED])], [*names, "shard"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each row where is_query (over vec_id)."""
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where(F.col("vec_id").isNotNull() & takes_part(F.col("x")))
    v = saved(v.select("vec_id", F.size("x").alias("dims"), fixed_point(F.col("x"), scale).alias("vector")), "vectors")
    totals = {r["dims"]: r["count"] for r in v.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(CELLED).collect()}
    all_ = v.count()
    fill = lambda d, rows: min(max(1, SHARD_BYTES // (8 * max(1, d))), max(SHARD, -(-rows // (2 * n))))  # noqa: E731  rows of a shard

    # pivots: at most CELLS of PIVOT_NUMBERS / dims rows for each of CELLED lengths
    wanted = {d: min(CELLS, max(1, PIVOT_NUMBERS // max(1, d)), -(-c // fill(d, c))) for d, c in totals.items()}
    least = Window.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    chosen = v.where(F.col("dims").isin(*totals)).withColumn("r", F.row_number().over(least)).where(F.col("r") <= CELLS) if totals else v.limit(0).withColumn("r", F.lit(0))
    limit = F.lit(0)
    for d, p in wanted.items():
        limit = F.when(F.col("dims") == d, p).otherwise(limit)
    pivots: dict[int, list] = {}
    for r in chosen.where(F.col("r") <= limit).collect():
        pivots.setdefault(r["dims"], []).append(r["vector"])
    ready = {d: np.unique(np.array(p, np.float64), axis=0) if d else np.zeros((1, 0)) for d, p in pivots.items()}
    dealt = saved(v.mapInArrow(_celled(ready), "vec_id long, dims int, vector array<long>, cell long, far double"), "cells")

    cells: dict[int, list] = {}
    for r in dealt.where(F.col("dims").isin(*ready)).groupBy("dims", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("dims", "cell").collect() if ready else []:
        cells.setdefault(r["dims"], []).append((r["cell"], r["radius"] * (1 + 1e-12), min(MOST_SHARDS, -(-r["n"] // fill(r["dims"], totals[r["dims"]])))))
    table = {d: tuple(np.array(c, t) for c, t in zip(zip(*x, strict=True), (np.int64, np.float64, np.int64), strict=True)) for d, x in cells.items()}
    rest = min(MOST_SHARDS, max(1, -(-(all_ - sum(totals.values())) // SHARD)))
    shards = F.lit(rest)
    for d, x in cells.items():
        by_cell = F.element_at(F.array(*[F.lit(dict((c, m) for c, _, m in x).get(i, 1)) for i in range(len(ready[d]))]), F.col("cell").cast("int") + 1)
        shards = F.when(F.col("dims") == d, by_cell).otherwise(shards)
    shard = F.col("cell") * MOST_SHARDS + F.pmod(F.xxhash64("vec_id"), shards)
    members = dealt.select("dims", shard.alias("shard"), F.lit(0).alias("role"), "vec_id", "vector", F.lit(NONE).alias("floor"))
    queries = v.where(is_query).groupBy("dims", "vec_id").agg(F.min("vector").alias("vector"))

    def asked(given: DataFrame, first: bool) -> DataFrame:
        given = given.select("dims", "vec_id", "vector", "floor")
        kind = "dims int, vec_id long, vector array<long>, floor long, shard long"
        return given.mapInArrow(_routed(ready, table, rest, first), kind).select("dims", "shard", F.lit(1).alias("role"), "vec_id", "vector", "floor")

    def pass_over(given: DataFrame) -> DataFrame:
        rows = members.union(given).repartition(n, "dims", "shard").sortWithinPartitions("dims", "shard", "role")
        return rows.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    found = saved(pass_over(asked(queries.withColumn("floor", F.lit(NONE)), True)), "first-round")
    if rest > 1 or sum(m for x in cells.values() for _, _, m in x) > 1:
        floors = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        again = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("low", F.lit(NONE)))
        found = found.union(pass_over(asked(again, False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
