"""Cosine neighbours, retrieval, cluster assignment and cluster quality.

Distances are rounded to 9 decimals before they are compared, so equal vectors tie whatever
batch they arrive in, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmap.functions.vectors import dot, norm

# Largest side that is sent to every task; larger inputs take the partitioned path.
BROADCAST_BYTES = 64 << 20
# Rows of each side in one cell of the partitioned path.
CELL_ROWS = 20_000
# Distances that a task holds at once: 32 MB in double precision.
TILE = 1 << 22
# Rows a task hands back at once.
OUT_ROWS = 10_000
# Rows that a task compares first, to know how near the others must come.
FIRST_ROWS = 256
# Groups of positions, as eighths of these; one in so many pairs may pass their test, else all positions are compared.
FOLD, FOLD_SHARE = 3, 200


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / n


def _matrix(col) -> np.ndarray:
    """A list column as a dense float64 matrix of unit rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, 0))
    if len(set(col.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(col), -1))


def _matrix_of_vectors(col: pa.Array, dim: int) -> np.ndarray:
    """A column of Spark ML vectors, sparse or dense, as a dense float64 matrix of unit rows."""
    v = col.storage if isinstance(col, pa.ExtensionArray) else col
    values, n = v.field("values").flatten(), v.field("values").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    sparse = v.field("type").fill_null(0).to_numpy(zero_copy_only=False) == 0
    at = np.empty(len(values), np.int64)
    at[np.repeat(sparse, n)] = v.field("indices").flatten().to_numpy(zero_copy_only=False)
    at[np.repeat(~sparse, n)] = np.tile(np.arange(dim), int((~sparse).sum()))
    out = np.zeros((len(v), dim))
    out[np.repeat(np.arange(len(v)), n), at] = values.to_numpy(zero_copy_only=False)
    return _unit(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    return np.round(np.subtract(1.0, d, out=d), 9, out=d)


def _tiles(n_a: int, n_b: int) -> Iterator[slice]:
    """Runs of the rows of one side whose distances to all rows of the other stay within TILE."""
    step = max(1, TILE // max(1, n_b))
    return (slice(i, min(i + step, n_a)) for i in range(0, n_a, step))


def _top(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, ties by id."""
    keep = np.arange(len(dist))
    if len(dist) > k:
        kth = np.partition(dist, k - 1)[k - 1]
        keep = np.flatnonzero(dist <= kth)
    return keep[np.lexsort((ids[keep], dist[keep]))][:k]


def _small(df: DataFrame, max_bytes: int) -> tuple[list, np.ndarray, pa.DataType] | None:
    """Ids, vectors and id type of a side that is proven small, else None. Reads at most `max_bytes`."""
    head = df.select(F.size("vec").alias("d")).head()
    dim = head["d"] if head else 1
    most = max(1, max_bytes // (8 * max(1, dim)))
    t = df.select("id", F.col("vec").cast("array<double>").alias("vec")).limit(most + 1).toArrow()
    if t.num_rows > most:
        return None
    return t.column("id").to_pylist(), _matrix(t.column("vec")), t.schema.field("id").type


class _Best:
    """The k nearest rows a task has seen for each of n queries, always the same ones.

    Once a query holds k rows, others only count if they are as near as the last of these. Numbers of single precision show that most
    are not: sums over groups of positions, which can only be too large (Cauchy-Schwarz), or where these let too many pass, over all positions.
    """

    def __init__(self, n: int, k: int):
        self.k, self.held, self.seen = k, np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.dist, self.ids = np.empty((n, k)), np.empty((n, k), dtype=object)
        self.single = self.folded = self.group = None

    def add(self, who: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        """Compares the queries `who` with a batch, in tiles of bounded size."""
        if not len(who) or not len(ids):
            return
        if self.single is None:
            self.single = q.astype(np.float32)
            # each group gets a few positions, not two that many rows use
            self.group = np.empty(q.shape[1], np.int64)
            self.group[np.argsort(-np.count_nonzero(m, axis=0), kind="stable")] = np.arange(q.shape[1]) % max(1, FOLD * q.shape[1] // 8)
            self.folded = self._fold(self.single)
        single, at = m.astype(np.float32), 0
        folded = self._fold(single)
        while at < len(ids):
            # few rows tell little about how near others must come, so few more are compared next
            some = slice(at, at + max(FIRST_ROWS, 3 * int(self.seen[who].min())))
            ready = (self.held[who] == self.k) & ~np.isnan(self.dist[who, -1])
            self._add_near(who[ready], q, ids[some], m[some], single[some], folded[some])
            self._add_all(who[~ready], q, ids[some], m[some])
            self.seen[who] += len(ids[some])
            at = some.stop

    def _fold(self, m: np.ndarray) -> np.ndarray:
        """Lengths of the rows over each group of positions."""
        order = np.argsort(self.group, kind="stable")
        starts = np.flatnonzero(np.diff(self.group[order], prepend=-1))
        return np.sqrt(np.add.reduceat((m * m)[:, order], starts, axis=1))

    def _add_all(self, who: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        for part in _tiles(len(who), len(ids)):
            mine = who[part]
            dist = _distances(q[mine], m)
            worst = np.where(self.held[mine] == self.k, self.dist[mine, -1], np.inf)
            # a batch without any row as near as the last one kept changes nothing; NaN is looked at
            for j in np.flatnonzero(~(dist.min(axis=1) > worst)):
                self._merge(mine[j], dist[j], ids)

    def _add_near(self, who: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, single: np.ndarray, folded: np.ndarray) -> None:
        slack = 2e-7 * (m.shape[1] + 500)  # more than single precision can be off by, for unit rows
        fold, step = True, max(1, TILE // (16 * m.shape[1]))
        for part in _tiles(len(who), len(ids)):
            mine = who[part]
            least = (1.0 - self.dist[mine, -1] - slack).astype(np.float32)[:, None]
            if fold:
                near = np.flatnonzero(self.folded[mine] @ folded.T >= least)
                fold = FOLD_SHARE * len(near) <= len(mine) * len(ids)
            if not fold:
                near = np.flatnonzero(self.single[mine] @ single.T >= least)
            i, j = np.divmod(near, len(ids))
            dist = np.empty(len(near))
            for k in range(0, len(near), step):
                dist[k:k + step] = np.einsum("ij,ij->i", q[mine[i[k:k + step]]], m[j[k:k + step]])
            dist = np.round(np.subtract(1.0, dist, out=dist), 9, out=dist)
            kept = dist <= self.dist[mine[i], -1]
            i, j, dist = i[kept], j[kept], dist[kept]
            bounds = np.flatnonzero(np.diff(i, prepend=-1, append=len(mine)))
            for a, b in zip(bounds[:-1], bounds[1:]):
                self._merge(mine[i[a]], dist[a:b], ids[j[a:b]])

    def _merge(self, i: int, dist: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the best of what query i holds and these rows."""
        near = _top(dist, ids, self.k)
        h = self.held[i]
        d, o = np.concatenate([self.dist[i, :h], dist[near]]), np.concatenate([self.ids[i, :h], ids[near]])
        cut = _top(d, o, self.k)
        h = self.held[i] = len(cut)
        self.dist[i, :h], self.ids[i, :h] = d[cut], o[cut]

    def rows(self, qid: list, names: list[str], a_type: pa.DataType, b_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What was kept: at most k rows per query, in batches of bounded size."""
        step = max(1, OUT_ROWS // self.k)
        for at in range(0, len(qid), step):
            some = slice(at, at + step)
            kept = np.arange(self.k) < self.held[some, None]
            if kept.any():
                a = [q for q, n in zip(qid[some], self.held[some]) for _ in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(a, a_type), pa.array(self.ids[some][kept].tolist(), b_type), pa.array(self.dist[some][kept])], names)


def _present(df: DataFrame) -> DataFrame:
    """Rows with a vector."""
    return df.filter(F.col("vec").isNotNull())


def _is_ml(df: DataFrame) -> bool:
    return isinstance(df.schema["vec"].dataType, VectorUDT)


def _as_arrays(df: DataFrame) -> DataFrame:
    """Spark ML vectors as arrays, without those that hold zeros only."""
    if not _is_ml(df):
        return df
    return df.withColumn("vec", vector_to_array("vec")).filter(F.exists("vec", lambda v: v != 0))


def _search_from_few(few, many: DataFrame, few_type: str, k: int) -> DataFrame:
    """Few query rows, many base rows: every task keeps its own best k per query."""
    shared = many.sparkSession.sparkContext.broadcast(few)
    many_type, ml = dict(many.dtypes)["id"], _is_ml(many)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, q_type = shared.value
        best, everyone, b_type = _Best(len(qid), k), np.arange(len(qid)), None
        for batch in batches:
            b_type = batch.schema.field("id").type
            if batch.num_rows and len(qid):
                ids = np.array(batch.column("id").to_pylist(), dtype=object)
                m = _matrix_of_vectors(batch.column("vec"), q.shape[1]) if ml else _matrix(batch.column("vec"))
                if ml:  # zeros only: no vector
                    there = ~np.isnan(m).any(axis=1)
                    ids, m = ids[there], m[there]
                best.add(everyone, q, ids, m)
        yield from best.rows(qid, ["a_id", "b_id", "distance"], q_type, b_type)

    return many.select("id", "vec").mapInArrow(scan, f"a_id {few_type}, b_id {many_type}, distance double")


def _search_into_few(many: DataFrame, few, few_type: str, k: int) -> DataFrame:
    """Many query rows, few base rows: each batch finishes alone."""
    shared = many.sparkSession.sparkContext.broadcast(few)
    many_type = dict(many.dtypes)["id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, b, b_type = shared.value
        bids = np.array(bid, dtype=object)
        by_id = np.argsort(bids, kind="stable")
        bids, b = bids[by_id], b[by_id]
        for batch in batches:
            if batch.num_rows == 0 or not bid:
                continue
            a = _matrix(batch.column("vec"))
            for part in _tiles(len(a), len(b)):
                dist = _distances(a[part], b)
                near = np.argsort(dist, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(np.arange(part.start, part.stop), near.shape[1]))),
                        pa.array(bids[near].ravel().tolist(), b_type),
                        pa.array(np.take_along_axis(dist, near, axis=1).ravel()),
                    ],
                    ["a_id", "b_id", "distance"],
                )

    return many.select("id", "vec").mapInArrow(scan, f"a_id {many_type}, b_id {few_type}, distance double")


def _search_in_cells(a: DataFrame, b: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """Two large sides: rows are spread evenly by hash over a grid of cells of bounded size, each
    side repeated along the other axis, and every cell keeps its best k per query row."""
    rows_a, rows_b = -(-a.count() // cell_rows), -(-b.count() // cell_rows)
    na, nb = max(1, rows_a), max(1, rows_b)
    types = dict(a.dtypes)["id"], dict(b.dtypes)["id"]

    def spread(df, own: str, n_own: int, other: str, n_other: int):
        return df.select(
            "id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        la, ra = left.column("id").to_pylist(), np.array(right.column("id").to_pylist(), dtype=object)
        out_a, out_b, out_d = [], [], []
        if la and len(ra):
            a, b = _matrix(left.column("vec")), _matrix(right.column("vec"))
            for part in _tiles(len(la), len(ra)):
                for key, dist in zip(la[part], _distances(a[part], b)):
                    near = _top(dist, ra, k)
                    out_a += [key] * len(near)
                    out_b += ra[near].tolist()
                    out_d += dist[near].tolist()
        return pa.table(
            {"a_id": pa.array(out_a, left.schema.field("id").type), "b_id": pa.array(out_b, right.schema.field("id").type), "distance": pa.array(out_d, pa.float64())}
        )

    ga = spread(a, "ga", na, "gb", nb).groupBy("ga", "gb")
    gb = spread(b, "gb", nb, "ga", na).select("id", "vec", "ga", "gb").groupBy("ga", "gb")
    return ga.cogroup(gb).applyInArrow(cell, f"a_id {types[0]}, b_id {types[1]}, distance double")


def nearest(a: DataFrame, b: DataFrame, k: int, max_bytes: int = BROADCAST_BYTES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest rows of `b` for every row of `a`: a_id, b_id, distance, rn.

    Both have columns `id` and `vec`, an array. The smaller side is broadcast when it is proven to fit;
    otherwise both are cut into a grid. No step emits all pairs. `b` may have Spark ML vectors, which travel
    without their zeros; one of zeros only counts as none.
    """
    a, b = _present(a), _present(b)
    few = _small(a, max_bytes)
    if few is not None:
        best = _search_from_few(few, b, dict(a.dtypes)["id"], k)
    else:
        b = _as_arrays(b)
        few = _small(b, max_bytes)
        if few is not None:
            best = _search_into_few(a, few, dict(b.dtypes)["id"], k)
        else:
            best = _search_in_cells(a, b, k, cell_rows)
    w = Window.partitionBy("a_id").orderBy("distance", "b_id")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def assign(vectors: DataFrame, centroids: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, cluster_id, dist_to_centroid. With centroids that fit in a task this is a map step."""
    v = _present(vectors.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec")))
    c = centroids.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec"))
    few = _small(c, max_bytes)
    best = _search_into_few(v, few, dict(c.dtypes)["id"], 1) if few is not None else nearest(v, c, 1, max_bytes)
    return best.select(F.col("a_id").alias("doc_id"), F.col("b_id").alias("cluster_id"), F.col("distance").alias("dist_to_centroid"))


def cluster_quality(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Davies-Bouldin index and mean squared distance, in cosine distance.

    Documents are reduced to one mean per cluster; the pairwise part then works on one row that
    holds the k centroids.
    """
    spread = assigned.groupBy("cluster_id").agg(
        F.avg("dist_to_centroid").alias("s"), F.sum(F.col("dist_to_centroid") * F.col("dist_to_centroid")).alias("sq"), F.count(F.lit(1)).alias("n")
    )
    model = spread.join(centroids, "cluster_id").agg(
        F.collect_list(F.struct("cluster_id", "s", "centroid", norm(F.col("centroid")).alias("len"))).alias("c"),
        (F.sum("sq") / F.sum("n")).alias("mean_squared_distance"),
    )

    def apart(x, y):
        return F.lit(1.0) - dot(x["centroid"], y["centroid"]) / (x["len"] * y["len"])

    def worst(x):
        others = F.filter("c", lambda y: y["cluster_id"] != x["cluster_id"])
        return F.array_max(F.transform(others, lambda y: F.try_divide(x["s"] + y["s"], apart(x, y))))

    ratios = F.transform("c", worst)
    return model.select(
        F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))), F.size("c").cast("double")).alias("davies_bouldin_index"),
        "mean_squared_distance",
    )


def vector_search(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """topic_id, doc_id, distance, rn."""
    q = queries.select(F.col("topic_id").alias("id"), F.col("embedding").alias("vec"))
    b = base.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(q, b, k).select(F.col("a_id").alias("topic_id"), F.col("b_id").alias("doc_id"), "distance", "rn")


def retrieve(topics: DataFrame, base: DataFrame, corpus: DataFrame, k: int, over: int = 3) -> DataFrame:
    """Search for `over * k`, then keep the topic's region, then cut to k.

    The filter comes after the search, so a topic may end with fewer than k passages.
    """
    hits = vector_search(topics, base, over * k)
    w = Window.partitionBy("topic_id").orderBy("distance", "doc_id")
    wanted = F.col("region_filter").isNull() | (F.col("region_filter") == "All") | (F.col("region") == F.col("region_filter"))
    return (
        hits.drop("rn").join(topics.select("topic_id", "region_filter"), "topic_id")
        .join(corpus.select("doc_id", "region"), "doc_id").filter(wanted)
        .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
        .select("topic_id", "doc_id", "distance", "rn")
    )


def search_cells(queries: DataFrame, celled: DataFrame, centroids: DataFrame, k: int, probes: int, slice_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Approximate search: only vectors in the `probes` cells nearest to a query are compared.

    `celled` has doc_id, embedding and cell; written with partitionBy("cell"), cells nobody
    probes are not even read. A hot cell is spread over as many tasks as it has files. Queries are
    sent to the tasks in slices of at most `slice_bytes`; more of them take more passes, with the same answer.
    """
    q = queries.select(F.col("topic_id").alias("id"), F.col("embedding").alias("vec")).filter(F.col("vec").isNotNull())
    n, dim = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).head()
    slices = max(1, -(-n * ((dim or 0) * 8 + 32) // slice_bytes))
    part = F.pmod(F.xxhash64("id"), F.lit(slices))
    found = [_search_slice(q.filter(part == i) if slices > 1 else q, celled, centroids, k, probes, dict(queries.dtypes)["topic_id"]) for i in range(slices)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _search_slice(q: DataFrame, celled: DataFrame, centroids: DataFrame, k: int, probes: int, id_type: str) -> DataFrame:
    few = _small(q, 4 * BROADCAST_BYTES)  # a slice by hash may be somewhat larger than the mean
    c = centroids.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec"))
    probed = {}
    for r in nearest(q, c, probes).collect():
        probed.setdefault(r["b_id"], set()).add(r["a_id"])
    by_cell = {cell: np.array([i for i, t in enumerate(few[0]) if t in who]) for cell, who in probed.items()}
    shared = q.sparkSession.sparkContext.broadcast((*few, by_cell))
    types = id_type, dict(celled.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q_, q_type, wanted = shared.value
        best, b_type = _Best(len(qid), k), None
        for batch in batches:
            b_type = batch.schema.field("id").type
            cells = np.array(batch.column("cell").to_pylist())
            ids_ = np.array(batch.column("id").to_pylist(), dtype=object)
            m = _matrix(batch.column("vec"))
            for cell in np.unique(cells):
                if cell in wanted:
                    rows = np.flatnonzero(cells == cell)
                    best.add(wanted[cell], q_, ids_[rows], m[rows])
        yield from best.rows(qid, ["topic_id", "doc_id", "distance"], q_type, b_type)

    local = (
        celled.filter(F.col("cell").isin(list(probed)))
        .select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec"), "cell")
        .mapInArrow(scan, f"topic_id {types[0]}, doc_id {types[1]}, distance double")
    )
    w = Window.partitionBy("topic_id").orderBy("distance", "doc_id")
    return local.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
