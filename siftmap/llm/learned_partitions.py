"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection with swap refinement. A small
neural classifier learns, from the vectors, how the neighbours of each sampled point spread over the parts; it places every vector
of the table in its likeliest part and sends a query to its several likeliest parts, where candidates are reranked by the exact
cosine in double precision. How many parts is measured: as many as find the wanted share of neighbours among sampled points that the
router was not fitted on, few for clustered vectors and most of them for vectors without structure.

Equal vectors are searched once: a group of them is one candidate with the smallest ids it needs, so a hot vector costs no more
than another. Parts are searched in blocks of bounded size on both sides. A query that finds too few candidates in its parts
searches all parts.

Defined cases: vectors that are null or zero, hold null or non-finite components, or have another length than most take no part;
rows that repeat an id and a vector count as one; ties go to the smaller id; a table without queries gives no rows; a null id is
neither query nor candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmap.llm.graph import stored

NEIGHBOURS = 5
#: Distinct vectors the index is fitted on, those of the smallest hash.
SAMPLE = 4096
GRAPH = 10
HIDDEN = 96
#: A query looks into as many parts as reach this recall on sampled points that the router has not seen.
RECALL = 0.94
LEAST_PARTS, MOST_PARTS = 8, 128
#: Rows of a block on either side of a search task.
BLOCK = 8192


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Symmetric 0/1 adjacency of each point with its k nearest by cosine."""
    x, n = unit(x), len(x)
    k = min(k, n - 1)
    near = np.zeros((n, n), np.float32)
    for i in range(0, n, 512):
        s = x[i:i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64)
        near[np.arange(i, i + len(s))[:, None], top] = 1
    return np.maximum(near, near.T)


def bisect(a: np.ndarray, passes: int = 8) -> np.ndarray:
    """A half of a graph's nodes, of equal size up to one, with few edges to the rest: Fiedler vector, median, best swaps."""
    n = len(a)
    root = np.sqrt(a.sum(axis=1) + 1e-9)
    first = root / np.linalg.norm(root)
    v = np.cos(np.arange(n) * 2.399963)  # any fixed start
    for _ in range(60):
        v = v + (a @ (v / root)) / root
        v -= first * (first @ v)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.lexsort((np.arange(n), v / root))[n // 2:]] = True
    degree = a.sum(axis=1)
    for _ in range(passes):
        across = a @ side
        gain = np.where(side, degree - 2 * across, 2 * across - degree)  # edges cut less if a node moves alone
        p, q = np.flatnonzero(side), np.flatnonzero(~side)
        p, q = p[np.argsort(-gain[p], kind="stable")], q[np.argsort(-gain[q], kind="stable")]
        best = saved = 0.0
        done = 0
        for k in range(min(64, len(p), len(q))):
            i, j = p[k], q[k]
            saved += degree[i] - 2 * across[i] + 2 * across[j] - degree[j] - 2 * a[i, j]
            across += a[:, j] - a[:, i]
            if saved > best + 1e-6:
                best, done = saved, k + 1
        if not done:
            break
        side[p[:done]], side[q[:done]] = False, True
    return side


def balanced_parts(a: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node; `parts` is a power of two."""
    out = np.zeros(len(a), np.int64)
    if parts > 1 and len(a) > 1:
        side = bisect(a)
        for half, first in ((~side, 0), (side, parts // 2)):
            at = np.flatnonzero(half)
            out[at] = first + balanced_parts(a[np.ix_(at, at)], parts // 2)
    return out


class Router:
    """A network with one hidden layer from a unit vector to the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, steps: int = 250):
        rng = np.random.default_rng(7)
        d, m = x.shape[1], target.shape[1]
        self.w = [rng.normal(size=(d, hidden)) * (2 / d) ** 0.5 * 2, np.zeros(hidden), rng.normal(size=(hidden, m)) * hidden ** -0.5, np.zeros(m)]
        first, second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        for t in range(1, steps + 1):
            h = np.maximum(x @ self.w[0] + self.w[1], 0)
            g = (self._soft(h @ self.w[2] + self.w[3]) - target) / len(x)
            back = (g @ self.w[2].T) * (h > 0)
            grads = [x.T @ back + 1e-5 * self.w[0], back.sum(axis=0), h.T @ g + 1e-5 * self.w[2], g.sum(axis=0)]
            for k, v in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.w[k] = self.w[k] - 0.02 * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-9)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def parts(self, x: np.ndarray, many: int) -> np.ndarray:
        """The `many` likeliest parts of each vector, likeliest first."""
        z = np.maximum(unit(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :many]


def fit(sample: np.ndarray, parts: int) -> Router:
    """Cuts the sample's neighbour graph and learns to find the parts of a point's neighbours."""
    a = neighbour_graph(sample)
    part = balanced_parts(a, parts)
    own = np.eye(parts)[part]
    target = own + a @ own
    return Router(unit(sample), target / target.sum(axis=1, keepdims=True))


def probes(router: Router, unseen: np.ndarray, parts: int, recall: float = RECALL, k: int = NEIGHBOURS) -> int:
    """The least number of parts to look into that finds this share of the neighbours among points which the router was not fitted on."""
    k = min(k, len(unseen) - 1)
    if k < 1:
        return parts
    x, order = unit(unseen), router.parts(unseen, parts)
    place = np.empty_like(order)
    place[np.arange(len(order))[:, None], order] = np.arange(parts)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    needed = np.sort(place[np.arange(len(x))[:, None], order[near, 0]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def parts_for(rows: int) -> int:
    """About an eighth of the root of the rows, as a power of two."""
    return int(np.clip(2 ** round(np.log2(max(rows, 1) ** 0.5 / 8)), LEAST_PARTS, MOST_PARTS))


def vectors(table: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """key, vec (doubles), ids (the k + 1 smallest), sought (whether a query is among all of them): one row per distinct usable vector."""
    usable = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where(
        F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0))
    length = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usable = usable.where(F.size("vec") == (length.n if length else 0))
    keyed = usable.withColumn("key", F.concat_ws("-", F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit(1), F.col("vec")))))
    return keyed.dropDuplicates(["key", "vec_id"])


def _groups(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("key").agg(F.min_by("vec", "rank").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _place(rows: DataFrame, router: Router, many: int) -> DataFrame:
    """Each row with `many` parts: columns key, vec, ids, part."""

    def run(batches):
        for batch in batches:
            if len(batch):
                part = router.parts(_matrix(batch.column(1)), many)
                at = pa.array(np.repeat(np.arange(len(batch)), part.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(part.ravel(), pa.int32())], ["key", "vec", "ids", "part"])

    return rows.select("key", "vec", "ids").mapInArrow(run, "key string, vec array<double>, ids array<bigint>, part int")


def _nearest(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 nearest groups of each query among one block of candidates."""
        out = {"query": [], "key": [], "ids": [], "score": []}
        if len(left) and len(right):
            q, x = _matrix(left.column("vec").combine_chunks()), _matrix(right.column("vec").combine_chunks())
            qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            unit_x, many = x / xn[:, None], min(k + 1, len(x))
            found_q, found_x, found_s = [], [], []
            for i in range(0, len(q), 256):
                s = (q[i:i + 256] / qn[i:i + 256, None]) @ unit_x.T
                bar = np.partition(s, len(x) - many, axis=1)[:, len(x) - many]
                a, b = np.nonzero(s >= bar[:, None] - 1e-12)
                exact = (q[i + a] * x[b]).sum(axis=1) / (qn[i + a] * xn[b])
                found_q.append(i + a)
                found_x.append(b)
                found_s.append(exact)
            a, b, s = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
            least = np.array([v[0].as_py() for v in right.column("ids").combine_chunks()])
            order = np.lexsort((least[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            head = np.searchsorted(a, a)
            keep = np.arange(len(a)) - head <= k
            a, b, s = pa.array(a[keep]), pa.array(b[keep]), s[keep]
            out = {"query": left.column("key").take(a), "key": right.column("key").take(b), "ids": right.column("ids").take(b), "score": pa.array(np.clip(s, -1.0, 1.0))}
        kinds = pa.schema([("query", pa.string()), ("key", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        return pa.table(out, schema=kinds)

    return run


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """part, blocks: so many blocks of about `block` rows each part has; a row per part."""
    return rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))


def _search(queries: DataFrame, placed: DataFrame, k: int, block: int) -> DataFrame:
    """query, ids, score: the nearest groups of each query over the parts it was sent to."""
    left, right = _blocks(queries, block).withColumnRenamed("blocks", "lefts"), _blocks(placed, block).withColumnRenamed("blocks", "rights")
    grid = F.broadcast(left.join(right, "part"))  # a row per part
    deal = F.xxhash64("key", F.lit(5))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    q = queries.join(grid, "part").withColumn("i", F.pmod(deal, F.col("lefts"))).withColumn("j", F.explode(span("rights"))).select("part", F.col("i").cast("int").alias("i"), "j", "key", "vec")
    c = placed.join(grid, "part").withColumn("j", F.pmod(deal, F.col("rights"))).withColumn("i", F.explode(span("lefts"))).select("part", "i", F.col("j").cast("int").alias("j"), "key", "vec", "ids")
    found = q.groupBy("part", "i", "j").cogroup(c.groupBy("part", "i", "j")).applyInArrow(_nearest(k), "query string, key string, ids array<bigint>, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
    return found.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("query", "ids", "score")


def search(table: DataFrame, sought, k: int = NEIGHBOURS, sample: int = SAMPLE, probed: int | None = None, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `table` (vec_id, embedding) where the condition `sought` on vec_id holds."""
    rows = vectors(table, k)
    groups = stored(_groups(rows, k), "groups")
    asked = stored(rows.where(sought).select(F.col("vec_id").alias("query_id"), "key"), "asked")
    n = groups.count()
    total = rows.count()
    first = groups.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(sample).select("vec").toArrow().column(0).combine_chunks()
    parts = parts or parts_for(n)
    while parts > 1 and len(first) < 4 * parts:
        parts //= 2
    points = _matrix(first)
    seen = len(points) - len(points) // 4
    router = fit(points[:seen], parts) if len(first) else Router(np.zeros((1, 1)), np.ones((1, 1)), steps=0)
    placed = stored(_place(groups, router, 1), "placed")
    wanted = groups.join(asked.select("key").distinct(), "key", "left_semi")
    many = min(parts, probed or probes(router, points[seen:], parts, k=k))
    found = stored(_search(_place(wanted, router, many), placed, k, block), "found")
    enough = min(k, total - 1)
    held = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > enough).select(F.col("query").alias("key"))
    short = wanted.join(held, "key", "left_anti")
    if many < parts and not short.isEmpty():
        more = stored(_search(_place(short, router, parts), placed, k, block), "found")
        found = found.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionAll(more)
    near = asked.join(found, asked.key == found.query).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
