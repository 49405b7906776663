"""Approximate nearest neighbours with learned partitions (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Vectors that the partitions are learned from: at least the first number, one in SHARE_OF of a larger table, at most the last.
SAMPLE, SHARE_OF, MOST = 8192, 128, 65536
#: Neighbours of each sampled vector in the graph, and sampled vectors of a partition, at least.
GRAPH, PART_ROWS = 10, 64
#: Share of sampled neighbours that the probed partitions must hold; it sets how many are probed.
AIM = 0.94
#: Rows of an index block and of a query block that meet in one group.
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048
#: Scores this close to the last kept one are compared again, exactly.
SLACK = 1e-9


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two near its largest component: squares neither overflow nor vanish, and no bit changes."""
    _, power = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -power)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by cosine, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 128):
        sim = x[s : s + 128] @ x.T
        sim[np.arange(len(sim)), s + np.arange(len(sim))] = -2
        out[s : s + 128] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def _halve(near: np.ndarray, rng) -> np.ndarray:
    """A balanced cut of a graph in two with few edges across: a slow mode of its random walk cut at the median, then swaps."""
    n = len(near)
    live = near >= 0
    to = np.where(live, near, 0)
    degree = live.sum(1) + np.bincount(to[live], minlength=n) + 1e-9

    def pull(x):
        back = np.bincount(to[live], np.repeat(x, live.sum(1)), n)
        return ((x[to] * live).sum(1) + back) / degree

    x = rng.normal(size=n)
    for _ in range(60):
        x = 0.5 * x + 0.5 * pull(x)
        x -= (x * degree).sum() / degree.sum()
        x /= np.abs(x).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        s = np.where(side, 1.0, -1.0)
        gain = -s * pull(s)  # positive: most neighbours are across
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        if not swap:
            break
        side[a[:swap]], side[b[:swap]] = False, True
    return side


def balanced(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Partition numbers from repeated halving; sizes differ by one at most at each cut."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(near), np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            own = np.flatnonzero(out == p)
            place = np.full(len(near), -1)
            place[own] = np.arange(len(own))
            out[own[_halve(place[near[own]], rng)]] += size
        size *= 2
    return out


class Router:
    """A small network from a unit vector to the probability of each partition."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        self.probes = parts

    def logits(self, x):
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3], h

    def fit(self, x, near, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 1) -> None:
        """Cross-entropy against the partitions ``near`` of each vector and its neighbours (a row of numbers each), with Adam."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), batch):
                i = order[s : s + batch]
                z, h = self.logits(x[i])
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                np.subtract.at(p, (np.repeat(np.arange(len(i)), near.shape[1]), near[i].reshape(-1)), 1 / near.shape[1])
                d = p / len(i)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def ranked(self, x) -> np.ndarray:
        return np.argsort(-self.logits(x)[0], axis=1, kind="stable")


def learn(x: np.ndarray) -> Router:
    """Partitions and router from a sample of unit vectors; ``probes`` is the least number of partitions that reaches AIM."""
    x = np.unique(x, axis=0)
    n = len(x)
    parts = 1
    while n // (parts * 2) >= PART_ROWS:
        parts *= 2
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router
    k = min(GRAPH, n - 1)
    near = graph(x, k)
    part = balanced(near, parts)
    # The fit leaves a tenth out, and the number of probes is set on that.
    held = np.arange(n) % 10 == 0
    router.fit(x[~held], np.hstack([part[near], part[:, None]])[~held])
    home = np.concatenate([router.ranked(x[s : s + 4096])[:, 0] for s in range(0, n, 4096)])
    ranked = router.ranked(x[held])
    at = np.empty(ranked.shape, np.int64)
    at[np.arange(len(at))[:, None], ranked] = np.arange(parts)
    places = at[np.repeat(np.arange(len(at)), k), home[near[held]].reshape(-1)]
    share = np.cumsum(np.bincount(places, minlength=parts)) / max(len(places), 1)
    router.probes = min(parts, int(np.searchsorted(share, AIM) + 1))
    return router


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """For each query its k best rows of a block, by the exact score and then the smaller id."""
    q, x = _scaled(q), _scaled(x)
    nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    out_q, out_x, out_s = [], [], []
    for s in range(0, len(q), 256):
        sim = (q[s : s + 256] @ x.T) / nq[s : s + 256, None] / nx
        sim[qid[s : s + 256, None] == xid] = -np.inf
        kk = min(k, sim.shape[1])
        last = -np.partition(-sim, kk - 1, axis=1)[:, kk - 1]
        for i in range(len(sim)):
            c = np.flatnonzero((sim[i] >= last[i] - SLACK) & (sim[i] > -np.inf))
            # Summed row by row in one order, so equal vectors have equal scores.
            score = (q[s + i] * x[c]).sum(1) / (nq[s + i] * nx[c])
            c = c[o := np.lexsort((xid[c], -score))[:k]]
            out_q.append(np.full(len(c), qid[s + i]))
            out_x.append(xid[c])
            out_s.append(score[o])
    join = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
    return join(out_q, np.int64), join(out_x, np.int64), join(out_s, np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest other rows found for each query: query_id, rank, vec_id, score (cosine in double precision).

    A balanced partition of the neighbour graph of a sample of distinct vectors (it grows with the table, up to MOST) teaches a
    router; each row is indexed in its most probable partition, and each query is compared with every row of its most probable
    ones: of as many as hold AIM of the sample's neighbours, and of more while these have too few rows. A query that found
    fewer than k rows even so (where many rows share an id) is compared with all rows, so it gets k, or all candidates if
    there are fewer. Rows of a partition are dealt into blocks, so a vector that many rows share doesn't gather in one task.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. A cosine
    needs vectors of one length: those that haven't the most common one are compared with all others of their own length. A
    repeated row counts once; ids that repeat with other vectors are candidates with each of them, and ask with the least.
    Equal scores go by the smaller id. An empty table gives no rows; columns other than the two are ignored.
    """
    spark = vectors.sparkSession

    def valid(df):
        v = F.col(f"`{vector}`")
        fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)

    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes.d
    asked = valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    sample = min(MOST, max(SAMPLE, sizes["count"] // SHARE_OF))
    some = store.smallest(rows.filter(F.size("v") == dim).withColumn("h", F.xxhash64("v", "id")), "h", sample, "id").select("v").toArrow()
    router = learn(_unit(_rows(some["v"])))
    shared = store.share(spark, router)  # a few hundred numbers for each of at most MOST / PART_ROWS partitions

    def routed(probes):
        """``probes``: partitions of each row, given the ranked ones."""

        def run(batches):
            router = shared()
            for b in batches:
                size = np.diff(b.column(1).offsets.to_numpy())
                usual = np.flatnonzero(size == dim)
                who, part = [np.flatnonzero(size != dim)], [-size[size != dim]]  # a partition for each other length
                if len(usual):
                    ranked = router.ranked(_unit(_rows(b.column(1).take(pa.array(usual)))))
                    n = probes(ranked)
                    who.append(np.repeat(usual, n))
                    part.append(ranked[np.arange(ranked.shape[1]) < n[:, None]])
                take = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(part).astype(np.int32))], names=["id", "v", "part"])

        return run

    ddl = f"id long, v {rows.schema['v'].dataType.simpleString()}, part int"
    index = store.keep(rows.mapInArrow(routed(lambda ranked: np.ones(len(ranked), int)), ddl), "ann-index")
    parts = len(router.w[3])
    held = np.zeros(parts)
    for r in index.filter("part >= 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r.part] = r.n
    usual = router.probes

    def enough(ranked):
        return np.minimum(parts, np.maximum(usual, (np.cumsum(held[ranked], axis=1) <= k).sum(1) + 1))

    found = store.keep(_compare(index, asked.mapInArrow(routed(enough), ddl), k), "ann-found")
    short = found.groupBy("query_id").count().filter(F.col("count") >= k).withColumnRenamed("query_id", "id")
    short = store.keep(asked.join(short, "id", "left_anti"), "ann-short")
    if short.limit(1).count():
        again = _compare(index, short.mapInArrow(routed(lambda ranked: np.full(len(ranked), parts)), ddl), k)
        found = store.keep(found.unionByName(again).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "ann-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compare(index: DataFrame, ask: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of each query the k best rows of every block of its partitions."""
    ask = store.keep(ask, "ann-queries")
    size = lambda df, name: df.groupBy("part").agg(F.count(F.lit(1)).alias(name))
    plan = size(index, "n").join(size(ask, "m"), "part")
    plan = plan.select("part", F.ceil(F.col("n") / INDEX_BLOCK).cast("int").alias("ib"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qb"))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = ask.join(plan, "part").select("id", "v", "part", deal("qb").alias("q"), every("ib").alias("i"))
    right = index.join(plan, "part").select("id", "v", "part", deal("ib").alias("i"), every("qb").alias("q"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            got = _best(_rows(a["v"]), a["id"].to_numpy(), _rows(b["v"]), b["id"].to_numpy(), k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    met = left.groupBy("part", "i", "q").cogroup(right.groupBy("part", "i", "q")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
