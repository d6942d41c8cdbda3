"""Approximate nearest neighbours with score-aware quantisation.

Euclidean distance is turned into an inner product by carrying each vector's squared
norm beside it: the nearest vector is the one with the largest q.x - |x|^2 / 2.
Vectors are cut into short blocks, each coded by one of sixteen centres. Errors
parallel to a vector hurt a maximum inner product more than errors across it, so
codes and centres minimise the anisotropic loss: the parallel part of the residual
weighs ETA times the rest. A query turns the centres into tables of sixteen values,
the scan sums table entries by code, and the best of each batch are ranked again by
exact distance in double precision. Every row is coded and scanned; only the centres
are fitted on a bounded sample.

Queries are taken in blocks of bounded size, each broadcast to one pass over the
vectors; a pass keeps the k best a query and batch, so hot vectors never gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, share, table

#: Vectors that the centres are fitted on at most, and components of a block.
SAMPLE, PART = 4096, 2
#: Weight of the residual's parallel part; rounds of fitting; centres a block (four bits).
ETA, ROUNDS, CENTRES = 4.0, 8, 16
#: Queries of one broadcast block; vectors scanned together; exact rankings a query and batch.
QUERY_BLOCK, BATCH, RERANK = 4096, 8192, 200


def usable(vectors: list) -> np.ndarray:
    """Which vectors take part: not null, not zero, all components finite. The dimension is judged elsewhere."""
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v and None not in v:
            a = np.asarray(v, np.float64)
            out[i] = np.isfinite(a).all() and a.any()
    return out


class Quantiser:
    """Centres by block, fitted to unit-free anisotropic loss by coordinate descent."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.dim = sample.shape[1]
        self.blocks = -(-self.dim // PART)
        x = self.pad(sample)
        rng = np.random.default_rng(seed)
        parts = x.reshape(len(x), self.blocks, PART)
        pick = rng.integers(0, len(x), (self.blocks, CENTRES))
        self.centres = np.stack([parts[pick[b], b] for b in range(self.blocks)])
        for _ in range(ROUNDS):
            codes = self.encode(sample, sweeps=1)
            self.update(x, codes)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, self.blocks * PART - self.dim)))

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that a few sweeps of coordinate descent over the blocks settle on."""
        x = self.pad(vectors)
        n = len(x)
        parts = x.reshape(n, self.blocks, PART)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, self.blocks, PART)
        off = parts[:, :, None] - self.centres[None]
        square = (off**2).sum(-1)
        along = np.einsum("nbcp,nbp->nbc", off, unit)
        codes = square.argmin(-1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(1)
        for _ in range(sweeps):
            for b in range(self.blocks):
                rest = total - along[rows, b, codes[:, b]]
                # |r|^2 + (ETA - 1) <r, unit>^2, of which only this block's part changes.
                loss = square[:, b] + (ETA - 1) * (rest[:, None] + along[:, b]) ** 2
                codes[:, b] = loss.argmin(1)
                total = rest + along[rows, b, codes[:, b]]
        return codes.astype(np.uint8)

    def update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The best centres for given codes, block by block."""
        n = len(x)
        parts = x.reshape(n, self.blocks, PART)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, self.blocks, PART)
        guess = np.stack([self.centres[b][codes[:, b]] for b in range(self.blocks)], 1)
        along = ((parts - guess) * unit).sum(-1)
        total = along.sum(1)
        for b in range(self.blocks):
            rest = total - along[:, b]
            for c in range(CENTRES):
                m = codes[:, b] == c
                if not m.any():
                    continue
                u, p = unit[m, b], parts[m, b]
                outer = np.eye(PART) * m.sum() + (ETA - 1) * u.T @ u
                pull = p.sum(0) + (ETA - 1) * (u * ((p * u).sum(1) + rest[m])[:, None]).sum(0)
                self.centres[b, c] = np.linalg.solve(outer, pull)
            guess = self.centres[b][codes[:, b]]
            along[:, b] = ((parts[:, b] - guess) * unit[:, b]).sum(1)
            total = rest + along[:, b]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block the sixteen inner products with the centres."""
        q = self.pad(queries).reshape(len(queries), self.blocks, PART)
        return np.einsum("qbp,bcp->qbc", q, self.centres).astype(np.float32)


def _scan(model: Quantiser, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products of all queries and coded vectors: the table scan as one product with the codes' indicator."""
    n, width = len(codes), model.blocks * CENTRES
    marks = np.zeros((n, width), np.float32)
    marks[np.arange(n)[:, None], np.arange(model.blocks) * CENTRES + codes] = 1
    return tables.reshape(len(tables), width) @ marks.T


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance, ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding). A vector that is null, zero, or holds a
    null or non-finite component takes no part, nor does one whose dimension is not
    the most common one (the smaller of equals). A query's own id is no candidate.
    Of queries with one id the smallest vector counts; repeated candidates stay
    repeated. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda v: v != 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    dim = common.d
    rows = rows.where(F.size("embedding") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").collect()
    model = Quantiser(np.array([r.embedding for r in sample]))
    held = share(spark, model)

    asked = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda v: v != 0)).where(F.size("embedding") == dim)
    asked = asked.groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        block = mine.orderBy("vec_id").collect()  # QUERY_BLOCK rows, give or take how evenly the ids hash
        if not block:
            continue
        sent = share(spark, (np.array([r.vec_id for r in block]), np.array([r.embedding for r in block])))

        def scan(batches, sent=sent) -> Iterator[dict]:
            model, (qid, q) = held(), sent()
            tables = model.tables(q)
            for ids, vecs in batches:
                order = np.argsort(np.asarray(ids), kind="stable")
                for lo in range(0, len(ids), BATCH):
                    at = order[lo : lo + BATCH]
                    vid, x = np.asarray(ids)[at], np.array([vecs[i] for i in at])
                    codes, half = model.encode(x), ((x**2).sum(1) / 2).astype(np.float32)
                    out_q, out_v, out_s = [], [], []
                    for ql in range(0, len(qid), 256):
                        near = half[None] - _scan(model, tables[ql : ql + 256], codes)
                        for j, row in enumerate(near, ql):
                            # Ties of the approximate score keep the smaller ids, as rows are in their order.
                            if len(row) > rerank:
                                cut = np.partition(row, rerank)[rerank]
                                pick = np.flatnonzero(row <= cut)
                                if len(pick) > rerank:
                                    pick = pick[np.argsort(row[pick], kind="stable")[:rerank]]
                            else:
                                pick = np.arange(len(row))
                            pick = pick[vid[pick] != qid[j]]
                            dist = np.sqrt(((x[pick] - q[j]) ** 2).sum(1))
                            best = np.lexsort((vid[pick], dist))[:k]
                            out_q += [qid[j]] * len(best)
                            out_v += vid[pick][best].tolist()
                            out_s += dist[best].tolist()
                    yield {"query_id": out_q, "vec_id": out_v, "score": out_s}

        part = map_arrow(rows, scan, "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
