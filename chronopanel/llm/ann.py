"""Nearest neighbours by largest inner product over an inverted multi-index.

The two halves of a vector are quantised apart by ``K`` centroids each, fitted on at most ``SAMPLE`` vectors (smallest id
hash). Every vector lies in the cell of its centroid pair. A query walks the pairs in falling order of summed centroid
products (least distance) with a heap, and stops once the cells visited hold the wanted share of all vectors. That share is
fitted on the sample: the smallest one that finds ``TARGET`` of the sample's true neighbours. Vectors of the cells visited
are reranked by their exact products on the original vectors.

A block is a slice of cells (by first centroid) and a salt that keeps it near ``BLOCK / 2`` vectors, so a cell of any size is
spread. Queries are dealt to blocks of near ``QUERIES / 2`` by their own first centroid, so that those of a block visit much the same
slices; a vector block meets only the query blocks that visit its slice, and a query goes only to the slices that it
visits. A block returns its best ``k`` per query, and a window keeps the best of those.

Defined cases: vectors that are null, empty, zero, of a length other than the most common one, or that hold null or non-finite
components take no part; of rows with one id the one with the smallest vector counts; null ids take no part; ties go to
the smaller id; with fewer candidates than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.common import column, map_batches
from chronopanel.session import stage

K, SAMPLE, TARGET, BLOCK, QUERIES, SLICES, TRIES = 64, 8_192, 0.95, 8_192, 2_048, 8, 200


def _centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c ** 2).sum(1) - 2 * x @ c.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray):
    """Pairs (i, j) in falling order of ``first[i] + second[j]``, by a heap over the two sorted lists."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, top = [(-(x[0] + y[0]), 0, 0)], [0] * len(x)          # top[i]: next place of row i
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


@dataclass
class MultiIndex:
    """Centroids of both halves and the share of vectors that a query visits."""

    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, :self.half], self.left), _nearest(x[:, self.half:], self.right)

    def probes(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Cells visited by a query as a boolean matrix; ``least`` vectors at least if there are so many."""
        wanted, seen, out = max(least, math.ceil(self.share * sizes.sum())), 0, np.zeros(sizes.shape, bool)
        for i, j in walk(self.left @ q[:self.half], self.right @ q[self.half:]):
            if sizes[i, j]:
                out[i, j] = True
                seen += int(sizes[i, j])
                if seen >= wanted:
                    break
        return out


def fit_index(sample: np.ndarray, k: int = K, neighbours: int = 20, target: float = TARGET, tries: int = TRIES) -> MultiIndex:
    """Centroids and visiting share from a bounded sample."""
    half = sample.shape[1] // 2
    index = MultiIndex(_centroids(sample[:, :half], k, 1), _centroids(sample[:, half:], k, 2), 1.0)
    if len(sample) < 4 * neighbours:
        return index
    i, j = index.cells(sample)
    sizes = np.zeros((len(index.left), len(index.right)), np.int64)
    np.add.at(sizes, (i, j), 1)
    needed = []
    for q in np.linspace(0, len(sample) - 1, min(tries, len(sample))).astype(int):
        products = sample @ sample[q]
        products[q] = -np.inf
        best = np.argpartition(-products, neighbours)[:neighbours]
        order, seen = np.full(sizes.shape, 0, np.int64), 0
        for a, b in walk(index.left @ sample[q, :half], index.right @ sample[q, half:]):
            order[a, b] = seen = seen + sizes[a, b]
        needed.extend(order[i[best], j[best]] / len(sample))
    index.share = float(min(1.0, np.quantile(needed, target)))
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def query_blocks(counts: dict[int, int], parts: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks for the queries of each first centroid: small neighbours share a block, a large one is split."""
    first, spread, at, held = [0] * parts, [1] * parts, 0, 0
    for c in range(parts):
        n = counts.get(c, 0)
        if held and held + n > QUERIES / 2:
            at, held = at + 1, 0
        first[c], spread[c] = at, max(1, math.ceil(n / (QUERIES / 2)))
        at, held = at + spread[c] - 1, held + n if spread[c] == 1 else QUERIES
    return first, spread


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_of_block(ids: np.ndarray, v: np.ndarray, c1: np.ndarray, c2: np.ndarray, query_ids: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int):
    """Exact best ``k`` of a block for each query: positions of queries and vectors, and their products."""
    rows, cols, scores = [], [], []
    for start in range(0, len(q), 128):
        part = slice(start, start + 128)
        s = np.where(probes[part][:, c1, c2] & (ids[None, :] != query_ids[part][:, None]), q[part] @ v.T, -np.inf)
        near = min(k, s.shape[1]) - 1
        edge = np.partition(-s, near, axis=1)[:, near]
        for r in range(len(s)):
            found = np.flatnonzero((s[r] >= -edge[r] - 1e-9) & (s[r] > -np.inf))
            exact = (v[found] * q[start + r]).sum(axis=1)             # one order of summing, so equal vectors tie
            keep = np.lexsort((ids[found], -exact))[:k]
            rows.append(np.full(len(keep), start + r))
            cols.append(found[keep])
            scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = K, sample: int = SAMPLE,
            target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row for which ``is_query`` (a column of ``id``) holds."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    table = stage(usable(vectors, id_col, vector_col), "vectors")
    common = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim = common["d"]
    table = table.where(F.size("v") == dim)
    drawn = table.orderBy(F.xxhash64("id")).limit(sample).select("v").toArrow().column("v").combine_chunks()
    index = fit_index(_matrix(drawn, dim), parts, k, target)

    def assign():
        def step(batch):
            c1, c2 = index.cells(_matrix(column(batch, "v"), dim))
            return {"id": column(batch, "id"), "v": column(batch, "v"), "c1": pa.array(c1, pa.int32()), "c2": pa.array(c2, pa.int32())}
        return step

    placed = stage(map_batches(table, assign, "id long, v array<double>, c1 int, c2 int"), "cells")
    sizes = np.zeros((len(index.left), len(index.right)), np.int64)
    for row in placed.groupBy("c1", "c2").count().collect():          # one row per cell, parts * parts at most
        sizes[row["c1"], row["c2"]] = row["count"]
    slice_of = np.arange(len(sizes)) * SLICES // len(sizes)
    salts = [max(1, math.ceil(int(sizes[slice_of == s].sum()) / (block / 2))) for s in range(SLICES)]
    first, spread = query_blocks({r["c1"]: r["count"] for r in placed.where(is_query).groupBy("c1").count().collect()}, len(sizes))

    pick = lambda values, at: F.element_at(F.array(*(F.lit(int(x)) for x in values)), at + 1)
    salted = placed.withColumn("slice", pick(slice_of, F.col("c1"))).withColumn("salt", F.pmod(F.xxhash64("id"), pick(salts, F.col("slice"))).cast("int"))

    def route():
        def step(batch):
            cells, slices = [], []
            for x in _matrix(column(batch, "v"), dim):
                probes = index.probes(x, sizes, k + 1)
                cells.append(np.packbits(probes).tobytes())
                slices.append(np.unique(slice_of[probes.any(axis=1)]).tolist())
            return {"id": column(batch, "id"), "v": column(batch, "v"), "asked": column(batch, "asked"), "cells": pa.array(cells, pa.binary()), "slices": pa.array(slices, pa.list_(pa.int32()))}
        return step

    block_of = pick(first, F.col("c1")) + F.pmod(F.xxhash64("id", F.lit(1)), pick(spread, F.col("c1"))).cast("int")
    spots = placed.where(is_query).select("id", "v", block_of.alias("asked")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    routed = stage(map_batches(spots, route, "id long, v array<double>, asked int, cells binary, slices array<int>"), "routes")
    queries = (routed.withColumn("slice", F.explode("slices")).withColumn("salt", F.explode(F.sequence(F.lit(0), pick(salts, F.col("slice")) - 1)))
               .select("id", "v", "asked", "cells", "slice", "salt"))
    meets = routed.select((F.col("asked") + 0).alias("asked"), F.explode("slices").alias("slice")).distinct()      # a column of its own for the cogroup
    salted = salted.join(meets, "slice")

    def rerank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if left.empty or right.empty:
            return empty
        v, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
        probes = np.unpackbits(np.frombuffer(b"".join(right["cells"]), np.uint8).reshape(len(q), -1), axis=1, count=sizes.size).astype(bool).reshape(len(q), *sizes.shape)
        r, c, s = best_of_block(ids, v, left["c1"].to_numpy(), left["c2"].to_numpy(), query_ids, q, probes, k)
        return pd.DataFrame({"query_id": query_ids[r], "vec_id": ids[c], "score": s})

    keys = ["slice", "salt", "asked"]
    found = salted.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
