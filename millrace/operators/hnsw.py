"""Approximate nearest neighbours by navigable small-world graphs (Malkov and Yashunin, 2016), one graph a shard.

Every row is in the graph of its shard; a query walks all graphs, each of which visits few of its rows, and the best of all are merged.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

M, BUILD, WIDTH = 16, 200, 100  # links a node, candidates while building, candidates while searching
SHARD = 20_000  # rows of a graph


class Graph:
    """Insert, search, delete, and to and from bytes. metric: 'cos' or 'l2'; a zero vector is at distance 1 from all by 'cos'."""

    def __init__(self, dim: int, metric: str = "cos", m: int = M, build: int = BUILD, seed: int = 0):
        self.dim, self.metric, self.m, self.build = dim, metric, m, build
        self.x = np.zeros((0, dim), np.float32)
        self.keys: list[int] = []
        self.links: list[list[list[int]]] = []  # of each node, by level
        self.gone: set[int] = set()
        self.top = -1
        self._rng = np.random.default_rng(seed)

    def _form(self, v) -> np.ndarray:
        v = np.asarray(v, np.float32)
        return v / n if self.metric == "cos" and (n := float(np.linalg.norm(v))) > 0 else v

    def _far(self, q: np.ndarray, ids) -> np.ndarray:
        return 1 - self.x[ids] @ q if self.metric == "cos" else np.sqrt(((self.x[ids] - q) ** 2).sum(1))

    def _walk(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes of a level, at most width, from starts on; nearest first."""
        seen = {i for _, i in starts}
        todo, best = list(starts), [(-d, i) for d, i in starts]
        heapify(todo)
        heapify(best)
        while todo:
            d, i = heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._far(q, new).tolist(), new):
                if len(best) < width:
                    heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapreplace(best, (-e, j))
                else:
                    continue
                heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, nearest first, those nearer to the centre than to any chosen one; then the nearest of the others."""
        chosen: list[int] = []
        left: list[int] = []
        for d, i in near:
            if len(chosen) >= most:
                break
            (chosen if not chosen or self._far(self.x[i], chosen).min() > d else left).append(i)
        return chosen + left[: most - len(chosen)]

    def extend(self, keys: list[int], vectors: np.ndarray) -> None:
        for k, v in zip(keys, vectors):
            self.insert(k, v)

    def insert(self, key: int, vector) -> None:
        q, i = self._form(vector), len(self.keys)
        if i >= len(self.x):
            self.x = np.vstack([self.x, np.zeros((max(64, len(self.x)), self.dim), np.float32)])
        self.x[i] = q
        self.keys.append(int(key))
        level = int(-math.log(1 - self._rng.random()) / math.log(self.m))
        self.links.append([[] for _ in range(level + 1)])
        if self.top < 0:
            self.top, self.entry = level, i
            return
        near = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for at in range(self.top, level, -1):
            near = self._walk(q, near[:1], 1, at)
        for at in range(min(level, self.top), -1, -1):
            near = self._walk(q, near, self.build, at)
            self.links[i][at] = self._spread(near, self.m)
            most = self.m * (2 if at == 0 else 1)
            for j in self.links[i][at]:
                own = self.links[j][at]
                own.append(i)
                if len(own) > most:
                    self.links[j][at] = self._spread(sorted(zip(self._far(self.x[j], own).tolist(), own)), most)
        if level > self.top:
            self.top, self.entry = level, i

    def delete(self, key: int) -> None:
        """The node stays a way to others but is found no more."""
        self.gone.update(i for i, k in enumerate(self.keys) if k == key)

    def search(self, vector, k: int, width: int = WIDTH) -> list[tuple[float, int]]:
        """(distance, key) of about the k nearest."""
        if self.top < 0:
            return []
        q = self._form(vector)
        near = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for at in range(self.top, 0, -1):
            near = self._walk(q, near[:1], 1, at)
        return [(d, self.keys[i]) for d, i in self._walk(q, near, max(width, k) + len(self.gone), 0) if i not in self.gone][:k]

    def to_bytes(self) -> bytes:
        n = len(self.keys)
        levels = np.array([len(x) for x in self.links], np.int32)
        counts = np.array([len(y) for x in self.links for y in x], np.int32)
        flat = np.array([j for x in self.links for y in x for j in y], np.int32)
        out = io.BytesIO()
        np.savez(out, x=self.x[:n], keys=np.array(self.keys, np.int64), levels=levels, counts=counts, flat=flat, gone=np.array(sorted(self.gone), np.int64), about=np.array([self.top, getattr(self, "entry", -1), self.m, self.build, self.metric == "cos", self.dim]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Graph":
        z = np.load(io.BytesIO(data))
        top, entry, m, build, cos, dim = z["about"].tolist()
        g = cls(dim, "cos" if cos else "l2", m, build)
        g.x, g.keys, g.gone, g.top, g.entry = z["x"], z["keys"].tolist(), set(z["gone"].tolist()), top, entry
        parts = iter(np.split(z["flat"], np.cumsum(z["counts"])[:-1])) if len(z["counts"]) else iter(())
        g.links = [[next(parts).tolist() for _ in range(n)] for n in z["levels"].tolist()]
        return g


class HnswIndex:
    """Graphs of all shards, stored as rows (shard, graph) under a path. Null vectors and those of another length are in none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dim: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cos", rows: int = SHARD, m: int = M, build: int = BUILD) -> "HnswIndex":
        ok = vectors.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"))
        shards = max(1, math.ceil(ok.count() / rows))

        def graph(pdf: pd.DataFrame) -> pd.DataFrame:
            g = Graph(dim, metric, m, build)
            pdf = pdf.sort_values("key")
            g.extend(pdf.key.tolist(), np.stack(pdf.v.to_list()))
            return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "graph": [g.to_bytes()]})

        ok.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(graph, "shard int, graph binary").write.mode("overwrite").parquet(path)
        return cls(vectors.sparkSession, path)

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
        """query_id, key, distance, rank of about the k nearest of each query. Queries go to every shard and stream past its graph; none goes through the driver."""
        graphs = self.spark.read.parquet(self.path)
        shards = graphs.count()
        if not shards:
            return self.spark.createDataFrame([], f"query_id bigint, {key} bigint, distance double, rank int")
        q = queries.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("binary").alias("graph"))
        g = graphs.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "graph")

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = None
            for b in batches:
                out = []
                for r in b.itertuples():
                    if r.kind == 0:
                        graph = Graph.from_bytes(r.graph)
                    elif graph is not None and len(r.v) == graph.dim:
                        out += [(r.query_id, i, float(d)) for d, i in graph.search(r.v, k, width)]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", key, "distance"])

        found = g.unionByName(q).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInPandas(near, f"query_id bigint, {key} bigint, distance double")
        return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)
