"""Operator 8: approximate nearest neighbours by largest inner product, on robust-pruned graphs.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries): among
those the Euclidean nearest are exactly those of largest inner product.  The distinct vectors are
dealt to shards by hash, about ``shard_rows`` each, and every shard builds a directed graph: a
greedy beam search for each point proposes neighbours, and relaxed distance pruning (an edge goes
when a kept neighbour is nearer to its end by the factor ``alpha``) keeps diverse edges; reverse
edges are added and pruned alike.  Queries search every shard, in blocks: beam search from the
shard's medoid, exact double-precision scores of what the beam holds, and the best k over shards.

Equal vectors are one node that carries its k + 1 smallest ids (enough for any answer of length k),
so a vector that a third of all rows share costs one node.  Edge cases: vectors that are NULL,
empty, all zero, or hold NULL or non-finite components take no part, neither do vectors whose
length is not the most frequent one (ties: the smaller), nor rows with a NULL id; score ties go to
the smaller id; rows with the query's id are the query's own and no candidates; fewer candidates
than k give them all; rows repeated with equal id and vector count once; extra columns don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, written


@dataclass(frozen=True)
class GraphConfig:
    degree: int = 24          #: edges kept by a pruning
    slack: int = 12           #: further edges before a node is pruned again
    beam: int = 48            #: beam while building
    search_beam: int = 64     #: beam of a query
    alpha: float = 1.2
    batch: int = 512          #: points searched at once
    shard_rows: int = 4096    #: distinct vectors per shard
    query_rows: int = 1024    #: queries per block
    seed: int = 7


def _distances(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of points (b, d) to the vectors of ids (b, c)."""
    return norms[ids] + np.einsum("bd,bd->b", points, points)[:, None] - 2 * np.einsum("bcd,bd->bc", x[ids], points)


def beam_search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, start: np.ndarray, points: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many points in step: (ids of the beam, ids expanded on the way), -1 padded."""
    b, rows = len(points), np.arange(len(points))
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x)), bool)
    first = start[:beam]
    ids[:, :len(first)] = first
    dist[:, :len(first)] = _distances(x, norms, np.broadcast_to(first, (b, len(first))), points)
    open_[:, :len(first)] = True
    seen[:, first] = True
    expanded = []
    while True:
        waiting = np.where(open_, dist, np.inf)
        j = waiting.argmin(1)
        live = np.flatnonzero(np.isfinite(waiting[rows, j]))
        if not len(live):
            break
        node = ids[live, j[live]]
        open_[live, j[live]] = False
        step = np.full(b, -1, np.int64)
        step[live] = node
        expanded.append(step)
        near = edges[node]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[np.broadcast_to(live[:, None], near.shape)[new], near[new]] = True
        d = np.where(new, _distances(x, norms, np.where(new, near, 0), points[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        pick = lambda old, more: np.take_along_axis(np.concatenate([old, more], 1), keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live], open_[live] = pick(ids[live], np.where(new, near, -1)), pick(open_[live], new)
    return ids, np.stack(expanded, 1) if expanded else np.empty((b, 0), np.int64)


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float,
                 degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node in ``points`` from its candidates (-1: none)."""
    cand = np.sort(candidates, 1)
    alive = (cand >= 0) & (cand != points[:, None])
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    cand = np.where(alive, cand, 0)
    vectors, rows = x[cand], np.arange(len(points))
    near = norms[cand] + norms[points][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, x[points])
    out = np.full((len(points), degree), -1, np.int64)
    for r in range(degree):
        waiting = np.where(alive, near, np.inf)
        j = waiting.argmin(1)
        ok = np.isfinite(waiting[rows, j])
        if not ok.any():
            break
        star = cand[rows, j]
        out[ok, r] = star[ok]
        alive[rows, j] = False
        between = norms[cand] + norms[star][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, x[star])
        alive &= ~(alpha * alpha * between <= near)
    return out


def build_graph(x: np.ndarray, config: GraphConfig = GraphConfig()) -> tuple[np.ndarray, np.ndarray]:
    """(edges, -1 padded; start nodes) of the vectors of one shard."""
    n, width = len(x), config.degree + config.slack
    rng = np.random.default_rng(config.seed)
    norms = np.einsum("nd,nd->n", x, x)
    edges = np.full((n, width), -1, np.int64)
    if n > 1:
        random = rng.integers(0, n - 1, (n, min(config.degree, n - 1)))
        random += random >= np.arange(n)[:, None]  # never the node itself
        random.sort(1)
        random[:, 1:][random[:, 1:] == random[:, :-1]] = -1
        edges[:, :random.shape[1]] = random
    start = np.array([int((norms - 2 * x @ x.mean(0)).argmin())]) if n else np.empty(0, np.int64)
    for alpha in (1.0, config.alpha):
        order = rng.permutation(n)
        for at in range(0, n, config.batch):
            points = order[at:at + config.batch]
            found, way = beam_search(x, norms, edges, start, x[points], config.beam)
            kept = robust_prune(x, norms, points, np.concatenate([found, way, edges[points]], 1), alpha, config.degree)
            edges[points] = -1
            edges[points, :config.degree] = kept
            _add_reverse(x, norms, edges, points, kept, alpha, config.degree)
    return edges, start


def _add_reverse(x, norms, edges, points, kept, alpha, degree) -> None:
    """Edges from the kept neighbours back to the points; overfull nodes are pruned."""
    to = kept.ravel()
    back = np.repeat(points, kept.shape[1])[to >= 0]
    to = to[to >= 0]
    known = (edges[to] == back[:, None]).any(1)
    to, back = to[~known], back[~known]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    used = (edges[nodes] >= 0).sum(1)
    full = used + counts > edges.shape[1]
    # room left: compact the row, then append
    for group in (np.flatnonzero(~full), np.flatnonzero(full)):
        for part in np.array_split(group, max(1, len(group) // 256)):
            if not len(part):
                continue
            more = np.full((len(part), counts[part].max()), -1, np.int64)
            at = np.arange(more.shape[1])[None, :]
            inside = at < counts[part][:, None]
            more[inside] = back[(first[part][:, None] + at)[inside]]
            merged = np.concatenate([edges[nodes[part]], more], 1)
            if full[part[0]]:
                pruned = robust_prune(x, norms, nodes[part], merged, alpha, degree)
                edges[nodes[part]] = -1
                edges[nodes[part], :degree] = pruned
            else:
                merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
                edges[nodes[part]] = merged[:, :edges.shape[1]]


def usable(df: DataFrame, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows whose vectors take part."""
    v = F.col(column).cast("array<double>")
    rows = df.select(F.col(ids).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == common["n"]) if common else rows


#: Blocks of queries that pass a shard while it is open in one task.
BLOCKS_PER_WAVE = 64
INDEX = "shard int, ids array<array<long>>, vectors binary, extra binary, edges binary, start array<long>"


def build_index(rows: DataFrame, k: int = 20, config: GraphConfig = GraphConfig()) -> DataFrame:
    """One row per shard: ids of each node, vectors (float64), the further coordinate, edges and
    start nodes.  ``rows``: (id, v) of one length, as ``usable`` gives them."""
    prepare(rows.sparkSession)
    # the k+1 smallest ids of every distinct vector (limited in each task before the shuffle)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = (rows.distinct().withColumn("_r", rank).where(F.col("_r") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    nodes = written(nodes, "ann-nodes")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    n, top = nodes.agg(F.count("*"), F.max(square)).first()
    shards = max(1, -(-n // config.shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda ids: ids[0]))
        v = np.stack(pdf["v"].to_list()).astype(np.float64)
        extra = np.sqrt(np.maximum(top - (v * v).sum(1), 0.0))
        edges, start = build_graph(np.concatenate([v, extra[:, None]], 1).astype(np.float32), config)
        return pd.DataFrame({"shard": [key[0]], "ids": [[list(map(int, i)) for i in pdf["ids"]]], "vectors": [v.tobytes()],
                             "extra": [extra.tobytes()], "edges": [edges.astype(np.int32).tobytes()], "start": [start.tolist()]})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return written(nodes.repartition(min(shards, tasks), "shard").groupBy("shard").applyInPandas(build, INDEX), "ann-index")


class Shard:
    """A shard's graph, opened from its row."""

    def __init__(self, ids, vectors: bytes, extra: bytes, edges: bytes, start):
        n = len(ids)
        self.ids = ids
        self.vectors = np.frombuffer(vectors).reshape(n, -1)
        self.x = np.concatenate([self.vectors, np.frombuffer(extra)[:, None]], 1).astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.x, self.x)
        self.edges = np.frombuffer(edges, np.int32).reshape(n, -1).astype(np.int64)
        self.start = np.array(start, np.int64)

    def search(self, query_ids: list[int], queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the k best found for each query, its own id left out."""
        points = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        found, _ = beam_search(self.x, self.norms, self.edges, self.start, points, beam)
        for own, query, nodes in zip(query_ids, queries, found):
            nodes = nodes[nodes >= 0]
            scores = self.vectors[nodes] @ query
            best = sorted((-float(s), i) for s, node in zip(scores, nodes) for i in self.ids[node] if i != own)
            for s, i in best[:k]:
                yield own, i, -s


def search(index: DataFrame, queries: DataFrame, k: int = 20, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row of ``queries`` (id, v)."""
    spark = index.sparkSession
    prepare(spark)
    top = index.agg(F.max("shard")).first()[0]
    n = queries.count()
    blocks = max(1, -(-n // config.query_rows))
    waves = max(1, -(-blocks // BLOCKS_PER_WAVE))
    # a task meets a shard's row first and then the blocks of queries of one wave, one at a time
    shard = F.explode(F.sequence(F.lit(0), F.lit(top if top is not None else 0)))
    packed = (queries.distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
              .groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
              .select(shard.alias("shard"), F.pmod("block", F.lit(waves)).cast("int").alias("wave"), F.lit(1).alias("turn"), "rows"))
    opened = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1)))).withColumn("turn", F.lit(0))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    pairs = (opened.unionByName(packed, allowMissingColumns=True).withColumn("_task", F.xxhash64("shard", "wave"))
             .repartition(tasks, "_task").sortWithinPartitions("shard", "wave", "turn").drop("_task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("shard", "wave", "turn")]))
            for i, (shard, wave, turn) in enumerate(keys):
                if turn == 0:
                    row = batch.select(["ids", "vectors", "extra", "edges", "start"]).slice(i, 1).to_pylist()[0]
                    held, current = (shard, wave), Shard(**row)
                elif held == (shard, wave):     # numbers without a shard have no row
                    asked = batch.column("rows").slice(i, 1).flatten()
                    ids = asked.field("id").to_pylist()
                    vectors = asked.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                    got = list(current.search(ids, vectors, k, max(config.search_beam, 2 * k)))
                    if got:
                        q, v, s = zip(*got)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                                                         names=["query_id", "vec_id", "score"])
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(df: DataFrame, k: int = 20, every: int = 20, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Query form: rows whose id is divisible by ``every`` against all rows."""
    rows = usable(df)
    return search(build_index(rows, k, config), rows.where(F.col("id") % every == 0), k, config)
