"""Approximate nearest neighbours by cosine over robust-pruned directed graphs.

Vectors are dealt to shards by a hash of their id, and each shard builds one graph: points
enter in growing batches, a greedy search from the entry point proposes neighbours, and
pruning keeps the nearest and drops what a kept neighbour is closer to by a factor ``ALPHA``,
so edges stay few and point everywhere. Edges are answered by edges back, pruned the same way.
A query runs a beam search in every shard; the shards' nearest are merged by exact cosines in
double precision. Copies of a vector are one point of a graph with all their ids, so a group
of copies of any size is searched once and loses no id that could be among the nearest.

Searching meets every shard with every block of queries. Shards grow with the table, from
4,096 to 65,536 rows, so the messages are fewer than the vectors until a table has 65,536 rows
for every task; beyond that they are blocks times shards. Cosines are of vectors scaled by powers of two, so no magnitude overflows.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids or vectors of another length than most (the longer at a tie). A repeated id is
returned once per row and asked once, with its least vector. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathomix.llm.common import shuffle_partitions
from fathomix.session import materialize

# Rows of a shard: as many as give every task one, between these.
SHARD_ROWS, LARGEST_SHARD = 4096, 1 << 16
DEGREE = 32
# Points kept while searching, and expanded at once.
BEAM, WIDTH = 64, 4
ALPHA = 1.2
BATCH = 512
# Queries that travel together.
QUERY_BLOCK = 2048


@dataclass
class Graph:
    """Unit vectors, padded neighbour lists (-1: none) and the entry point."""

    points: np.ndarray
    edges: np.ndarray
    entry: int

    def search(self, queries: np.ndarray, beam: int = BEAM, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``beam`` nearest points found (-1: none) and their squared distances."""
        rows = np.arange(len(queries))[:, None]
        # The last column takes what padding writes.
        visited = np.zeros((len(queries), len(self.points) + 1), bool)
        found = np.full((len(queries), beam), -1)
        apart = np.full((len(queries), beam), np.inf, np.float32)
        done = np.zeros((len(queries), beam), bool)
        found[:, 0] = self.entry
        apart[:, 0] = 2 - 2 * (queries @ self.points[self.entry])
        visited[:, self.entry] = True
        while True:
            waiting = (found >= 0) & ~done
            if not waiting.any():
                return found, apart
            order = np.argsort(~waiting, axis=1, kind="stable")[:, :WIDTH]
            picked = np.where(waiting[rows, order], found[rows, order], -1)
            done[rows, order] = True
            near = np.where(picked[:, :, None] >= 0, self.edges[picked], -1).reshape(len(queries), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[visited[rows, near]] = -1
            visited[rows, near] = True
            visited[:, -1] = False
            use = np.flatnonzero((near >= 0).any(axis=0))
            near = near[:, use]
            far = (2 - 2 * np.einsum("bcd,bd->bc", self.points[near], queries)).astype(np.float32)
            far[near < 0] = np.inf
            both = np.concatenate([apart, far], axis=1)
            best = np.argsort(both, axis=1, kind="stable")[:, :beam]
            ids = np.concatenate([found, near], axis=1)
            done = np.concatenate([done, np.zeros_like(near, bool)], axis=1)[rows, best]
            found, apart = ids[rows, best], both[rows, best]
            found[np.isinf(apart)] = -1


def pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each ``own`` point out of its row of ``candidates`` (-1: none).

    The nearest candidate stays and removes all others that it is closer to than the point
    is, by a factor ``alpha``; so on with the next nearest, up to ``degree``.
    """
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == own[:, None]] = -1
    vectors = points[candidates]
    apart = 2 - 2 * np.einsum("bcd,bd->bc", vectors, points[own])
    apart[candidates < 0] = np.inf
    rows = np.arange(len(own))
    kept = np.full((len(own), degree), -1)
    alive = apart.copy()
    for slot in range(degree):
        nearest = alive.argmin(axis=1)
        some = np.isfinite(alive[rows, nearest])
        if not some.any():
            break
        kept[some, slot] = candidates[rows, nearest][some]
        between = 2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, nearest])
        alive[(alpha * alpha * between <= apart) & some[:, None]] = np.inf
        alive[rows, nearest] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
    """A graph over distinct unit vectors, entered in a fixed random order."""
    n = len(points)
    order = np.random.default_rng(0).permutation(n)
    middle = points.mean(axis=0)
    entry = int((points @ middle).argmax())
    order = np.concatenate([[entry], order[order != entry]])
    graph = Graph(points, np.full((n, degree), -1), entry)
    at = 1
    while at < n:
        batch = order[at:at + min(BATCH, max(8, at))]
        found, _ = graph.search(points[batch], beam)
        # Points of a batch do not see each other in the graph yet, so near ones are proposed directly.
        mates = np.argsort(-(points[batch] @ points[batch].T), axis=1)[:, : min(len(batch), degree // 2)]
        graph.edges[batch] = pruned(points, batch, np.concatenate([found, batch[mates]], axis=1), degree, alpha)
        _add_back(graph, batch, degree, alpha)
        at += len(batch)
    return graph


def _add_back(graph: Graph, batch: np.ndarray, degree: int, alpha: float) -> None:
    ends = graph.edges[batch]
    source, target = np.repeat(batch, degree)[(ends >= 0).ravel()], ends[ends >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    changed, first, count = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(changed), BATCH):
        some = slice(low, low + BATCH)
        fresh = np.full((len(changed[some]), count[some].max()), -1)
        for i, (f, c) in enumerate(zip(first[some], count[some])):
            fresh[i, :c] = source[f:f + c]
        candidates = np.concatenate([graph.edges[changed[some]], fresh], axis=1)
        graph.edges[changed[some]] = pruned(graph.points, changed[some], candidates, degree, alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = vectors.select("vec_id", whole.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & some)
    usual = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.filter(F.size("embedding") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def build(vectors: DataFrame, shard_rows: int | None = None) -> tuple[DataFrame, int]:
    """The stored index, one row per shard, and the number of shards.

    ``shard, ids, vectors, edges``: ids and original vectors of all rows, and the graph over
    their distinct directions as neighbour lists.
    """
    rows = usable(vectors)
    total = rows.count()
    if shard_rows is None:
        tasks = max(shuffle_partitions(vectors), vectors.sparkSession.sparkContext.defaultParallelism)
        shard_rows = min(max(SHARD_ROWS, -(-total // tasks)), LARGEST_SHARD)
    shards = max(1, -(-total // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        x = _matrix(table.column("embedding").combine_chunks(), table.num_rows)
        _, first, member = np.unique(x, axis=0, return_index=True, return_inverse=True)
        unit = _unit(x[first])
        graph = build_graph(unit)
        return pa.Table.from_pydict({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
            "width": pa.array([x.shape[1]], pa.int32()),
            "vectors": pa.array([x.tobytes()], pa.binary()),
            "first": pa.array([first.astype("<i4").tobytes()], pa.binary()),
            "member": pa.array([member.ravel().astype("<i4").tobytes()], pa.binary()),
            "edges": pa.array([graph.edges.astype("<i4").tobytes()], pa.binary()),
            "entry": pa.array([graph.entry], pa.int32()),
        })

    index = dealt.select("shard", F.col("vec_id").cast("long").alias("vec_id"), "embedding").groupBy("shard").applyInArrow(
        make, "shard int, ids array<long>, width int, vectors binary, first binary, member binary, edges binary, entry int")
    return materialize(index), shards


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component near one; this rounds nothing."""
    _, exponent = np.frexp(np.abs(x).max(axis=-1, keepdims=True))
    return np.ldexp(x, -exponent)


def cosines(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines of vectors of any magnitude."""
    query, others = _scaled(query), _scaled(others)
    dots = (others * query).sum(axis=1)
    return dots / (np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(axis=1)))


class Shard:
    """A shard's index, unpacked for searching."""

    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), row["width"])
        self.first = np.frombuffer(row["first"], "<i4")
        member = np.frombuffer(row["member"], "<i4")
        # Rows of each distinct vector, by id.
        self.order = np.argsort(member, kind="stable")
        self.bounds = np.searchsorted(member[self.order], np.arange(len(self.first) + 1))
        edges = np.frombuffer(row["edges"], "<i4").reshape(len(self.first), -1)
        self.graph = Graph(_unit(self.vectors[self.first]), edges, row["entry"])

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """``query, vec_id, score`` of the ``k`` nearest other rows found for each query."""
        found, _ = self.graph.search(_unit(queries), max(beam, 2 * k))
        for query, vector, points in zip(ids.tolist(), queries, found):
            points = points[points >= 0]
            # Of copies, only the k + 1 smallest ids can be among the k nearest other rows.
            rows = np.concatenate([
                self.order[self.bounds[p]:min(self.bounds[p] + k + 1, self.bounds[p + 1])] for p in points])
            rows = rows[self.ids[rows] != query]
            scores = cosines(vector, self.vectors[rows])
            for at in np.lexsort((self.ids[rows], -scores))[:k]:
                yield query, int(self.ids[rows[at]]), float(scores[at])


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each of ``queries``.

    ``queries`` has ``vec_id`` and ``embedding`` of usable vectors. Queries travel in blocks, each
    one to every shard. Each shard's index comes first in its partition, then the blocks, so a
    task holds one shard at a time.
    """
    fields = [f for f in index.schema if f.name != "shard"]
    stored = materialize(queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    blocks = max(1, -(-stored.count() // QUERY_BLOCK))
    block = materialize(stored.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q")).select(
        "block", F.col("q.id").alias("asked"), F.flatten("q.v").alias("components")))
    asked = block.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "block", "asked", "components")
    held = index.select("shard", *[f.name for f in fields], *[
        F.lit(None).cast(block.schema[n].dataType).alias(n) for n in ("block", "asked", "components")])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                ids = batch.column(batch.num_columns - 2)[i]
                if not ids.is_valid:
                    shard, current = Shard(batch.slice(i, 1).to_pylist()[0]), number
                elif number == current:
                    ids = ids.values.to_numpy()
                    vectors = batch.column(batch.num_columns - 1)[i].values.to_numpy().reshape(len(ids), -1)
                    for low in range(0, len(ids), BATCH):
                        rows = list(shard.nearest(ids[low:low + BATCH], vectors[low:low + BATCH], k, beam))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, schema.types)], schema=schema)

    together = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions(
        "shard", F.col("block").asc_nulls_first())
    near = together.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """``query, vec_id, score`` of the ``k`` nearest other rows found for each query."""
        found, _ = self.graph.search(_unit(queries), max(beam, 2 * k))
        for query, vector, points in zip(ids.tolist(), queries, found):
            points = points[points >= 0]
            # Of copies, only the k + 1 smallest ids can be among the k nearest other rows.
            rows = np.concatenate([
                self.order[self.bounds[p]:min(self.bounds[p] + k + 1, self.bounds[p + 1])] for p in points])
            rows = rows[self.ids[rows] != query]
            scores = cosines(vector, self.vectors[rows])
            for at in np.lexsort((self.ids[rows], -scores))[:k]:
                yield query, int(self.ids[rows[at]]), float(scores[at])


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each of ``queries``.

    ``queries`` has ``vec_id`` and ``embedding`` of usable vectors. Each shard's index comes
    first in its partition, then the queries in batches, so a task holds one shard at a time.
    """
    fields = [f for f in index.schema if f.name != "shard"]
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"),
    )
    held = index.select("shard", *[f.name for f in fields], F.lit(None).cast("long").alias("query_id"),
                        F.lit(None).cast("array<double>").alias("query"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current, ids, vectors = None, None, [], []

        def answered() -> pa.RecordBatch:
            rows = list(shard.nearest(np.array(ids), np.array(vectors, float), k, beam))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, schema.types)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                query = batch.column(batch.num_columns - 2)[i].as_py()
                if ids and (query is None or number != current or len(ids) >= BATCH):
                    yield answered()
                    ids, vectors = [], []
                if query is None:
                    shard, current = Shard(batch.slice(i, 1).to_pylist()[0]), number
                elif number == current:
                    ids.append(query)
                    vectors.append(batch.column(batch.num_columns - 1)[i].as_py())
        if ids:
            yield answered()

    together = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions(
        "shard", F.col("query_id").asc_nulls_first())
    near = together.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int | None = None, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest other rows of each row whose id is divisible by ``every``."""
    index, shards = build(vectors, shard_rows)
    asked = usable(vectors).filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(index, shards, asked, k, beam)
