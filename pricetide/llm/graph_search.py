"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, stored as flat neighbour arrays; shard results are merged.

Every valid row is indexed. Rows with equal vectors are one node, which keeps the smallest ids that any answer can use (one more than the
answers wanted; a query's own id may be among them), so thousands of copies don't tie the graph into a knot, and no answer is lost. Nodes are dealt to shards by a hash
of their least id: at least SHARDS of them, more where a shard would hold over SHARD_NODES, so that a task's memory is bounded.

A shard's task inserts its nodes in batches that double at first; a batch searches the graph so far (all its searches advance together,
one numpy step at a time), chooses diverse neighbours among what it found and itself, and links back; full lists keep their most diverse part.
Largest inner product becomes nearest direction by one more coordinate that gives all vectors of a shard the same length. The index is a
table: rows of at most CHUNK nodes with flat arrays of vectors, ids and neighbours by layer. Searching reads it again, shard by shard; blocks of
queries pass by. Found nodes are scored exactly on the original vectors, in double precision, summed in order.

Defined results: vectors that are null, empty, all zero or hold null or non-finite numbers take no part, nor do rows without id; an id that repeats is one row with its least vector; a
vector is compared with those of its own length; ties go to the smaller id; fewer candidates than wanted are all returned. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm.common import checkpoint_folder, table

WANTED, EVERY = 20, 20
SHARDS, SHARD_NODES = 16, 1 << 20
#: Neighbours in upper layers (the lowest has twice as many), candidates of an insertion and of a search.
LINKS, BUILD, BEAM = 16, 48, 64
#: Nodes in a row of the stored index, queries in a block, pairs (query, node) whose visits one search notes.
CHUNK, QUERIES, NOTED = 4_096, 256, 1 << 25


#: Newcomers that a node's list takes at once, lists mended at once.
AT_ONCE, HUBS = 4, 2_048


class Layer:
    """A graph on the first nodes of a shard: links[i] are the neighbours of node i, padded by -1."""

    def __init__(self, size: int, degree: int):
        self.links = np.full((size, degree), -1, np.int32)
        self.count = 0


def best(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest of each row, largest first."""
    if sims.shape[1] > n:
        part = np.argpartition(-sims, n - 1, 1)[:, :n]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), 1, "stable"), 1)


def products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each row's vectors (rows x some x dim) with the row's one."""
    return np.matmul(rows, one[:, :, None])[:, :, 0]


def search(vectors: np.ndarray, links: np.ndarray, count: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and similarities of the beam that a best-first walk from entry (queries x some) leaves, nearest first."""
    n = len(queries)
    nodes, sims, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    seen = np.zeros((n, count + 1), bool)  # the last column stands for no node
    width = min(entry.shape[1], beam)
    nodes[:, :width] = entry[:, :width]
    sims[:, :width] = np.where(nodes[:, :width] >= 0, products(vectors[nodes[:, :width]], queries), -np.inf)
    np.put_along_axis(seen, nodes[:, :width].astype(np.int64), True, 1)
    live = np.arange(n)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        at = open_sims.argmax(1)
        going = open_sims[np.arange(len(live)), at] > -np.inf
        live, at = live[going], at[going]
        if not len(live):
            break
        done[live, at] = True
        near = links[nodes[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        found = np.where(fresh, products(vectors[near], queries[live]), -np.inf)
        all_sims = np.concatenate([sims[live], found], 1)
        top = best(all_sims, beam)
        sims[live] = np.take_along_axis(all_sims, top, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(fresh, near, -1)], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(fresh)], 1), top, 1)
    nodes[sims == -np.inf] = -1
    return nodes, sims


def diverse(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none): those nearer to the row's vector than to any chosen before, filled up by the nearest others."""
    rows, width = nodes.shape
    between = np.matmul(vectors[nodes], vectors[nodes].transpose(0, 2, 1))
    chosen, held = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for k in range(width):
        blocked = (chosen[:, :k] & (between[:, k, :k] > sims[:, k, None])).any(1) if k else np.zeros(rows, bool)
        chosen[:, k] = ~blocked & (nodes[:, k] >= 0) & (held < degree)
        held += chosen[:, k]
    order = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)), 1, "stable")[:, :degree]
    out = np.take_along_axis(nodes, order, 1)
    if out.shape[1] < degree:
        out = np.concatenate([out, np.full((rows, degree - out.shape[1]), -1, out.dtype)], 1)
    return out


def ranked(vectors: np.ndarray, centres: np.ndarray, nodes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's candidates without repeats or the row's own node, the width nearest to it, nearest first."""
    nodes = np.sort(nodes, 1)
    nodes = np.where((nodes == centres[:, None]) | np.concatenate([np.zeros((len(nodes), 1), bool), nodes[:, 1:] == nodes[:, :-1]], 1), -1, nodes)
    sims = np.where(nodes >= 0, products(vectors[nodes], vectors[centres]), -np.inf)
    top = best(sims, width)
    return np.take_along_axis(nodes, top, 1), np.take_along_axis(sims, top, 1)


def link(vectors: np.ndarray, layer: Layer, new: np.ndarray, candidates: np.ndarray) -> None:
    """Adds nodes new (the next ones of the layer) with their candidates to the layer."""
    degree = layer.links.shape[1]
    with_batch = np.concatenate([candidates, new[np.argpartition(-(vectors[new] @ vectors[new].T), min(LINKS, len(new) - 1), 1)[:, : LINKS + 1]]], 1)
    nodes, sims = ranked(vectors, new, with_batch, BUILD)
    layer.links[new] = diverse(vectors, nodes, sims, degree)
    layer.count = int(new[-1]) + 1
    to, source = layer.links[new], np.repeat(new, degree).reshape(len(new), degree)
    to, source = to[to >= 0], source[to >= 0]
    order = np.lexsort((-np.einsum("ed,ed->e", vectors[to], vectors[source]), to))
    to, source = to[order], source[order]
    _, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    for least in range(0, degree, AT_ONCE):  # the nearest newcomers first; a list holds no more than degree
        now = (place >= least) & (place < least + AT_ONCE)
        if not now.any():
            break
        hubs, row = np.unique(to[now], return_inverse=True)
        asked = np.full((len(hubs), AT_ONCE), -1, np.int32)
        asked[row, place[now] - least] = source[now]
        for at in range(0, len(hubs), HUBS):
            some = hubs[at : at + HUBS]
            nodes, sims = ranked(vectors, some, np.concatenate([layer.links[some], asked[at : at + HUBS]], 1), degree + AT_ONCE)
            layer.links[some] = diverse(vectors, nodes, sims, degree)


def build(vectors: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of each layer, the lowest first; levels fall, so that a layer holds the first nodes."""
    layers = [Layer(int((levels >= k).sum()), LINKS * (1 if k else 2)) for k in range(int(levels[0]) + 1)]
    done = 0
    while done < len(vectors):
        new = np.arange(done, min(len(vectors), done + max(1, min(QUERIES, done // 2))), dtype=np.int32)
        new = new[levels[new] == levels[done]]
        if not done:
            for k in range(int(levels[0]) + 1):
                layers[k].count = 1
            done = 1
            continue
        entry = np.zeros((len(new), 1), np.int32)
        for k in range(len(layers) - 1, -1, -1):
            if not layers[k].count:
                continue
            if k > levels[done]:
                entry = search(vectors, layers[k].links, layers[k].count, vectors[new], entry, 4)[0]
            else:
                entry, _ = search(vectors, layers[k].links, layers[k].count, vectors[new], entry, BUILD)
                link(vectors, layers[k], new, entry)
        done += len(new)
    return [x.links for x in layers]


def seek(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """The beam of nodes found for each query, nearest first."""
    entry = np.zeros((len(queries), 1), np.int32)
    for k in range(len(layers) - 1, 0, -1):
        entry = search(vectors, layers[k], len(layers[k]), queries, entry, 4)[0]
    return search(vectors, layers[0], len(layers[0]), queries, entry, beam)[0]


def raised(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by the longest, and one coordinate that gives all of them its length."""
    scale = np.abs(vectors).max()
    norms = np.sqrt(((vectors / scale) ** 2).sum(1))
    unit = vectors / scale / norms.max()
    return np.concatenate([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))[:, None]], 1).astype(np.float32)


def valid(rows: DataFrame) -> DataFrame:
    """One (vec_id, embedding as doubles) for each id with a vector that takes part."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nodes_of(rows: DataFrame, wanted: int) -> DataFrame:
    """Distinct vectors with their smallest ids: (dim, lead, ids, embedding)."""
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= wanted + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.size("embedding").alias("dim"), F.col("ids")[0].alias("lead"), "ids", "embedding")


def floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


INDEX = "shard int, at int, nodes int, dim int, size int, vectors binary, ids binary, ends binary, links array<binary>"


def indexed(nodes: DataFrame, shards: int) -> DataFrame:
    """The index as rows of INDEX: at most CHUNK nodes of a shard each, from its node at on; links by layer, ends of each node's ids."""

    def graph(shard: int, leads: np.ndarray, ids: list, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        draw = (leads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x632BE59BD9B4E019)
        draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        levels = (-np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / np.log(LINKS)).astype(np.int64)
        order = np.lexsort((leads, -levels))
        vectors, ids, levels = vectors[order], [ids[i] for i in order], levels[order]
        layers = build(raised(vectors), levels)
        for at in range(0, len(vectors), CHUNK):
            part = slice(at, at + CHUNK)
            own = ids[part]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int32()) for x in (shard, at, len(own), vectors.shape[1], len(vectors))), pa.array([vectors[part].tobytes()]), pa.array([np.concatenate(own).astype(np.int64).tobytes()]),
                 pa.array([np.cumsum([len(x) for x in own]).astype(np.int32).tobytes()]), pa.array([[x[part].tobytes() for x in layers]], pa.list_(pa.binary()))],
                names=["shard", "at", "nodes", "dim", "size", "vectors", "ids", "ends", "links"],
            )

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leads, ids, vectors = None, [], [], []
        for batch in batches:
            own = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                if own[first] != shard:
                    if shard is not None:
                        yield from graph(shard, np.concatenate(leads), ids, np.concatenate(vectors))
                    shard, leads, ids, vectors = int(own[first]), [], [], []
                leads.append(part.column("lead").to_numpy())
                ids.extend(np.array(x, np.int64) for x in part.column("ids").to_pylist())
                vectors.append(floats(part, "embedding").reshape(last - first, -1))
        if shard is not None:
            yield from graph(shard, np.concatenate(leads), ids, np.concatenate(vectors))

    dealt = nodes.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lead")
    return dealt.select("shard", "lead", "ids", "embedding").mapInArrow(built, INDEX)


class Shard:
    """What a task holds of one shard while queries pass by."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, *part) -> None:
        self.parts.append(part)

    def prepare(self) -> None:
        if self.ready:
            return
        dim, size = self.parts[0][:2]
        self.vectors = np.concatenate([np.frombuffer(p[2], np.float64).reshape(-1, dim) for p in self.parts])
        counts, ids = [np.diff(np.frombuffer(p[4], np.int32), prepend=0) for p in self.parts], [np.frombuffer(p[3], np.int64) for p in self.parts]
        self.ids, self.ends = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        degrees = [2 * LINKS if k == 0 else LINKS for k in range(len(self.parts[0][5]))]
        self.layers = [np.concatenate([np.frombuffer(p[5][k], np.int32).reshape(-1, m) for p in self.parts]) for k, m in enumerate(degrees)]
        self.raised, self.parts, self.ready = raised(self.vectors), [], True

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, wanted: int, beam: int) -> tuple[list, list, list]:
        flat = np.concatenate([queries / np.abs(queries).max(1)[:, None], np.zeros((len(queries), 1))], 1).astype(np.float32)
        own, found, scores = [], [], []
        step = max(1, NOTED // (len(self.vectors) + 1))
        for first in range(0, len(queries), step):
            nodes = seek(self.raised, self.layers, flat[first : first + step], beam)
            for query_id, query, row in zip(query_ids[first : first + step], queries[first : first + step], nodes, strict=True):
                row = row[row >= 0]
                each, score = self.vectors[row] * query, np.zeros(len(row))
                for k in range(len(query)):
                    score += each[:, k]
                counts = self.ends[row] - np.where(row > 0, self.ends[row - 1], 0)
                ids = np.concatenate([self.ids[e - c : e] for e, c in zip(self.ends[row], counts, strict=True)] or [np.zeros(0, np.int64)])
                each = np.repeat(score, counts)
                ids, each = ids[other := ids != query_id], each[other]
                top = np.lexsort((ids, -each))[:wanted]
                own.append(np.full(len(top), query_id)), found.append(ids[top]), scores.append(each[top])
        return own, found, scores


def neighbours(rows: DataFrame, wanted: int = WANTED, every: int = EVERY, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found for each row of (vec_id, embedding) whose id is divisible by every."""
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/graph-{uuid.uuid4()}"
    valid(rows).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    nodes_of(rows, wanted).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    plan, total = [], 0
    for row in sorted(nodes.groupBy("dim").count().collect()):  # one row for each length of vectors
        n = max(min(SHARDS, row["count"]), -(-row["count"] // SHARD_NODES))
        plan.append((row.dim, total, n))
        total += n
    schema = "query_id long, vec_id long, score double"
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = spark.createDataFrame(plan, "dim int, first int, n int")
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("lead"), F.col("n"))).cast("int"))  # a row for each length
    indexed(dealt, total).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids, vectors = part.column("vec_id").to_numpy(), floats(part, "embedding")
                for at in range(0, len(ids), QUERIES):
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[at : at + QUERIES].tobytes()]), pa.array([vectors[at * dim : (at + QUERIES) * dim].tobytes()])], names=["dim", "ids", "vectors"])

    asked = rows.where(F.col("vec_id") % every == 0).select(F.size("embedding").alias("dim"), "vec_id", "embedding").mapInArrow(packed, "dim int, ids binary, vectors binary")
    asked = asked.join(F.broadcast(shards), "dim").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("shard"), "dim", "ids", "vectors")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, Shard()
        for batch in batches:
            for own, kind, dim, size, vectors, ids, ends, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    shard, held = own, Shard()
                if kind == 0:
                    held.add(dim, size, vectors, ids, ends, links)
                    continue
                if not held.parts and not held.ready:
                    continue  # the hash dealt this shard nothing
                held.prepare()
                out = held.answer(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim), wanted, beam)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    none = F.lit(None)
    stream = index.select("shard", F.lit(0).alias("kind"), "at", "dim", "size", "vectors", "ids", "ends", "links").unionByName(
        asked.select("shard", F.lit(1).alias("kind"), F.lit(0).alias("at"), "dim", F.lit(0).alias("size"), "vectors", "ids", none.cast("binary").alias("ends"), none.cast("array<binary>").alias("links"))
    )
    dealt = stream.repartitionById(total, F.col("shard")).sortWithinPartitions("shard", "kind", "at").drop("at")
    found = dealt.mapInArrow(answered, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


#: Every query against every row. The search is approximate: it equals this where its beam finds all of the true neighbours, as on small tables.
OP11_SQL = f"""
WITH rows AS (
  SELECT vec_id::BIGINT AS vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1
),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score
  FROM rows q JOIN rows r ON r.vec_id <> q.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs
QUALIFY rank <= {WANTED}
"""
