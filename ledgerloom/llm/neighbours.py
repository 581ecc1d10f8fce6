"""Approximate nearest neighbours by inner product: shards of close vectors, a robust-pruned graph in each, beam searches of the shards where neighbours lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .embeddings import fit_cells
from .graph import QUERY_BEAM, PrunedGraph

#: Vectors of a shard, about; half as many again at most, but for chance.
SHARD = 8192
#: Most cells; beyond it cells are dealt out to more shards.
MOST_CELLS = 4096
#: Vectors that cells are fitted to, at most, and queries whose true neighbours say how many cells are searched; picked by a hash of their content.
SAMPLE, PROBED = 20_000, 200
#: Share of true neighbours that the searched cells must hold.
REACH = 0.98
#: Queries that search a shard together.
BLOCK = 4096


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: usable rows with the content they have, and each content once with a number ``uid`` and its ``k`` smallest ids, which are all that can be among the ``k`` nearest of anything."""
    numbers = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(numbers).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0) & (size < float("inf")) & F.col("vec_id").isNotNull()
    rows = rows.where(F.coalesce(usable, F.lit(False))).withColumn("same", F.sha2(F.to_json(F.struct("v")), 256))
    # Spark keeps the first k of each task before it shuffles, so a vector that fills a third of the table is no large group.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("n") <= k)
    classes = first.groupBy("same").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return rows.select("vec_id", "same"), cut(classes.withColumn("uid", F.monotonically_increasing_id()))


def build_index(classes: DataFrame, dims: int, n: int, shard: int = SHARD, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``(index, cells, centres)`` of the ``n`` classes with ``dims`` numbers: every vector is a vertex of its shard's graph.

    ``index``: ``cell, sub, node, uid, v, out``; ``cells``: ``cell, subs``, at
    most ``MOST_CELLS`` rows. Cells are those of spherical k-means over at most
    ``sample`` vectors; one with too many vectors is dealt by a hash to several shards.
    """
    spark, numbers = classes.sparkSession, classes.schema["v"].dataType.simpleString()
    own = classes.where(F.size("v") == dims).select("uid", "v")
    picked = own if n <= sample else own.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * 0.9 * sample / n))
    known = sorted(tuple(r["v"]) for r in picked.select("v").limit(sample).collect())  # bounded by ``sample``
    points = _unit(np.array(known, np.float64))
    centres = fit_cells(points[np.random.default_rng(1).permutation(len(points))], min(MOST_CELLS, -(-n // shard)))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(_matrix(batch.column(1), dims))
            home = np.concatenate([(v[lo : lo + 1024] @ shared.value.T).argmax(axis=1) for lo in range(0, len(v), 1024)]) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32))], names=["uid", "v", "cell"])

    placed = cut(own.mapInArrow(place, f"uid long, v {numbers}, cell int"))
    cells = cut(placed.groupBy("cell").agg(F.ceil(F.count("*") / (1.5 * shard)).cast("int").alias("subs")))
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("sub", F.pmod(F.xxhash64("uid"), "subs").cast("int"))  # MOST_CELLS rows at most

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        made = PrunedGraph(_matrix(table.column("v"), dims)).build()
        ends = pa.array(np.arange(len(table) + 1) * made.out.shape[1], pa.int32())
        return pa.table([table.column("cell"), table.column("sub"), pa.array(np.arange(len(table), dtype=np.int32)), table.column("uid"), table.column("v"), pa.ListArray.from_arrays(ends, pa.array(made.out.ravel().astype(np.int32)))], names=["cell", "sub", "node", "uid", "v", "out"])

    shards = dealt.select("cell", "sub", "uid", "v").groupBy("cell", "sub")
    return cut(shards.applyInArrow(graph, f"cell int, sub int, node int, uid long, v {numbers}, out array<int>")), cells, centres


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Of each query the ``k`` best classes found, ties to the smallest id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "least"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def probes(index: DataFrame, queries: DataFrame, centres: np.ndarray, dims: int, k: int, reach: float, probed: int = PROBED) -> int:
    """How many cells, from that of the nearest centre on, hold ``reach`` of the ``k`` true nearest vectors: measured on ``probed`` queries against all vectors, block by block."""
    if len(centres) == 1 or reach >= 1:
        return len(centres)
    some = queries.select("uid", "v").orderBy(F.xxhash64("uid", F.lit(5)), "uid").limit(probed).collect()
    if not some:
        return 1
    asked = np.array([r["v"] for r in some], np.float64)
    shared = index.sparkSession.sparkContext.broadcast((asked, np.array([r["uid"] for r in some])))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        best = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            uid, cell = batch.column(0).to_numpy(), np.repeat(batch.column(2).to_numpy()[None, :].astype(np.int64), len(asked), axis=0)
            score = asked @ _matrix(batch.column(1), dims).T
            score[own[:, None] == uid[None, :]] = -np.inf
            score, cell = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], cell], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, top, axis=1), np.take_along_axis(cell, top, axis=1)
        width = best[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), width)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["query", "score", "least"])

    near = _nearest(index.select("uid", "v", "cell").mapInArrow(block, "query long, score double, least long").where("score > double('-inf')"), k).collect()  # probed x k rows
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None, :], axis=1)
    ranks = np.sort([rank[r["query"], r["least"]] for r in near])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(reach * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def search_index(index: DataFrame, cells: DataFrame, centres: np.ndarray, queries: DataFrame, dims: int, k: int, beam: int = QUERY_BEAM, reach: float = REACH) -> DataFrame:
    """``query, uid, score``: of each query (``uid, v``, one row for each) the ``k`` best vectors of every shard that it searches.

    Queries go to the cells that ``probes`` tells, in blocks; a block takes a
    copy of the shard's graph. The beam works in single precision, the scores
    are those of the original numbers in double precision.
    """
    numbers = index.schema["v"].dataType.simpleString()
    wanted = probes(index, queries, centres, dims, k, reach)
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot = _matrix(batch.column(1), dims) @ shared.value.T
            near = np.argsort(-dot, axis=1, kind="stable")[:, :wanted].astype(np.int32)
            ends = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], names=["uid", "v", "cells"])

    routed = queries.select("uid", "v").mapInArrow(route, f"uid long, v {numbers}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    routed = cut(routed)
    blocks = routed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(cells, "cell")
    blocks = cut(blocks)
    asked = routed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))  # MOST_CELLS rows at most
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("cell", "sub", "block", "uid", "v")
    graphs = index.join(F.broadcast(blocks.select("cell", "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    graphs = graphs.select(F.col("cell").alias("g_cell"), F.col("sub").alias("g_sub"), F.col("block").alias("g_block"), "node", "uid", "v", "out")

    def answer(key: tuple, asked: pa.Table, graph: pa.Table) -> pa.Table:
        if not len(asked) or not len(graph):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query", "uid", "score"])
        graph = graph.sort_by("node")
        v, uid = _matrix(graph.column("v"), dims), graph.column("uid").to_numpy()
        q = _matrix(asked.column("v"), dims)
        found = PrunedGraph(v, graph.column("out").combine_chunks().flatten().to_numpy().reshape(len(uid), -1).astype(np.int64)).search(q, k, beam)
        i, j = np.nonzero(found >= 0)
        node = found[i, j]
        return pa.table([asked.column("uid").to_numpy()[i], uid[node], np.einsum("ij,ij->i", q[i], v[node])], names=["query", "uid", "score"])

    return asked.groupBy("cell", "sub", "block").cogroup(graphs.groupBy("g_cell", "g_sub", "g_block")).applyInArrow(answer, "query long, uid long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding", shard: int = SHARD, beam: int = QUERY_BEAM, reach: float = REACH) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``, among all rows but itself.

    :param vectors: ``vec_id`` and ``embedding`` (array of numbers); other columns are ignored.
    :param reach: share of true neighbours that the searched cells hold, as measured on ``PROBED`` queries; 1: all cells.
    :return: ``query_id, rank`` (from 1)``, vec_id, score``, nearest first, ties to the smaller id; all candidates where there are fewer than ``k``.

    Rows whose id is null, or whose vector is null, empty, zero or holds null or
    non-finite components, are neither queries nor candidates. Vectors of
    different lengths aren't compared. Equal vectors are one vertex of a graph
    and answer with all their rows; a row repeated is another candidate, and
    another query with the same answer. An empty table gives an empty one.
    """
    spark: SparkSession = vectors.sparkSession
    rows, classes = distinct_vectors(vectors, k + 1, key, column)
    asking = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(classes.select("same", F.col("uid").alias("query")), "same").select("vec_id", "query"))
    queries = classes.join(asking.select(F.col("query").alias("uid")).distinct(), "uid", "left_semi").select("uid", "v")
    found = None
    for r in sorted(classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()):  # one length as a rule
        index, cells, centres = build_index(classes, r["dims"], r["n"], shard)
        own = search_index(index, cells, centres, queries.where(F.size("v") == r["dims"]), r["dims"], k + 1, beam, reach)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = found.join(classes.select("uid", "ids", F.get("ids", F.lit(0)).alias("least")), "uid")
    # Of each query the k + 1 best rows, itself among them or not: one of its own rows goes.
    best = _nearest(found, k + 1).select("query", "uid", "score", F.posexplode("ids").alias("at", "vec_id"), (F.col("at") == F.array_position("ids", F.col("vec_id")) - 1).alias("first"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = best.withColumn("place", place).where(F.col("place") <= k + 1)
    # Rows of one vector ask alike; a repeated row is told apart by a number.
    asking = asking.withColumn("row", F.monotonically_increasing_id()).select(F.col("vec_id").alias("query_id"), F.col("query").alias("asked"), "row")
    all_found = asking.join(best, F.col("asked") == F.col("query")).where(~((F.col("uid") == F.col("query")) & (F.col("vec_id") == F.col("query_id")) & F.col("first")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return all_found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
