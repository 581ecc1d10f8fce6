"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one vector kept of each group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Vectors for each cell, about.
CELL = 400
#: Most cells; beyond it cells grow and are dealt out in more blocks.
MOST_CELLS = 8192
#: Vectors that k-means and the margin are fitted to, at most; picked by a hash of their content.
SAMPLE = 20_000
#: Independent sets of cells. A pair is missed only if it meets in none of them.
TABLES = 2
#: Of pairs right at the threshold, the share that must meet; 1: all, by the exact margin.
RECALL = 0.999
#: Home vectors and compared vectors of a block.
BLOCK = 2048


def fit_cells(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means over unit vectors; fewer than ``k`` if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        dead = size < 1e-12
        centres = np.where(dead[:, None], sample[rng.choice(len(sample), k)], sums / np.where(dead, 1, size)[:, None])
    return centres


def margin(threshold: float) -> float:
    """How far from the border of a cell a vector can have a partner across it: ``sin(acos(threshold))``.

    Borders are planes through the origin. A partner across one is within
    ``acos(threshold)``, so no vector further off than that has one there,
    however the vectors spread.
    """
    return math.sqrt(1 - threshold * threshold) if threshold > 0 else 1.0


def _gap(a: np.ndarray, b: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each pair: by how much one's cosine with its own centre exceeds that with the other's, the lesser way round."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 1024):
        da, db = a[lo : lo + 1024] @ centres.T, b[lo : lo + 1024] @ centres.T
        row, ha, hb = np.arange(len(da)), da.argmax(axis=1), db.argmax(axis=1)
        out[lo : lo + 1024] = np.minimum(db[row, hb] - db[row, ha], da[row, ha] - da[row, hb])
    return out


def slack(points: np.ndarray, tables: list[np.ndarray], threshold: float, recall: float, pairs: int = 40_000, seed: int = 3) -> float:
    """Difference of cosines up to which a vector is a guest in another cell, so that ``recall`` of pairs at the threshold meet.

    It is measured on pairs whose displacement points from one of the sampled
    vectors to another, so it follows the directions in which the vectors
    really spread, and on links within the sample. A tenth is added.
    """
    if recall >= 1 or len(points) < 3:
        return math.inf
    rng = np.random.default_rng(seed)
    x, p, q = (points[rng.integers(0, len(points), pairs)] for _ in range(3))
    z = p - q
    z -= (z * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(z, axis=1)
    x, z = x[size > 1e-6], z[size > 1e-6] / size[size > 1e-6, None]
    y = threshold * x + math.sqrt(1 - threshold * threshold) * z
    some = points[:2000]
    i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    keep = rng.permutation(len(i))[:pairs]
    found = 0.0
    for a, b in ((x, y), (some[i[keep]], some[j[keep]])):
        if len(a):
            found = max(found, float(np.quantile(np.min([_gap(a, b, c) for c in tables], axis=0), recall)))
    return 1.1 * found


class _Members:
    """Rows of a block: unit vectors, ids, weights, cells (padded by -1, those of all tables) and which of them are home."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.weight = pdf["uid"].to_numpy(), pdf["copies"].to_numpy()
        v = np.stack(pdf["v"].to_list()).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        self.v = v / np.linalg.norm(v, axis=1, keepdims=True)
        lists = pdf["cells"].to_list()
        width = max(len(x) for x in lists)
        self.cells = np.array([np.concatenate([x, np.full(width - len(x), -1)]) for x in lists], np.int64)
        self.homes = np.stack(pdf["homes"].to_list()).astype(np.int64)

    def of(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cells[i], self.homes[i]


def _first_meeting(a: _Members, i: np.ndarray, b: _Members, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether no cell before ``cell`` holds both of each pair, as home of at least one."""
    out = np.ones(len(i), bool)
    for lo in range(0, len(i), 4096):
        (ca, ha), (cb, hb) = a.of(i[lo : lo + 4096]), b.of(j[lo : lo + 4096])
        both = (ca >= 0) & (ca < cell) & (ca[:, :, None] == cb[:, None, :]).any(axis=2)
        home = (ca[:, :, None] == ha[:, None, :]).any(axis=2) | (ca[:, :, None] == hb[:, None, :]).any(axis=2)
        out[lo : lo + 4096] = ~(both & home).any(axis=1)
    return out


def _links(home: _Members, other: _Members, guest: np.ndarray, cell: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight linked to each home vector and to each guest among the others; edges that connect what the block links, a forest rather than all pairs."""
    linked, back, ends = np.zeros(len(home.ids), np.int64), np.zeros(len(other.ids), np.int64), []
    ids, where = np.unique(np.concatenate([home.ids, other.ids]), return_inverse=True)
    mine, theirs = where[: len(home.ids)], where[len(home.ids) :]
    label = np.arange(len(ids))  # of each vector here, its component so far
    for lo in range(0, len(home.ids), 256):
        hit = home.v[lo : lo + 256] @ other.v.T >= threshold
        hit &= mine[lo : lo + 256, None] != theirs[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        first = _first_meeting(home, i + lo, other, j, cell)
        i, j = i[first] + lo, j[first]
        np.add.at(linked, i, other.weight[j])
        across = guest[j]
        np.add.at(back, j[across], home.weight[i[across]])
        for x, y in zip(mine[i].tolist(), theirs[j].tolist()) if len(i) < 64 else _spanning(mine[i], theirs[j], label):
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                ends.append((ids[x], ids[y]))
    a, b = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
    return linked, back, a, b


def _spanning(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs enough to connect what all of them do: of each vector one for every component that it reaches."""
    key = x.astype(np.int64) * len(label) + label[y]
    _, one = np.unique(key, return_index=True)
    apart = one[label[x[one]] != label[y[one]]]
    return zip(x[apart].tolist(), y[apart].tolist())


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, cell: int = CELL, sample: int = SAMPLE, tables: int = TABLES, recall: float = RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Links at a cosine of ``threshold`` or more, in double precision, whatever other columns say.

    :param vectors: ``vec_id`` and ``embedding`` (array of numbers); other columns are ignored.
    :param recall: share of pairs right at the threshold that are compared (nearer ones are missed less often);
        1: all of them, by the exact margin, which in many dimensions comes near to comparing all with all.
    :return: ``vec_id, n_links, component_id, kept``, one row for each input row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: 0 links, a component of their own, kept. Vectors of
    different lengths link with nothing of another length. Equal vectors are
    compared once and counted as often as they are there, so a repeated row is
    another vector linked with the first; different vectors that share a
    ``vec_id`` are vectors of their own. A null ``vec_id`` has a null component
    and isn't kept. An empty table gives an empty one.

    Cells come from k-means over at most ``sample`` vectors, ``tables`` times
    from different starts. In each, a vector lies in its own cell, its home,
    and is a guest in those whose centre is nearly as close (see ``slack``,
    never further than ``margin`` allows a partner). Two vectors meet in a cell
    that is home to one of them; what they are to each other is counted in the
    first such cell. A cell is dealt out in blocks of home and compared
    vectors; what leaves a block is a count for each vector and a forest of
    edges.
    """
    spark = vectors.sparkSession
    numbers = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(numbers).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    fit = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (size > 0) & (size < float("inf"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull())
    good = rows.where("fit").select("vec_id", "v", F.sha2(F.to_json(F.struct("v")), 256).alias("same"))
    classes = good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # A class is known by a number from here on; it is written, so the number stays.
    classes = cut(classes.withColumn("uid", F.monotonically_increasing_id()))
    named = classes.select(F.col("same").alias("__same"), "rep", "copies", "uid").hint("shuffle_hash")
    units = cut(good.join(named, (F.col("vec_id") == F.col("rep")) & (F.col("same") == F.col("__same"))).select("uid", "copies", "v").dropDuplicates(["uid"]))
    shapes = {r["d"]: r["n"] for r in units.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    links = None
    for dims, n in sorted(shapes.items()):  # one length as a rule
        own = _compare(spark, units.where(F.size("v") == dims), numbers, dims, n, threshold, cell, sample, tables, recall)
        links = own if links is None else links.unionByName(own)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    links = cut(links)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    parts = cut(connected_components(links.where("b IS NOT NULL")))
    heads = parts.join(classes.select("uid", "rep"), F.col("id") == F.col("uid")).groupBy("component").agg(F.min("rep").alias("head")).withColumnRenamed("component", "c")
    reach = parts.join(heads, F.col("component") == F.col("c")).select("id", "head")
    classed = classes.join(counts, F.col("uid") == F.col("of"), "left").join(reach, F.col("uid") == F.col("id"), "left")
    classed = classed.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "rep").alias("component_id"))
    done = good.select("vec_id", "same").join(classed, "same", "left").select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _compare(spark: SparkSession, units: DataFrame, numbers: str, dims: int, n: int, threshold: float, cell: int, sample: int, tables: int, recall: float) -> DataFrame:
    """``(a, b, n)``: rows without ``b`` count what is linked to ``a``; the others are edges."""
    picked = units
    if n > sample:
        picked = units.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * 0.9 * sample / n))
    known = sorted(tuple(r["v"]) for r in picked.select("v").limit(sample).collect())  # bounded by ``sample``
    points = np.array(known, np.float64)
    points /= np.abs(points).max(axis=1, keepdims=True)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = points[np.random.default_rng(1).permutation(len(points))]
    k = min(MOST_CELLS, -(-n // cell))
    made = [fit_cells(points, k, seed=7 + t) for t in range(tables if k > 1 and recall < 1 else 1)]
    within, near = slack(points, made, threshold, recall) if k > 1 else math.inf, margin(threshold)
    shared = spark.sparkContext.broadcast(made)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for lo in range(0, len(raw), 1024):
                part = raw[lo : lo + 1024].astype(np.float64)
                part /= np.abs(part).max(axis=1, keepdims=True)
                part /= np.linalg.norm(part, axis=1, keepdims=True)
                own, at, base, homes = [], [], 0, []
                for c in shared.value:
                    dot = part @ c.T
                    home = dot.argmax(axis=1)
                    gap = dot.max(axis=1, keepdims=True) - dot
                    i, j = np.nonzero(gap <= within)
                    # A partner lies no further across the border than the margin.
                    reached = (gap[i, j] <= near * np.linalg.norm(c[home[i]] - c[j], axis=1) + 1e-12) | (j == home[i])
                    own.append(i[reached]), at.append(j[reached] + base), homes.append(home + base)
                    base += len(c)
                i, j, h = np.concatenate(own), np.concatenate(at), np.stack(homes, axis=1)
                order = np.lexsort((j, i))
                i, j = i[order], j[order]
                ends = np.searchsorted(i, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(j, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, len(part)) for k in range(3)), lists, pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel(), pa.int32()))], names=["uid", "copies", "v", "cells", "homes"]
                )

    placed = cut(units.select("uid", "copies", "v").mapInArrow(assign, f"uid long, copies long, v {numbers}, cells array<int>, homes array<int>"))
    dealt = placed.withColumn("cell", F.explode("cells")).withColumn("home", F.array_contains("homes", F.col("cell")))
    sizes = dealt.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("homes_in"), F.count("*").alias("members"))
    sizes = cut(sizes.where("homes_in > 0 AND members > 1").select(F.col("cell").alias("of"), F.ceil(F.col("homes_in") / BLOCK).alias("hb"), F.ceil(F.col("members") / BLOCK).alias("mb")))
    spread = dealt.join(F.broadcast(sizes), F.col("cell") == F.col("of"))  # at most TABLES * MOST_CELLS rows
    spot = F.xxhash64("uid", F.lit(11))
    columns = ["uid", "copies", "v", "cells", "homes"]
    homes = spread.where("home").select("cell", F.pmod(spot, "hb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), F.lit(0).alias("role"), *columns)
    others = spread.select("cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), F.pmod(spot, "mb").alias("j"), F.when(F.col("home"), 1).otherwise(2).alias("role"), *columns)

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine, rest = pdf[pdf["role"] == 0], pdf[pdf["role"] > 0]
        if not len(mine) or not len(rest):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        linked, back, a, b = _links(_Members(mine), _Members(rest), rest["role"].to_numpy() == 2, int(key[0]), threshold)
        ids, counts = np.concatenate([mine["uid"].to_numpy(), rest["uid"].to_numpy()]), np.concatenate([linked, back])
        some = counts > 0
        found = pd.DataFrame({"a": ids[some], "b": pd.array([pd.NA] * int(some.sum()), "Int64"), "n": counts[some]})
        return pd.concat([found, pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": np.zeros(len(a), np.int64)})])

    return homes.unionByName(others).groupBy("cell", "i", "j").applyInPandas(block, "a long, b long, n long")
