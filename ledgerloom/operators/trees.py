"""Trees grown level by level from sums over binned features: boosting under the pinball loss, and forests that know which rows each tree left out.

Features are binned once and stored with the rows, a byte for each. A job sums
targets by (tree, node, feature, bin) for all trees of a round, whatever fold or
quantile they serve, and the driver picks the splits: what it gets has a fixed
size. Nothing of a row's earlier rounds is done again, as its margins are a
column that is written down every few rounds.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import forget, work_folder

#: Bins of a feature beside the one for nulls, which is the first.
BINS = 63
#: Boosting rounds after which margins are written down.
WRITTEN_EVERY = 10
#: Rows for each partition of the binned table, about.
ROWS = 200_000
#: Partial sums that the driver adds up itself, at most; more are added up by a shuffle first.
GATHERED = 2_000_000
_BATCH = 8192


@dataclasses.dataclass
class Trees:
    """Trees of one depth side by side. A node's row goes right if its ``feature`` has a bin above ``bin``; a node without a split (feature -1) sends all left."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    bin: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    @classmethod
    def blank(cls, trees: int, depth: int) -> Trees:
        return cls(np.full((trees, 2**depth - 1), -1, np.int64), np.zeros((trees, 2**depth - 1), np.int64), np.zeros((trees, 2**depth)))

    def node(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Of each row and tree, the node of that level, counted from its first."""
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        feature, bound = np.maximum(self.feature, 0), np.where(self.feature < 0, 255, self.bin)  # no bin lies above 255
        out = np.zeros((len(self.feature), len(x)), np.int64)
        for t, at in enumerate(out):  # a tree's columns stay in the cache
            for _ in range(levels):
                right = flat.take(first + feature[t].take(at)) > bound[t].take(at)
                at *= 2
                at += 1 + right
        return out.T - (2**levels - 1)

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees)."""
        return self.value[np.arange(len(self.feature))[None, :], self.node(x, self.depth)]


def bin_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> np.ndarray:
    """Upper bounds of the bins (features, bins - 1): quantiles of each feature."""
    steps = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    got = rows.agg(*[F.percentile_approx(n, steps, F.lit(10_000)).alias(n) for n in names]).first()
    return np.array([got[n] if got[n] is not None else [0.0] * (bins - 1) for n in names], float)


def with_bins(rows: DataFrame, names: list[str], edges: np.ndarray, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``x``, a byte for each feature: 0 for null, else one more than the bounds below the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(names)), np.uint8)
            for k, n in enumerate(names):
                v = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float)
                x[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(edges[k], v, side="left"))
            flat = x.tobytes()
            cells = pa.array([flat[i * len(names) : (i + 1) * len(names)] for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), cells], names=[*kept, "x"])

    types = dict(rows.dtypes)
    return rows.select(*kept, *[F.col(n).cast("double").alias(n) for n in names if n not in kept]).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", x binary")


def _bytes(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


Work = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]


def level_sums(table: DataFrame, trees: Trees, level: int, features: int, work: Work, parts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted targets by (tree, node, feature, bin) of a level. ``work`` tells a batch's weights and targets, (rows, trees) each.

    ``parts``: partitions of the table, if known. Where their sums are ``GATHERED`` numbers at most, no shuffle adds them up.
    """
    bins, m, nodes = BINS + 1, len(trees.feature), 2**level
    shape = (m, nodes, features, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, g = np.zeros((m, features, nodes * bins)), np.zeros((m, features, nodes * bins))
        for whole in batches:
            for lo in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(lo, _BATCH)
                x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
                weight, target = work(batch, x)
                base, by_feature = trees.node(x, level) * bins, np.ascontiguousarray(x.T)
                for t in range(m):
                    some = weight[:, t] > 0
                    w, wt, b = weight[some, t], weight[some, t] * target[some, t], base[some, t]
                    for f in range(features):
                        cell = b + by_feature[f][some]
                        n[t, f] += np.bincount(cell, w, nodes * bins)
                        g[t, f] += np.bincount(cell, wt, nodes * bins)
        n, g = (a.reshape(m, features, nodes, bins).transpose(0, 2, 1, 3).ravel() for a in (n, g))
        some = np.flatnonzero(n)
        for lo in range(0, len(some), 100_000):
            part = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part]), pa.array(g[part])], names=["cell", "n", "g"])

    partial, size = table.mapInArrow(run, "cell long, n double, g double"), int(np.prod(shape))
    if parts is None or parts * size > GATHERED:
        partial = partial.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    # As many rows as trees, nodes, features and bins make, however many rows there are.
    got = partial.toArrow()
    cell = got.column("cell").to_numpy()
    out = [np.bincount(cell, got.column(c).to_numpy(), size) for c in ("n", "g")]
    return out[0].reshape(shape), out[1].reshape(shape)


def split(trees: Trees, level: int, n: np.ndarray, g: np.ndarray, least: float, share: float = 1.0, seed: int = 0) -> None:
    """Sets the splits of a level to those that lower the squared error most, with ``least`` weight on each side; each node looks at a ``share`` of the features. Values of the nodes below are set to the means."""
    m, nodes, features, _ = n.shape
    looked = np.ones((m, nodes, features), bool)
    if share < 1:
        draw = np.random.default_rng((seed, level)).random((m, nodes, features))
        looked = draw <= np.sort(draw, axis=2)[:, :, [max(0, int(np.ceil(share * features)) - 1)]]
    for t in range(m):
        left_n, left_g = n[t].cumsum(axis=2)[:, :, :-1], g[t].cumsum(axis=2)[:, :, :-1]
        all_n, all_g = n[t].sum(axis=2)[:, :, None], g[t].sum(axis=2)[:, :, None]
        right_n, right_g = all_n - left_n, all_g - left_g
        fit = (left_n >= least) & (right_n >= least) & looked[t][:, :, None]
        gain = np.where(fit, left_g**2 / np.maximum(left_n, 1e-12) + right_g**2 / np.maximum(right_n, 1e-12) - all_g**2 / np.maximum(all_n, 1e-12), -np.inf)
        best = gain.reshape(nodes, -1).argmax(axis=1)
        f, b = np.unravel_index(best, gain.shape[1:])
        at = np.arange(nodes)
        good = gain[at, f, b] > 1e-12 * np.maximum(1.0, np.abs(all_g[:, 0, 0]))
        first = 2**level - 1
        trees.feature[t, first : first + nodes] = np.where(good, f, -1)
        trees.bin[t, first : first + nodes] = b
        if 2 * nodes == trees.value.shape[1]:
            total_n, total_g = all_n[:, 0, 0], all_g[:, 0, 0]
            ln, lg = np.where(good, left_n[at, f, b], total_n), np.where(good, left_g[at, f, b], total_g)
            rn, rg = total_n - ln, total_g - lg
            trees.value[t, 0::2] = lg / np.maximum(ln, 1e-12)
            trees.value[t, 1::2] = np.where(rn > 1e-9, rg / np.maximum(rn, 1e-12), 0.0)


def stored(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows`` as a table in the shared folder, in partitions of about ``ROWS`` rows if their number is told."""
    path = work_folder(rows.sparkSession)
    (rows if n is None else rows.repartition(max(1, -(-n // ROWS)))).write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.written_to = path
    return out


def boost(table: DataFrame, features: int, weight_bits: list[int], quantiles: list[float], rounds: int, rate: float, depth: int, least: float) -> tuple[np.ndarray, list[Trees]]:
    """Model ``k`` of boosting under the pinball loss of ``quantiles[k]``, over rows whose ``fits`` has bit ``weight_bits[k]``: its start, and each round's trees.

    :param table: ``x, label, fits``, stored.

    A model starts at the quantile of its labels. In each round a tree is fitted
    to the sign by which rows lie above or below their margins, and each leaf
    moves by ``rate`` times the quantile of the residuals in it. All models' trees of a round
    are grown by the same jobs; margins are written down every ``WRITTEN_EVERY`` rounds.
    """
    q, bit = np.array(quantiles), np.array(weight_bits)
    inside = [F.percentile_approx(F.when(F.col("fits").bitwiseAND(F.lit(1).cast("long") * (1 << int(b))) != 0, F.col("label")), F.lit(float(p)), F.lit(10_000)) for p, b in zip(q, bit)]
    got = table.agg(*[c.alias(f"q{k}") for k, c in enumerate(inside)]).first()
    start = np.array([0.0 if x is None else x for x in got], float)
    made: list[Trees] = []
    recent: list[Trees] = []
    models, parts = len(q), table.rdd.getNumPartitions()
    table = table.select("x", "label", "fits", F.lit(start.tobytes()).alias("margins"))

    def margins(batch: pa.RecordBatch, x: np.ndarray, since: list[Trees]) -> np.ndarray:
        out = _bytes(batch.column(batch.schema.get_field_index("margins")), models, np.float64).copy()
        for t in since:
            out += t.predict(x)
        return out

    def weights(batch: pa.RecordBatch) -> np.ndarray:
        fits = batch.column(batch.schema.get_field_index("fits")).to_numpy(zero_copy_only=False)
        return (fits[:, None] >> bit[None, :] & 1).astype(float)

    for k in range(rounds):
        since = tuple(recent)

        def signs(batch: pa.RecordBatch, x: np.ndarray, since=since) -> tuple[np.ndarray, np.ndarray]:
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            return weights(batch), np.where(label[:, None] > margins(batch, x, since), q[None, :], q[None, :] - 1)

        trees = Trees.blank(models, depth)
        for level in range(depth):
            split(trees, level, *level_sums(table, trees, level, features, signs, parts), least)

        def residuals(batches: Iterator[pa.RecordBatch], since=since, trees=trees) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
                label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
                i, m = np.nonzero(weights(batch) > 0)
                cell = trees.node(x, depth)[i, m] + m * 2**depth
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((label[:, None] - margins(batch, x, since))[i, m])], names=["cell", "r"])

        levels = sorted(set(q.tolist()))
        leaves = table.mapInArrow(residuals, "cell long, r double").groupBy("cell").agg(F.percentile_approx("r", F.array(*[F.lit(p) for p in levels]), F.lit(2_000)).alias("at")).collect()  # a row for each leaf
        trees.value[:] = 0
        for r in leaves:
            model, leaf = divmod(r["cell"], 2**depth)
            trees.value[model, leaf] = rate * r["at"][levels.index(float(q[model]))]
        made.append(trees)
        recent.append(trees)
        if len(recent) == WRITTEN_EVERY and k + 1 < rounds:
            done = tuple(recent)

            def move(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
                    now, size = margins(batch, x, done).tobytes(), 8 * models
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([now[i * size : (i + 1) * size] for i in range(len(x))], pa.binary())], names=["x", "label", "fits", "margins"])

            before, table, recent = table, stored(table.mapInArrow(move, table.schema)), []
            parts = table.rdd.getNumPartitions()
            forget(before)  # not the caller's, which the first round reads
    forget(table)
    return start, made


def bootstrap_weights(rid: np.ndarray, trees: np.ndarray, seed: int = 17) -> np.ndarray:
    """How often each tree draws each row: Poisson numbers of mean 1 from a hash of row and tree, the same wherever they are asked for."""
    z = rid.astype(np.uint64)[:, None] + (trees.astype(np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(steps, u, side="right").astype(float)


def grow_forest(table: DataFrame, features: int, bits: list[int], trees: int, depth: int, least: float, share: float = 1 / 3, seed: int = 17) -> Trees:
    """``trees`` trees for each of ``bits``, in a row, over rows whose ``fits`` has the bit, each on its own bootstrap draw; ``table``: ``rid, x, label, fits``, stored."""
    bit, number = np.repeat(bits, trees), np.arange(trees * len(bits))

    def drawn(batch: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        inside = col("fits")[:, None] >> bit[None, :] & 1
        return inside * bootstrap_weights(col("rid"), number, seed), np.broadcast_to(col("label")[:, None], inside.shape)

    out = Trees.blank(len(number), depth)
    for level in range(depth):
        split(out, level, *level_sums(table, out, level, features, drawn), least, share, seed)
    return out


def out_of_bag(table: DataFrame, forest: Trees, features: int, bits: list[int], seed: int = 17) -> DataFrame:
    """``rid, part, e, votes``: residual of each training row of fold ``part`` from the mean of the trees that didn't draw it; rows that all trees drew have none."""
    each, number = len(forest.feature) // len(bits), np.arange(len(forest.feature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(lo, _BATCH)
                col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
                free = bootstrap_weights(col("rid"), number, seed) == 0
                value, votes = (np.where(free, forest.predict(x), 0).reshape(len(x), len(bits), each).sum(axis=2), free.reshape(len(x), len(bits), each).sum(axis=2))
                i, part = np.nonzero((col("fits")[:, None] >> np.array(bits)[None, :] & 1 > 0) & (votes > 0))
                yield pa.RecordBatch.from_arrays([pa.array(col("rid")[i]), pa.array(part.astype(np.int32)), pa.array(col("label")[i] - value[i, part] / votes[i, part]), pa.array(votes[i, part])], names=["rid", "part", "e", "votes"])

    return table.mapInArrow(run, "rid long, part int, e double, votes long")


def leaf_quantiles(table: DataFrame, forest: Trees, features: int, bits: list[int], steps: list[float]) -> DataFrame:
    """``cell, at``: of each tree and leaf (tree times the number of leaves, plus leaf) the quantiles of all the labels of its fold that fall into it."""
    bit, leaves = np.repeat(bits, len(forest.feature) // len(bits)), forest.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(lo, _BATCH)
                x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
                fits, label = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fits", "label"))
                i, t = np.nonzero(fits[:, None] >> bit[None, :] & 1)
                yield pa.RecordBatch.from_arrays([pa.array(forest.node(x, forest.depth)[i, t] + t * leaves), pa.array(label[i])], names=["cell", "y"])

    rows = table.mapInArrow(run, "cell long, y double")
    return rows.groupBy("cell").agg(F.percentile_approx("y", F.array(*[F.lit(s) for s in steps]), F.lit(1000)).alias("at"))


def scored(rows: DataFrame, features: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: list[str], part: str = "part") -> DataFrame:
    """``rows`` (with ``x``) without ``x`` and with a column for each of ``columns``: ``add(x, part)`` gives them, (rows, columns)."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bytes(batch.column(batch.schema.get_field_index("x")), features).astype(np.int64)
            which = batch.column(batch.schema.get_field_index(part)).to_numpy(zero_copy_only=False)
            got = np.concatenate([add(x[lo : lo + _BATCH], which[lo : lo + _BATCH]) for lo in range(0, len(x), _BATCH)]) if len(x) else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(got[:, k]) for k in range(len(columns)))], names=[*kept, *columns])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + "".join(f", {c} double" for c in columns))
