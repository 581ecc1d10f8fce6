"""Nearest neighbours against brute force: exact rows where a shard is small, recall where it isn't."""

from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import graph, neighbours, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, cell int, sub int, query long, label int"


def usable(i, v):
    return i is not None and bool(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0


def brute(rows, every, k):
    good = [(i, np.array(v)) for i, v in rows if usable(i, v)]
    out = Counter()
    for p, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(q @ v), j) for n, (j, v) in enumerate(good) if n != p and len(v) == len(q))[:k]
            out.update((i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, **more).collect())


def recall(want, got):
    """Share of the true neighbours, by query, that are found."""
    true, mine = defaultdict(set), defaultdict(set)
    for rows, into in ((want, true), (got, mine)):
        for q, _, j, _ in rows:
            into[q].add(j)
    return sum(len(true[q] & mine[q]) for q in true) / sum(map(len, true.values()))


def test_neighbours_equal_brute_force(spark):
    """Lengths that differ, so largest products aren't smallest angles; unusable vectors; repeated rows, ids and vectors; ties."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.3, 3)).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(1000, 1100)]  # one vector, far more often than k
    rows += [(20, rows[20][1]), (20, rows[3][1]), (40, rows[40][1])]  # a repeated row, an id with another vector, a query's copy
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (480, [1.0, None]), (500, [float("inf")] * 8), (None, rows[1][1])]
    rows += [(600, [1.0, 2.0]), (601, [2.0, 1.0]), (620, [3.0])]
    for k in (5, 20):
        assert found(spark, rows, k=k, every=20) == brute(rows, 20, k)


def test_neighbours_fewer_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    assert found(spark, rows) == brute(rows, 20, 20)
    assert found(spark, [(0, [1.0])]) == Counter()
    assert found(spark, []) == Counter()
    assert found(spark, [(0, None)]) == Counter()


@pytest.mark.parametrize("shape", ["spread", "clustered", "one group"])
def test_recall_over_shards(spark, shape):
    """Several cells, some of several shards; a third of the vectors may be near copies of one."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2400, 24))
    if shape == "clustered":
        v = rng.normal(size=(40, 24))[rng.integers(0, 40, 2400)] * 2 + v
    if shape == "one group":
        v[:900] = v[0] + rng.normal(scale=0.1, size=(900, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = brute(rows, 20, 20), found(spark, rows, shard=300)
    assert recall(want, got) >= 0.95
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    by_query = defaultdict(list)
    for q, rank, j, score in sorted(got):
        by_query[q].append(score)
        assert score == round(float(v[q] @ v[j]), 9) and q != j
    assert all(x == sorted(x, reverse=True) for x in by_query.values())


def test_far_fewer_cells_are_searched_where_vectors_are_clustered(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 8 + rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    _, classes = neighbours.distinct_vectors(df, 21)
    index, cells, centres = neighbours.build_index(classes, 16, 3000, shard=100)
    assert index.count() == 3000 and len(centres) == 30
    assert neighbours.probes(index, classes.select("uid", "v"), centres, 16, 20, 0.98) <= 6
    assert neighbours.probes(index, classes.select("uid", "v"), centres, 16, 20, 1.0) == 30


def test_graph_degree_and_reach():
    v = np.random.default_rng(1).normal(size=(500, 10))
    g = graph.PrunedGraph(v).build(degree=12)
    assert g.out.shape == (500, 12) and g.out.max() < 500
    assert not (g.out == np.arange(500)[:, None]).any()
    assert all(len(set(x[x >= 0].tolist())) == (x >= 0).sum() for x in g.out)
    top = np.argsort(-(v @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(top.tolist(), g.search(v, 10).tolist())]) > 0.97


def test_query_recall_on_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in queries.op13_neighbours(spark, data).collect())
    assert recall(brute(rows, 20, 20), got) >= 0.9
