"""A robust-pruned directed graph over the vectors of one shard, and beam search in it, for many vectors at once."""

from __future__ import annotations

import numpy as np

#: Edges that leave a vector, at most.
DEGREE = 32
#: Relaxation of the pruning rule in the second pass: a candidate goes if a kept neighbour is this much nearer to it than the vector is.
RELAXED = 1.2
#: Width of the beam while the graph is built and when it is queried.
BUILD_BEAM, QUERY_BEAM = 64, 128
#: Vertices at which every search starts: far from each other, so that a dense group can't hold a search back.
STARTS = 32
#: Vectors that are searched for side by side, and vertices of a beam that are expanded at once.
TOGETHER, EXPANDED = 256, 4


class PrunedGraph:
    """Vectors as points whose squared distance to a query falls as their inner product with it grows.

    A coordinate is added to each vector, so that all have the largest one's
    length; a query's is 0.
    """

    def __init__(self, vectors: np.ndarray, out: np.ndarray | None = None):
        length = np.einsum("ij,ij->i", vectors, vectors)
        more = np.sqrt(np.maximum(0.0, (length.max() if len(length) else 0.0) - length))
        self.points = np.concatenate([vectors, more[:, None]], axis=1).astype(np.float32)
        self.out, self.starts = out, self._far_apart(STARTS)

    def _far_apart(self, k: int) -> np.ndarray:
        """The vertex nearest to the mean, then again and again that furthest from those taken."""
        points, taken = self.points, []
        away = np.full(len(points), np.inf)
        at = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if len(points) else 0
        while len(taken) < min(k, len(points)):
            taken.append(at)
            away = np.minimum(away, ((points - points[at]) ** 2).sum(axis=1))
            at = int(away.argmax())
        return np.unique(np.array(taken, np.int64))

    def beam(self, queries: np.ndarray, width: int, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy search from the starts: of each query the nearest vertices found (padded by -1) and their distances less the query's square, nearest first; and the vertices that were expanded.

        A step expands the nearest vertices of every beam that haven't been, and
        keeps the ``width`` nearest of beam and neighbours; it ends when no beam
        has one left.
        """
        out = self.out if out is None else out
        points, n, rows = self.points, len(self.points), np.arange(len(queries))[:, None]
        square = np.einsum("ij,ij->i", points, points)
        near = square[self.starts] - 2 * queries @ points[self.starts].T
        order = np.argsort(near, axis=1, kind="stable")[:, :width]
        ids, near = self.starts[order], near[rows, order]
        todo, seen, expanded = np.ones(ids.shape, bool), np.zeros((len(queries), n + 1), bool), []
        seen[:, n] = True
        seen[:, self.starts] = True
        while todo.any():
            at = np.argsort(~todo, axis=1, kind="stable")[:, :EXPANDED]  # beams are sorted, so these are the nearest
            go = todo[rows, at]
            chosen = np.where(go, ids[rows, at], n)
            todo[rows, at] = False
            expanded.append(chosen)
            found = np.where(chosen[:, :, None] < n, out[np.minimum(chosen, n - 1)], n).reshape(len(queries), -1)
            found = np.sort(np.where(found < 0, n, found), axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = n
            found[seen[rows, found]] = n
            seen[rows, found] = True
            take = np.sort(found, axis=1)[:, : max(1, int((found < n).sum(axis=1).max()))]
            safe = np.minimum(take, n - 1)
            dist = square[safe] - 2 * np.matmul(points[safe], queries[:, :, None])[:, :, 0]
            dist[take == n] = np.inf
            all_ids, all_near = np.concatenate([ids, take], axis=1), np.concatenate([near, dist], axis=1)
            all_todo = np.concatenate([todo, take < n], axis=1)
            order = np.argsort(all_near, axis=1, kind="stable")[:, :width]
            ids, near, todo = all_ids[rows, order], all_near[rows, order], all_todo[rows, order]
        return np.where(ids < n, ids, -1), near, np.concatenate(expanded, axis=1) if expanded else np.zeros((len(queries), 0), np.int64)

    def prune(self, of: np.ndarray, candidates: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
        """Neighbours of each vertex among its candidates (``len(points)`` pads them): the nearest one is kept, those go that are nearer to it, by the relaxed measure, than to the vertex; again until ``degree`` are kept. Padded by -1."""
        points, n = self.points, len(self.points)
        candidates = np.sort(np.where(candidates == of[:, None], n, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
        real = candidates < n
        own = points[np.minimum(candidates, n - 1)]
        dist = ((own - points[of][:, None, :]) ** 2).sum(axis=2)
        dist[~real] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, : max(1, int(real.sum(axis=1).max(initial=0)))]
        rows = np.arange(len(of))[:, None]
        candidates, dist, own = candidates[rows, order], dist[rows, order], own[rows, order]
        square = (own**2).sum(axis=2)
        apart = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
        alive, kept = np.isfinite(dist), np.full((len(of), degree), -1, np.int64)
        row = np.arange(len(of))
        for k in range(degree):
            first = alive.argmax(axis=1)
            some = alive[row, first]
            if not some.any():
                break
            kept[some, k] = candidates[row, first][some]
            alive &= relaxed * relaxed * apart[row, first] > dist
            alive[row, first] = False
        return kept

    def build(self, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> PrunedGraph:
        """Edges by two passes over the vectors in an order shuffled by ``seed``, the first one without relaxation."""
        n, points = len(self.points), self.points
        rng = np.random.default_rng(seed)
        out = rng.integers(0, max(1, n), (n, degree))
        out[out == np.arange(n)[:, None]] = -1
        for relaxed in (1.0, RELAXED):
            order = rng.permutation(n)
            for lo in range(0, n, TOGETHER):
                of = order[lo : lo + TOGETHER]
                near, _, expanded = self.beam(points[of], beam, out)
                candidates = np.concatenate([np.where(near < 0, n, near), expanded, np.where(out[of] < 0, n, out[of])], axis=1)
                out[of] = self.prune(of, candidates, relaxed, degree)
                self._back(of, out, relaxed, degree)
        self.out = out
        return self

    def _back(self, of: np.ndarray, out: np.ndarray, relaxed: float, degree: int) -> None:
        """Edges back from the new neighbours; vertices with too many are pruned again."""
        i, k = np.nonzero(out[of] >= 0)
        source, target = of[i], out[of][i, k]
        there = (out[target] == source[:, None]).any(axis=1)
        source, target = source[~there], target[~there]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, start, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(ends), TOGETHER):
            own, first, many = ends[lo : lo + TOGETHER], start[lo : lo + TOGETHER], count[lo : lo + TOGETHER]
            new = np.full((len(own), int(many.max())), len(self.points), np.int64)
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            new[np.repeat(np.arange(len(own)), many), at] = source[np.repeat(first, many) + at]
            has = (out[own] >= 0).sum(axis=1)
            room = has + many <= degree
            for r in np.flatnonzero(room).tolist():
                out[own[r], np.flatnonzero(out[own[r]] < 0)[: many[r]]] = new[r, : many[r]]
            if (~room).any():
                tight = own[~room]
                out[tight] = self.prune(tight, np.concatenate([np.where(out[tight] < 0, len(self.points), out[tight]), new[~room]], axis=1), relaxed, degree)

    def search(self, queries: np.ndarray, k: int, beam: int = QUERY_BEAM) -> np.ndarray:
        """The ``k`` vertices of largest inner product that a beam finds for each query, padded by -1."""
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        found = [self.beam(flat[lo : lo + TOGETHER], max(beam, k))[0][:, :k] for lo in range(0, len(flat), TOGETHER)]
        return np.concatenate(found) if found else np.zeros((0, k), np.int64)
