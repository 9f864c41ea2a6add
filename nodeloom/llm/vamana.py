"""A robust-pruned directed neighbour graph over unit vectors, built and searched in batches of numpy operations.

Construction inserts points in random order, in batches that double: a greedy beam search over the graph so far proposes
neighbours, relaxed distance pruning keeps an edge only if no kept edge leads much nearer to its end (factor ``alpha``),
and every kept edge is offered backwards, with the same pruning where a point has more than its share. Beam search from
the medoid answers queries. A graph should hold every vector once: callers collapse equal ones.
"""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA, BATCH = 32, 40, 1.08, 1024


class PrunedGraph:
    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1):
        """x: float32 rows of length one. degree: edges kept per point; beam: width of the searches while building."""
        self.x, self.degree, self.slots = x, degree, degree + degree // 2
        self.beam, self.relax = beam, np.float32(alpha * alpha)
        n = len(x)
        self.out = np.full((n, self.slots), -1, np.int32)
        self.deg = np.zeros(n, np.int32)
        self.start = int(np.argmax(x @ x.mean(0))) if n else -1
        self._seen: np.ndarray | None = None
        self._build(np.random.default_rng(seed))

    @classmethod
    def read(cls, x: np.ndarray, out: np.ndarray) -> PrunedGraph:
        """A graph from its stored edges, for searching."""
        g = cls.__new__(cls)
        g.x, g.out, g._seen = x, out, None
        g.start = int(np.argmax(x @ x.mean(0))) if len(x) else -1
        return g

    # -- search ----------------------------------------------------------------------------------------------------

    def search(self, q: np.ndarray, beam: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (1 - cosine), nearest first, of the ``beam`` best points met per query; -1 pads."""
        ids = np.full((len(q), beam), -1, np.int32)
        dist = np.full((len(q), beam), np.inf, np.float32)
        for a in range(0, len(q), BATCH):
            ids[a : a + BATCH], dist[a : a + BATCH] = self._search(q[a : a + BATCH], beam, width)
        return ids, dist

    def _search(self, q: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        x, n, b = self.x, len(self.x), len(q)
        if self._seen is None or len(self._seen) < b * n:
            self._seen = np.zeros(max(b, min(BATCH, n)) * n, bool)
        seen = self._seen
        seen[: b * n] = False
        fin_i = np.full((b, beam), -1, np.int32)
        fin_d = np.full((b, beam), np.inf, np.float32)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        todo = np.zeros((b, beam), bool)
        ids[:, 0], dist[:, 0], todo[:, 0] = self.start, 1 - q @ x[self.start], True
        seen[rows * n + self.start] = True
        while len(rows):
            pick = todo & (np.cumsum(todo, 1, dtype=np.int16) <= width)
            r, c = np.nonzero(pick)
            todo ^= pick
            nb = self.out[ids[r, c]]
            ok = nb >= 0
            v = nb[ok]
            rr = np.repeat(r, ok.sum(1))
            key = rows[rr] * n + v
            new = ~seen[key]
            v, rr, key = v[new], rr[new], key[new]
            seen[key] = True
            d = 1 - np.einsum("ij,ij->i", x[v], q[rows[rr]])
            # candidates beyond the beam's end can't enter it
            near = d < dist[rr, -1]
            v, rr, d = v[near], rr[near], d[near]
            if len(v):
                count = np.bincount(rr, minlength=len(rows))
                first = np.cumsum(count) - count
                most = int(count.max())
                at = np.arange(len(v)) - first[rr]
                ci = np.full((len(rows), beam + most), -1, np.int32)
                cd = np.full((len(rows), beam + most), np.inf, np.float32)
                ct = np.ones((len(rows), beam + most), bool)
                ci[:, :beam], cd[:, :beam], ct[:, :beam] = ids, dist, todo
                ci[rr, beam + at], cd[rr, beam + at] = v, d
                o = np.argsort(cd, 1)[:, : beam + 4]
                ids, dist, todo = np.take_along_axis(ci, o, 1), np.take_along_axis(cd, o, 1), np.take_along_axis(ct, o, 1)
                if width > 1:  # a point met twice in one step
                    twice = (ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)
                    if twice.any():
                        dist[:, 1:][twice] = np.inf
                        o = np.argsort(dist, 1)
                        ids, dist, todo = np.take_along_axis(ids, o, 1), np.take_along_axis(dist, o, 1), np.take_along_axis(todo, o, 1)
                ids, dist = ids[:, :beam].copy(), dist[:, :beam].copy()
                todo = todo[:, :beam] & (dist < np.inf)
            live = todo.any(1)
            if not live.all():
                done = ~live
                fin_i[rows[done]], fin_d[rows[done]] = ids[done], dist[done]
                rows, ids, dist, todo = rows[live], ids[live], dist[live], todo[live]
        fin_i[fin_d == np.inf] = -1
        return fin_i, fin_d

    # -- construction ------------------------------------------------------------------------------------------------

    def _prune(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Set the edges of ``own`` to the pruned candidates (nearest first, -1 pads)."""
        ok = (ids >= 0) & (ids != own[:, None])
        c = self.x[np.where(ids >= 0, ids, 0)]
        gap = 1 - np.matmul(c, c.transpose(0, 2, 1))
        gap *= self.relax
        keep = np.zeros(ids.shape, bool)
        left = np.full(len(own), self.degree)
        for i in range(ids.shape[1]):
            take = ok[:, i] & (left > 0)
            keep[:, i] = take
            left -= take
            ok &= ~(take[:, None] & (gap[:, i] <= dist))
            if not i % 8 and not ok[:, i + 1 :].any():
                break
        o = np.argsort(~keep, 1, kind="stable")[:, : self.degree]
        got = np.where(np.take_along_axis(keep, o, 1), np.take_along_axis(ids, o, 1), -1)
        self.out[own] = -1
        self.out[own, : got.shape[1]] = got
        self.deg[own] = keep.sum(1)

    def _offer_back(self, own: np.ndarray) -> None:
        """Offer every edge of ``own`` to the point at its end."""
        e = self.out[own]
        ok = e >= 0
        to, src = e[ok], np.repeat(own, ok.sum(1))
        o = np.argsort(to, kind="stable")
        to, src = to[o], src[o]
        known = (self.out[to] == src[:, None]).any(1)
        to, src = to[~known], src[~known]
        if not len(to):
            return
        p, first, count = np.unique(to, return_index=True, return_counts=True)
        at = np.arange(len(to)) - np.repeat(first, count)
        fits = self.deg[p] + count <= self.slots
        f = np.repeat(fits, count)
        self.out[to[f], self.deg[to[f]] + at[f]] = src[f]
        self.deg[p[fits]] += count[fits].astype(np.int32)
        over = p[~fits]
        for a in range(0, len(over), BATCH):
            q = over[a : a + BATCH]
            sel = np.isin(to, q)
            w = int(count[np.isin(p, q)].max())
            ids = np.full((len(q), self.slots + w), -1, np.int32)
            ids[:, : self.slots] = self.out[q]
            ids[np.searchsorted(q, to[sel]), self.slots + at[sel]] = src[sel]
            d = 1 - np.matmul(self.x[np.where(ids >= 0, ids, 0)], self.x[q][:, :, None])[:, :, 0]
            d[ids < 0] = np.inf
            o = np.argsort(d, 1)[:, : self.slots + self.beam]
            self._prune(q, np.take_along_axis(ids, o, 1), np.take_along_axis(d, o, 1))

    def _build(self, rng: np.random.Generator) -> None:
        n = len(self.x)
        if n < 2:
            return
        order = rng.permutation(n).astype(np.int32)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32)
        done = 1
        while done < n:
            own = order[done : done + max(1, min(done, BATCH))]
            ids, dist = self._search(self.x[own], self.beam, 2)
            self._prune(own, ids, dist)
            self._offer_back(own)
            done += len(own)
