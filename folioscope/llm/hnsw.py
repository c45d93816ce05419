"""Hierarchical navigable small-world graph over vectors, for the largest inner product, in flat neighbour arrays.

Vectors get one more coordinate so that all have the same length; nearness by inner product is then nearness by
distance, for which small-world graphs navigate well. Points are inserted by falling level in batches: a batch is
searched in the graph so far and among itself, its members choose diverse neighbours, and these link back, pruned to
the same rule where full. All steps are vectorised over a batch.
"""

from __future__ import annotations

import numpy as np


def _search(vectors, links, queries, entry, width):
    """Best-first search of a layer for all queries at once: (ids, scores), each (queries, width), -1 where none."""
    q = len(queries)
    ids = np.full((q, width), -1, np.int32)
    scores = np.full((q, width), -np.inf, np.float32)
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, len(vectors)), bool)
    rows = np.arange(q)
    width0 = min(entry.shape[1], width)
    ids[:, :width0] = entry[:, :width0]
    scores[:, :width0] = np.where(ids[:, :width0] >= 0, np.einsum("qd,qed->qe", queries, vectors[ids[:, :width0]]), -np.inf)
    for e in range(width0):
        seen[rows, ids[:, e]] = True
    active = rows
    while len(active):
        at = np.where(done[active] | (ids[active] < 0), -np.inf, scores[active])
        best = at.argmax(axis=1)
        live = at[np.arange(len(active)), best] > -np.inf
        active, best = active[live], best[live]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, ids[active, best][:, None])] = True
        s = np.where(fresh, np.einsum("qd,qnd->qn", queries[active], vectors[near]), -np.inf).astype(np.float32)
        all_ids = np.concatenate((ids[active], np.where(fresh, near, -1)), axis=1)
        all_scores = np.concatenate((scores[active], s), axis=1)
        all_done = np.concatenate((done[active], np.zeros(s.shape, bool)), axis=1)
        keep = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, keep, axis=1)
        scores[active] = np.take_along_axis(all_scores, keep, axis=1)
        done[active] = np.take_along_axis(all_done, keep, axis=1)
    return ids, scores


def _diverse(vectors, ids, scores, most):
    """Of each row's candidates, best first, those nearer to the row's point than to any chosen before; filled up with the best."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
    dup = np.zeros(ids.shape, bool)
    by = np.argsort(ids, axis=1, kind="stable")
    sorted_ = np.take_along_axis(ids, by, axis=1)
    np.put_along_axis(dup, by[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
    good = (ids >= 0) & np.isfinite(scores) & ~dup
    near = vectors[np.where(ids >= 0, ids, 0)]
    cross = np.einsum("bid,bjd->bij", near, near)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        rival = np.where(chosen[:, :c], cross[:, c, :c], -np.inf).max(axis=1, initial=-np.inf) if c else np.full(len(ids), -np.inf)
        chosen[:, c] = good[:, c] & (scores[:, c] > rival) & (chosen[:, :c].sum(axis=1) < most)
    rank = np.where(chosen, 0, np.where(good, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(good, order, axis=1), np.take_along_axis(ids, order, axis=1), -1).astype(np.int32)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.layers, self.entry = layers, entry
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        # scaled so that float32 holds the squares whatever the vectors' size
        self.scale = float(np.sqrt(squares.max(initial=0.0))) or 1.0
        plain = vectors / self.scale
        self.vectors = np.concatenate((plain, np.sqrt(np.maximum(0, 1 - (plain**2).sum(axis=1)))[:, None]), axis=1).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = 16, effort: int = 64, batch: int = 256, seed: int = 0) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        graph = cls(vectors, [], int(order[0]))
        v = graph.vectors
        graph.layers = layers = [np.full((n, links * 2 if at == 0 else links), -1, np.int32) for at in range(level[order[0]] + 1)]
        at = 1
        while at < n:
            top = level[order[at]]
            size = min(batch, at)
            new = order[at : at + size]
            new = new[level[new] == top]
            at += len(new)
            entry = np.full((len(new), 1), graph.entry, np.int32)
            among = v[new] @ v[new].T
            np.fill_diagonal(among, -np.inf)
            for layer in range(len(layers) - 1, -1, -1):
                ids, scores = _search(v, layers[layer], v[new], entry, 1 if layer > top else effort)
                entry = ids
                if layer > top:
                    continue
                width = min(len(new), 32)
                own = np.argpartition(-among, width - 1, axis=1)[:, :width]
                ids = np.concatenate((ids, new[own].astype(np.int32)), axis=1)
                scores = np.concatenate((scores, np.take_along_axis(among, own, axis=1)), axis=1)
                layers[layer][new, :links] = _diverse(v, ids, scores, links)
                graph._link_back(layers[layer], new)
        return graph

    def _link_back(self, table: np.ndarray, new: np.ndarray) -> None:
        v, most = self.vectors, table.shape[1]
        from_, to = np.repeat(new, most), table[new].ravel()
        from_, to = from_[to >= 0], to[to >= 0]
        known = (table[to] == from_[:, None]).any(axis=1)
        from_, to = from_[~known], to[~known]
        if not len(to):
            return
        score = np.einsum("nd,nd->n", v[from_], v[to])
        by = np.lexsort((-score, to))
        from_, to = from_[by], to[by]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        keep = rank < most  # the nearest; those beyond could not all be chosen anyway
        from_, to, rank = from_[keep], to[keep], rank[keep]
        target, row = np.unique(to, return_inverse=True)
        extra = np.full((len(target), int(rank.max()) + 1), -1, np.int32)
        extra[row, rank] = from_
        for low in range(0, len(target), 1024):
            t = target[low : low + 1024]
            ids = np.concatenate((table[t], extra[low : low + 1024]), axis=1)
            fits = (ids >= 0).sum(axis=1) <= most
            packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)[:, :most]
            table[t[fits]] = packed[fits]
            if not fits.all():
                t, ids = t[~fits], ids[~fits]
                scores = np.where(ids >= 0, np.einsum("td,tnd->tn", v[t], v[np.where(ids >= 0, ids, 0)]), -np.inf)
                table[t] = _diverse(v, ids, scores, most)

    def search(self, queries: np.ndarray, effort: int) -> np.ndarray:
        """Ids of about the ``effort`` nearest points of each query, -1 where there are fewer."""
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        q = np.concatenate((queries / np.where(norms > 0, norms, 1), np.zeros((len(queries), 1))), axis=1).astype(np.float32)
        entry = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry, _ = _search(self.vectors, self.layers[layer], q, entry, 1)
        return _search(self.vectors, self.layers[0], q, entry, min(effort, len(self.vectors)))[0]
