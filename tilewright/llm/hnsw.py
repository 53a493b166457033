"""A hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays.

Nodes are inserted in the order of a hash of their keys, a batch at a time: the batch searches
the graph of the nodes before it with a beam, compares its own members with each other, and is
then linked: each node to the nearest it found (its forward links, which stay), and back from
those to it (of the back links of a node the nearest stay, and always that of a node which has
no nearer one). Each layer above holds one in `RATIO` nodes of the layer below. What the
insertion found is kept: every pair of near nodes is seen when the later of the two comes in.
Searches run for many queries at a time; a step widens the beams of all of them.
"""

from __future__ import annotations

import numpy as np

#: Nodes of a layer for each node of the next.
RATIO = 16
#: A layer of at most so many nodes is compared whole: that finds what a descent looks for.
SCANNED = 1024
#: Queries whose beams are widened at once.
ROWS = 512
#: Pairs of vectors whose products are taken at once.
CHUNK = 1024

NONE = np.float32(-2)


def best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in falling order."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


class _Layer:
    """Nodes of a layer in order of insertion; links: places in the layer, the first `forward`
    of them forward ones; score: similarity of the back links, raised by 2 if they must stay."""

    def __init__(self, nodes: np.ndarray, forward: int, back: int):
        self.nodes, self.forward, self.n = nodes, forward, 0
        self.links = np.full((len(nodes), forward + back), -1, dtype=np.int32)
        self.score = np.full((len(nodes), back), NONE, dtype=np.float32)

    def add(self, found: np.ndarray, sims: np.ndarray) -> None:
        """Link the next len(found) nodes with their nearest (places, in falling order)."""
        lo, size = self.n, len(found)
        ahead, likeness = found[:, : self.forward], sims[:, : self.forward]
        self.links[lo : lo + size, : ahead.shape[1]] = ahead
        self.n += size
        source = np.repeat(np.arange(lo, lo + size, dtype=np.int32), ahead.shape[1])
        target, score = ahead.reshape(-1), (likeness + np.float32(2) * (np.arange(ahead.shape[1]) == 0)).astype(np.float32).reshape(-1)
        keep = target >= 0
        source, target, score = source[keep], target[keep], score[keep]
        if not len(target):
            return
        by = np.lexsort((-score, target))
        source, target, score = source[by], target[by], score[by]
        own, first, at = np.unique(target, return_index=True, return_inverse=True)
        rank = np.arange(len(target)) - first[at]
        back = self.score.shape[1]
        keep = rank < back
        new, new_score = np.full((len(own), back), -1, dtype=np.int32), np.full((len(own), back), NONE, dtype=np.float32)
        new[at[keep], rank[keep]], new_score[at[keep], rank[keep]] = source[keep], score[keep]
        all_links = np.concatenate([self.links[own, self.forward :], new], axis=1)
        all_score = np.concatenate([self.score[own], new_score], axis=1)
        top = np.argpartition(-all_score, back - 1, axis=1)[:, :back]
        self.links[own, self.forward :] = np.take_along_axis(all_links, top, axis=1)
        self.score[own] = np.take_along_axis(all_score, top, axis=1)


class Graph:
    """The graph of a shard. near, sims: for each node what its insertion found, `ef` of the
    nodes before it and of its batch, in falling order (-1 where there are fewer)."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, ef: int = 16, forward: int = 12, back: int = 16, batch: int = ROWS):
        n = len(vectors)
        mixed = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.order = np.argsort(mixed, kind="stable")  # place in the input of each node
        self.vectors = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        u = ((mixed[self.order] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(RATIO)).astype(int)
        self.layers = [_Layer(np.arange(n, dtype=np.int32), forward, back)]
        while len(self.layers[-1].nodes) > SCANNED:
            above = np.nonzero(level >= len(self.layers))[0].astype(np.int32)
            if not len(above) or len(above) == len(self.layers[-1].nodes):
                break
            self.layers.append(_Layer(above, forward, back))
        self._seen = np.zeros(max(ROWS, batch) * n, dtype=bool)
        found, likeness = np.full((n, ef), -1, dtype=np.int32), np.full((n, ef), NONE, dtype=np.float32)
        for lo in range(0, n, batch):
            hi = min(n, lo + batch)
            x = self.vectors[lo:hi]
            peers = x @ x.T
            np.fill_diagonal(peers, NONE)
            entry = None
            for number in range(len(self.layers) - 1, -1, -1):
                layer = self.layers[number]
                entry, sims = self._step(x, number, entry, ef)
                mine = np.nonzero(self._members(layer, lo, hi))[0]
                if len(mine):
                    near = peers if len(mine) == hi - lo else peers[np.ix_(mine, mine)]
                    # a full beam takes only what is nearer than its last; pressed to the left
                    c = np.flatnonzero(near > (sims[mine, -1:] if sims.shape[1] >= ef else NONE))
                    r, c = c // len(mine), c % len(mine)
                    count = np.bincount(r, minlength=len(mine))
                    slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                    own, like = np.full((len(mine), count.max()), -1, dtype=np.int32), np.full((len(mine), count.max()), NONE, dtype=np.float32)
                    own[r, slot], like[r, slot] = layer.n + c, near[r, c]
                    places, both = np.concatenate([entry[mine], own], axis=1), np.concatenate([sims[mine], like], axis=1)
                    top = best(both, ef)
                    places, both = np.take_along_axis(places, top, axis=1), np.take_along_axis(both, top, axis=1)
                    layer.add(places, both)
                    if number == 0:
                        found[lo:hi, : places.shape[1]], likeness[lo:hi, : places.shape[1]] = places, both
        back_to = np.empty(n, dtype=np.int64)
        back_to[self.order] = np.arange(n)
        self.near, self.sims = self._outside(found[back_to]), likeness[back_to]

    @staticmethod
    def _members(layer: _Layer, lo: int, hi: int) -> np.ndarray:
        out = np.zeros(hi - lo, dtype=bool)
        a, b = np.searchsorted(layer.nodes, (lo, hi))
        out[layer.nodes[a:b] - lo] = True
        return out

    def _outside(self, places: np.ndarray) -> np.ndarray:
        """Places in the input of nodes."""
        return np.where(places >= 0, self.order[places], -1)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, similarity) of the links of layer 0, places in the input."""
        layer = self.layers[0]
        a = np.repeat(np.arange(len(layer.links)), layer.links.shape[1])
        b = layer.links.reshape(-1)
        keep = b >= 0
        a, b = a[keep], b[keep]
        return self.order[a], self.order[b], _products(self.vectors, a, self.vectors, b)

    def _step(self, x: np.ndarray, number: int, entry: np.ndarray | None, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the layer, similarities) of the nearest that a layer has, in falling order;
        entry: places in the layer above."""
        layer = self.layers[number]
        width = ef if number == 0 else 8
        if layer.n <= SCANNED:
            if not layer.n:
                return np.full((len(x), width), -1, dtype=np.int32), np.full((len(x), width), NONE, dtype=np.float32)
            sims = x @ self.vectors[layer.nodes[: layer.n]].T
            top = best(sims, width)
            return _wide(top.astype(np.int32), width, -1), _wide(np.take_along_axis(sims, top, axis=1), width, NONE)
        above = self.layers[number + 1]
        at = np.searchsorted(layer.nodes, above.nodes)
        entry = np.where(entry >= 0, at[entry], -1)
        entry[(entry < 0).all(axis=1), 0] = 0
        return self._beams(x, layer, entry, width)

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the input, similarities) of about the k nearest of each query, in falling order."""
        ef = max(ef, k)
        found, sims = np.full((len(queries), k), -1, dtype=np.int64), np.full((len(queries), k), NONE, dtype=np.float32)
        for at in range(0, len(queries), ROWS):
            x, entry, s = queries[at : at + ROWS], None, None
            for number in range(len(self.layers) - 1, -1, -1):
                entry, s = self._step(x, number, entry, ef)
            found[at : at + ROWS], sims[at : at + ROWS] = self._outside(entry[:, :k]), s[:, :k]
        return found, sims

    def within(self, queries: np.ndarray, at_least: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the input, similarity) of the nodes at least so similar: a query that
        fills its beam with such nodes is searched again with one four times as wide."""
        out, asking = [], np.arange(len(queries))
        while len(asking):
            ef = min(ef, len(self.vectors))
            found, sims = self.search(queries[asking], ef, ef)
            good = (sims >= at_least) & (found >= 0)
            full = good.all(axis=1) & (ef < len(self.vectors))
            r, c = np.nonzero(good & ~full[:, None])
            out.append((asking[r], found[r, c], sims[r, c]))
            asking, ef = asking[full], ef * 4
        return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float32)))

    def _beams(self, x: np.ndarray, layer: _Layer, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(x), layer.n
        vectors, nodes, base = self.vectors, layer.nodes, layer is self.layers[0]
        seen, marks = self._seen, []  # all False before and after
        beam, sims = np.full((q, ef), -1, dtype=np.int32), np.full((q, ef), NONE, dtype=np.float32)
        done = np.ones((q, ef), dtype=bool)
        active, fresh = np.arange(q), entry
        while True:
            fresh = np.sort(fresh, axis=1)
            ok = fresh >= 0
            ok[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            c = np.flatnonzero(ok)
            r, node = c // fresh.shape[1], fresh.take(c)
            at = active.take(r) * n + node
            keep = np.nonzero(~seen.take(at))[0]
            r, node, at = r.take(keep), node.take(keep), at.take(keep)
            seen[at] = True
            marks.append(at)
            # the new ones of each beam, pressed to the left
            count = np.bincount(r, minlength=len(active))
            slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            m = int(count.max()) if len(r) else 0
            if m:
                s = _products(x, active.take(r), vectors, node if base else nodes.take(node))
                grid, value = np.full((len(active), m), -1, dtype=np.int32), np.full((len(active), m), NONE, dtype=np.float32)
                grid[r, slot], value[r, slot] = node, s
                all_sims = np.concatenate([sims[active], value], axis=1)
                top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
                sims[active] = np.take_along_axis(all_sims, top, axis=1)
                beam[active] = np.take_along_axis(np.concatenate([beam[active], grid], axis=1), top, axis=1)
                done[active] = np.take_along_axis(np.concatenate([done[active], grid < 0], axis=1), top, axis=1)
            score = np.where(done[active], np.float32(-3), sims[active])
            w = min(wide, ef)
            pick = np.argpartition(-score, w - 1, axis=1)[:, :w]
            good = np.take_along_axis(score, pick, axis=1) > NONE
            go = good.any(axis=1)
            if not go.any():
                break
            active, pick, good = active[go], pick[go], good[go]
            rows = np.repeat(active, w).reshape(-1, w)
            done[rows[good], pick[good]] = True
            parents = np.where(good, np.take_along_axis(beam[active], pick, axis=1), -1)
            fresh = np.where(parents[:, :, None] >= 0, layer.links.take(parents, axis=0, mode="clip"), -1).reshape(len(active), -1)
        for at in marks:
            seen[at] = False
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(beam, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _products(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows a of x and rows b of y, so many at a time as caches hold."""
    out = np.empty(len(a), dtype=np.float32)
    for at in range(0, len(a), CHUNK):
        np.einsum("ij,ij->i", x.take(a[at : at + CHUNK], axis=0), y.take(b[at : at + CHUNK], axis=0), out=out[at : at + CHUNK])
    return out


def _wide(a: np.ndarray, width: int, fill: float) -> np.ndarray:
    if a.shape[1] >= width:
        return a[:, :width]
    out = np.full((len(a), width), fill, dtype=a.dtype)
    out[:, : a.shape[1]] = a
    return out
