"""Hierarchical navigable small-world graphs over unit vectors, built and searched in batches with numpy.

Vectors enter in order of falling level, so that the nodes of every level are the first ones. A batch of new vectors
is searched in the graph as it stands, all at once; links are chosen for diversity among what the beams found and the
batch itself. A vector within ``reach`` of a node becomes a member of that node's ball instead of a node, so a group
of copies is one node with a long list of members, whatever its size.
"""

from __future__ import annotations

import math

import numpy as np

#: Links of a new node, and links a node holds at most on level 0 (above: half as many).
LINKS, MOST_LINKS = 12, 32
#: Beam of an insertion, and vectors inserted at once.
BUILD_WIDTH, BATCH = 32, 384
#: Cells of a beam's memory of seen nodes.
SEEN = 1 << 26


def levels(keys: np.ndarray) -> np.ndarray:
    """The level of each vector, by its 64-bit key: each level holds one in ``LINKS`` of the one below."""
    share = ((keys.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(share) / math.log(LINKS)).astype(np.int64)


def beam(vectors: np.ndarray, n: int, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int):
    """``ids, cosines`` of the ``width`` nearest nodes that each query's beam meets, from its ``start`` on."""
    count = len(queries)
    ids = np.full((count, width), -1, np.int32)
    sims = np.full((count, width), -3, np.float32)
    fresh = np.zeros((count, width), bool)
    seen = np.zeros((count, n), bool)
    first = np.einsum("qd,qd->q", vectors[start], queries)
    ids[:, 0], sims[:, 0], fresh[:, 0] = start, first, True
    seen[np.arange(count), start] = True
    every = np.arange(count)
    while True:
        best = np.where(fresh, sims, -4).argmax(1)
        rows = every[fresh[every, best]]
        if not len(rows):
            return ids, sims
        at = best[rows]
        fresh[rows, at] = False
        near = links[ids[rows, at]]
        known = near >= 0
        known &= ~seen[rows[:, None], np.where(known, near, 0)]
        r, c = np.nonzero(known)
        found = near[r, c]
        seen[rows[r], found] = True
        cosines = np.full(near.shape, -3, np.float32)
        cosines[r, c] = np.einsum("ij,ij->i", vectors[found], queries[rows[r]])
        all_sims = np.concatenate([sims[rows], cosines], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if width > 1 else all_sims.argmax(1)[:, None]
        sims[rows] = np.take_along_axis(all_sims, top, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(known, near, -1)], 1), top, 1)
        fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], known], 1), top, 1)


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Up to ``most`` of each row's candidates, nearest first, none nearer to a chosen one than to the row's vector."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    own = vectors[np.maximum(ids, 0)]
    between = own @ own.transpose(0, 2, 1)
    free = ids >= 0
    free[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    valid, chosen = free.copy(), np.zeros_like(free)
    count = np.zeros(len(ids), np.int64)
    for k in range(ids.shape[1]):
        take = free[:, k] & (count < most)
        chosen[:, k] = take
        count += take
        free &= ~(take[:, None] & (between[:, k] > sims))
    rank = np.where(chosen, 0, np.where(valid & fill, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
    return np.pad(picked, ((0, 0), (0, most - picked.shape[1])), constant_values=-1)


class Graph:
    """Nodes, their links on every level, and the members of each node's ball."""

    def __init__(self, units: np.ndarray, links: list[np.ndarray], n: int, leader: np.ndarray):
        """``units``: all vectors, the ``n`` nodes first; ``leader``: the node of each vector, its own for nodes."""
        self.units, self.links, self.n, self.leader = units, links, n, leader
        self.vectors = units[:n].astype(np.float32)
        cosines = np.clip(np.einsum("id,id->i", units, units[leader]), -1, 1)
        self.radius = np.zeros(n)
        np.maximum.at(self.radius, leader[n:], np.arccos(cosines[n:]))
        order = np.argsort(leader, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(leader, minlength=n))[:-1])
        self.sizes = np.bincount(leader, minlength=n)

    def search(self, queries: np.ndarray, width: int):
        at = np.zeros(len(queries), np.int64)
        for links in self.links[:0:-1]:
            at = beam(self.vectors, len(links), links, queries, at, 1)[0][:, 0]
        return beam(self.vectors, self.n, self.links[0], queries, at, width)

    def near(self, queries: np.ndarray, angle: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``query, node`` of all met nodes whose ball may reach within ``angle`` of the query.

        A query whose beam is full of nodes that near goes again with a beam twice as wide; no list is cut.
        """
        limits = np.cos(np.minimum(angle + self.radius, np.pi)) - 1e-5  # single precision
        least, todo, out = limits.min(), np.arange(len(queries)), []
        step = max(1, SEEN // max(self.n, 1))
        while len(todo):
            again = []
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, sims = self.search(queries[part].astype(np.float32), min(width, self.n))
                hit = (ids >= 0) & (sims >= limits[np.maximum(ids, 0)])
                full = (sims.min(1) >= least) if width < self.n else np.zeros(len(part), bool)
                again.append(part[full])
                r, c = np.nonzero(hit & ~full[:, None])
                out.append((part[r], ids[r, c]))
            todo, width = np.concatenate(again), 2 * width
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int),) * 2

    def linked(self, queries: np.ndarray, cosine: float, width: int, own: np.ndarray):
        """``query, count, other``: how many vectors of a ball have that cosine with the query, and one that has it.

        ``own`` is the place of each query among this graph's vectors, or -1; a query is no link of itself.
        """
        angle = math.acos(cosine)
        query, node = self.near(queries, angle, width)
        inside = np.flatnonzero(own >= 0)
        pairs = np.unique(np.concatenate([query, inside]) * self.n + np.concatenate([node, self.leader[own[inside]]]))
        query, node = pairs // self.n, pairs % self.n
        cosines = np.einsum("id,id->i", queries[query], self.units[node])
        whole = np.arccos(np.clip(cosines, -1, 1)) + self.radius[node] <= angle - 1e-6
        single = self.sizes[node] == 1
        sure = np.where(single, cosines >= cosine, whole)
        at_home = (own[query] >= 0) & (self.leader[own[query]] == node)
        found = [(query[sure], (self.sizes[node] - at_home)[sure], node[sure])]
        open_ = np.flatnonzero(~sure & ~single)
        open_ = open_[np.argsort(node[open_], kind="stable")]
        for part in np.split(open_, np.flatnonzero(np.diff(node[open_])) + 1) if len(open_) else []:
            members = self.members[node[part[0]]]
            for a in range(0, len(part), 256):
                some = query[part[a : a + 256]]
                count, other = np.zeros(len(some), np.int64), np.full(len(some), -1, np.int64)
                for b in range(0, len(members), 1 << 15):
                    these = members[b : b + (1 << 15)]
                    close = (queries[some] @ self.units[these].T >= cosine) & (these != own[some][:, None])
                    count += close.sum(1)
                    other = np.where(close.any(1), these[close.argmax(1)], other)
                found.append((some, count, other))
        query, count, other = (np.concatenate(x) for x in zip(*found, strict=True))
        return query[count > 0], count[count > 0], other[count > 0]

    def audit(self, angle: float, width: int, queries: np.ndarray, target: float) -> tuple[int, float]:
        """The first of ``width``, twice, four times it... whose beams find ``target`` of all near nodes, and the share found."""
        limits = np.cos(np.minimum(angle + self.radius, np.pi))
        truth = np.argwhere(queries @ self.units[: self.n].T >= limits)
        while True:
            found = set(zip(*(x.tolist() for x in self.near(queries, angle, width)), strict=True))
            share = sum((int(q), int(v)) in found for q, v in truth) / max(len(truth), 1)
            if share >= target or not len(truth) or width >= self.n:
                return width, share if len(truth) else 1.0
            width *= 2


def moved(units: np.ndarray, angle: float, seed: int) -> np.ndarray:
    """Each unit vector, turned by ``angle`` in a direction of its own."""
    side = np.random.default_rng(seed).standard_normal(units.shape)
    side -= np.einsum("id,id->i", side, units)[:, None] * units
    size = np.linalg.norm(side, axis=1, keepdims=True)
    return np.cos(angle) * units + np.sin(angle) * np.divide(side, size, out=np.zeros_like(side), where=size > 0)


def build(units: np.ndarray, keys: np.ndarray, reach: float) -> tuple[Graph, np.ndarray]:
    """The graph of unit vectors whose balls have the radius ``reach``, and the input row of each of its vectors."""
    own = levels(keys)
    order = np.lexsort((keys, -own))
    units, own = units[order], own[order]
    near, total = math.cos(reach), len(units)
    vectors = np.zeros(units.shape, np.float32)
    at_least = [int((own >= k).sum()) for k in range(int(own.max()) + 1)]
    links = [np.full((m, MOST_LINKS if k == 0 else MOST_LINKS // 2), -1, np.int32) for k, m in enumerate(at_least)]
    held = np.zeros(len(links), np.int64)  # nodes of each level
    node_of = np.full(total, -1, np.int64)  # the node of a vector's ball
    as_row: list[int] = []  # the row of each node
    done = 0
    while done < total:
        level = own[done]
        end = min(done + min(BATCH, max(16, held[0])), at_least[level])
        rows = np.arange(done, end)
        queries = units[rows].astype(np.float32)
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if held[0]:
            at = np.zeros(len(rows), np.int64)
            for k in range(int(np.count_nonzero(held)) - 1, -1, -1):
                ids, sims = beam(vectors, int(held[k]), links[k], queries, at, BUILD_WIDTH if k <= level else 1)
                met[k] = (ids, sims)
                at = ids[np.arange(len(rows)), sims.argmax(1)]
            best = np.einsum("id,id->i", units[rows], units[np.array(as_row)[at]])
            node_of[rows[best >= near]] = at[best >= near]
        free = rows[node_of[rows] < 0]
        between = units[free] @ units[free].T
        close = np.tril(between >= near, -1)
        leads = np.ones(len(free), bool)
        for i in np.flatnonzero(close.any(1)):
            nearest = np.flatnonzero(close[i] & leads)
            if len(nearest):
                leads[i] = False
                node_of[free[i]] = free[nearest[between[i, nearest].argmax()]] - total - 1  # numbered below
        new = free[leads]
        first = int(held[0])
        numbers = np.full(total, -1, np.int64)
        numbers[new] = np.arange(first, first + len(new))
        late = rows[node_of[rows] < -1]
        node_of[late] = numbers[node_of[late] + total + 1]
        node_of[new] = numbers[new]
        vectors[first : first + len(new)] = units[new].astype(np.float32)
        as_row.extend(new.tolist())
        mutual = between[np.ix_(leads, leads)].astype(np.float32)
        np.fill_diagonal(mutual, -3)
        inside = min(BUILD_WIDTH // 2, max(len(new) - 1, 0))
        peers = np.argsort(-mutual, axis=1)[:, :inside]
        peer_sims = np.take_along_axis(mutual, peers, 1)
        place = np.searchsorted(rows, new)
        for k in range(int(level) + 1):
            ids, sims = (peers + first).astype(np.int32), peer_sims
            if k in met:
                ids, sims = np.concatenate([met[k][0][place], ids], 1), np.concatenate([met[k][1][place], sims], 1)
            if ids.shape[1]:
                picked = diverse(vectors, ids, sims, LINKS, True)
                links[k][first : first + len(new), :LINKS] = picked
                _link_back(vectors, links[k], np.arange(first, first + len(new)), picked)
            held[k] += len(new)
        done = end
    nodes = np.array(as_row, np.int64)
    members = np.setdiff1d(np.arange(total), nodes)
    rows = np.concatenate([nodes, members])
    n = len(nodes)
    kept = [x[: held[k]] for k, x in enumerate(links) if held[k]]
    return Graph(units[rows], kept, n, node_of[rows]), order[rows]


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
    """Links from what new nodes have picked back to them; full lists are chosen anew."""
    source = np.repeat(new, picked.shape[1])
    target = picked.ravel()
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    ends, starts, counts = np.unique(target, return_index=True, return_counts=True)
    most = links.shape[1]
    rank = np.arange(len(target)) - np.repeat(starts, counts)
    keep = rank < most
    added = np.full((len(ends), min(int(counts.max(initial=0)), most)), -1, np.int32)
    added[np.repeat(np.arange(len(ends)), counts)[keep], rank[keep]] = source[keep]
    both = np.concatenate([links[ends], added], 1)
    ordered = np.sort(both, axis=1)
    both[:, 1:] = np.where(ordered[:, 1:] == ordered[:, :-1], -1, ordered[:, 1:])
    both[:, 0] = ordered[:, 0]
    both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    fits = (both >= 0).sum(1) <= most
    links[ends[fits]] = both[fits, :most]
    for part in np.array_split(np.flatnonzero(~fits), max(1, int((~fits).sum()) // 512)):
        if len(part):
            ids = both[part]
            own = np.einsum("icd,id->ic", vectors[np.maximum(ids, 0)], vectors[ends[part]])
            own[ids < 0] = -3
            links[ends[part]] = diverse(vectors, ids, own, most, False)
