"""The principal graph: a small object on the driver, broadcast to wherever rows meet it."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np


METRICS = ("euclidean", "sqeuclidean", "cityblock", "manhattan", "l1", "l2", "chebyshev", "cosine", "correlation")


def pairwise(f: np.ndarray, g: np.ndarray | None = None, metric: str = "euclidean") -> np.ndarray:
    """Distances between the columns of f and g by one of METRICS."""
    g = f if g is None else g
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if metric in ("cityblock", "manhattan", "l1", "chebyshev"):
        out = np.zeros((f.shape[1], g.shape[1]))
        for a, b in zip(f, g, strict=True):  # by dimension, so that no table of all differences is made
            gap = np.abs(a[:, None] - b[None, :])
            out = np.maximum(out, gap) if metric == "chebyshev" else out + gap
        return out
    if metric in ("cosine", "correlation"):
        f, g = (x - x.mean(axis=0) if metric == "correlation" else x for x in (f, g))
        f, g = (np.divide(x, np.sqrt((x * x).sum(axis=0)), out=np.zeros_like(x, dtype=float), where=(x * x).sum(axis=0) > 0) for x in (f, g))
        return np.clip(1 - f.T @ g, 0, 2)
    sq = (f * f).sum(0)[:, None] + (g * g).sum(0)[None, :] - 2 * f.T @ g
    return np.maximum(sq, 0) if metric == "sqeuclidean" else np.sqrt(np.maximum(sq, 0))


def minimum_spanning_tree(d: np.ndarray) -> np.ndarray:
    """0/1 adjacency of the tree, grown from node 0 by the nearest outside node."""
    k = len(d)
    b = np.zeros((k, k), int)
    if not k:
        return b
    best, link = d[0].astype(float).copy(), np.zeros(k, int)
    inside = np.zeros(k, bool)
    inside[0] = True
    for _ in range(k - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        b[j, link[j]] = b[link[j], j] = 1
        inside[j] = True
        closer = d[j] < best
        best[closer], link[closer] = d[j][closer], j
    return b


def shortest(weights: np.ndarray, source: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from ``source`` and predecessors; a weight of 0 means no edge."""
    k = len(weights)
    dist, before = np.full(k, np.inf), np.full(k, -1)
    dist[source] = 0
    queue = [(0.0, source)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > dist[u]:
            continue
        for v in np.flatnonzero(weights[u]):
            if d + weights[u, v] < dist[v]:
                dist[v], before[v] = d + weights[u, v], u
                heapq.heappush(queue, (float(dist[v]), int(v)))
    return dist, before


def trace(before: np.ndarray, target: int) -> list[int]:
    path = [int(target)]
    while before[path[-1]] >= 0:
        path.append(int(before[path[-1]]))
    return path[::-1]


@dataclass(frozen=True)
class Segment:
    n: str
    start: int
    end: int
    d: float


@dataclass(frozen=True)
class PrincipalGraph:
    """``adjacency`` K x K, ``nodes`` d x K; the rest is known once the graph has a root."""

    adjacency: np.ndarray
    nodes: np.ndarray
    method: str = "ppt"
    sigma: float = 0.1
    lam: float = 1.0
    root: int | None = None
    root2: int | None = None
    meeting: int | None = None
    time: np.ndarray | None = None
    seg: tuple[str, ...] = ()
    segments: tuple[Segment, ...] = ()
    milestones: dict[str, int] = field(default_factory=dict)

    @property
    def degree(self) -> np.ndarray:
        return self.adjacency.sum(axis=0)

    @property
    def tips(self) -> list[int]:
        return np.flatnonzero(self.degree == 1).tolist()

    @property
    def forks(self) -> list[int]:
        return np.flatnonzero(self.degree > 2).tolist()

    @property
    def edges(self) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for a, b in np.argwhere(np.triu(self.adjacency))]

    def weights(self) -> np.ndarray:
        return np.where(self.adjacency > 0, pairwise(self.nodes) + 1e-6, 0.0)

    def distances(self, source: int) -> np.ndarray:
        return shortest(self.weights(), source)[0]

    def path(self, a: int, b: int) -> list[int]:
        return trace(shortest(self.weights(), a)[1], b)

    # --- rooting ---

    def rooted(self, root: int) -> PrincipalGraph:
        """Distances from the root, and segments between nodes that aren't of degree two."""
        if len(self.tips) == 0 and self.adjacency.any():
            return self._rooted_circle(root)
        dist, before = shortest(self.weights(), root)
        ends = sorted(set(np.flatnonzero(self.degree != 2).tolist()) | {root})
        seg, found = [""] * len(dist), []
        for i, a in enumerate(ends):
            before_a = shortest(self.weights(), a)[1]
            for b in ends[i + 1 :]:
                path = trace(before_a, b)
                if path[0] != a or any(v in ends for v in path[1:-1]):
                    continue
                s, e = (a, b) if dist[a] <= dist[b] else (b, a)
                name = str(len(found) + 1)
                found.append(Segment(name, s, e, float(abs(dist[e] - dist[s]))))
                for v in path:  # a node between segments keeps the last one
                    seg[v] = name
        stones = {str(v): v for v in ends}
        return replace(self, root=root, root2=None, meeting=None, time=dist, seg=tuple(seg), segments=tuple(found), milestones=self._named(stones))

    def _rooted_circle(self, root: int) -> PrincipalGraph:
        dist, before = shortest(self.weights(), root)
        far = int(np.argmax(dist))
        one = trace(before, far)
        seg = ["1" if v in one[:-1] else "0" for v in range(len(dist))]
        beside = [v for v in np.flatnonzero(self.adjacency[root]).tolist() if v not in one]
        root2 = beside[0] if beside else root
        segments = (Segment("0", root2, far, float(dist[far] - dist[root2])), Segment("1", root, far, float(dist[far])))
        return replace(self, root=root, root2=root2, time=dist, seg=tuple(seg), segments=segments, milestones=self._named({str(v): v for v in (root, far)}))

    def rooted_twice(self, a: int, b: int, meeting: int) -> PrincipalGraph:
        """The root farther from ``meeting`` leads; on the other's side times and segments turn round."""
        da, db = self.distances(a)[meeting], self.distances(b)[meeting]
        main, second = (a, b) if da >= db else (b, a)
        g = self.rooted(main)
        dist2 = self.distances(second)
        side = self.path(second, meeting)
        shift = abs(da - db)
        time = g.time.copy()
        for v in side:
            time[v] = dist2[v] + shift
        turned = tuple(Segment(s.n, s.end, s.start, s.d) if s.start in side and s.end in side and dist2[s.start] > dist2[s.end] else s for s in g.segments)
        return replace(g, root2=second, meeting=meeting, time=time, segments=turned)

    def _named(self, stones: dict[str, int]) -> dict[str, int]:
        """Names already given to nodes hold on."""
        known = {v: k for k, v in self.milestones.items()}
        return {known.get(v, k): v for k, v in stones.items()}

    def renamed(self, names: dict[str, str] | list[str]) -> PrincipalGraph:
        if not isinstance(names, dict):
            names = dict(zip(self.milestones, names, strict=True))
        return replace(self, milestones={names.get(k, k): v for k, v in self.milestones.items()})

    # --- segments on paths ---

    def segment_path(self, start: int, end: int) -> list[Segment]:
        """Segments in direction of time from one milestone node to another; none if there is no such way."""
        known, at = [], end
        by_end = {s.end: s for s in self.segments}
        while at != start:
            if at not in by_end or len(known) > len(self.segments):
                return []
            known.append(by_end[at])
            at = by_end[at].start
        return known[::-1]

    # --- changes of topology; each returns the new graph and which old nodes each new one averages ---

    def kept(self, keep: np.ndarray) -> tuple[PrincipalGraph, list[list[int]]]:
        new = {int(v): i for i, v in enumerate(keep)}
        stones = {k: new[v] for k, v in self.milestones.items() if v in new}
        g = PrincipalGraph(self.adjacency[np.ix_(keep, keep)], self.nodes[:, keep], self.method, self.sigma, self.lam, milestones=stones)
        return g, [[int(v)] for v in keep]

    def cleaned(self, min_branch: int = 3, leaves: list[int] | None = None) -> tuple[PrincipalGraph, list[list[int]]]:
        """Without the branches of ``leaves``, then without tips nearer than ``min_branch`` nodes to a fork."""
        alive = np.ones(len(self.nodes.T), bool)
        for leaf in leaves or []:
            for v in self._to_fork(leaf, alive)[:-1]:
                alive[v] = False
        while True:
            degree = (self.adjacency * np.outer(alive, alive)).sum(axis=0)
            tips = np.flatnonzero(alive & (degree == 1))
            if not (alive & (degree > 2)).any():
                break
            lengths = {int(t): len(self._to_fork(int(t), alive)) for t in tips}
            nearest = min(lengths, key=lambda t: (lengths[t], t))
            if lengths[nearest] > min_branch:
                break
            alive[nearest] = False
        return self.kept(np.flatnonzero(alive))

    def _to_fork(self, tip: int, alive: np.ndarray) -> list[int]:
        """Nodes from a tip to the nearest fork, the fork last."""
        b = self.adjacency * np.outer(alive, alive)
        degree, path, last = b.sum(axis=0), [tip], -1
        while degree[path[-1]] <= 2:
            ahead = [int(v) for v in np.flatnonzero(b[path[-1]]) if v != last]
            if not ahead:
                break
            last = path[-1]
            path.append(ahead[0])
        return path

    def merged(self) -> tuple[PrincipalGraph, list[list[int]]]:
        """Edges between two forks shrink to one node at their mean, first edge first."""
        b, f = self.adjacency.copy(), self.nodes.copy()
        groups = [[i] for i in range(len(b))]
        stones = dict(self.milestones)
        while True:
            degree = b.sum(axis=0)
            pair = next(((i, j) for i, j in np.argwhere(np.triu(b)) if degree[i] >= 3 and degree[j] >= 3), None)
            if pair is None:
                break
            i, j = map(int, pair)
            f[:, i] = (f[:, i] + f[:, j]) / 2
            b[i] |= b[j]
            b[:, i] |= b[:, j]
            b[i, i] = 0
            groups[i] = groups[i] + groups[j]
            keep = np.array([v for v in range(len(b)) if v != j])
            stones = {k: int(np.searchsorted(keep, i if v == j else v)) for k, v in stones.items()}
            b, f, groups = b[np.ix_(keep, keep)], f[:, keep], [groups[v] for v in keep]
        return PrincipalGraph(b, f, self.method, self.sigma, self.lam, milestones=stones), groups

    def simplified_groups(self, n_nodes: int = 10) -> list[list[int]]:
        """Milestones stay; the other nodes of a segment form ``n_nodes`` chunks along time."""
        stones = sorted(set(self.milestones.values()))
        groups = [[v] for v in stones]
        for s in sorted(set(self.seg), key=lambda x: int(x or 0)):
            inside = sorted((v for v in range(len(self.seg)) if self.seg[v] == s and v not in stones), key=lambda v: self.time[v])
            groups += [c.tolist() for c in np.array_split(np.array(inside, int), n_nodes) if len(c)]
        return groups

    def layout(self) -> dict[str, float]:
        """Horizontal place of each segment: leaves side by side, parents amid their children."""
        children: dict[int, list[Segment]] = {}
        for s in self.segments:
            children.setdefault(s.start, []).append(s)
        place: dict[str, float] = {}
        count = 0

        def put(s: Segment) -> float:
            nonlocal count
            below = [put(c) for c in children.get(s.end, []) if c.n != s.n]
            if not below:
                count += 1
                below = [float(count - 1)]
            place[s.n] = sum(below) / len(below)
            return place[s.n]

        for s in children.get(self.root, []):
            put(s)
        return {n: float(i) for i, n in enumerate(sorted(place, key=lambda n: (place[n], int(n))))}
