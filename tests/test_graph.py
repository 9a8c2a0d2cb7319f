import numpy as np

from ramify.plans.graph import PrincipalGraph, minimum_spanning_tree, pairwise
from ramify.operators.project import slide_windows


def line(n=7):
    a = np.zeros((n, n), int)
    for i in range(n - 1):
        a[i, i + 1] = a[i + 1, i] = 1
    return PrincipalGraph(a, np.arange(n, dtype=float)[None, :])


def star():
    a = np.zeros((7, 7), int)
    for x, y in ((0, 1), (1, 2), (2, 3), (2, 5), (3, 4), (5, 6)):
        a[x, y] = a[y, x] = 1
    f = np.array([[0, 1, 2, 3, 4, 3, 4], [0, 0, 0, 1, 2, -1, -2]], float)
    return PrincipalGraph(a, f)


def test_double_fork_merges_to_five_nodes():
    a = np.zeros((6, 6), int)
    for x, y in ((0, 1), (0, 2), (0, 3), (1, 4), (1, 5)):
        a[x, y] = a[y, x] = 1
    g, groups = PrincipalGraph(a, np.zeros((2, 6))).merged()
    assert len(g.degree) == 5 and sorted(map(len, groups)) == [1, 1, 1, 1, 2] and g.degree.max() == 4


def test_spanning_tree_is_least():
    rng = np.random.default_rng(0)
    f = rng.random((2, 8))
    d = pairwise(f)
    b = minimum_spanning_tree(d)
    assert b.sum() == 14
    parent = list(range(8))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    total = 0.0
    for i, j in sorted(((i, j) for i in range(8) for j in range(i)), key=lambda p: d[p]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += d[i, j]
    assert np.isclose((d * b).sum() / 2, total)


def test_rooted_line_and_star():
    g = line().rooted(0)
    assert g.tips == [0, 6] and len(g.segments) == 1 and np.allclose(g.time, np.arange(7), atol=1e-4)
    g = star().rooted(0)
    assert g.forks == [2] and {(s.start, s.end) for s in g.segments} == {(0, 2), (2, 4), (2, 6)}
    assert [s.end for s in g.segment_path(0, 4)] == [2, 4] and g.segment_path(4, 0) == []


def test_circle_has_two_arcs():
    a = np.array([[1 if (i - j) % 6 in (1, 5) else 0 for j in range(6)] for i in range(6)])
    t = np.arange(6) * np.pi / 3
    g = PrincipalGraph(a, np.vstack([np.cos(t), np.sin(t)])).rooted(0)
    assert [s.n for s in g.segments] == ["0", "1"] and g.root2 in (1, 5) and {s.end for s in g.segments} == {3}


def test_cleanup_removes_short_branches():
    a = np.zeros((8, 8), int)
    for x, y in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7)):
        a[x, y] = a[y, x] = 1
    g, _ = PrincipalGraph(a, np.arange(8, dtype=float)[None, :]).cleaned(2)
    assert len(g.degree) == 7 and not g.forks
    h, _ = star().cleaned(0, leaves=[4])
    assert len(h.degree) == 5


def test_two_roots():
    g = star().rooted_twice(0, 4, 2)
    assert g.meeting == 2 and {g.root, g.root2} == {0, 4}


def test_layout_puts_leaves_apart():
    g = star().rooted(0)
    assert len(set(g.layout().values())) == 3


def test_windows_share_their_border():
    time, mass = np.arange(10, dtype=float), np.ones(10)
    out = slide_windows(time, mass, list(range(4)), [list(range(4, 10))], 3)
    assert all(len(w) <= 3 for _, w in out) and out[0][1][-1] == out[1][1][0]
