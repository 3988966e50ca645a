"""Small graphs (src, dest, weight, ts) with known answers, a random generator, and Kruskal's algorithm."""

import random

M1 = [(0, 1, 5, 0), (1, 2, 3, 0), (0, 2, 4, 1), (2, 3, 7, 1), (1, 3, 6, 2), (0, 1, 5, 2), (3, 3, 1, 2), (0, 3, 2, 3)]
M1_STEPS = {
    (1, 2, 3, 0): [(-1, 0)], (0, 1, 5, 0): [(-1, 0), (0, 1)], (0, 2, 4, 1): [(-1, 1)], (2, 3, 7, 1): [(-1, 1), (1, 2)],
    (0, 1, 5, 2): [(0, 2)], (1, 3, 6, 2): [(-1, 2), (2, 3)], (0, 3, 2, 3): [(-1, 3)],
}
M1_WEIGHTS = {(0, 0): 8, (1, 1): 11, (2, 2): 11, (3, 3): 2, (0, 1): 14, (1, 2): 15, (2, 3): 7, (0, 2): 13, (1, 3): 11, (0, 3): 9}
M2 = [(0, 1, 1, 0), (1, 2, 1, 1), (0, 2, 1, 2)]
M2_STEPS = {(0, 1, 1, 0): [(-1, 0), (0, 2)], (1, 2, 1, 1): [(-1, 1)], (0, 2, 1, 2): [(-1, 2)]}
M3 = [(0, 1, 1, 0), (0, 1, 1, 2)]
M4 = [(0, 1, 1, 3), (1, 2, 2, 3)]


def kruskal(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for e in sorted(set(edges), key=lambda e: (e[2], -e[3], e[0], e[1])):
        a, b = root(e[0]), root(e[1])
        if a != b:
            up[a] = b
            out.append(e)
    return out


def window(edges, ts, te):
    return kruskal([e for e in edges if ts <= e[3] <= te])


def random_graph(seed):
    r = random.Random(seed)
    n, t, m, w = r.randint(2, 8), r.randint(1, 10), r.randint(0, 50), r.choice([2, 5, 1000])
    return n, t, sorted({(r.randrange(n), r.randrange(n), r.randrange(w), r.randrange(t)) for _ in range(m)})


def naive_staircase(edges, total):
    """The staircase from the forests of all windows."""
    out = {}
    local = [e for t in range(total) for e in window(edges, t, t)]
    for te in range(total):
        found = [set(window(edges, a, te)) for a in range(te + 1)]
        for e in local:
            if e[3] <= te:
                s = max((a for a in range(e[3] + 1) if e not in found[a]), default=-1)
                if not out.get(e) or out[e][-1][0] < s:
                    out.setdefault(e, []).append((s, te))
    return out
