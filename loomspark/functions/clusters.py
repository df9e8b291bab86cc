"""Clustering in NumPy for sets of vectors that fit one task: density clusters, average linkage, silhouettes, macro groups."""

from __future__ import annotations

import numpy as np

# The share of a macro group that is still fine, how near silhouettes count as equal, and when the largest group is split.
TARGET_SHARE, EPS, MAX_SHARE, CHILD_SHARE = 0.40, 0.005, 0.35, 0.9


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """Edges (distance, a, b) of a least spanning tree of a distance matrix, by rising distance (Prim)."""
    n = len(d)
    near, come, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (d[at] < near)
        near[closer], come[closer] = d[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[at], come[at], at))
    return np.array(sorted(edges))


def density_clusters(x: np.ndarray, least: int, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: in no cluster) and memberships of points, by density at all scales at once.

    A point's core distance is that to its neighbours-th nearest point, itself counted; two points are as far apart as the largest of their distance
    and core distances. Raising density cuts the spanning tree into ever smaller parts; parts below least points fall off. Of the parts that
    remain, those live longest that hold most points over the widest range of density: no chosen one holds another, and the whole is none.
    A point's membership is its density when it leaves its cluster over the largest in it.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    least, neighbours = min(least, n), min(neighbours, n)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    np.fill_diagonal(d, 0)
    core = np.partition(d, neighbours - 1, axis=1)[:, neighbours - 1]
    tree = spanning_tree(np.maximum(np.maximum(core[:, None], core[None]), d))
    # the hierarchy: each edge joins two parts; part n + i is that of edge i
    root, size, left, right, height = list(range(2 * n - 1)), [1] * n, {}, {}, {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (w, a, b) in enumerate(tree):
        p, q = find(int(a)), find(int(b))
        left[n + i], right[n + i], height[n + i] = p, q, w
        size.append(size[p] + size[q])
        root[p] = root[q] = n + i

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += [left[k], right[k]]
        return out

    # from the top down: a cluster goes on while only small parts leave it, and ends where two large ones part
    born, members, kids, parent = {0: 0.0}, {0: []}, {0: []}, {0: -1}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            a, b = left[node], right[node]
            if size[a] >= least and size[b] >= least:
                for part in (a, b):
                    k = len(born)
                    born[k], members[k], kids[k], parent[k] = lam, [], [], c
                    kids[c].append(k)
                    members[c].append((lam, size[part], []))
                    todo.append((part, k))
                break
            small, big = (a, b) if size[a] < size[b] else (b, a)
            if size[big] < least:
                members[c].append((lam, size[node], points(node)))
                break
            members[c].append((lam, size[small], points(small)))
            node = big
        else:
            members[c].append((np.inf, 1, [node]))
    finite = max((m[0] for ms in members.values() for m in ms if np.isfinite(m[0])), default=1.0)
    stability = {c: sum((min(lam, finite) - born[c]) * k for lam, k, _ in ms) for c, ms in members.items()}
    chosen = set()
    for c in sorted(born, reverse=True):
        below = sum(stability[k] for k in kids[c])
        if c and (not kids[c] or stability[c] >= below):
            chosen.add(c)
            drop = list(kids[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += kids[k]
        else:
            stability[c] = below
    labels, prob = np.full(n, -1), np.zeros(n)
    for label, c in enumerate(sorted(chosen)):
        lam, todo = np.zeros(n), [c]
        while todo:
            k = todo.pop()
            for v, _, ps in members[k]:
                lam[ps] = min(v, finite)
            todo += kids[k]
        mine = lam > 0
        labels[mine], prob[mine] = label, lam[mine] / lam.max()
    return labels, prob


def cosine_distances(x: np.ndarray) -> np.ndarray:
    u = unit_rows(np.asarray(x, float))
    return np.clip(1 - u @ u.T, 0, 2)


def average_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """k groups by joining the two groups of least mean distance again and again (the first such pair of ties); numbered by their first member."""
    groups = [[i] for i in range(len(d))]
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    while len(groups) > k:
        i, j = sorted(np.unravel_index(int(np.argmin(m)), m.shape))
        a, b = len(groups[i]), len(groups[j])
        m[i] = m[:, i] = (a * m[i] + b * m[j]) / (a + b)
        m[i, i] = np.inf
        m = np.delete(np.delete(m, j, 0), j, 1)
        groups[i] += groups.pop(j)
    labels = np.empty(len(d), int)
    for n, g in enumerate(sorted(groups, key=min)):
        labels[g] = n
    return labels


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """The mean over points of (nearest other group - own group) / the larger; 0 for a group of one."""
    kinds, out = np.unique(labels), np.zeros(len(d))
    mean = np.stack([d[:, labels == k].sum(1) for k in kinds], 1)
    count = np.array([(labels == k).sum() for k in kinds])
    for i in range(len(d)):
        own = int(np.searchsorted(kinds, labels[i]))
        if count[own] > 1:
            a = mean[i, own] / (count[own] - 1)
            b = min(mean[i, j] / count[j] for j in range(len(kinds)) if j != own)
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return float(out.mean())


def macro_groups(centroids: np.ndarray, sizes: np.ndarray, k_range: tuple[int, int] = (5, 10)) -> tuple[np.ndarray, dict]:
    """Groups of topics and how they were chosen: of the numbers of groups whose largest holds TARGET_SHARE at most (all, if none does), those of nearly the best silhouette, and of these the one with the smallest largest group."""
    n, total = len(sizes), float(sizes.sum())
    lo, hi = sorted(k_range)
    ks = [k for k in range(max(lo, 2), min(hi, n) + 1) if k < n]
    if not ks:
        return np.zeros(n, int), {"k": 1, "silhouette": None, "largest_share": 1.0 if total else 0.0}
    d, tried = cosine_distances(centroids), []
    for k in ks:
        labels = average_linkage(d, k)
        share = max(sizes[labels == g].sum() for g in range(k)) / total if total else 0.0
        tried.append({"k": k, "silhouette": silhouette(d, labels), "largest_share": float(share), "labels": labels})
    pool = [t for t in tried if t["largest_share"] <= TARGET_SHARE] or tried
    best = max(t["silhouette"] for t in pool)
    one = min((t for t in pool if best - t["silhouette"] <= EPS), key=lambda t: (t["largest_share"], t["k"]))
    return one["labels"], {x: one[x] for x in ("k", "silhouette", "largest_share")}


def split_largest(labels: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, max_share: float = MAX_SHARE) -> np.ndarray:
    """labels with the largest group, if it holds more than max_share, split in two; in three, if one of two holds nearly all and three parts are more even. New groups get new numbers."""
    total = float(sizes.sum())
    totals = {int(g): float(sizes[labels == g].sum()) for g in np.unique(labels)}
    big = max(totals, key=lambda g: (totals[g], -g)) if totals else -1
    mine = np.flatnonzero(labels == big)
    if not total or totals[big] / total <= max_share or len(mine) < 2:
        return labels
    d = cosine_distances(centroids[mine])

    def parts(k: int) -> tuple[np.ndarray, float]:
        p = average_linkage(d, k)
        return p, max(sizes[mine][p == g].sum() for g in range(k)) / max(sizes[mine].sum(), 1e-12)

    p, share = parts(2)
    if share > CHILD_SHARE and len(mine) >= 3:
        p3, share3 = parts(3)
        p = p3 if share3 < share else p
    out = labels.copy()
    out[mine] = labels.max() + 1 + p
    return out


def diverse(x: np.ndarray, centroid: np.ndarray, k: int, near: float = 0.95) -> list[int]:
    """k rows by likeness to the centroid, such as are nearer than near to a chosen one last."""
    u = unit_rows(np.asarray(x, float))
    order = np.argsort(-(u @ (centroid / max(np.linalg.norm(centroid), 1e-12))), kind="stable").tolist()
    chosen: list[int] = []
    for i in order:
        if len(chosen) < k and all(u[i] @ u[j] < near for j in chosen):
            chosen.append(i)
    return chosen + [i for i in order if i not in chosen][: k - len(chosen)]
