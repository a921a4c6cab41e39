"""Brute-force versions that the operators are compared with."""

import numpy as np


def groups(n_or_ids, pairs):
    """Smallest id reachable from each id."""
    parent = {i: i for i in n_or_ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def simhash_groups(fps, ids, distance):
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= distance)
    return groups(ids, [(ids[a], ids[b]) for a, b in near])


def cosine_groups(vectors, labels, ids, least):
    u = np.array(vectors, float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    labels = np.array(labels)
    near = (u @ u.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    found = groups(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    return {i: (int(k), found[i]) for i, k in zip(ids, near.sum(axis=1))}


def nearest(vectors, ids, every, k):
    x, ids = np.array(vectors, float), np.array(ids)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x[i] * x).sum(axis=1)
        s[ids == ids[i]] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if np.isfinite(s[j])][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out
