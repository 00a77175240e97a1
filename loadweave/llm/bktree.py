"""BK-trees over 64-bit fingerprints, many at once, as numpy arrays.

A BK-tree hangs each value below a parent under the Hamming distance to it. By
the triangle inequality a search with radius r, at a node in distance d, has to
follow only the edges d-r to d+r. A forest holds one tree per bucket; all trees
are built and searched level by level, so the work is done on whole arrays.
"""

from __future__ import annotations

import numpy as np

_EDGES = 65  # distances 0 to 64


def build(roots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the forest: sorted keys ``parent * 65 + distance`` and the child of each.

    ``roots`` gives for each value the index of its bucket's first value. The trees
    are those that inserting the values one after the other gives.
    """
    keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    active = np.flatnonzero(roots != np.arange(len(roots)))
    at = roots[active]
    while len(active):
        key = at * _EDGES + np.bitwise_count(values[active] ^ values[at])
        unique, first, which = np.unique(key, return_index=True, return_inverse=True)
        child = active[first]
        keys.append(unique)
        children.append(child)
        at = child[which]
        rest = at != active
        active, at = active[rest], at[rest]
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def search(
    roots: np.ndarray,
    values: np.ndarray,
    edges: tuple[np.ndarray, np.ndarray],
    radius: int,
    chunk: int = 4096,
    others: tuple[np.ndarray, np.ndarray] | None = None,
):
    """Yield pairs (i, j), j < i, of values of one bucket within ``radius`` of each other.

    ``others``, roots and values that are in no tree: instead the pairs of one of them, i, and
    a value of a tree, j.
    """
    keys, children = edges
    asked_roots, asked = others or (roots, values)
    for start in range(0, len(asked), chunk):
        query = np.arange(start, min(start + chunk, len(asked)))
        node = asked_roots[query]
        while len(query):
            distance = np.bitwise_count(asked[query] ^ values[node]).astype(np.int64)
            hit = distance <= radius
            if others is None:
                hit &= node < query
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(keys, node * _EDGES + np.maximum(distance - radius, 0))
            high = np.searchsorted(
                keys, node * _EDGES + np.minimum(distance + radius, _EDGES - 1), side="right"
            )
            many = high - low
            total = int(many.sum())
            query = np.repeat(query, many)
            begin = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            node = children[begin + np.arange(total)]


def components(n: int, pairs) -> np.ndarray:
    """For each of n values the smallest index that the pairs connect it with."""
    label = np.arange(n)
    pairs = list(pairs)
    if not pairs:
        return label
    a = np.concatenate([p[0] for p in pairs])
    b = np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tolist() != label.tolist():
            label = jumped
        if (label == before).all():
            return label
