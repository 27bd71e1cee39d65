"""Convex hulls of voxel regions, in exact integer arithmetic."""

from __future__ import annotations

import numpy as np

_STEPS = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]])


def _ends(at: np.ndarray) -> np.ndarray:
    """Voxels at either end of their row along every axis: no other can touch the hull."""
    keep = np.zeros(len(at), bool)
    for a in range(3):
        others = [x for x in range(3) if x != a]
        order = np.lexsort((at[:, a], at[:, others[0]], at[:, others[1]]))
        row = at[order][:, others]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]).any(1)
        first = np.flatnonzero(new)
        keep[order[first]] = True
        keep[order[np.append(first[1:], len(at)) - 1]] = True
    return at[keep]


def planes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward normals and offsets (``n . x <= d`` inside) of the hull of integer points that span space.

    Points are added one at a time; faces that see a point give way to new ones over their horizon.
    """
    p = np.unique(points, axis=0).astype(np.int64)
    a = 0
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    c = int(np.argmax((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1)))
    d = int(np.argmax(np.abs((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a]))))
    inner = p[[a, b, c, d]].sum(0)  # four times a point inside
    faces, normals, offsets = [], [], []

    def add(i, j, k):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        o = int(n @ p[i])
        if int(n @ inner) > 4 * o:
            n, o, j, k = -n, -o, k, j
        faces.append((i, j, k))
        normals.append(n)
        offsets.append(o)

    for tri in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        add(*tri)
    for q in range(len(p)):
        if q in (a, b, c, d):
            continue
        sees = np.array(normals) @ p[q] > np.array(offsets)
        if not sees.any():
            continue
        edges: dict[tuple[int, int], int] = {}
        for f in np.flatnonzero(sees):
            i, j, k = faces[f]
            for e in ((i, j), (j, k), (k, i)):
                edges[e] = 1
        horizon = [e for e in edges if (e[1], e[0]) not in edges]
        keep = np.flatnonzero(~sees)
        faces, normals, offsets = ([x[f] for f in keep] for x in (faces, normals, offsets))
        for i, j in horizon:
            add(i, j, q)
    return np.array(normals), np.array(offsets)


def convex_image(at: np.ndarray) -> np.ndarray:
    """Mask, in the bounding box of voxels ``at``, of the voxels whose centre lies in the hull of the voxels' face centres."""
    low = at.min(0)
    at = at - low
    shape = at.max(0) + 1
    normals, offsets = planes((2 * _ends(at)[:, None, :] + _STEPS).reshape(-1, 3))
    grid = 2 * np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), axis=-1).reshape(-1, 3)
    inside = np.ones(len(grid), bool)
    for n, d in zip(normals, offsets):
        inside &= grid @ n <= d
    return inside.reshape(shape)


def longest(mask: np.ndarray) -> float:
    """Greatest distance, in voxels, between points half a voxel outside the surface of a mask."""
    padded = np.pad(mask, 1)
    at = np.argwhere(padded)
    tips = []
    for s in _STEPS:
        out = ~padded[tuple((at + s).T)]
        tips.append(2 * at[out] + s)
    p = np.unique(np.concatenate(tips), axis=0)
    best = 0
    for k in range(0, len(p), 512):
        best = max(best, int(((p[k : k + 512, None, :] - p[None, :, :]) ** 2).sum(-1).max()))
    return 0.5 * best**0.5
