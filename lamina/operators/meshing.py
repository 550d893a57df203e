"""Small dense helpers for one patch or group: terms, triangles, simplification, least squares."""

from __future__ import annotations

import heapq

import numpy as np


def polynomial_terms(degree: int) -> list[tuple[int, int]]:
    """Exponents (of y, of x) with sum up to ``degree``."""
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def triangles(rows: int, cols: int) -> np.ndarray:
    """Two triangles a cell of a grid, as vertex indices."""
    i = np.arange(rows * cols).reshape(rows, cols)
    a, b, c, d = i[:-1, :-1].ravel(), i[:-1, 1:].ravel(), i[1:, :-1].ravel(), i[1:, 1:].ravel()
    return np.concatenate([np.stack([a, b, c], 1), np.stack([b, d, c], 1)])


def simplify(vertices: np.ndarray, faces: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadric edge collapse, the cheapest edge of all first, down to ``target`` faces; a mesh with no more is copied."""
    v, f = vertices.astype(float).copy(), [tuple(map(int, t)) for t in faces]
    quadric = np.zeros((len(v), 4, 4))
    for t in f:
        n = np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]])
        if np.linalg.norm(n):
            n = n / np.linalg.norm(n)
            plane = np.append(n, -n @ v[t[0]])
            for i in t:
                quadric[i] += np.outer(plane, plane)
    alive, version = set(range(len(f))), np.zeros(len(v), int)
    owner = {i: {k for k, t in enumerate(f) if i in t} for i in range(len(v))}

    def cost(a, b):
        p = np.append((v[a] + v[b]) / 2, 1)
        return float(p @ (quadric[a] + quadric[b]) @ p)

    heap = [(cost(a, b), a, b, 0, 0) for a, b in {tuple(sorted(e)) for t in f for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))}]
    heapq.heapify(heap)
    while len(alive) > target and heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or not owner[a] or not owner[b]:
            continue
        v[a], quadric[a] = (v[a] + v[b]) / 2, quadric[a] + quadric[b]
        for k in list(owner[b]):
            t = tuple(a if i == b else i for i in f[k])
            if len(set(t)) < 3:
                alive.discard(k)
                for i in f[k]:
                    owner[i].discard(k)
            else:
                f[k] = t
                owner[a].add(k)
        owner[b] = set()
        version[a] += 1
        version[b] += 1
        for i in {i for k in owner[a] for i in f[k]} - {a}:
            x, y = sorted((a, i))
            heapq.heappush(heap, (cost(x, y), x, y, version[x], version[y]))
    kept = sorted({i for k in alive for i in f[k]})
    at = {i: k for k, i in enumerate(kept)}
    return v[kept], np.array([[at[i] for i in f[k]] for k in sorted(alive)], int).reshape(-1, 3)


def levenberg_marquardt(residual, x: np.ndarray, iterations: int = 50, damping: float = 1e-3, eps: float = 1e-6) -> np.ndarray:
    """Minimise |residual(x)|^2 with a finite-difference Jacobian."""
    x = x.astype(float).copy()
    r = residual(x)
    for _ in range(iterations):
        j = np.stack([(residual(x + eps * e) - r) / eps for e in np.eye(len(x))], 1)
        h = j.T @ j
        step = np.linalg.solve(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), -j.T @ r)
        new = residual(x + step)
        if new @ new < r @ r:
            x, r, damping = x + step, new, damping / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 4
    return x


def levenberg_marquardt_many(residual, x: np.ndarray, iterations: int = 50, damping: float = 1e-3, eps: float = 1e-6) -> np.ndarray:
    """``levenberg_marquardt`` of many problems at once, each with its own damping and end: ``residual(x[k], k)`` gives a row for each of the problems ``k``."""
    x, live = x.astype(float).copy(), np.arange(len(x))
    r, damped = residual(x, live), np.full(len(x), damping)
    for _ in range(iterations):
        if not len(live):
            break
        p, q = x[live], r[live]
        j = np.stack([(residual(p + eps * e, live) - q) / eps for e in np.eye(x.shape[1])], 2)
        h = np.swapaxes(j, 1, 2) @ j
        d = np.maximum(np.diagonal(h, axis1=1, axis2=2), 1e-12)
        step = np.linalg.solve(h + damped[live, None, None] * d[:, :, None] * np.eye(x.shape[1]), -(q[:, None, :] @ j).swapaxes(1, 2))[..., 0]
        new = residual(p + step, live)
        better = (new * new).sum(1) < (q * q).sum(1)
        x[live[better]], r[live[better]] = (p + step)[better], new[better]
        damped[live] *= np.where(better, 1 / 3, 4.0)
        live = live[~(better & (np.abs(step).max(1) < 1e-12))]
    return x
