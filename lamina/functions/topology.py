"""Topology of masks: Betti numbers, skeleton overlap, and losses from them; canvases for overlays."""

from __future__ import annotations

import numpy as np

from lamina.functions.kernels import components, thin2d


def euler2d(mask: np.ndarray) -> int:
    """Vertices minus edges plus faces of a 2-D mask with 4-connected pixels as vertices."""
    m = mask.astype(int)
    return int(m.sum() - (m[1:] * m[:-1]).sum() - (m[:, 1:] * m[:, :-1]).sum() + (m[1:, 1:] * m[1:, :-1] * m[:-1, 1:] * m[:-1, :-1]).sum())


def betti2d(mask: np.ndarray) -> tuple[int, int]:
    """Components and holes of a 2-D mask."""
    b0 = components(mask.astype(bool))[1]
    return b0, b0 - euler2d(mask)


def betti_loss(prediction: np.ndarray, target: np.ndarray, at: float = 0.5) -> int:
    """Differences of both Betti numbers."""
    p, t = betti2d(prediction > at), betti2d(target > at)
    return abs(p[0] - t[0]) + abs(p[1] - t[1])


def skeleton_recall(prediction: np.ndarray, target: np.ndarray) -> float:
    """Share of the target's skeleton that the prediction covers; 1 for an empty skeleton."""
    s = thin2d(target > 0)
    return float(prediction[s].sum() / s.sum()) if s.any() else 1.0


def cl_dice(a: np.ndarray, b: np.ndarray) -> float:
    """Harmonic mean of how much of each mask's skeleton lies in the other; 1 if both are empty."""
    if not a.any() and not b.any():
        return 1.0
    p, r = skeleton_recall(b.astype(float), a), skeleton_recall(a.astype(float), b)
    return 2 * p * r / (p + r) if p + r else 0.0


def canvas(height: int, width: int) -> np.ndarray:
    return np.zeros((height, width, 4), np.uint8)


def draw_line(image: np.ndarray, y0: int, x0: int, y1: int, x1: int, colour: tuple) -> None:
    """A line of pixels; parts outside the canvas are cut off."""
    n = max(abs(y1 - y0), abs(x1 - x0), 1)
    y, x = np.rint(np.linspace(y0, y1, n + 1)).astype(int), np.rint(np.linspace(x0, x1, n + 1)).astype(int)
    ok = (y >= 0) & (y < image.shape[0]) & (x >= 0) & (x < image.shape[1])
    image[y[ok], x[ok]] = colour


def draw_rectangle(image: np.ndarray, y0: int, x0: int, y1: int, x1: int, colour: tuple) -> None:
    for a, b in (((y0, x0), (y0, x1)), ((y1, x0), (y1, x1)), ((y0, x0), (y1, x0)), ((y0, x1), (y1, x1))):
        draw_line(image, *a, *b, colour)


def draw_disc(image: np.ndarray, y: float, x: float, radius: float, colour: tuple) -> None:
    """All pixels within the radius; a colour of zeros erases."""
    yy, xx = np.indices(image.shape[:2])
    image[(yy - y) ** 2 + (xx - x) ** 2 <= radius * radius] = colour


def blend(below: np.ndarray, above: np.ndarray, alpha: float, mode: str = "alpha") -> np.ndarray:
    """"alpha", "additive" or "multiply" of two images in 0..255."""
    a, b = below.astype(float), above.astype(float)
    out = {"alpha": a * (1 - alpha) + b * alpha, "additive": a + alpha * b, "multiply": a * (1 - alpha + alpha * b / 255)}[mode]
    return np.clip(out, 0, 255).astype(np.uint8)
