"""Seeded augmentations of image and mask arrays; compositions take (image, mask, generator)."""

from __future__ import annotations

import numpy as np


def flip(image, mask, rng):
    """Each axis is reversed with probability one half."""
    at = tuple(slice(None, None, -1) if rng.random() < 0.5 else slice(None) for _ in range(image.ndim))
    return image[at], mask[at]


def rotate90(image, mask, rng):
    k = int(rng.integers(0, 4))
    return np.rot90(image, k, (-2, -1)), np.rot90(mask, k, (-2, -1))


def noise(sigma: float):
    return lambda image, mask, rng: (image + rng.normal(0, sigma, image.shape), mask)


def brightness(most: float):
    return lambda image, mask, rng: (image + rng.uniform(-most, most), mask)


def contrast(lo: float, hi: float):
    def run(image, mask, rng):
        m = image.mean()
        return (image - m) * rng.uniform(lo, hi) + m, mask

    return run


def gamma(lo: float, hi: float):
    def run(image, mask, rng):
        a, b = image.min(), image.max()
        return ((image - a) / (b - a)) ** rng.uniform(lo, hi) * (b - a) + a if b > a else image, mask

    return run


def sometimes(p: float, step):
    return lambda image, mask, rng: step(image, mask, rng) if rng.random() < p else (image, mask)


def compose(*steps):
    def run(image, mask, rng):
        for s in steps:
            image, mask = s(image, mask, rng)
        return image, mask

    return run


def default_pipeline():
    """Flips, turns, and mild intensity changes."""
    return compose(flip, rotate90, sometimes(0.5, noise(0.02)), sometimes(0.5, brightness(0.1)), sometimes(0.5, contrast(0.8, 1.2)), sometimes(0.3, gamma(0.8, 1.25)))


def apply(image: np.ndarray, mask: np.ndarray, seed: int, key: int, pipeline=None):
    """The pipeline with a generator that depends on the seed and the row's key alone."""
    return (pipeline or default_pipeline())(image, mask, np.random.default_rng([seed, key]))
