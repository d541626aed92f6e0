"""Decoding to the E8 lattice, and hash keys of lattice cells."""

from __future__ import annotations

import itertools

import numpy as np

DIMENSIONS = 8


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: D8."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight: E8 is D8 and D8 shifted by a half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(DIMENSIONS), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            out.append([a if k == i else b if k == j else 0.0 for k in range(DIMENSIONS)])
    for signs in itertools.product((0.5, -0.5), repeat=DIMENSIONS):
        if sum(sign < 0 for sign in signs) % 2 == 0:
            out.append(list(signs))
    return np.array(out)


STEPS = shortest()


def nearest_and_neighbours(x: np.ndarray, more: int) -> np.ndarray:
    """Each row's lattice point, then the ``more`` neighbours closest to it: n x (1 + more) x 8."""
    home = nearest(x)
    # |rest - step|^2 = |rest|^2 - 2 rest.step + 2, and the first and last are the same for all
    order = np.argpartition(-((x - home) @ STEPS.T), more - 1, axis=1)[:, :more]
    return np.concatenate([home[:, None], home[:, None] + STEPS[order]], axis=1)


class Tables:
    """Hash tables over vectors of one dimension: random projections to blocks of eight."""

    def __init__(self, dimension: int, tables: int, blocks: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dimension])
        self.tables, self.blocks = tables, blocks
        n = tables * blocks
        self.planes = rng.normal(0.0, scale, (dimension, n * DIMENSIONS))
        self.shift = rng.uniform(0.0, 2.0, n * DIMENSIONS)
        self.odd = rng.integers(1, 1 << 62, (n, DIMENSIONS), dtype=np.int64) | 1
        self.salt = rng.integers(1, 1 << 62, tables, dtype=np.int64)

    def keys(self, unit: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
        """Home keys, n x tables, and the keys to ask for, n x tables x asked; home comes first.

        A key mixes the table and its blocks' points; equal points have equal keys.
        """
        n, many = len(unit), self.tables * self.blocks
        points = (unit @ self.planes + self.shift).reshape(n * many, DIMENSIONS)
        found = np.rint(2 * nearest_and_neighbours(points, neighbours)).astype(np.int64)
        found = found.reshape(n, many, 1 + neighbours, DIMENSIONS)
        with np.errstate(over="ignore"):
            mixed = (found * self.odd[None, :, None, :]).sum(axis=3)
            mixed = mixed.reshape(n, self.tables, self.blocks, 1 + neighbours)
            asked = np.broadcast_to(self.salt[None, :, None], (n, self.tables, 1)).copy()
            for block in range(self.blocks):
                asked = _stir(asked[..., None] + mixed[:, :, block, None, :]).reshape(
                    n, self.tables, -1)
        return asked[:, :, 0], asked


def _stir(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers stirred, so that sums of keys don't meet by chance."""
    y = x.astype(np.uint64)
    y = (y ^ (y >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (y ^ (y >> np.uint64(29))).astype(np.int64)
