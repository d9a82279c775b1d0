"""Constant matrices of the perceptual hash and the table of dihedral variants.

The whole way from pixels to coefficients is linear and separable: PDQF = A X A', where
A = D S, S samples a filtered row of 512 pixels at 127 places and D holds 16 rows of the
discrete cosine transform.  Everything is computed once, in double precision.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIZE, COARSE, ORDER = 512, 127, 16
#: Weights of the tent filter, by distance from its centre.
TENT = (3 / 9, 2 / 9, 1 / 9)
#: BT.601 luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)
QUALITY_DIVISOR = 180.0
DEFAULT_RADIUS = 31
MODES = ("variant", "precise")

#: ord, name, 2x2 matrix (x to x, x to y, y to x, y to y), then how its coefficients come
#: from the original's: transposed, even columns negated, even rows negated.  Fixed values: the
#: matrices of ord 5 and 7 are the published ones, though their names suggest others.
DIHEDRALS = (
    (0, "NORMAL", (1, 0, 0, 1), (False, False, False)),
    (1, "FLOPPED", (-1, 0, 0, 1), (False, True, False)),
    (2, "ROTATED_180", (-1, 0, 0, -1), (False, True, True)),
    (3, "FLIPPED", (1, 0, 0, -1), (False, False, True)),
    (4, "ROTATED_90_FLOPPED", (0, -1, -1, 0), (True, False, False)),
    (5, "ROTATED_270", (0, 1, 1, 0), (True, False, True)),
    (6, "FLOPPED_ROTATED_270", (0, -1, 1, 0), (True, True, True)),
    (7, "ROTATED_90", (0, 1, -1, 0), (True, True, False)),
)


def dct_matrix() -> np.ndarray:
    """16 x 127: frequencies 1 to 16, the constant one left out."""
    i, j = np.arange(1, ORDER + 1)[:, None], np.arange(COARSE)[None, :]
    return np.sqrt(2 / COARSE) * np.cos(np.pi / (2 * COARSE) * i * (2 * j + 1))


def tent_matrix() -> np.ndarray:
    """127 x 512: the tent at pixels 4, 8, ..., 508."""
    out = np.zeros((COARSE, SIZE))
    for i in range(COARSE):
        for d, w in enumerate(TENT):
            out[i, 4 * (i + 1) - d] = out[i, 4 * (i + 1) + d] = w
    return out


def precise_matrix() -> np.ndarray:
    """127 x 512: a box of three pixels (fewer at the edges) applied twice, then sampled."""
    near = np.abs(np.subtract.outer(np.arange(SIZE), np.arange(SIZE))) <= 1
    box = near / near.sum(axis=1, keepdims=True)
    return (box @ box)[[(2 * i + 1) * SIZE // (2 * COARSE) for i in range(COARSE)]]


@lru_cache(maxsize=4)
def places(mode: str = "variant") -> np.ndarray:
    """Pixels on which the tents of the sampler stand; two boxes of three are the tent as well, and no edge is near enough to cut one."""
    i = np.arange(COARSE)
    return 4 * (i + 1) if mode == "variant" else (2 * i + 1) * SIZE // (2 * COARSE)


@lru_cache(maxsize=4)
def sampler(mode: str = "variant") -> np.ndarray:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    return tent_matrix() if mode == "variant" else precise_matrix()


@lru_cache(maxsize=4)
def projection(mode: str = "variant") -> np.ndarray:
    """A: 16 x 512."""
    return dct_matrix() @ sampler(mode)


@lru_cache(maxsize=256)
def triangle(size: int) -> np.ndarray:
    """512 x size: scaling by a triangle filter, which widens with the step when pictures shrink; each row sums to one."""
    step = size / SIZE
    wide = max(step, 1.0)
    centre, at = (np.arange(SIZE) + 0.5)[:, None] * step - 0.5, np.arange(size)[None, :]
    w = np.maximum(1 - np.abs(at - centre) / wide, 0)
    return w / w.sum(axis=1, keepdims=True)


@lru_cache(maxsize=256)
def scaled_sampler(mode: str, size: int) -> np.ndarray:
    """S R: 127 x size."""
    return sampler(mode) if size == SIZE else sampler(mode) @ triangle(size)


@lru_cache(maxsize=256)
def scaled_projection(mode: str, size: int) -> np.ndarray:
    """A R: 16 x size."""
    return projection(mode) if size == SIZE else projection(mode) @ triangle(size)


@lru_cache(maxsize=2)
def whole_dct() -> np.ndarray:
    """The cosines in whole units of 2**-32 (as doubles, which hold them exactly)."""
    return np.rint(dct_matrix() * 2.0**32)


@lru_cache(maxsize=4)
def whole_sampler(mode: str) -> np.ndarray:
    """The sampler in whole ninths, or thirty-sixths in precise mode."""
    return np.rint(sampler(mode) * (9 if mode == "variant" else 36))


def pack_matrix(m: tuple[int, int, int, int]) -> int:
    """Four signed bytes, most significant first, as an unsigned 32-bit number."""
    return int.from_bytes(bytes(x & 0xFF for x in m), "big")


def dihedral_index(ord_: int) -> tuple[np.ndarray, np.ndarray]:
    """Source index and sign of each of the 256 coefficients of a variant."""
    transposed, cols, rows = DIHEDRALS[ord_][3]
    i = np.arange(256)
    r, c = i // 16, i % 16
    sign = np.where(cols & (c % 2 == 0), -1, 1) * np.where(rows & (r % 2 == 0), -1, 1)
    return (c * 16 + r if transposed else i), sign
