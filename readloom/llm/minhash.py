"""ProbMinHash sketches of weighted word shingles."""

from __future__ import annotations

import numpy as np

from . import words

#: Words of a shingle; bands and rows of a sketch. At a similarity of 0.8 a pair shares no band with probability 5e-6.
SHINGLE, BANDS, ROWS = 5, 40, 6


def shingles(h: np.ndarray, first: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: (shingle, text, count), sorted by text and shingle."""
    g, own = words.grams(h, first, n)
    if not len(g):
        return g, own, own
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])]))
    return g[at], own[at], np.diff(np.concatenate([at, [len(g)]]))


def sketch(g: np.ndarray, own: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """For each text and register the shingle whose arrival there is first.

    Shingle d of weight w sends arrivals of a Poisson process of rate w to random registers, the same in every text. A shingle
    stops once its arrivals come after the latest first arrival of its text's registers. Two texts agree in a register with
    the probability Jaccard similarity of their weighted shingles (with equal weights: the Jaccard similarity).
    """
    earliest = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    live, at, turn = np.arange(len(g)), np.zeros(len(g)), 0
    while len(live):
        draw = words.mixed(g[live], 2 * turn + 3)
        at = at - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[live]
        slot = own[live] * size + (words.mixed(draw, 2 * turn + 4) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, slot, at)
        won = at == earliest[slot]
        winner[slot[won]] = g[live[won]]
        latest = earliest.reshape(texts, size).max(1)
        on = at < latest[own[live]]
        live, at, turn = live[on], at[on], turn + 1
    return winner.reshape(texts, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band, which names the band too."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    for k in range(rows):
        out = words.mixed(out ^ parts[:, :, k], 40 + k)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
