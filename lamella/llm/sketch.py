"""Odd sketches exact enough to tell a similarity just below the limit from one at it."""
from __future__ import annotations

import numpy as np

from .text import mix

#: Sets up to SMALL are their own MinHash sample; larger ones are dealt by one permutation to 2 ** SAMPLE_BITS bins, the smallest of each bin is kept.
SMALL, SAMPLE_BITS, BITS = 3000, 12, 13
SLACK = 0.008


def slack(total: np.ndarray, least: float) -> np.ndarray:
    """What bits that met may take from the similarity of two small sets of `total` elements together: five deviations at `least`, SLACK at the least.
    With d elements in one set alone, the estimate of d has the variance w/4 (exp(4 d / w) - 1) - d over w bits."""
    width, alone = 1 << BITS, total * (1 - least) / (1 + least)
    spread = np.sqrt(np.maximum(width / 4 * np.expm1(4 * alone / width) - alone, 0))
    return np.maximum(SLACK, 5 * spread * 2 * total / (total + alone) ** 2)


def fine_sketch(s: np.ndarray) -> bytes:
    """Of a set of hashes: the parity bitmap of the sample, then the bitmap of the bins that are not empty (none for small sets)."""
    g, full = mix(s ^ np.uint64(0x5851F42D4C957F2D)), np.zeros(1 << SAMPLE_BITS, np.uint8)
    if len(g) > SMALL:
        g = np.sort(g)
        bins = g >> np.uint64(64 - SAMPLE_BITS)
        lead = np.r_[True, bins[1:] != bins[:-1]]
        g, full[bins.astype(np.int64)] = g[lead], 1
    odd = np.bincount((mix(g) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint8) & 1
    return np.packbits(odd).tobytes() + np.packbits(full).tobytes()


def allowed(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray, least: float) -> np.ndarray:
    """Which rows of `many` (unsigned bytes, as fine_sketch makes them) may have at least `least` Jaccard similarity to `one`, whose
    sets have n_many and n_one elements. Bits that differ tell how many sample values stand in one sample alone. Of small sets that
    gives the similarity but for bits that met (slack); of large ones the bins full in either give the union of the
    samples, and five deviations of sampling are granted as well. A small and a large set are told apart by size only."""
    size, width = (1 << BITS) // 8, 1 << BITS
    z = np.bitwise_count(one[:size].view(np.uint64) ^ np.ascontiguousarray(many[:, :size]).view(np.uint64)).sum(1, dtype=np.int64)
    alone = np.where(2 * z < width, -width / 2 * np.log(np.maximum(1 - 2 * z / width, 1e-300)), np.inf)
    total = n_one + n_many
    with np.errstate(invalid="ignore"):
        small = np.where(np.isinf(alone), 0.0, (total - alone) / (total + alone)) >= least - slack(total, least)
    bins, mine = np.ascontiguousarray(many[:, size:]).view(np.uint64), one[size:].view(np.uint64)
    either = np.maximum(np.bitwise_count(mine | bins).sum(1, dtype=np.int64), 1)
    both = np.bitwise_count(mine).sum(dtype=np.int64) + np.bitwise_count(bins).sum(1, dtype=np.int64)
    unseen = np.clip(1 - either * (1 + least) / total, 0, 1)
    large = (both - alone) / 2 / either >= least - 5 * np.sqrt(least * (1 - least) * unseen / either) - SLACK
    kinds = (n_many > SMALL).astype(int) + int(n_one > SMALL)
    return (np.minimum(n_one, n_many) >= least * np.maximum(n_one, n_many)) & np.choose(kinds, [small, np.ones(len(many), bool), large])
