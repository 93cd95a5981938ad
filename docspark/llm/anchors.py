"""Content-defined anchors: positions that any two equal byte strings of a length share.

Every GRAM bytes have a hash. Of each string of LENGTH bytes the grams with the least hash
are anchors. Which they are depends on the string's bytes alone, so equal strings
have the same anchors at the same places, and to find all repeats it is enough to
compare what surrounds anchors of equal hash. One position in about 60 is an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH, GRAM = 200, 64
#: Grams in a string of LENGTH bytes.
SPAN = LENGTH - GRAM + 1
#: Window starts that are handled at a time: bounds memory to about 50 bytes each.
PIECE = 1 << 20
# odd multipliers of the hash over a gram's words, and of its final mix
_A, _B, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        h ^= h >> np.uint64(31)
        h *= _A
        h += words[i : i + n] * _B
    h ^= h >> np.uint64(33)
    h *= _M
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))


def anchors(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the anchors in texts that lie end to end in ``data``, bounded by ``offsets``; those near the cut of two pieces come twice."""
    end_of_data = int(offsets[-1])
    for a in range(int(offsets[0]), end_of_data - LENGTH + 1, piece):
        b = min(a + piece, end_of_data - LENGTH + 1)
        h = gram_hashes(data[a : b + LENGTH - 1])
        least = _sliding(h, SPAN, np.minimum)  # of the string that starts here
        for end in offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b + LENGTH, "left") + 1]:
            least[max(0, int(end) - LENGTH + 1 - a) : max(0, int(end) - a)] = 0  # it would leave its text
        padded = np.zeros(len(least) + 2 * (SPAN - 1), np.uint64)
        padded[SPAN - 1 : SPAN - 1 + len(least)] = least
        at = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == h)
        yield at + a, h[at]
