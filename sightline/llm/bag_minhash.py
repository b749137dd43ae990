"""BagMinHash signatures of weighted sets (multisets), many sets at once.

Each element of the universe owns one Poisson process over (time, weight, register).  A set sees the
points of its elements whose weight level is at most the element's weight; a register takes the first
point it sees.  Two sets agree in a register with probability equal to their weighted Jaccard
similarity.  The weight axis is cut into the intervals (0,1], (1,2], (2,4], (4,8] ... and the point's
random bits say where in its interval it lies, so heavy elements cost the logarithm of their weight
plus the points that are early enough to matter, and all points later than a set's horizon are never
made.  The horizon grows for the sets that still have an empty register.
"""

from __future__ import annotations

import numpy as np

from sightline.llm.textops import mix

# Expected points per register below the first horizon: ln(registers) + SLACK.
SLACK = 3.0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INTERVAL = 0xD1B54A32D192ED03
_PLACE = np.uint64(0x8CB92BA72F3D8DD7)


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """(n_rows, registers) identities of the first points; rows without elements stay 0.

    ``rows``, ``elements`` (64-bit hashes) and integer ``weights`` list each set's distinct elements.
    """
    identity = np.zeros(n_rows * registers, dtype=np.uint64)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    with np.errstate(divide="ignore"):
        horizon = (np.log(registers) + SLACK) / total
    use = np.ones(len(rows), dtype=bool)
    while use.any():
        first = _first_points(rows[use], elements[use], weights[use].astype(np.uint64), horizon, n_rows, registers)
        done = first[0].reshape(n_rows, registers).max(axis=1) < np.inf
        open_rows = np.zeros(n_rows, dtype=bool)
        open_rows[rows[use]] = True
        settled = np.repeat(open_rows & done, registers)
        identity[settled] = first[1][settled]
        horizon = horizon * 2
        use &= ~done[rows]
    return identity.reshape(n_rows, registers)


def _first_points(rows, elements, weights, horizon, n_rows, registers) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(n_rows * registers, np.inf)
    identity = np.zeros(n_rows * registers, dtype=np.uint64)
    low, high, level = 0, 1, 0
    while len(rows):
        width = high - low
        row, weight = rows, weights
        key = mix(elements + np.uint64(_INTERVAL * (level + 1) % (1 << 64)))
        time = np.zeros(len(rows))
        while len(row):
            key = mix(key + _STEP)
            uniform = ((key >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53
            time = time - np.log(uniform) / (registers * width)
            alive = time < horizon[row]
            row, weight, key, time = row[alive], weight[alive], key[alive], time[alive]
            bits = mix(key ^ _PLACE)
            register = ((bits >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            place = np.uint64(low + 1) + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32))
            seen = place <= weight
            at = row[seen] * registers + register[seen]
            t = time[seen]
            np.minimum.at(best, at, t)
            won = best[at] == t
            identity[at[won]] = key[seen][won]
        more = weights > high
        rows, elements, weights = rows[more], elements[more], weights[more]
        low, high, level = high, high * 2, level + 1
    return best, identity
