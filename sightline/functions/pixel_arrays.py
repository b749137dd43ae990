"""The pixel expressions of ``functions.pixels`` over NumPy arrays, and labelling of connected mask pixels.

Used inside the Arrow pass over images, where a pixel must not become a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sightline.functions.pixels import (
    AUDIT_SAT_ABOVE, AUDIT_VAL_ABOVE, DETECT_SAT_MIN, DETECT_VAL_MIN, GREEN_HUES, HUES, RED_HUES)


def grid_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) blue, green, red of an image; one channel counts as grey, a fourth is dropped."""
    grid = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(grid, 3, axis=2) if channels == 1 else grid[:, :, :3]


def hsv_arrays(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value of the last axis in fixed-point arithmetic; see ``functions.pixels.hsv``."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    val = np.maximum(np.maximum(b, g), r)
    diff = val - np.minimum(np.minimum(b, g), r)

    def scaled(amount: np.ndarray, full: float, base: np.ndarray) -> np.ndarray:
        factor = np.rint(full / np.arange(1, 256)).astype(np.int64)
        return (amount * factor[np.maximum(base, 1) - 1] + 2048) >> 12

    sector = np.where((r >= g) & (r >= b), g - b, np.where(g >= b, b - r + 2 * diff, r - g + 4 * diff))
    return scaled(sector, 122880.0, diff) % HUES, scaled(diff, 1044480.0, val), val


def _in_range(hue: np.ndarray, hues: tuple[int, int]) -> np.ndarray:
    return (hue - hues[0]) % HUES <= (hues[1] - hues[0]) % HUES


def tag_masks(bgr: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Detector masks per colour tag (an empty tag takes both hues), and the value."""
    hue, sat, val = hsv_arrays(bgr)
    bright = (val >= DETECT_VAL_MIN) & (sat >= DETECT_SAT_MIN)
    red, green = bright & _in_range(hue, RED_HUES), bright & _in_range(hue, GREEN_HUES)
    return {"red": red, "green": green, "": red | green}, val


def audit_mask_array(bgr: np.ndarray) -> np.ndarray:
    _, sat, val = hsv_arrays(bgr)
    return (val > AUDIT_VAL_ABOVE) & (sat > AUDIT_SAT_ABOVE)


@dataclass
class Runs:
    """Horizontal runs of masks of one shape, in reading order; ``label`` is the first run of a run's component."""

    image: np.ndarray
    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    label: np.ndarray

    def __len__(self) -> int:
        return len(self.x0)

    @property
    def length(self) -> np.ndarray:
        return self.x1 - self.x0 + 1


def labelled_runs_of(masks: np.ndarray) -> Runs:
    """Runs of (images, height, width) masks with their components, corners touching.

    Runs of neighbouring rows are matched by binary search.
    """
    n, height, width = masks.shape
    padded = np.zeros((n * height, width + 2), dtype=np.int8)
    padded[:, 1:-1] = masks.reshape(n * height, width)
    step = np.diff(padded, axis=1)
    row, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1] - 1
    image, y = row // height, row % height
    # A gap of one row keeps images apart; no run reaches the two columns that pad a row.
    line = (row + image) * (width + 2)
    first = np.searchsorted(line + x1, line + width + 2 + x0 - 1, "left")
    past = np.searchsorted(line + x0, line + width + 2 + x1 + 1, "right")
    links = np.maximum(past - first, 0)
    upper = np.repeat(np.arange(len(x0)), links)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
    return Runs(image, y, x0, x1, least_labels(len(x0), upper, lower))


def least_labels(n: int, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n`` members, which the links (upper, lower) join.

    Labels spread in rounds: each link gives the lesser of its two labels to the holders of both, and labels
    follow their labels until they rest; a round at least halves the number of unfinished components.
    """
    label = np.arange(n)
    while len(upper):
        a, b = label[upper], label[lower]
        open_links = a != b
        if not open_links.any():
            break
        upper, lower, a, b = upper[open_links], lower[open_links], a[open_links], b[open_links]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def linked_runs(group: np.ndarray, node: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Least node of the component of each run, within its group, corners touching.

    Runs come sorted by (group, y, x0).  Runs of one node belong together; runs of one row may overlap.
    """
    if not len(node):
        return node
    # Rows that follow each other in a group differ by one place, all others by more.
    same = np.diff(group) == 0
    step = np.where(same, np.minimum(np.diff(y), 2), 2)
    line = np.concatenate([[0], np.cumsum(step)]) * (x1.max() - x0.min() + 3)
    left, right = line + (x0 - x0.min()), np.maximum.accumulate(line + (x1 - x0.min()))
    width = x1.max() - x0.min() + 3
    first = np.searchsorted(right, left + width - 1, "left")
    past = np.searchsorted(left, line + (x1 - x0.min()) + width + 1, "right")
    links = np.maximum(past - first, 0)
    upper = np.repeat(np.arange(len(node)), links)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
    touching = (x1[lower] >= x0[upper] - 1) & (line[lower] == line[upper] + width)
    order = np.lexsort((node, group))
    fresh = np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(group[order]) != 0)])
    member = np.empty(len(node), dtype=np.int64)
    member[order] = np.cumsum(fresh) - 1
    label = least_labels(int(fresh.sum()), member[upper[touching]], member[lower[touching]])
    return node[order][fresh][label][member]


def run_sums(values: np.ndarray, runs: Runs) -> np.ndarray:
    """Sum of (images, height, width) ``values`` over each run."""
    _, height, width = values.shape
    total = np.concatenate([[0], np.cumsum(values.reshape(-1), dtype=np.int64)])
    base = (runs.image * height + runs.y) * width
    return total[base + runs.x1 + 1] - total[base + runs.x0]
