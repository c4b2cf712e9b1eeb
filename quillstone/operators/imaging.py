"""Image operators in numpy, for use inside a recognition plug-in: threshold, skew, rules.

Recognition engines and image libraries are external; these are the steps that need
none. Arrays are gray pages (uint8, 255 is white).
"""

from __future__ import annotations

import numpy as np


def otsu(gray: np.ndarray) -> int:
    """Threshold that parts the gray values into two classes with the least variance inside them."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def sauvola(gray: np.ndarray, window: int = 25, k: float = 0.2, spread: float = 128.0, band: int = 512) -> np.ndarray:
    """Local threshold mean * (1 + k * (deviation / spread - 1)); text 0, else 255.

    Sums over windows come from prefix sums of one band of rows at a time.
    """
    window |= 1
    pad = window // 2
    wide = np.pad(gray.astype(np.float64), pad, mode="symmetric")
    out = np.empty(gray.shape, np.uint8)

    def sums(x: np.ndarray) -> np.ndarray:
        c = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return c[window:, window:] - c[:-window, window:] - c[window:, :-window] + c[:-window, :-window]

    for top in range(0, gray.shape[0], band):
        own = wide[top : top + band + 2 * pad]
        mean = sums(own) / window**2
        deviation = np.sqrt(np.maximum(sums(own * own) / window**2 - mean * mean, 0.0))
        limit = mean * (1 + k * (deviation / spread - 1))
        out[top : top + band] = np.where(gray[top : top + band] > limit, 255, 0)
    return out


def sheared_variance(ink: np.ndarray, degrees: float) -> float:
    """Variance of row sums of the ink turned by a small angle (columns are shifted, which is the same to first order)."""
    h, w = ink.shape
    y, x = np.nonzero(ink)
    rows = np.round(y - np.tan(np.radians(degrees)) * (x - w / 2.0)).astype(int)
    return float(np.bincount(rows[(rows >= 0) & (rows < h)], minlength=h).var())


def find_skew(gray: np.ndarray, width: int = 700) -> float:
    """Angle in degrees (±5 by half, then by a twentieth) that makes rows clearest; 0 if the gain is under 2 %."""
    step = max(1, -(-gray.shape[1] // width))
    small = gray[::step, ::step]
    ink = small <= otsu(small)
    if ink.sum() < 200:
        return 0.0
    coarse = max(np.arange(-5, 5.5, 0.5), key=lambda a: sheared_variance(ink, a))
    best = max(np.arange(coarse - 0.5, coarse + 0.55, 0.05), key=lambda a: sheared_variance(ink, a))
    flat = sheared_variance(ink, 0.0)
    return 0.0 if flat > 0 and sheared_variance(ink, best) / flat < 1.02 else round(float(best), 2)


def _long_runs(ink: np.ndarray, least: int) -> np.ndarray:
    """Ink in horizontal runs of at least ``least`` pixels."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out = np.zeros(ink.shape, bool)
    for (row, begin), (_, end) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
        if end - begin >= least:
            out[row, begin:end] = True
    return out


def remove_rules(binary: np.ndarray, across: float = 0.25, down: float = 0.05) -> np.ndarray:
    """A binary page (text 0) without lines over a quarter of its width or a twentieth of its height."""
    ink = binary == 0
    rules = _long_runs(ink, max(1, int(across * ink.shape[1]))) | _long_runs(ink.T, max(1, int(down * ink.shape[0]))).T
    return np.where(rules, 255, binary).astype(np.uint8)


def components(ink: np.ndarray) -> list[tuple[int, int, int]]:
    """(width, height, area) of eight-connected pieces of ink, by joining runs of rows."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    last: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for begin, end in edges.reshape(-1, 2):
            parent.append(len(parent))
            boxes.append([begin, y, end, y + 1, end - begin])
            own = len(parent) - 1
            for b, e, i in last:
                if b <= end and begin <= e:
                    a, c = root(own), root(i)
                    if a != c:
                        parent[a] = c
                        x, z = boxes[c], boxes[a]
                        boxes[c] = [min(x[0], z[0]), min(x[1], z[1]), max(x[2], z[2]), max(x[3], z[3]), x[4] + z[4]]
            now.append((begin, end, own))
        last = now
    return [(b[2] - b[0], b[3] - b[1], int(b[4])) for i, b in enumerate(boxes) if parent[i] == i]
