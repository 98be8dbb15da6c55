"""Banded edit distance of integer sequences."""

from __future__ import annotations

from collections import Counter

import numpy as np

FAR = 1 << 28
CELLS = 120_000
#: Diagonals to each side of the first, narrow band.
NARROW = 12


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without their common beginning and end, which change no distance."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
        end = n - 1 - int(differ[-1]) if len(differ) else n
        a, b = a[: len(a) - end], b[: len(b) - end]
    return a, b


def _block(pairs: list[tuple[np.ndarray, np.ndarray]], half: int) -> np.ndarray:
    """Distances of the pairs by alignments inside a band of half diagonals to each side: exact up to half, else upper bounds."""
    n = max(len(a) for a, _ in pairs)
    width, count = 2 * half + 1, len(pairs)
    # a column for each pair, so that every step runs along all pairs
    left = np.full((n, count), -1, dtype=np.int32)
    right = np.full((n + width + half, count), -2, dtype=np.int32)
    for i, (a, b) in enumerate(pairs):
        left[: len(a), i] = a
        right[half : half + min(len(b), n + width), i] = b[: n + width]
    # distances less the number of their diagonal: what a step along the row costs is gone from them
    steps = np.arange(width)
    row = np.repeat((np.where(steps >= half, steps - half, FAR) - steps).astype(np.int32)[:, None], count, axis=1)
    best, other, differ = row.copy(), row.copy(), np.empty((width, count), dtype=bool)
    last = np.array([len(b) - len(a) + half for a, b in pairs])
    out = np.full(count, FAR, dtype=np.int64)
    ending: dict[int, list[int]] = {}
    for i in np.flatnonzero((last >= 0) & (last < width)).tolist():
        ending.setdefault(len(pairs[i][0]), []).append(i)
    shifts = [1 << k for k in range((width - 1).bit_length())]
    for i in range(n + 1):
        if done := ending.get(i):
            out[done] = row[last[done], done] + last[done]
        if i == n:
            break
        np.not_equal(left[i], right[i : i + width], out=differ)
        np.add(row, differ, out=best)
        row += 2
        np.minimum(best[:-1], row[1:], out=best[:-1])
        # the least so far along the row, of 2, 4, 8, ... of it
        for shift in shifts:
            other[:shift] = best[:shift]
            np.minimum(best[shift:], best[:-shift], out=other[shift:])
            best, other = other, best
        row, best = best, row
    return out


def banded(a: list[int], b: list[int], limit: int) -> int | None:
    """Edit distance of a and b if it is at most limit, else None, by an alignment kept to limit diagonals on each side.

    Bit r of the vectors stands for row j - limit + r of column j, so the band moves down with each column: vertical
    steps up and down (up, down), horizontal ones likewise (right, left), and diagonals without cost (free). The
    distance is followed along the band's lowest diagonal to b's end, then along b's last row.
    """
    n, m = len(b), len(a)
    if abs(n - m) > limit:
        return None
    width = 2 * limit + 1
    mask, top = (1 << width) - 1, 1 << (2 * limit)
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    up, down, d = mask ^ ((1 << limit) - 1), 0, min(limit, n)
    get = places.get
    for j, x in enumerate(a, 1):
        same, shift = get(x, 0), j - limit - 1
        if same:
            same = (same >> shift if shift >= 0 else same << -shift) & mask
        free = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = (down | ~(free | up)) & mask, free & up
        if j + limit <= n:
            d += not free & top
        else:
            at = n - j + limit
            d += (right >> at & 1) - (left >> at & 1)
        if d - (m - j) > limit:
            return None
        free >>= 1
        up, down = (left | ~(free | right)) & mask, free & right
    return d if d <= limit else None


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> list[bool]:
    """Whether the edit distance of each pair is at most its limit.

    Differences in length and in the words' counts spare most alignments of unlike pairs. Many pairs at a time are then
    aligned in a narrow band: a distance found there is an upper bound, which settles most like pairs. The rest are
    aligned in a band as wide as the limit.
    """
    out, work = [False] * len(pairs), []
    for i, ((a, b), limit) in enumerate(zip(pairs, limits)):
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = _trimmed(a, b)
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b)) <= limit
            continue
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        if max(len(a), len(b)) - common <= limit:
            work.append((abs(len(a) - len(b)) + NARROW, len(a), i, a, b))
    work.sort(key=lambda x: (x[0] // 16, x[1]))
    at = 0
    while at < len(work):
        end, half = at + 1, work[at][0]
        while end < len(work) and (end + 1 - at) * (2 * max(half, work[end][0]) + 1) <= CELLS and work[end][0] < half + 16 and work[end][1] <= 2 * work[at][1] + 64:
            half, end = max(half, work[end][0]), end + 1
        some = work[at:end]
        for (_, _, i, a, b), d in zip(some, _block([x[3:] for x in some], half)):
            out[i] = bool(d <= limits[i]) or (half < limits[i] and banded(a.tolist(), b.tolist(), min(limits[i], max(len(a), len(b)))) is not None)
        at = end
    return out


def best_in(pattern: np.ndarray, text: np.ndarray, shift: int, half: int) -> int:
    """Least edit distance of pattern to any stretch of text, on diagonals (text minus pattern position) shift - half to shift + half."""
    width = 2 * half + 1
    padded = np.full(len(pattern) + width, -2, dtype=np.int64)
    start = shift - half
    lo, hi = max(0, start), min(len(text), start + len(padded))
    if hi > lo:
        padded[lo - start : hi - start] = text[lo:hi]
    steps = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i, p in enumerate(pattern):
        best = row + (padded[i : i + width] != p)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        best -= steps
        np.minimum.accumulate(best, out=best)
        row = best + steps
    return int(row.min())
