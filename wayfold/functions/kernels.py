"""All-pairs trajectory distances over numpy arrays of segments, shape (n, 4)."""

from __future__ import annotations

import numpy as np

CELLS, BATCH_CELLS = 1_000_000, 20_000


def _squares(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, 2) to segments (m, 4); coordinates apart, as sums over a short axis are slow."""
    x, y = s[:, 0], s[:, 1]
    dx, dy = s[:, 2] - x, s[:, 3] - y
    square = dx * dx + dy * dy
    left, up = p[:, 0, None] - x, p[:, 1, None] - y
    t = left * (dx / np.where(square == 0, 1.0, square))
    t += up * (dy / np.where(square == 0, 1.0, square))
    np.clip(t, 0, 1, out=t)
    left -= t * dx
    up -= t * dy
    left *= left
    up *= up
    left += up
    return left


def points_to_segments(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distances of points (n, 2) to segments (m, 4)."""
    return np.sqrt(_squares(p, s))


def match_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Segment match distances of all pairs."""
    one = np.maximum(_squares(a[:, :2], b), _squares(a[:, 2:], b))
    other = np.maximum(_squares(b[:, :2], a), _squares(b[:, 2:], a))
    return np.sqrt(np.maximum(one, other.T, out=one), out=one)


def cross_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of segments meets."""
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    p, q, r, s = a[:, None, :2], a[:, None, 2:], b[None, :, :2], b[None, :, 2:]
    t1, t2, t3, t4 = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
    on = lambda t, u, v, w: (t == 0) & ((w >= np.minimum(u, v)) & (w <= np.maximum(u, v))).all(-1)
    return (t1 * t2 < 0) & (t3 * t4 < 0) | on(t1, p, q, r) | on(t2, p, q, s) | on(t3, r, s, p) | on(t4, r, s, q)


def gap_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least distances of all pairs of segments."""
    ends = [points_to_segments(a[:, :2], b), points_to_segments(a[:, 2:], b), points_to_segments(b[:, :2], a).T, points_to_segments(b[:, 2:], a).T]
    return np.where(cross_matrix(a, b), 0.0, np.minimum.reduce(ends))


def box_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the boxes of all pairs of segments."""
    low = lambda s: np.minimum(s[:, :2], s[:, 2:])
    high = lambda s: np.maximum(s[:, :2], s[:, 2:])
    apart = np.maximum(np.maximum(low(a)[:, None] - high(b)[None], low(b)[None] - high(a)[:, None]), 0)
    return np.sqrt((apart * apart).sum(2))


def blocks(a: np.ndarray, b: np.ndarray):
    """Slices of ``a`` of which the matrix with ``b`` has about CELLS cells, so memory doesn't grow with both."""
    step = max(1, CELLS // len(b))
    return (a[k : k + step] for k in range(0, len(a), step))


def directed(a: np.ndarray, b: np.ndarray, matrix=gap_matrix) -> float:
    """Largest of the least distances of the segments of ``a`` to ``b``."""
    return float(max(matrix(part, b).min(1).max() for part in blocks(a, b)))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    far, near = 0.0, np.full(len(b), np.inf)
    for part in blocks(a, b):
        m = match_matrix(part, b)
        far, near = max(far, m.min(1).max()), np.minimum(near, m.min(0))
    return float(max(far, near.max()))


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the segments of the same place meet, by the formulas of ``geometry.segments_intersect``."""
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    (ax, ay, cx, cy), (bx, by, dx, dy) = a.T, b.T
    t1, t2, t3, t4 = turn(ax, ay, cx, cy, bx, by), turn(ax, ay, cx, cy, dx, dy), turn(bx, by, dx, dy, ax, ay), turn(bx, by, dx, dy, cx, cy)

    def on(t, px, py, qx, qy, x, y):
        return (t == 0) & (x >= np.minimum(px, qx)) & (x <= np.maximum(px, qx)) & (y >= np.minimum(py, qy)) & (y <= np.maximum(py, qy))

    return (t1 * t2 < 0) & (t3 * t4 < 0) | on(t1, ax, ay, cx, cy, bx, by) | on(t2, ax, ay, cx, cy, dx, dy) | on(t3, bx, by, dx, dy, ax, ay) | on(t4, bx, by, dx, dy, cx, cy)


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where the segments of the same place meet, 0.5 where coordinates are missing, else 0."""
    return np.where(_meets(a, b), 1.0, np.where(np.isnan(a).any(1) | np.isnan(b).any(1), 0.5, 0.0))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the segments of the same place, by the formulas of ``geometry.segment_min``."""

    def end(px, py, s):
        x1, y1, x2, y2 = s.T
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        t = np.where(square == 0, 0.0, np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(square == 0, 1.0, square), 0, 1))
        ox, oy = px - (x1 + t * dx), py - (y1 + t * dy)
        return np.sqrt(ox * ox + oy * oy)

    ends = [end(a[:, 0], a[:, 1], b), end(a[:, 2], a[:, 3], b), end(b[:, 0], b[:, 1], a), end(b[:, 2], b[:, 3], a)]
    return np.where(_meets(a, b), 0.0, np.fmin.reduce(ends))


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where a ray to the right from the first end in ``b`` crosses the edge of the same place, as in ``Polygon.holds``."""
    (x1, y1, x2, y2), (x, y) = a.T, b.T[:2]
    rise = np.where(y1 == y2, 1.0, y2 - y1)
    return (((y < y1) != (y < y2)) & (x < x1 + (y - y1) * ((x2 - x1) / rise))).astype(float)


#: Functions of pairs of segments, how the pairs of a row are combined, and what a row without pairs gives.
PAIRED = {"meeting": (meeting, np.maximum, 0.0), "apart": (apart, np.fmin, np.nan), "crossed": (crossed, np.add, 0.0)}
PAIRS = 50_000


def row_pairs(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, each, combine, empty: float) -> np.ndarray:
    """``each`` of all pairs of the na segments of ``a`` and the nb of ``b`` that belong to each row, combined to one
    number a row; about PAIRS pairs are held at once, or the other side of one segment."""
    out, counts = np.full(len(na), empty), na * nb
    at, bt = np.cumsum(na) - na, np.cumsum(nb) - nb
    rows = np.flatnonzero(counts)
    total, begin = np.cumsum(counts[rows]), 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - counts[rows[begin]] + PAIRS, "right")))
        some = rows[begin:end]
        n = counts[some]
        if n[0] > PAIRS:  # one row
            r = some[0]
            step, other = max(1, PAIRS // nb[r]), b[bt[r] : bt[r] + nb[r]]
            for k in range(at[r], at[r] + na[r], step):
                part = a[k : min(k + step, at[r] + na[r])]
                out[r] = combine(out[r], combine.reduce(each(np.repeat(part, len(other), 0), np.tile(other, (len(part), 1)))))
        else:
            starts = np.cumsum(n) - n
            place, wide = np.arange(n.sum()) - np.repeat(starts, n), np.repeat(nb[some], n)
            out[some] = combine.reduceat(each(a[np.repeat(at[some], n) + place // wide], b[np.repeat(bt[some], n) + place % wide]), starts)
        begin = end
    return out


def hausdorff_many(parts: list[np.ndarray], query: np.ndarray) -> np.ndarray:
    """``hausdorff`` of each part to one query, several parts in one matrix."""
    out, most = np.zeros(len(parts)), max(1, BATCH_CELLS // len(query))
    begin = 0
    while begin < len(parts):
        end, held = begin + 1, len(parts[begin])
        while end < len(parts) and held + len(parts[end]) <= most:
            held, end = held + len(parts[end]), end + 1
        if held > most:  # one long part
            out[begin] = hausdorff(parts[begin], query)
        else:
            starts = np.cumsum([0, *(len(p) for p in parts[begin : end - 1])])
            m = match_matrix(np.concatenate(parts[begin:end]), query)
            out[begin:end] = np.maximum(np.maximum.reduceat(m.min(1), starts), np.minimum.reduceat(m, starts, axis=0).max(1))
        begin = end
    return out


def grid(low, high, across: int, up: int) -> np.ndarray:
    """Points (n, 2) of a grid in a box."""
    x = low[0] + (np.arange(across) + 0.5) / across * (high[0] - low[0])
    y = low[1] + (np.arange(up) + 1) / up * (high[1] - low[1])
    return np.array([(a, b) for a in x for b in y])


def point_gaps(parts: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Distances of points to trajectories, points x parts. Those of two trajectories to one point differ
    by their Hausdorff distance at most."""
    out, begin = np.empty((len(points), len(parts))), 0
    while begin < len(parts):
        end, held = begin + 1, len(parts[begin])
        while end < len(parts) and held + len(parts[end]) <= BATCH_CELLS:
            held, end = held + len(parts[end]), end + 1
        flat, starts = np.concatenate(parts[begin:end]), np.cumsum([0, *(len(p) for p in parts[begin : end - 1])])
        for k, point in enumerate(points):
            out[k, begin:end] = np.sqrt(np.minimum.reduceat(_squares(point[None], flat)[0], starts))
        begin = end
    return out


def longest(a: np.ndarray, n: int) -> np.ndarray:
    """The n segments with the largest steps, which few others match."""
    return a if len(a) <= n else a[np.argpartition(-np.abs(a[:, 2:] - a[:, :2]).sum(1), n - 1)[:n]]


def maybe_within(parts: list[np.ndarray], query: np.ndarray, r: float, some: int = 8) -> np.ndarray:
    """False where the Hausdorff distance to a query is above ``r`` by the longest segments of either side."""
    hard, out = longest(query, some), np.ones(len(parts), bool)
    most, begin = max(1, BATCH_CELLS // max(len(query), len(hard))), 0
    while begin < len(parts):
        end, held = begin + 1, len(parts[begin])
        while end < len(parts) and held + len(parts[end]) <= most * some:
            held, end = held + len(parts[end]), end + 1
        if held <= most * some:
            starts = np.cumsum([0, *(len(p) for p in parts[begin : end - 1])])
            near = np.minimum.reduceat(match_matrix(hard, np.concatenate(parts[begin:end])), starts, axis=1).max(0) <= r
            left = np.flatnonzero(near) + begin
            out[begin:end] = near
            if len(left):
                own = [longest(parts[j], some) for j in left]
                starts = np.cumsum([0, *(len(p) for p in own[:-1])])
                out[left] = np.maximum.reduceat(match_matrix(np.concatenate(own), query).min(1), starts) <= r if sum(map(len, own)) <= max(1, CELLS // len(query)) else True
        begin = end
    return out


def match_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Segment match distances of rows of the same place."""

    def ends(p: np.ndarray, s: np.ndarray) -> np.ndarray:
        d = s[:, 2:] - s[:, :2]
        square = (d * d).sum(1)
        t = np.clip(((p - s[:, :2]) * d).sum(1) / np.where(square == 0, 1.0, square), 0, 1) * (square > 0)
        off = p - (s[:, :2] + t[:, None] * d)
        return np.sqrt((off * off).sum(1))

    return np.maximum(np.maximum(ends(a[:, :2], b), ends(a[:, 2:], b)), np.maximum(ends(b[:, :2], a), ends(b[:, 2:], a)))


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Frechet distance with match distances as cost, by antidiagonals: three of them are held,
    and the costs of one are taken from a matrix if that is small, else computed for it."""
    n, m = len(a), len(b)
    flat = match_matrix(a, b).ravel() if n * m <= CELLS and m > 1 else None
    last, before, here = (np.full(n + 2, np.inf) for _ in range(3))  # row i is at i + 1; outside it is infinity
    for k in range(n + m - 1):
        low, high = max(0, k - m + 1), min(n - 1, k)
        if flat is not None:  # (i, k - i) is at k + i * (m - 1)
            cost = flat[k + low * (m - 1) : k + high * (m - 1) + 1 : m - 1]
        else:
            i = np.arange(low, high + 1)
            cost = match_pairs(a[i], b[k - i])
        if k:
            best = np.minimum(last[low : high + 1], before[low : high + 1])  # (i - 1, j) and (i - 1, j - 1)
            np.minimum(best, last[low + 1 : high + 2], out=best)
            np.maximum(best, cost, out=here[low + 1 : high + 2])
        else:
            here[1] = cost[0]
        here[low] = here[high + 2] = np.inf  # what the next two diagonals can see of older ones
        last, before, here = here, last, before
    return float(last[n])


def points_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Of two point lists as segments: the smaller of the two directed least distances."""
    return min(directed(a, b), directed(b, a))


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """Indices that recursive splitting at the farthest point keeps, each once."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a > 1:
            far = points_to_segments(points[a + 1 : b], np.concatenate([points[a], points[b]])[None])[:, 0]
            k = int(np.argmax(far))
            if far[k] > eps:
                k += a + 1
                keep.add(k)
                stack += [(a, k), (k, b)]
    return np.array(sorted(keep))


def memoised(distance, limit: int = 100_000):
    """``distance`` of (key, array) pairs that keeps results, each for both orders; emptied when it is full."""
    known: dict[tuple, float] = {}

    def measure(a: tuple, b: tuple) -> float:
        key = (a[0], b[0]) if a[0] <= b[0] else (b[0], a[0])
        found = known.get(key)
        if found is None:
            if len(known) >= limit:
                known.clear()
            found = known[key] = distance(a[1], b[1])
        return found

    return measure


#: Metrics and other measures of two trajectories; a function of two arrays serves as well.
BATCHES = {hausdorff: hausdorff_many}
DISTANCES = {"hausdorff": hausdorff, "frechet": frechet, "points": points_distance}


def measured(parts: list[np.ndarray], query: np.ndarray, measure) -> np.ndarray:
    """The distances of all parts to a query, side by side where the measure has a form for that."""
    many = BATCHES.get(measure)
    return many(parts, query) if many else np.array([measure(p, query) for p in parts], float)
