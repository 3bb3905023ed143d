"""Pure NumPy kernels over one tile: morphology, components, distance, min-cut.

``present`` marks pixels inside the image; absent pixels are neutral.
"""

from __future__ import annotations

import numpy as np

from tidewright.functions import constants as K


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of ``2 * radius + 1`` places."""
    out = []
    for dy in range(-radius, radius + 1):
        half = round(radius * (1 - (dy / radius) ** 2) ** 0.5) if radius else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def _shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[r, c] = a[r + dy, c + dx]``, ``fill`` outside."""
    h, w = a.shape
    out = np.full_like(a, fill)
    r0, r1, c0, c1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = a[r0 + dy : r1 + dy, c0 + dx : c1 + dx]
    return out


def dilate(m: np.ndarray, present: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros_like(m)
    inside = m & present
    for dy, dx in ellipse(radius):
        out |= _shifted(inside, dy, dx, False)
    return out & present


def erode(m: np.ndarray, present: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~m, present, radius) & present


def close_open(m: np.ndarray, present: np.ndarray, close_r: int, open_r: int) -> np.ndarray:
    if close_r > 0:
        m = erode(dilate(m, present, close_r), present, close_r)
    if open_r > 0:
        m = dilate(erode(m, present, open_r), present, open_r)
    return m


def open_close(m: np.ndarray, present: np.ndarray, open_r: int, close_r: int) -> np.ndarray:
    return close_open(close_open(m, present, 0, open_r), present, close_r, 0)


def gradient(m: np.ndarray, present: np.ndarray) -> np.ndarray:
    return dilate(m, present, 1) & ~erode(m, present, 1)


def edge_band(m: np.ndarray, present: np.ndarray, radius: int) -> np.ndarray:
    edge = gradient(m, present)
    return dilate(edge, present, radius) if radius > 0 else edge


def components(m: np.ndarray) -> np.ndarray:
    """8-connected components: each pixel gets the least row-major place of its own, else -1.

    Runs of set pixels in a row are joined by union-find with the runs they
    touch in the row above.
    """
    h, w = m.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = m
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]  # past the last pixel
    up = np.arange(len(rows))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = np.searchsorted(rows, np.arange(h + 1))
    for r in range(1, h):
        a, b = int(first[r - 1]), int(first[r])
        i, j, last = a, b, int(first[r + 1])
        while i < b and j < last:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:  # touching, diagonals included
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.full((h, w), -1, np.int64)
    roots = np.array([find(k) for k in range(len(rows))], np.int64)
    for r, s, e, root in zip(rows.tolist(), starts.tolist(), ends.tolist(), roots.tolist(), strict=True):
        out[r, s:e] = rows[root] * w + starts[root]
    return out


def chamfer(source: np.ndarray, straight: float = K.CHAMFER_STRAIGHT, diagonal: float = K.CHAMFER_DIAGONAL) -> np.ndarray:
    """3x3 chamfer distance to the nearest source pixel; a fixed one where there is none."""
    if not source.any():
        return np.full(source.shape, K.NO_WATER_PX)
    return relax(np.where(source, 0.0, np.inf), straight, diagonal)


def relax(known: np.ndarray, straight: float = K.CHAMFER_STRAIGHT, diagonal: float = K.CHAMFER_DIAGONAL) -> np.ndarray:
    """Least of ``known`` plus the 3x3 chamfer distance to it, by a pass down and one up."""
    h, w = known.shape
    d = known.copy()
    place = np.arange(w) * straight
    for rows in (range(h), range(h - 1, -1, -1)):
        last = None
        for r in rows:
            row = d[r]
            if last is not None:
                row = np.minimum(row, last + straight)
                row[1:] = np.minimum(row[1:], last[:-1] + diagonal)
                row[:-1] = np.minimum(row[:-1], last[1:] + diagonal)
            right = np.minimum.accumulate(row - place) + place
            left = (np.minimum.accumulate((row + place)[::-1]))[::-1] - place
            d[r] = last = np.minimum(row, np.minimum(right, left))
    return d


def contrast(img: np.ndarray) -> np.ndarray:
    """1 + gain * exp(-gradient / decay), the gradient scaled by its greatest value."""
    gy = np.gradient(img, axis=0) if img.shape[0] > 1 else np.zeros_like(img)
    gx = np.gradient(img, axis=1) if img.shape[1] > 1 else np.zeros_like(img)
    g = np.hypot(gy, gx)
    return 1.0 + K.CONTRAST_GAIN * np.exp(-(g / (g.max() + 1e-6)) / K.CONTRAST_DECAY)


def spatial_weights(dist_m: np.ndarray) -> np.ndarray:
    """Contrast times the coastal modulator, for each year of a (T, H, W) stack."""
    near = K.ANISO_BASE + K.ANISO_GAIN * np.exp(-dist_m / K.ANISO_DECAY_M)
    return np.stack([contrast(d) for d in dist_m]) * near


#: Neighbour steps (dt, dr, dc) of the space-time grid; a step and its reverse follow each other.
STEPS = ((0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 0, 0))


def _pair(shape: tuple[int, ...], step: tuple[int, int, int]) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """Slices of the nodes that have a neighbour by ``step``, and of those neighbours."""
    here = tuple(slice(max(0, -d), n - max(0, d)) for n, d in zip(shape, step, strict=True))
    there = tuple(slice(max(0, d), n - max(0, -d)) for n, d in zip(shape, step, strict=True))
    return here, there


def edge_capacities(weights: np.ndarray, grow: np.ndarray, shrink: np.ndarray) -> list[np.ndarray]:
    """Capacities by step: both ends' weights between neighbours of a year; growth from t to t+1, shrink back."""
    out = []
    for step in STEPS:
        cap = np.zeros(weights.shape)
        here, there = _pair(weights.shape, step)
        if step[0] == 0:
            cap[here] = weights[here] + weights[there]
        elif step[0] == 1:
            cap[here] = grow[here]
        else:
            cap[here] = shrink[there]  # from t+1 to t, charged by year t
        out.append(cap)
    return out


def cut_energy(label: np.ndarray, cost_true: np.ndarray, cost_false: np.ndarray, caps: list[np.ndarray]) -> float:
    """Energy of a labelling: unary costs, and capacities of edges from False to True."""
    total = float(np.where(label, cost_true, cost_false).sum())
    for step, cap in zip(STEPS, caps, strict=True):
        here, there = _pair(label.shape, step)
        total += float((cap[here] * (~label[here] & label[there])).sum())
    return total


def min_cut(cost_true: np.ndarray, cost_false: np.ndarray, caps: list[np.ndarray]) -> np.ndarray:
    """Labels of least energy on a (T, H, W) grid, by push-relabel on whole arrays.

    False pays ``cost_false``, True pays ``cost_true``; an edge i -> j is paid
    when i is False and j True (False is the source side).  All nodes push in
    one direction at a time, so no two pushes meet; heights are set anew by a
    breadth-first search from the sink every few sweeps.  A node is True when
    it can still reach the sink; others are False.
    """
    shape = cost_true.shape
    caps = [c.astype(float).copy() for c in caps]
    flow = np.minimum(cost_true, cost_false)
    excess = cost_true - flow  # what the source can still send through a node (cut if True)
    to_sink = cost_false - flow  # what the node can still send to the sink (cut if False)
    pairs = [_pair(shape, s) for s in STEPS]
    limit = int(np.prod(shape)) + 2
    eps = 1e-9

    def heights() -> np.ndarray:
        """Steps to the sink in the residual graph; ``limit`` where there is no way."""
        h = np.full(shape, limit, np.int64)
        front = to_sink > eps
        h[front] = 1
        level = 1
        while front.any():
            level += 1
            new = np.zeros(shape, bool)
            for (here, there), cap in zip(pairs, caps, strict=True):
                new[here] |= front[there] & (cap[here] > eps)
            front = new & (h == limit)
            h[front] = level
        return h

    h = heights()
    sweep = 0
    while True:
        active = (excess > eps) & (h < limit)
        if not active.any():
            h = heights()
            active = (excess > eps) & (h < limit)
            if not active.any():
                return h < limit
        push = np.where(active, np.minimum(excess, to_sink), 0.0)
        excess -= push
        to_sink -= push
        for k, (here, there) in enumerate(pairs):
            ok = (excess[here] > eps) & (h[here] < limit) & (h[here] == h[there] + 1)
            push = np.where(ok, np.minimum(excess[here], caps[k][here]), 0.0)
            if push.any():
                caps[k][here] -= push
                caps[k ^ 1][there] += push
                excess[here] -= push
                excess[there] += push
        sweep += 1
        if sweep % 8 == 0:
            h = heights()
            continue
        least = np.where(to_sink > eps, 0, limit)
        for (here, there), cap in zip(pairs, caps, strict=True):
            near = np.where(cap[here] > eps, h[there], limit)
            least[here] = np.minimum(least[here], near)
        active = (excess > eps) & (h < limit)
        h = np.where(active, np.minimum(np.maximum(h, least + 1), limit), h)


def temporal_smooth(p: np.ndarray, weights=K.TEMPORAL_WEIGHTS) -> np.ndarray:
    """Centred weighted mean along time; weights of missing years are left out."""
    t, half = len(p), len(weights) // 2
    if t <= 1:
        return p
    out = np.empty_like(p)
    for k in range(t):
        a, b = max(0, k - half), min(t, k + half + 1)
        w = np.array(weights[half - k + a : half - k + b])
        out[k] = np.tensordot(w, p[a:b], 1) / w.sum() if w.sum() > 1e-8 else p[k]
    return np.clip(out, 0.0, 1.0)


def persistent_decline(p: np.ndarray, years: int = K.RETREAT_YEARS) -> np.ndarray:
    """Least one-year decline over ``years`` years from each on; the tail uses the years there are."""
    d = np.clip(np.concatenate([p[:1], p[:-1]]) - p, 0.0, 1.0)
    out = d.copy()
    for k in range(1, max(1, years)):
        out = np.minimum(out, np.concatenate([d[k:], np.repeat(d[-1:], min(k, len(d)), axis=0)])[: len(d)])
    return out


def label_block(water: np.ndarray, port: np.ndarray, dist_m: np.ndarray) -> np.ndarray:
    """Port labels of a (T, H, W) block: non-water cut and port cut, both true."""
    log = lambda x: -np.log(np.clip(x, 1e-6, 1.0))
    weights = spatial_weights(dist_m)
    grow, shrink = np.full_like(water, K.L1_FORWARD), K.L1_BACKWARD * (1.0 - water)
    dry = min_cut(log(1.0 - water), log(water), edge_capacities(weights, grow, shrink))
    p = temporal_smooth(np.clip(port, 0.0, 1.0))
    sure = 1.0 / (1.0 + np.exp(-(p - K.EXPAND_MID) * K.EXPAND_SLOPE))
    grow = (K.L2_FWD_BASE + K.L2_FWD_GAIN * p) * (1.0 - K.RETREAT_RELAX * persistent_decline(p))
    bonus = K.L2_BWD_BONUS * np.exp(-dist_m / K.L2_DECAY_M) * sure
    shrink = K.L2_BWD_BASE + K.L2_BWD_GAIN * (1.0 - sure) - bonus
    caps = edge_capacities(weights, np.maximum(grow, K.FWD_MIN), np.maximum(shrink, K.L2_BWD_MIN))
    return dry & min_cut(log(p), log(1.0 - p), caps)


def affine_warp(img: np.ndarray, degrees: float, scale: float, dr: float, dc: float, nearest: bool) -> np.ndarray:
    """Rotation and scaling about (height / 2, width / 2), then a shift by (dr, dc); bilinear or nearest, mirrored borders.

    A positive angle turns counter-clockwise, rows counted downwards.  Every pixel takes its value from where the
    inverse of that mapping puts it.
    """
    h, w = img.shape
    a = np.deg2rad(degrees)
    cy, cx = h / 2, w / 2
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - cy - dr, x - cx - dc
    sx = (np.cos(a) * x - np.sin(a) * y) / scale + cx
    sy = (np.sin(a) * x + np.cos(a) * y) / scale + cy

    def mirror(i: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(i) % (2 * (n - 1))
        return np.where(i < n, i, 2 * (n - 1) - i)

    if nearest:
        return img[mirror(np.floor(sy + 0.5).astype(int), h), mirror(np.floor(sx + 0.5).astype(int), w)]
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    at = lambda i, j: img[mirror(i, h), mirror(j, w)]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + low * fy
