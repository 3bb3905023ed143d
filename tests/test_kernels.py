"""NumPy kernels against plain restatements and enumeration."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.functions import kernels as N

masks = st.integers(1, 9).flatmap(
    lambda h: st.integers(1, 9).flatmap(
        lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))
    )
)


def flood(m):
    """Least row-major place of each component, by flood fill."""
    out = np.full(m.shape, -1)
    for r, c in zip(*np.nonzero(m), strict=True):
        if out[r, c] >= 0:
            continue
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and out[y, x] < 0:
                out[y, x] = r * m.shape[1] + c
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


@given(masks)
def test_components_equal_flood_fill(m):
    assert (N.components(m) == flood(m)).all()


@given(masks)
def test_components_partition_survives_flips(m):
    a, b = N.components(m), N.components(m[::-1, ::-1])[::-1, ::-1]
    assert len(set(a[m].tolist())) == len(set(b[m].tolist())) == len(set(zip(a[m].tolist(), b[m].tolist(), strict=True)))


@given(masks)
def test_chamfer_is_the_least_over_sources(m):
    d = N.chamfer(m)
    ys, xs = np.nonzero(m)
    for r in range(m.shape[0]):
        for c in range(m.shape[1]):
            if not len(ys):
                assert d[r, c] == 1e6
                continue
            a, b = np.abs(ys - r), np.abs(xs - c)
            assert d[r, c] == pytest.approx((0.955 * np.abs(a - b) + 1.3693 * np.minimum(a, b)).min())


@given(masks, st.integers(1, 3))
def test_morphology_laws(m, radius):
    here = np.ones_like(m)
    assert (N.dilate(m, here, radius) >= m).all()
    assert (N.erode(m, here, radius) <= m).all()
    closed = N.close_open(m, here, radius, 0)
    assert (N.close_open(closed, here, radius, 0) == closed).all()


@pytest.mark.parametrize("radius, widths", [(1, [1, 3, 1]), (2, [1, 5, 5, 5, 1]), (3, [1, 5, 7, 7, 7, 5, 1])])
def test_ellipse_rows(radius, widths):
    rows = [sum(1 for a, _ in N.ellipse(radius) if a == dy) for dy in range(-radius, radius + 1)]
    assert rows == widths


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([(1, 2, 3), (2, 2, 2), (3, 2, 1), (2, 3, 2), (3, 1, 3)]))
def test_min_cut_is_the_least_of_all_labellings(seed, shape):
    rng = np.random.default_rng(seed)
    true, false = rng.random(shape) * 3, rng.random(shape) * 3
    caps = N.edge_capacities(rng.random(shape), rng.random(shape) * 2, rng.random(shape) * 2)
    best = min(
        N.cut_energy(np.array(v).reshape(shape), true, false, caps)
        for v in itertools.product((False, True), repeat=int(np.prod(shape)))
    )
    found = N.min_cut(true, false, caps)
    assert N.cut_energy(found, true, false, caps) == pytest.approx(best, abs=1e-6)


def test_growth_pays_forward_and_shrink_pays_backward():
    grow, shrink = np.full((2, 1, 1), 3.0), np.full((2, 1, 1), 5.0)
    caps = N.edge_capacities(np.zeros((2, 1, 1)), grow, shrink)
    zero = np.zeros((2, 1, 1))
    up, down = np.array([False, True]).reshape(2, 1, 1), np.array([True, False]).reshape(2, 1, 1)
    assert N.cut_energy(up, zero, zero, caps) == 3.0
    assert N.cut_energy(down, zero, zero, caps) == 5.0


@given(st.lists(st.floats(0, 1), min_size=1, max_size=9))
def test_temporal_kernels(values):
    p = np.array(values).reshape(-1, 1, 1)
    flat = np.full_like(p, 0.4)
    assert N.temporal_smooth(flat) == pytest.approx(flat)
    one = np.clip(np.concatenate([p[:1], p[:-1]]) - p, 0, 1)
    assert (N.persistent_decline(p, 2) <= one + 1e-12).all()


def test_warp_without_motion_is_the_image():
    x = np.arange(30.0).reshape(5, 6)
    assert N.affine_warp(x, 0, 1, 0, 0, False) == pytest.approx(x)
    assert (N.affine_warp(x, 0, 1, 0, 0, True) == x).all()


def plain_warp(img, degrees, scale, dr, dc):
    """The published 2 x 3 matrix, its inverse by linear algebra, one pixel at a time; nearest."""
    h, w = img.shape
    a, b = scale * np.cos(np.deg2rad(degrees)), scale * np.sin(np.deg2rad(degrees))
    cx, cy = w / 2, h / 2
    m = np.array([[a, b, (1 - a) * cx - b * cy + dc], [-b, a, b * cx + (1 - a) * cy + dr], [0, 0, 1]])
    back = np.linalg.inv(m)
    place = lambda v, n: int(np.floor(v + 0.5))

    def mirror(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i

    out = np.empty_like(img)
    for r, c in np.ndindex(h, w):
        x, y, _ = back @ (c, r, 1)
        out[r, c] = img[mirror(place(y, h), h), mirror(place(x, w), w)]
    return out


@pytest.mark.parametrize("shape", [(8, 8), (7, 7), (6, 9), (9, 6)])
@pytest.mark.parametrize("move", [(90, 1, 0, 0), (180, 1, 0, 0), (-90, 1, 0, 0), (0, 1, 2, -3), (0, 2, 0, 0), (90, 1, 1, 2)])
def test_warp_follows_the_matrix(shape, move):
    x = np.arange(float(np.prod(shape))).reshape(shape)
    shifted = N.affine_warp(x + 0.0, *move[:2], move[2] + 1e-7, move[3] + 1e-7, True)  # off the borders between pixels
    assert (shifted == plain_warp(x, *move[:2], move[2] + 1e-7, move[3] + 1e-7)).all()


def test_quarter_turn_takes_a_point_where_the_matrix_does():
    x = np.zeros((8, 8))
    x[4, 7] = 1.0  # row 4, column 7: (x, y) = (7, 4) goes to (4, 1)
    assert np.argwhere(N.affine_warp(x, 90, 1, 0, 0, True) == 1.0).tolist() == [[1, 4]]


def plain_labels(water, port, dist):
    """Both layers by trying all labellings of the published energy, edge by edge."""
    t, h, w = water.shape
    log = lambda v: -np.log(np.clip(v, 1e-6, 1))

    def weights(k):
        gy, gx = np.gradient(dist[k])
        g = np.sqrt(gy**2 + gx**2)
        return (1 + 5 * np.exp(-(g / (g.max() + 1e-6)) / 0.1)) * (0.5 + 1.5 * np.exp(-dist[k] / 500))

    lam = np.stack([weights(k) for k in range(t)])

    def solve(yes, no, grow, shrink):
        best, won = np.inf, None
        for v in itertools.product((False, True), repeat=t * h * w):
            x = np.array(v).reshape(t, h, w)
            e = np.where(x, yes, no).sum()
            for k, r, c in np.ndindex(t, h, w):
                for dr, dc in ((0, 1), (1, 0)):
                    if r + dr < h and c + dc < w and x[k, r, c] != x[k, r + dr, c + dc]:
                        e += lam[k, r, c] + lam[k, r + dr, c + dc]
                if k + 1 < t:
                    e += grow[k, r, c] if not x[k, r, c] and x[k + 1, r, c] else 0
                    e += shrink[k, r, c] if x[k, r, c] and not x[k + 1, r, c] else 0
            if e < best - 1e-9:
                best, won = e, x
        return won

    dry = solve(log(1 - water), log(water), np.full_like(water, 2.0), 50 * (1 - water))
    p = N.temporal_smooth(np.clip(port, 0, 1))
    sure = 1 / (1 + np.exp(-(p - 0.55) * 6))
    grow = np.maximum((20 + 50 * p) * (1 - 0.6 * N.persistent_decline(p)), 2)
    shrink = np.maximum(2 + 40 * (1 - sure) - 6 * np.exp(-dist / 200) * sure, 1)
    return dry & solve(log(p), log(1 - p), grow, shrink)


@pytest.mark.parametrize("seed", range(6))
def test_block_labels_have_least_energy(seed):
    rng = np.random.default_rng(seed)
    shape = [(2, 2, 2), (3, 2, 2), (2, 2, 3)][seed % 3]
    water, port, dist = rng.random(shape), rng.random(shape), rng.random(shape) * 400
    assert (N.label_block(water, port, dist) == plain_labels(water, port, dist)).all()
