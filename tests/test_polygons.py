"""Overlap and rasters of polygons of any simple shape and direction."""

import numpy as np
import pyarrow as pa
import pytest

from planarium.functions import rings
from planarium.operators import pairs, raster

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
ANGLE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
CUP = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
NAN = float("nan")
CELLS = "cell_id long, cx double, cy double, clipped boolean, poly array<struct<x:double,y:double>>"


def moved(ring, x, y, s=1.0):
    return [(s * a + x, s * b + y) for a, b in ring]


#: Two rings, and what they share over the smaller area (None: no pair).
CASES = [
    (SQUARE, moved(SQUARE, 0.5, 0), 0.5), (SQUARE, moved(SQUARE, 0.5, 0)[::-1], 0.5), (SQUARE[::-1], moved(SQUARE, 0.5, 0)[::-1], 0.5),
    (SQUARE, moved(SQUARE, 1, 0), None), (SQUARE, moved(SQUARE, 1, 1), None), (moved(SQUARE, -1, -1, 4), SQUARE, 1.0), (SQUARE, SQUARE, 1.0),
    (ANGLE, moved(SQUARE, 1, 1), None), (ANGLE, ANGLE[::-1], 1.0), (ANGLE, moved(SQUARE, 0.5, 0.5), 0.75), (CUP, moved([(0, 0), (3, 0), (3, 0.5), (0, 0.5)], 0, 2), 2 / 3), (CUP, ANGLE, 1.0),
    ([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)], SQUARE, None), ([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 0.0), (0.0, 2.0)], SQUARE, None), ([(0.0, 0.0), (2.0, 0.0), (1.0, 0.0), (1.0, 1.0)], SQUARE, None),
    ([*SQUARE, SQUARE[0]], [SQUARE[0], *SQUARE], 1.0), ([(0.0, 0.0), (0.5, 0.0), *SQUARE[1:]], moved(SQUARE, 0, 0.5), 0.5),
    ([(0.0, 0.0), (1.0, 0.0)], SQUARE, None), ([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], SQUARE, None), (None, SQUARE, None), ([(0.0, 0.0), (NAN, 0.0), (1.0, 1.0)], SQUARE, None), ([(0.0, 0.0), None, (1.0, 1.0)], SQUARE, None),
]


def test_coverage_of_any_rings(spark):
    rows = []
    for i, (a, b, _) in enumerate(CASES):
        # Each case in a place of its own, far from all others and from the origin.
        x = 1e4 + 100.0 * i
        far = lambda r, x=x: None if r is None else [None if p is None else (p[0] + x, p[1]) for p in r]
        rows += [(2 * i, x, 0.0, False, far(a)), (2 * i + 1, x + 0.1, 0.0, False, far(b))]
    cells = spark.createDataFrame(rows, CELLS)
    got = {r["i"] // 2: (r["j"] - r["i"], r["cf"]) for r in pairs.coverage_map(cells, 9.0).collect()}
    assert got == {i: (1, pytest.approx(cf, abs=1e-9)) for i, (_, _, cf) in enumerate(CASES) if cf}
    both = {r["i"] // 2 for r in pairs.iou_pairs(cells).collect()}
    assert both == set(got)


def star(rng, n, x, y):
    a = np.sort(rng.random(n) + np.arange(n)) * 2 * np.pi / n
    r = 0.3 + rng.random(n)
    p = list(zip((x + r * np.cos(a)).tolist(), (y + r * np.sin(a)).tolist()))
    return p if rng.random() < 0.5 else p[::-1]


def inside(ring, x, y):
    c = np.zeros(x.shape, dtype=bool)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        m = (y1 <= y) != (y2 <= y)
        c ^= m & (x < (x2 - x1) * (y - y1) / np.where(m, y2 - y1, 1.0) + x1)
    return c


def test_random_concave_rings(spark):
    rng = np.random.default_rng(2)
    rings = [star(rng, int(rng.integers(4, 15)), *rng.random(2) * 3) for _ in range(40)]
    cells = spark.createDataFrame([(i, 0.0, 0.0, False, r) for i, r in enumerate(rings)], CELLS)
    got = {(r["i"], r["j"]): r["iou"] for r in pairs.iou_pairs(cells).collect()}
    n = 700
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * 6 - 1.5, (np.arange(n) + 0.5) / n * 6 - 1.5)
    masks = [inside(r, x, y) for r in rings]
    for i in range(40):
        for j in range(i + 1, 40):
            want = (masks[i] & masks[j]).sum() / (masks[i] | masks[j]).sum()
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=0.01)
    counts = {(r["row"], r["col"]): r["n"] for r in raster.coverage_raster(cells, (-1.5, 4.5, -1.5, 4.5), 70).collect()}
    px, py = np.meshgrid((np.arange(70) + 0.5) / 70 * 6 - 1.5, (np.arange(70) + 0.5) / 70 * 6 - 1.5)
    total = sum(inside(r, px, py).astype(int) for r in rings)
    assert counts == {(int(a), int(b)): int(total[a, b]) for a, b in zip(*np.nonzero(total))}


def test_boxes_of_very_mixed_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(x + s), float(y + s * t)) for i, (x, y, s, t) in enumerate(zip(rng.random(150) * 100, rng.random(150) * 100, 10 ** (rng.random(150) * 5 - 3), rng.random(150) * 2))]
    rows += [(200, 5.0, 5.0, 5.0, 5.0), (201, 5.0, 5.0, 5.0, 5.0), (202, 4.0, 4.0, 6.0, 6.0)]
    got = [(r["i"], r["j"]) for r in pairs.box_pairs(spark.createDataFrame(rows, "cell_id long, x0 double, y0 double, x1 double, y1 double")).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_raster_edges(spark):
    rows = [(1, 0.0, 0.0, False, CUP[::-1]), (2, 0.0, 0.0, False, None), (3, 0.0, 0.0, False, [(0.0, 0.0), (NAN, 1.0), (1.0, 1.0)]), (4, 0.0, 0.0, False, [(0.0, 0.0), (1.0, 1.0)])]
    cells = spark.createDataFrame(rows, CELLS)
    box = (0.0, 3.0, 0.0, 3.0)
    assert {(r["row"], r["col"], r["n"]) for r in raster.coverage_raster(cells, box, 3).collect()} == {(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 2, 1)}
    assert raster.hull_raster(cells, box, 3).count() == 9 and raster.coverage_runs(cells, box, 3).count() == 5
    assert raster.coverage_raster(cells, (10.0, 12.0, 0.0, 1.0), 4).count() == 0


def test_rings_of_one_size_are_tested_together():
    ell = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (-1, 2), (-1, 0)]
    touch = [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 2)]
    back = [(0, 0), (3, 0), (1, 0), (1, 2), (0, 2), (0, 1)]
    assert rings._cross_themselves(np.array([ell, bow, ell[::-1], touch, back], dtype=float)).tolist() == [False, True, False, True, True]


def plain_hull(ring):
    if ring is None or any(p is None or p[0] != p[0] or p[1] != p[1] for p in ring):
        return None
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def chain(points):
        out = []
        for p in points:
            while len(out) >= 2 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    v = sorted(set(ring))
    h = chain(v) + chain(v[::-1])
    return h if len(h) >= 3 else None


def test_hulls_of_a_batch_are_those_of_its_rings():
    """Copies, points on one line, nulls and NaN among them."""
    rng = np.random.default_rng(4)
    rows = [[tuple(map(float, p)) for p in np.round(rng.normal(size=(int(rng.integers(0, 12)), 2)), int(rng.integers(0, 3))) + 0.0] for _ in range(500)]
    rows += [None, [(0.0, 0.0), None, (1.0, 1.0), (2.0, 0.0)], [(0.0, 0.0), (NAN, 1.0), (1.0, 1.0)], [(0.0, 0.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], CUP, CUP[::-1]]
    column = pa.array([r and [p and {"x": p[0], "y": p[1]} for p in r] for r in rows], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    got = [r and [(p["x"], p["y"]) for p in r] for r in rings.hulls(column).to_pylist()]
    assert got == [plain_hull(r) for r in rows]
