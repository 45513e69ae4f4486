"""Overlap of polygons of any simple shape, for batches of Arrow rows.

Rings are padded to one width by repeating their last vertex, which changes no
area.  A convex ring is clipped by the half planes of another one, all pairs of
a batch at once; any other ring is the signed sum of the triangles of its fan.
Areas change continuously with the vertices, so touching and nearly equal
edges need no cases of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers that a batch of rings may hold at once.
CHUNK = 1 << 20


def rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vertices (n, 2) and the number of them in each row; a null row or vertex has none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = column.flatten()
    xy = np.stack([pc.fill_null(pc.struct_field(v, c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in "xy"], axis=1) if len(v) else np.zeros((0, 2))
    return xy, size


def padded(xy: np.ndarray, size: np.ndarray, width: int | None = None) -> np.ndarray:
    """Rings (rows, width, 2), each filled up with its last vertex; empty rings are zeros."""
    width = int(size.max(initial=1)) if width is None else width
    first = np.cumsum(size) - size
    at = first[:, None] + np.minimum(np.arange(max(width, 1)), np.maximum(size - 1, 0)[:, None])
    out = xy[np.minimum(at, max(len(xy) - 1, 0))] if len(xy) else np.zeros((len(size), max(width, 1), 2))
    out[size == 0] = 0.0
    return out


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def signed_areas(x: np.ndarray) -> np.ndarray:
    """Shoelace areas of rings (rows, vertices, 2), taken from the first vertex so that far rings lose no digits."""
    d = x - x[:, :1]
    return cross(d, np.roll(d, -1, axis=1)).sum(axis=1) / 2


def clipped_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared area of each convex ring of x with the convex ring of y in its row, both counter-clockwise."""
    y = y - x[:, :1]
    x = x - x[:, :1]
    rows = np.arange(len(x))[:, None]
    for e in range(y.shape[1]):
        a, edge = y[:, e][:, None], (y[:, (e + 1) % y.shape[1]] - y[:, e])[:, None]
        side = cross(edge, x - a)
        after, x2 = np.roll(side, -1, axis=1), np.roll(x, -1, axis=1)
        inside = side >= 0
        enters = np.roll(inside, -1, axis=1)
        turn = inside != enters
        if not turn.any() and inside.all():
            continue
        t = np.where(turn, side / np.where(turn, side - after, 1.0), 0.0)
        at = np.stack([x + t[..., None] * (x2 - x), x2], axis=2).reshape(len(x), -1, 2)
        keep = np.stack([turn, enters], axis=2).reshape(len(x), -1)
        n = keep.sum(axis=1)
        new = np.zeros((len(x), max(int(n.max(initial=0)), 1), 2))
        r, c = np.nonzero(keep)
        new[r, (np.cumsum(keep, axis=1) - 1)[r, c]] = at[r, c]
        x = new[rows, np.minimum(np.arange(new.shape[1]), np.maximum(n - 1, 0)[:, None])]
    return np.abs(signed_areas(x))


def _fan(xy: np.ndarray, size: np.ndarray, convex: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings as counter-clockwise convex pieces with signs: (vertices, sizes, row of each piece, sign); a convex ring is its own."""
    first = np.cumsum(size) - size
    pieces = np.where(convex, 1, np.maximum(size - 2, 0))
    row = np.repeat(np.arange(len(size)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole = convex[row]
    tri = np.stack([first[row], first[row] + k + 1, first[row] + k + 2], axis=1)
    sign = np.ones(len(row))
    if (~whole).any():
        p = xy[np.minimum(tri, len(xy) - 1)]
        turn = cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        sign = np.where(whole, 1.0, np.sign(turn))
        tri[:, 1:] = np.where((turn < 0)[:, None], tri[:, :0:-1], tri[:, 1:])
    n = np.where(whole, size[row], 3)
    start = np.where(whole, first[row], 0)
    at = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    inside = np.repeat(whole, n)
    at[~inside] = tri[~whole].reshape(-1)
    return xy[at], n, row, sign


def shared_areas(a: pa.Array, b: pa.Array, convex_a: np.ndarray, convex_b: np.ndarray) -> np.ndarray:
    """Shared area of the two rings of each row; both simple, counter-clockwise and without repeated neighbours."""
    (xa, na), (xb, nb) = rings(a), rings(b)
    pa_, ra, row_a, sa = _fan(xa, na, convex_a)
    pb_, rb, row_b, sb = _fan(xb, nb, convex_b)
    # Every piece of a row's one ring meets every piece of the other.
    ka, kb = np.bincount(row_a, minlength=len(na)), np.bincount(row_b, minlength=len(nb))
    fa, fb = np.cumsum(ka) - ka, np.cumsum(kb) - kb
    many = ka * kb
    row = np.repeat(np.arange(len(na)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    i, j = fa[row] + k // np.maximum(kb[row], 1), fb[row] + k % np.maximum(kb[row], 1)
    at_a, at_b = np.cumsum(ra) - ra, np.cumsum(rb) - rb
    out = np.zeros(len(na))
    # Pairs of like size together, so that padding stays small.
    wide = np.maximum(ra[i], rb[j]) if len(i) else np.zeros(0, np.int64)
    order = np.argsort(wide, kind="stable")
    take = lambda p, start, n: padded(p[np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)], n)
    a0 = 0
    while a0 < len(order):
        step = max(1, CHUNK // (4 * int(wide[order[a0]]) + 8))
        a1 = int(min(a0 + step, np.searchsorted(wide[order], 2 * wide[order[a0]], side="right")))
        o = order[a0:a1]
        s = clipped_areas(take(pa_, at_a[i[o]], ra[i[o]]), take(pb_, at_b[j[o]], rb[j[o]]))
        np.add.at(out, row[o], s * sa[i[o]] * sb[j[o]])
        a0 = a1
    return np.maximum(out, 0.0)


def _cross_themselves(v: np.ndarray) -> np.ndarray:
    """For each of the rings (rows, vertices, 2): do edges that aren't neighbours meet, or neighbours run back on each other?"""
    n, w = v.shape[1], np.roll(v, -1, axis=1)
    d = w - v
    e = np.roll(d, -1, axis=1)
    bad = ((cross(d, e) == 0) & ((d * e).sum(axis=2) < 0)).any(axis=1)
    for i in range(n - 2):
        j = slice(i + 2, n - (i == 0))
        a, b, p, q, u, f = v[:, i, None], w[:, i, None], v[:, j], w[:, j], d[:, i, None], d[:, j]
        if not p.shape[1]:
            continue
        s1, s2 = np.sign(cross(u, p - a)), np.sign(cross(u, q - a))
        s3, s4 = np.sign(cross(f, a - p)), np.sign(cross(f, b - p))
        within = lambda x, y, z: ((x >= np.minimum(y, z)) & (x <= np.maximum(y, z))).all(axis=-1)
        meets = (s1 * s2 < 0) & (s3 * s4 < 0)
        meets |= (s1 == 0) & within(p, a, b) | (s2 == 0) & within(q, a, b)
        meets |= (s3 == 0) & within(a, p, q) | (s4 == 0) & within(b, p, q)
        bad |= meets.any(axis=1)
    return bad


def shaped(poly: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Rings turned counter-clockwise without repeated neighbours, whether each is convex, and whether it is a simple ring with an area.

    Rows that aren't (fewer than three vertices, null or NaN coordinates,
    crossing or touching themselves) come back as empty rings.
    """
    xy, size = rings(poly)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    before = np.arange(len(xy)) - 1
    before[first[size > 0]] = (first + size - 1)[size > 0]
    keep = (xy != xy[before]).any(axis=1) if len(xy) else np.zeros(0, bool)
    good = np.ones(len(size), dtype=bool)
    np.logical_and.at(good, row, np.isfinite(xy).all(axis=1))
    xy, row = xy[keep], row[keep]
    size = np.bincount(row, minlength=len(good))
    good &= size >= 3
    xy, row = xy[good[row]], row[good[row]]
    size = np.bincount(row, minlength=len(good))
    first = np.cumsum(size) - size
    after = np.arange(len(xy)) + 1
    after[(first + size - 1)[size > 0]] = first[size > 0]
    near = xy - xy[first[row]]
    area = np.bincount(row, cross(near, near[after]), minlength=len(good)) / 2 if len(xy) else np.zeros(len(good))
    good &= area != 0
    # Turned round where the area is negative.
    k = np.arange(len(xy)) - first[row]
    xy = xy[np.where(area[row] < 0, first[row] + size[row] - 1 - k, np.arange(len(xy)))]
    d = xy[after] - xy
    turn, along = cross(d, d[after]), (d * d[after]).sum(axis=1)
    bent = np.bincount(row, (turn < 0) | (turn == 0) & (along < 0), minlength=len(good)) > 0
    round_ = np.bincount(row, np.arctan2(turn, along), minlength=len(good))
    convex = good & ~bent & (np.abs(round_ - 2 * np.pi) < 1)
    # Rings of one size are tested together.
    bent = np.flatnonzero(good & ~convex)
    for n in np.unique(size[bent]).tolist():
        same = bent[size[bent] == n]
        for at in np.array_split(same, -(-len(same) * n // CHUNK)):
            good[at] = ~_cross_themselves(xy[first[at][:, None] + np.arange(n)])
    xy = xy[good[row]]
    size = np.where(good, size, 0)
    v = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), v), convex, good


def _half_hulls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower chains of the sorted points (rows, points, 2) and their lengths: each point drops those before it that don't turn left."""
    chain, n = np.zeros_like(x), np.zeros(len(x), dtype=np.int64)
    for k in range(x.shape[1]):
        p, left = x[:, k], np.arange(len(x))
        while len(left := left[n[left] >= 2]):
            a, b = chain[left, n[left] - 2], chain[left, n[left] - 1]
            left = left[cross(b - a, p[left] - a) <= 0]
            n[left] -= 1
        chain[np.arange(len(x)), n] = p
        n += 1
    return chain, n


def hulls(poly: pa.Array) -> pa.Array:
    """Counter-clockwise convex hull of the vertices of each row; null with fewer than three corners, or with a null or NaN vertex."""
    xy, size = rings(poly)
    first = np.cumsum(size) - size
    known = size >= 3
    np.logical_and.at(known, np.repeat(np.arange(len(size)), size), ~np.isnan(xy).any(axis=1))
    parts, owner = [np.zeros((0, 2))], [np.zeros(0, np.int64)]
    # Rows of one size are wrapped together.
    for n in np.unique(size[known]).tolist():
        same = np.flatnonzero(known & (size == n))
        for at in np.array_split(same, -(-len(same) * n // CHUNK)):
            x = xy[first[at][:, None] + np.arange(n)]
            x = np.take_along_axis(x, np.lexsort((x[..., 1], x[..., 0]))[..., None], axis=1)
            (low, a), (high, b) = _half_hulls(x), _half_hulls(x[:, ::-1])
            # The last point of a chain is the first of the other one.
            used = np.concatenate([np.arange(n) < (a - 1)[:, None], np.arange(n) < (b - 1)[:, None]], axis=1)
            used &= (a + b - 2 >= 3)[:, None]
            parts.append(np.concatenate([low, high], axis=1)[used])
            owner.append(np.repeat(at, used.sum(axis=1)))
    corners, row = np.concatenate(parts), np.concatenate(owner)
    corners = corners[np.argsort(row, kind="stable")]
    size = np.bincount(row, minlength=len(size))
    v = pa.StructArray.from_arrays([pa.array(corners[:, 0].copy()), pa.array(corners[:, 1].copy())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), v, mask=pa.array(size == 0))
