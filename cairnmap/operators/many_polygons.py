"""The descriptors of many small polygons at once, by array operations over all polygons of as many corners.

A triangle belongs to the Delaunay triangulation if no other corner lies in its circle; with few corners all triples are
tried.  Where corners lie on a circle together, or two in one place, several triangulations are right: such polygons, and
those of more than MOST corners, go through ``geometry``, one by one, so both give the same rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from . import geometry

#: Corners up to which all triples are tried; numbers of one step.
MOST, STEP = 16, 1 << 19
#: A corner that is this near to a circle, as a share of its radius squared, is on it.
HAIR = 1e-9


def _delaunay(p: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which triples (columns) are Delaunay triangles of the polygons (rows), and which polygons leave a choice."""
    b, n, _ = p.shape
    mid = p.mean(1)
    reach = np.abs(p - mid[:, None]).max((1, 2))
    # The three far corners of geometry.delaunay decide which flat triangles at the border count.
    far = 1e4 * reach[:, None, None] * np.array([[-1.0, -1], [1, -1], [0, 1]])
    all_ = np.concatenate([p, mid[:, None] + far], 1) - mid[:, None]
    ax, ay, bx, by, cx, cy = (all_[:, triples[:, i], k] for i in range(3) for k in range(2))
    with np.errstate(all="ignore"):
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        r2 = (ax - ux) ** 2 + (ay - uy) ** 2
        within, near = np.zeros(d.shape, bool), np.zeros(d.shape, bool)
        for j in range(n + 3):
            off = ((all_[:, j, 0, None] - ux) ** 2 + (all_[:, j, 1, None] - uy) ** 2) / r2 - 1
            other = ~(triples == j).any(1)
            within |= (off < -HAIR) & other
            near |= ~(np.abs(off) > HAIR) & other
    area, span = np.abs(d / 2), (reach * reach * 1e-12)[:, None]
    real = (d != 0) & ~within
    doubt = (real & (near | ~np.isfinite(r2) | ((area > span / 9) & (area < 9 * span)))).any(1) | ~np.isfinite(p).all((1, 2)) | (reach == 0)
    same = np.zeros(b, bool)
    for i in range(n):
        same |= (p[:, i, None] == p[:, i + 1 :]).all(2).any(1)
    return real & ~near & (area > span), doubt | same


def _inside(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """geometry.inside of one point (x, y) for each polygon."""
    q, x, y = np.roll(p, -1, 1), x[:, None], y[:, None]
    px, py, qx, qy = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    with np.errstate(all="ignore"):
        at = (qx - px) * (y - py) / (qy - py) + px
    cross = (qx - px) * (y - py) - (qy - py) * (x - px)
    edge = (np.minimum(px, qx) <= x) & (x <= np.maximum(px, qx)) & (np.minimum(py, qy) <= y) & (y <= np.maximum(py, qy)) & (cross == 0)
    return ((((py > y) != (qy > y)) & (x < at)).sum(1) % 2 == 1) & ~edge.any(1)


def _inner_angles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The two smaller interior angles of each triangle, ascending."""
    la, lb, lc = (np.hypot(*(u - v).T) for u, v in ((b, c), (a, c), (a, b)))
    corner = lambda o, s, t: np.degrees(np.arccos(np.clip((s * s + t * t - o * o) / (2 * s * t), -1, 1)))
    first, second = corner(la, lb, lc), corner(lb, la, lc)
    return np.sort(np.stack([first, second, 180 - first - second], 1), 1)[:, :2]


def _openings(p: np.ndarray, seed: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """geometry.opening_angles of each region's boundary at the three corners of its seed, ascending."""
    row, out = np.arange(len(seed)), []
    for v in seed.T:
        here = p[row, v]
        (bx, by), (ax, ay) = (p[row, before[row, v]] - here).T, (p[row, after[row, v]] - here).T
        out.append(np.minimum(360 - (np.degrees(np.arctan2(by, bx)) - np.degrees(np.arctan2(ay, ax))) % 360, 180.0))
    return np.sort(np.stack(out, 1), 1)


def _same_size(p: np.ndarray, caps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygons (rows) of as many corners -> (polygon of each triangle, (caps, triangles, 5), centres, polygons in doubt)."""
    n = p.shape[1]
    triples = np.array(list(combinations(range(n), 3)))
    found, doubt = _delaunay(p, triples)
    shifted = p - p[:, :1]
    x, y = shifted[..., 0], shifted[..., 1]
    size = (x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)
    doubt |= np.abs(size) <= HAIR * np.abs(shifted).max((1, 2)) ** 2
    of, which = np.nonzero(found & ~doubt[:, None])
    tri = triples[which]
    a, b, c = (p[of, tri[:, i]] for i in range(3))
    centre = (a + b + c) / 3
    keep = _inside(p[of], *centre.T)
    keep |= (np.bincount(of[keep], minlength=len(p)) == 0)[of]
    of, tri, a, b, c, centre = (v[keep] for v in (of, tri, a, b, c, centre))
    # Corners counter-clockwise from here on; a boundary is the corner after, and before, each of its corners (-1: not on it).
    turned = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) < 0
    seed = np.where(turned[:, None], tri[:, [0, 2, 1]], tri)
    m, row = len(of), np.arange(len(of))
    first = np.searchsorted(of, of)
    most = int((row - first).max(initial=-1)) + 1
    table = np.full((len(p), most, 3), -1)
    table[of, row - first] = seed
    near = table[of]
    after, before = np.full((m, n + 1), -1), np.full((m, n + 1), -1)
    for i in range(3):
        after[row, seed[:, i]], before[row, seed[:, (i + 1) % 3]] = seed[:, (i + 1) % 3], seed[:, i]
    opens, mine, inner = {}, p[of], _inner_angles(a, b, c)
    live = row
    for step in range(max(caps) + 1):
        if step in caps:
            opens[step] = _openings(mine, seed, after, before)
        if step == max(caps) or not len(live):
            continue
        # A neighbour shares an edge, which the boundary walks the other way round.  With one, its third corner has to be
        # new; with two, their common corner leaves the boundary and may not be the seed's.
        to, cand = after[live], near[live]
        r = np.arange(len(live))[:, None]
        shared = np.stack([(to[r, cand[..., (i + 1) % 3]] == cand[..., i]) & (cand[..., 0] >= 0) for i in range(3)], 2)
        one, two = shared.sum(2) == 1, shared.sum(2) == 2
        apex = np.take_along_axis(cand, (np.argmax(shared, 2)[..., None] + 2) % 3, 2)[..., 0]
        drop = np.take_along_axis(cand, (np.argmin(shared, 2)[..., None] + 2) % 3, 2)[..., 0]
        fits = (one & (to[r, apex] < 0)) | (two & (drop[..., None] != seed[live][:, None]).all(2))
        can = fits.any(1)
        live, pick = live[can], np.argmax(fits[can], 1)
        at = np.flatnonzero(can)
        grows = one[at, pick]
        s, k, v = live[grows], np.argmax(shared[at, pick], 1)[grows], apex[at, pick][grows]
        t = cand[at, pick][grows]
        j = np.arange(len(s))
        u, w = t[j, (k + 1) % 3], t[j, k]
        after[s, u], before[s, v], after[s, v], before[s, w] = v, u, w, v
        s, v = live[~grows], drop[at, pick][~grows]
        u, w = before[s, v], after[s, v]
        after[s, u], before[s, w], after[s, v], before[s, v] = w, u, -1, -1
    return of, np.stack([np.concatenate([inner, opens[cap]], 1) for cap in caps]), centre, np.flatnonzero(doubt)


def descriptors(points: np.ndarray, sizes: np.ndarray, caps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygons of ``sizes`` corners, one after the other in ``points`` -> (polygon, number in caps, triangle, (rows, 5)
    descriptors, (rows, 2) centres) in double precision, in that order: what geometry.described gives for each."""
    start = np.cumsum(sizes) - sizes
    single, parts = np.flatnonzero(sizes > MOST).tolist(), []
    for n in np.unique(sizes[(sizes >= 3) & (sizes <= MOST)]).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, STEP // (n * (n - 1) * (n - 2) // 6))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            of, d, centre, doubt = _same_size(points[start[some, None] + np.arange(n)], caps)
            number = np.arange(len(of)) - np.searchsorted(of, of)
            parts += [(some[of], np.full(len(of), i), number, d[i], centre) for i in range(len(caps))]
            single += some[doubt].tolist()
    for i in single:
        each, centre = geometry.described(points[start[i] : start[i] + sizes[i]], caps)
        parts += [(np.full(len(d), i), np.full(len(d), c), np.arange(len(d)), d, centre) for c, d in enumerate(each)]
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, 5)), np.zeros((0, 2))
    out = [np.concatenate([p[i] for p in parts]) for i in range(5)]
    order = np.lexsort((out[2], out[1], out[0]))
    return tuple(v[order] for v in out)
