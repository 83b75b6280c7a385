"""Plane geometry of single polygons in NumPy: triangulation, kernel growth, opening angles, simplification, contours."""

from __future__ import annotations

import math

import numpy as np


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles as ascending vertex triples in ascending order (Bowyer-Watson); [] for degenerate input."""
    pts = np.asarray(points, float)
    if len(pts) < 3 or not np.isfinite(pts).all():
        return []
    centre, reach = pts.mean(0), float(np.abs(pts - pts.mean(0)).max())
    if reach == 0:
        return []
    far = 1e4 * reach
    everything = np.vstack([pts, centre + [[-far, -far], [far, -far], [0, far]]])
    n, seen = len(pts), set()

    def around(t):
        (ax, ay), (bx, by), (cx, cy) = everything[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return (0.0, 0.0, math.inf)
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)

    everything = everything - centre
    live = {(n, n + 1, n + 2): around((n, n + 1, n + 2))}
    for i in range(n):
        x, y = everything[i]
        if (x, y) in seen:
            continue
        seen.add((x, y))
        hit = [t for t, (ux, uy, r2) in live.items() if (x - ux) ** 2 + (y - uy) ** 2 < r2 * (1 - 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for t in hit:
            del live[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[e] = edges.get(e, 0) + 1
        for (a, b), times in edges.items():
            if times == 1:
                t = tuple(sorted((a, b, i)))
                live[t] = around(t)
    span = reach * reach * 1e-12
    area = lambda t: abs((everything[t[1]][0] - everything[t[0]][0]) * (everything[t[2]][1] - everything[t[0]][1]) - (everything[t[2]][0] - everything[t[0]][0]) * (everything[t[1]][1] - everything[t[0]][1]))
    return sorted(t for t in live if t[2] < n and area(t) > span)


def signed_area(polygon: np.ndarray) -> float:
    x, y = np.asarray(polygon, float).T
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def inside(polygon: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd test; points on an edge are outside."""
    p, q = np.asarray(polygon, float), np.roll(np.asarray(polygon, float), -1, 0)
    x, y = points[:, 0, None], points[:, 1, None]
    rises = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
    cross = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0])
    within = (np.minimum(p[:, 0], q[:, 0]) <= x) & (x <= np.maximum(p[:, 0], q[:, 0])) & (np.minimum(p[:, 1], q[:, 1]) <= y) & (y <= np.maximum(p[:, 1], q[:, 1]))
    return ((rises & (x < at)).sum(1) % 2 == 1) & ~(within & (cross == 0)).any(1)


def interior_triangles(polygon: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles with their centre inside the polygon; all of them for a polygon without area or if none is."""
    triangles = delaunay(polygon)
    if not triangles or signed_area(polygon) == 0:
        return triangles
    keep = inside(polygon, np.asarray(polygon, float)[np.array(triangles)].mean(1))
    return [t for t, k in zip(triangles, keep) if k] if keep.any() else triangles


def boundary_loop(region: list[tuple[int, int, int]]) -> list[int] | None:
    """The vertices of a region's boundary in order, if it is one simple loop; else None."""
    edges: dict[tuple[int, int], int] = {}
    for a, b, c in region:
        for e in ((a, b), (b, c), (a, c)):
            edges[e] = edges.get(e, 0) + 1
    near: dict[int, list[int]] = {}
    for (a, b), times in edges.items():
        if times == 1:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    if not near or any(len(v) != 2 for v in near.values()):
        return None
    start = min(near)
    loop, before = [start], None
    while True:
        a, b = near[loop[-1]]
        after = b if a == before else a
        if after == start:
            break
        before = loop[-1]
        loop.append(after)
    return loop if len(loop) == len(near) else None


def kernels(triangles: list[tuple[int, int, int]], seed: int, cap: int) -> list[list[int]]:
    """Grows a region from a seed triangle by up to ``cap`` neighbours, each the first in order that leaves one simple
    boundary on which all three seed vertices lie.  Gives the boundary's vertices in order, before and after each step."""
    by_edge: dict[tuple[int, int], list[int]] = {}
    for i, (a, b, c) in enumerate(triangles):
        for e in ((a, b), (b, c), (a, c)):
            by_edge.setdefault(e, []).append(i)

    def neighbours(i):
        a, b, c = triangles[i]
        return {j for e in ((a, b), (b, c), (a, c)) for j in by_edge[e]} - {i}

    region, front, loops = {seed}, neighbours(seed), [list(triangles[seed])]
    for _ in range(cap):
        for j in sorted(front):
            grown = boundary_loop([triangles[i] for i in sorted(region | {j})])
            if grown is not None and set(triangles[seed]) <= set(grown):
                region.add(j)
                front = (front | neighbours(j)) - region
                loops.append(grown)
                break
        else:
            break
    return loops


def opening_angles(points: np.ndarray, loop: list[int], vertices) -> list[float]:
    """min(360 - interior angle, 180) of the loop at each vertex; 0 for a vertex off the loop."""
    pts = np.asarray(points, float)
    if len(loop) < 3:
        return [0.0] * len(vertices)
    if signed_area(pts[loop]) < 0:
        loop = loop[::-1]
    place, out = {v: i for i, v in enumerate(loop)}, []
    for v in vertices:
        if v not in place:
            out.append(0.0)
            continue
        i = place[v]
        before, after = pts[loop[i - 1]] - pts[v], pts[loop[(i + 1) % len(loop)]] - pts[v]
        interior = (math.degrees(math.atan2(before[1], before[0])) - math.degrees(math.atan2(after[1], after[0]))) % 360
        out.append(min(360 - interior, 180.0))
    return out


def angles(a, b, c) -> list[float]:
    """Interior angles of a triangle in degrees, ascending; zeros if a side has no length."""
    la, lb, lc = math.dist(b, c), math.dist(a, c), math.dist(a, b)
    if not la * lb * lc:
        return [0.0] * 3
    corner = lambda o, s, t: math.degrees(math.acos(max(-1.0, min(1.0, (s * s + t * t - o * o) / (2 * s * t)))))
    first, second = corner(la, lb, lc), corner(lb, la, lc)
    return sorted([first, second, 180 - first - second])


def described(polygon, caps) -> tuple[list[np.ndarray], np.ndarray]:
    """For each growth cap the (T, 5) descriptors, and the (T, 2) triangle centres, in double precision; empty for under
    three vertices or no triangle.  One triangulation and one growth serve all caps."""
    pts = np.asarray(polygon, float).reshape(-1, 2)
    triangles = interior_triangles(pts) if len(pts) >= 3 else []
    rows, centres = [[] for _ in caps], []
    for i, t in enumerate(triangles):
        loops, inner = kernels(triangles, i, max(caps)), angles(*pts[list(t)])[:2]
        open_ = [sorted(opening_angles(pts, loop, t)) for loop in loops]
        for out, cap in zip(rows, caps):
            out.append([*inner, *open_[min(cap, len(loops) - 1)]])
        centres.append(pts[list(t)].mean(0))
    return [np.array(r, float).reshape(-1, 5) for r in rows], np.array(centres, float).reshape(-1, 2)


def descriptors_by_cap(polygon, caps) -> tuple[list[np.ndarray], np.ndarray]:
    """described() in single precision."""
    rows, centres = described(polygon, caps)
    return [r.astype(np.float32) for r in rows], centres.astype(np.float32)


def descriptors(polygon, cap: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """((T, 5) descriptors, (T, 2) triangle centres) for one growth cap."""
    found, centres = descriptors_by_cap(polygon, (cap,))
    return found[0], centres


def simplify(polygon, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed curve, split at the first vertex and the one farthest from it."""
    pts = np.asarray(polygon, float).reshape(-1, 2)
    if len(pts) < 4:
        return pts
    split = int(((pts - pts[0]) ** 2).sum(1).argmax())

    def keep(chain: list[int]) -> list[int]:
        if len(chain) < 3:
            return chain
        a, b = pts[chain[0]], pts[chain[-1]]
        d, length = b - a, math.dist(a, b)
        inner = pts[chain[1:-1]] - a
        away = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length else np.sqrt((inner**2).sum(1))
        at = int(away.argmax())
        if away[at] <= tolerance:
            return [chain[0], chain[-1]]
        return keep(chain[: at + 2])[:-1] + keep(chain[at + 1 :])

    if not split:
        return pts[:1]
    first = keep(list(range(split + 1)))
    second = keep([*range(split, len(pts)), 0])
    return pts[first[:-1] + second[:-1]]


def adaptive_tolerance(area: float, image_area: float, perimeter: float) -> float:
    return (0.002 + 0.018 * math.sqrt(max(0.0, min(1.0, area / image_area)))) * perimeter


def components(mask) -> np.ndarray:
    """Labels 1, 2, ... of the 8-connected components of a mask in reading order; 0 elsewhere."""
    mask = np.asarray(mask, bool)
    labels, n = np.zeros(mask.shape, np.int64), 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        n += 1
        labels[start], stack = n, [start]
        while stack:
            r, c = stack.pop()
            for i in range(max(0, r - 1), min(mask.shape[0], r + 2)):
                for j in range(max(0, c - 1), min(mask.shape[1], c + 2)):
                    if mask[i, j] and not labels[i, j]:
                        labels[i, j] = n
                        stack.append((i, j))
    return labels


def component_boxes(mask, least: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area) of components of ``least`` pixels or more; ends exclusive."""
    labels, out = components(mask), []
    for i in range(1, labels.max(initial=0) + 1):
        r, c = np.nonzero(labels == i)
        if len(r) >= least:
            out.append((int(c.min()), int(r.min()), int(c.max()) + 1, int(r.max()) + 1, len(r)))
    return out


def outlines(mask, least: float = 0.0) -> list[np.ndarray]:
    """Outer outlines of a mask's regions along pixel borders, as (x, y) loops of an area of ``least`` or more."""
    mask = np.pad(np.asarray(mask, bool), 1)
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(mask)):
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if not mask[r + dr, c + dc]:
                steps.setdefault(a, []).append(b)
    out = []
    while steps:
        at = start = min(steps)
        loop, heading = [], None
        while True:
            loop.append((int(at[0]) - 1, int(at[1]) - 1))
            ways = steps[at]
            turn = lambda b: 0 if heading is None else (heading[0] * (b[1] - at[1]) - heading[1] * (b[0] - at[0]))
            to = max(ways, key=turn)
            ways.remove(to)
            if not ways:
                del steps[at]
            heading, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
        ring = np.array(loop, float)
        if signed_area(ring) >= max(least, 1e-9):
            out.append(ring)
    return out
