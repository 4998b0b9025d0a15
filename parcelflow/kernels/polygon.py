"""Polygons in numpy. A region is a list of rings (N x 2 arrays, closed or not); inside is even-odd, so holes are just rings.

Union, intersection and difference come from one arrangement: cut all edges where they cross, keep the pieces with the
result on one side only, chain them to rings with the inside on the left. kernels.batch does the same for many regions at once, and buffers.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

Region = list[np.ndarray]
SNAP = 1e-9


def ring(points) -> np.ndarray:
    """Without the last point where it is the first again, to the ring's own size: far from the origin, corners are apart that are the same to that distance."""
    r = np.asarray(points, float).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and np.abs(r[0] - r[-1]).max() <= SNAP * np.ptp(r, 0).max() else r


def signed_area(r: np.ndarray) -> float:
    """About the first corner, so that small rings far from the origin keep their digits."""
    x, y = (r - r[:1]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(region: Region) -> float:
    """Rings that lie in an odd number of others are holes."""
    total = 0.0
    for k, r in enumerate(region):
        depth = sum(_inside_ring(_inner_point(r), [q]) for j, q in enumerate(region) if j != k)
        total += abs(signed_area(r)) * (-1 if depth % 2 else 1)
    return total


def perimeter(region: Region) -> float:
    return float(sum(np.hypot(*(np.roll(r, -1, 0) - r).T).sum() for r in region))


def centroid(r: np.ndarray) -> tuple[float, float]:
    """About the first corner, as signed_area."""
    x, y = (r - r[:1]).T
    c = x * np.roll(y, -1) - np.roll(x, -1) * y
    a = c.sum() / 2
    if abs(a) < 1e-18:
        return float(r[:, 0].mean()), float(r[:, 1].mean())
    return float(((x + np.roll(x, -1)) * c).sum() / (6 * a) + r[0, 0]), float(((y + np.roll(y, -1)) * c).sum() / (6 * a) + r[0, 1])


def _inner_point(r: np.ndarray) -> np.ndarray:
    """A point inside a ring: just left of an edge's middle, of an edge long enough."""
    o = r if signed_area(r) > 0 else r[::-1]
    e = np.roll(o, -1, 0) - o
    size = np.hypot(*e.T)
    for k in np.argsort(-size):
        for eps in (1e-3, 1e-6, 1e-9):
            p = o[k] + e[k] / 2 + np.array([-e[k][1], e[k][0]]) * eps
            if _inside_ring(p, [r]):
                return p
    return r.mean(0)


def _inside_ring(p, region: Region) -> bool:
    return bool(inside(np.asarray(p, float)[None], region)[0])


def inside(points: np.ndarray, region: Region) -> np.ndarray:
    """Even-odd membership of points; on the border either."""
    out = np.zeros(len(points), bool)
    for r in region:
        a, b = r, np.roll(r, -1, 0)
        y = points[:, 1][:, None]
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        out ^= ((cross & (points[:, 0][:, None] < at)).sum(1) % 2).astype(bool)
    return out


def distance_to_border(p: np.ndarray, region: Region) -> np.ndarray:
    best = np.full(len(p), np.inf)
    for r in region:
        a, d = r, np.roll(r, -1, 0) - r
        t = ((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300)
        q = a + np.clip(t, 0, 1)[..., None] * d
        best = np.minimum(best, np.hypot(*(p[:, None] - q).transpose(2, 0, 1)).min(1))
    return best


def _edges(region: Region) -> np.ndarray:
    return np.concatenate([np.stack([r, np.roll(r, -1, 0)], 1) for r in region]) if region else np.zeros((0, 2, 2))


def _cut(edges: np.ndarray, scale: float) -> np.ndarray:
    """Edges parted where they cross, touch or run along each other."""
    a, b = edges[:, 0], edges[:, 1]
    lo, hi = np.minimum(a, b) - scale, np.maximum(a, b) + scale
    pieces = []
    for k in range(len(edges)):
        near = np.flatnonzero((lo[:, 0] <= hi[k, 0]) & (hi[:, 0] >= lo[k, 0]) & (lo[:, 1] <= hi[k, 1]) & (hi[:, 1] >= lo[k, 1]))
        d, e = b[k] - a[k], b[near] - a[near]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        w = a[near] - a[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den, (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
        ok = (np.abs(den) > 1e-14 * np.hypot(*d) * np.hypot(*e.T)) & (u >= -1e-9) & (u <= 1 + 1e-9) & (t > 1e-9) & (t < 1 - 1e-9)
        ts = list(t[ok])
        for q in (a[near], b[near]):  # ends of others on this edge
            s = ((q - a[k]) * d).sum(1) / max(d @ d, 1e-300)
            off = np.hypot(*(a[k] + s[:, None] * d - q).T)
            ts += list(s[(off <= scale) & (s > 1e-9) & (s < 1 - 1e-9)])
        ts = np.unique(np.round([0, *ts, 1], 12))
        p = a[k] + ts[:, None] * d
        pieces.append(np.stack([p[:-1], p[1:]], 1))
    return np.concatenate(pieces) if pieces else np.zeros((0, 2, 2))


def combine(regions: list[Region], rule) -> Region:
    """The region where rule(memberships: list of boolean arrays) holds."""
    every = [r for g in regions for r in g if len(r) >= 3]
    if not every:
        return []
    pts = np.concatenate(every)
    size = float(max(np.ptp(pts[:, 0]), np.ptp(pts[:, 1]), 1e-12))
    scale = size * SNAP
    origin = pts.min(0)
    parts = _cut(_edges(every), scale)
    key = np.round((parts - origin) / (scale * 10)).astype(np.int64)
    ids: dict[tuple, np.ndarray] = {}
    seen: dict[tuple, int] = {}
    for k, (p, q) in enumerate(key):
        p, q = tuple(p), tuple(q)
        ids.setdefault(p, parts[k, 0]), ids.setdefault(q, parts[k, 1])
        if p != q:
            seen.setdefault((p, q) if p < q else (q, p), k)
    pairs = list(seen)
    if not pairs:
        return []
    a, b = np.array([ids[p] for p, _ in pairs]), np.array([ids[q] for _, q in pairs])
    d = b - a
    n = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(*d.T)[:, None]
    step = np.minimum(np.hypot(*d.T) * 1e-3, size * 1e-7)[:, None]
    mid = (a + b) / 2
    left, right = (rule([inside(mid + s * n * step, g) for g in regions]) for s in (1, -1))
    follow = defaultdict(list)
    for k, (p, q) in enumerate(pairs):
        if left[k] and not right[k]:
            follow[p].append(q)
        elif right[k] and not left[k]:
            follow[q].append(p)
    rings = []
    for start in list(follow):
        while follow[start]:
            path, at, before = [start], follow[start].pop(), start
            while at != start and follow.get(at):
                path.append(at)
                nxt = follow[at]
                if len(nxt) > 1:  # at a crossing turn as far left as can be, so that rings part there
                    back = math.atan2(before[1] - at[1], before[0] - at[0])
                    nxt.sort(key=lambda q: -((math.atan2(q[1] - at[1], q[0] - at[0]) - back) % (2 * math.pi) or 2 * math.pi))
                before, at = at, nxt.pop()
            if at == start and len(path) >= 3:
                rings.append(_simple(np.array([ids[p] for p in path])))
    return [r for r in rings if len(r) >= 3 and abs(signed_area(r)) > size * size * 1e-15]


def _simple(r: np.ndarray) -> np.ndarray:
    """Without points on the line between their neighbours."""
    p, q = np.roll(r, 1, 0), np.roll(r, -1, 0)
    c = (r[:, 0] - p[:, 0]) * (q[:, 1] - r[:, 1]) - (r[:, 1] - p[:, 1]) * (q[:, 0] - r[:, 0])
    keep = np.abs(c) > 1e-12 * np.hypot(*(r - p).T) * np.hypot(*(q - r).T)
    return r[keep] if keep.sum() >= 3 else r


def union(*regions: Region) -> Region:
    return combine(list(regions), lambda m: np.logical_or.reduce(m))


def intersection(a: Region, b: Region) -> Region:
    return combine([a, b], lambda m: m[0] & m[1])


def difference(a: Region, b: Region) -> Region:
    return combine([a, b], lambda m: m[0] & ~m[1])


def parts(region: Region) -> list[Region]:
    """Connected parts: outer rings with their holes, the largest first."""
    depth = [sum(_inside_ring(_inner_point(r), [q]) for j, q in enumerate(region) if j != k) for k, r in enumerate(region)]
    outer = [k for k, n in enumerate(depth) if n % 2 == 0]
    out = {k: [region[k]] for k in outer}
    for k, n in enumerate(depth):
        if n % 2:
            p = _inner_point(region[k])
            home = [o for o in outer if depth[o] == n - 1 and _inside_ring(p, [region[o]])]
            if home:
                out[home[0]].append(region[k])
    return sorted(out.values(), key=area, reverse=True)


def fill_holes(region: Region) -> Region:
    return [p[0] for p in parts(region)]


def convex_hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, np.asarray(points, float))))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        h: list = []
        for p in seq:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(p)
        return h[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def rotated_rectangle(points: np.ndarray) -> np.ndarray:
    """The smallest rectangle around points: four corners. Collapses with the hull."""
    h = convex_hull(points)
    if len(h) < 3:
        return h
    best = None
    for e in np.roll(h, -1, 0) - h:
        u = e / np.hypot(*e)
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = np.ptp(s) * np.ptp(t)
        if best is None or size < best[0] - 1e-15:
            best = (size, [s.min() * u + t.min() * v, s.max() * u + t.min() * v, s.max() * u + t.max() * v, s.min() * u + t.max() * v])
    return np.array(best[1])


def principal_axes(points: np.ndarray) -> tuple[float, float]:
    """Headings (0 north, clockwise) of the longer and the shorter side of the smallest rectangle."""
    r = rotated_rectangle(points)
    e1, e2 = r[1] - r[0], r[2] - r[1]
    major, minor = (e1, e2) if np.hypot(*e1) >= np.hypot(*e2) else (e2, e1)
    return tuple(float(np.degrees(np.arctan2(v[0], v[1])) % 360) for v in (major, minor))


def capsule(a, b, d: float, arc: int = 8, flat: bool = False) -> Region:
    """All within d of a segment; flat: without the round ends."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    u = b - a
    size = np.hypot(*u)
    base = math.atan2(u[1], u[0]) if size else 0.0
    if flat and size:
        n = np.array([-u[1], u[0]]) / size * d
        return [np.array([a - n, b - n, b + n, a + n])]
    t = np.linspace(-math.pi / 2, math.pi / 2, 2 * arc + 1)
    end = np.stack([np.cos(base + t), np.sin(base + t)], 1) * d
    return [np.concatenate([b + end, a - end])]


def buffer(region: Region, d: float, arc: int = 8) -> Region:
    """Grown by d with round corners, or shrunk by -d; nothing may be left. See batch.buffer."""
    from parcelflow.kernels import batch

    return next(iter(batch.buffer(batch.of([region]), d, arc).regions())) if d and region else list(region)


def close_gaps(region: Region, d: float) -> Region:
    """Grown by d and shrunk again, which bridges gaps under 2 d."""
    return buffer(buffer(region, d), -d)


def half_plane(region: Region, p, q) -> Region:
    """What lies left of the line from p to q, clipped edge by edge."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    d = q - p
    out = []
    for r in region:
        s = d[0] * (r[:, 1] - p[1]) - d[1] * (r[:, 0] - p[0])
        new = []
        for k in range(len(r)):
            j = (k + 1) % len(r)
            if s[k] >= 0:
                new.append(r[k])
            if (s[k] > 0 > s[j]) or (s[k] < 0 < s[j]):
                new.append(r[k] + (r[j] - r[k]) * (s[k] / (s[k] - s[j])))
        if len(new) >= 3:
            out.append(np.array(new))
    return out


def wall_cut(region: Region, other: Region) -> Region:
    """region cut along the line of the longest wall of `other` that it touches, keeping the side with less of `other`; where no wall is touched, the plain difference."""
    best = None
    for p, q in _edges(other):
        mids = p + (q - p) * np.linspace(0.02, 0.98, 25)[:, None]
        touched = inside(mids, region).mean() * np.hypot(*(q - p))
        if touched > 0 and (best is None or touched > best[0]):
            best = (touched, p, q)
    if best is None:
        return difference(region, other)
    sides = [half_plane(region, best[1], best[2]), half_plane(region, best[2], best[1])]
    sides = [s for s in sides if area(s) > 0]
    return min(sides, key=lambda s: (round(area(intersection(s, other)), 9), -area(s))) if len(sides) > 1 else difference(region, other)


def clip_in_order(regions: list[Region]) -> list[Region]:
    """Largest first, each without what larger ones took; results in the order of the input."""
    out: dict[int, Region] = {}
    for k in sorted(range(len(regions)), key=lambda i: -area(regions[i])):
        r = regions[k]
        for done in out.values():
            if done and r and _boxes_meet(r, done) and area(intersection(r, done)) > 1e-12:
                r = wall_cut(r, done)
                if r and area(intersection(r, done)) > 1e-12:
                    r = difference(r, done)
        out[k] = max(parts(r), key=area) if r else []
    return [out[k] for k in range(len(regions))]


def _boxes_meet(a: Region, b: Region) -> bool:
    p, q = np.concatenate(a), np.concatenate(b)
    return bool((p.min(0) <= q.max(0)).all() and (p.max(0) >= q.min(0)).all())


def is_sound(region: Region, least: float = 1e-9) -> bool:
    """A polygon with area whose smallest rectangle doesn't collapse."""
    if not region or any(len(r) < 3 or np.isnan(r).any() for r in region):
        return False
    m = rotated_rectangle(np.concatenate(region))
    return area(region) >= least and len(m) == 4 and abs(signed_area(m)) > 0


def relation(a: Region, b: Region) -> dict[str, bool]:
    """intersects, within, contains, touches, disjoint, overlaps of two polygons."""
    common = area(intersection(a, b)) if _boxes_meet(a, b) else 0.0
    sa, sb = area(a), area(b)
    eps = 1e-9 * min(sa, sb)
    near = common > eps or (_boxes_meet(a, b) and _touch(a, b))
    inn, has = common >= sa - eps, common >= sb - eps
    return {"intersects": near, "within": inn, "contains": has, "touches": near and common <= eps, "disjoint": not near, "overlaps": common > eps and not inn and not has}


def _touch(a: Region, b: Region) -> bool:
    size = float(np.ptp(np.concatenate(a + b))) or 1.0
    tol = size * 1e-9
    return bool((distance_to_border(np.concatenate(a), b) <= tol).any() or (distance_to_border(np.concatenate(b), a) <= tol).any() or _cross(a, b))


def _cross(a: Region, b: Region) -> bool:
    ea, eb = _edges(a), _edges(b)
    for p, q in ea:
        d, e = q - p, eb[:, 1] - eb[:, 0]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        w = eb[:, 0] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den, (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
        if ((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
            return True
    return False


def distance(a: Region, b: Region) -> float:
    """0 where they meet."""
    if _boxes_meet(a, b) and (_cross(a, b) or inside(a[0][:1], b)[0] or inside(b[0][:1], a)[0]):
        return 0.0
    return float(min(distance_to_border(np.concatenate(a), b).min(), distance_to_border(np.concatenate(b), a).min()))
