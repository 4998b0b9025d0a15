"""Many regions at once: what kernels.polygon does with one, in numpy over all regions of an Arrow batch.

A Batch has the points of all rings, where each ring starts, and where each region starts among the rings. Arrangements compare
all edges of a region with each other; regions of about as many edges are laid side by side, so that no Python runs for a single one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from parcelflow.kernels import polygon as P

#: Comparisons of edges laid side by side at once.
AT_ONCE = 2_000_000


@dataclass
class Batch:
    xy: np.ndarray  # points x 2
    ring: np.ndarray  # first point of each ring, and the end
    region: np.ndarray  # first ring of each region, and the end

    def __len__(self) -> int:
        return len(self.region) - 1

    @property
    def owner(self) -> np.ndarray:
        """The region of each ring."""
        return np.repeat(np.arange(len(self)), np.diff(self.region))

    @property
    def of_point(self) -> np.ndarray:
        """The ring of each point."""
        return np.repeat(np.arange(len(self.ring) - 1), np.diff(self.ring))

    @property
    def after(self) -> np.ndarray:
        """The index of the point that follows each in its ring."""
        n = np.arange(1, len(self.xy) + 1)
        full = np.diff(self.ring) > 0
        n[self.ring[1:][full] - 1] = self.ring[:-1][full]
        return n

    @property
    def before(self) -> np.ndarray:
        b = np.empty(len(self.xy), np.int64)
        b[self.after] = np.arange(len(self.xy))
        return b

    def regions(self) -> Iterator[P.Region]:
        for a, b in zip(self.region[:-1].tolist(), self.region[1:].tolist()):
            yield [self.xy[self.ring[k] : self.ring[k + 1]] for k in range(a, b)]

    def keep_points(self, keep: np.ndarray) -> Batch:
        n = np.bincount(self.of_point[keep], minlength=len(self.ring) - 1)
        return Batch(self.xy[keep], _starts(n), self.region)

    def take_rings(self, rings: np.ndarray, owner: np.ndarray, n: int) -> Batch:
        """A batch of n regions of these rings (owner: the new region of each, ascending)."""
        size = np.diff(self.ring)[rings]
        return Batch(self.xy[_ranges(self.ring[rings], size)], _starts(size), _starts(np.bincount(owner, minlength=n)))

    def take(self, regions: np.ndarray) -> Batch:
        n = np.diff(self.region)[regions]
        return self.take_rings(_ranges(self.region[regions], n), np.repeat(np.arange(len(regions)), n), len(regions))


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. n[0] numbers, then those of first[1] .."""
    return np.repeat(first - _starts(n)[:-1], n) + np.arange(int(n.sum()))


def _sums(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    c = np.bincount(np.repeat(np.arange(len(start) - 1), np.diff(start)), weights=v, minlength=len(start) - 1)
    return c[: len(start) - 1]


def of(regions: list[P.Region]) -> Batch:
    rings = [r for g in regions for r in g]
    xy = np.concatenate(rings).astype(float) if rings else np.zeros((0, 2))
    return Batch(xy.reshape(-1, 2), _starts(np.array([len(r) for r in rings], np.int64)), _starts(np.array([len(g) for g in regions], np.int64)))


def from_arrow(column) -> Batch:
    """Of an Arrow column of rings; nulls have none. A ring's last point falls out where it is the first again."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    pts = inner.flatten().flatten()
    b = Batch(np.stack([p.to_numpy(zero_copy_only=False).astype(float) for p in pts[:2]], 1), _starts(n(inner)), _starts(n(column)))
    size = np.diff(b.ring)
    many = np.flatnonzero(size > 1)
    if len(many):
        first, last = b.xy[b.ring[many]], b.xy[b.ring[many + 1] - 1]
        full = b.ring[:-1][size > 0]
        ext = (np.maximum.reduceat(b.xy, full) - np.minimum.reduceat(b.xy, full)).max(1)[np.cumsum(size > 0)[many] - 1]
        drop = np.abs(first - last).max(1) <= P.SNAP * ext
        keep = np.ones(len(b.xy), bool)
        keep[b.ring[many[drop] + 1] - 1] = False
        b = b.keep_points(keep)
    return b


def to_arrow(b: Batch):
    import pyarrow as pa

    pts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(b.xy[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(b.region.astype(np.int32)), pa.ListArray.from_arrays(pa.array(b.ring.astype(np.int32)), pts))


# ---- measures ----


def signed_areas(b: Batch) -> np.ndarray:
    """Of each ring, about its first corner."""
    if not len(b.xy):
        return np.zeros(len(b.ring) - 1)
    x, y = (b.xy - b.xy[b.ring[b.of_point]]).T
    n = b.after
    return _sums(x * y[n] - x[n] * y, b.ring) / 2


def perimeters(b: Batch) -> np.ndarray:
    return _sums(_sums(np.hypot(*(b.xy[b.after] - b.xy).T), b.ring), b.region) if len(b.xy) else np.zeros(len(b))


def centroids(b: Batch) -> np.ndarray:
    """Of each ring."""
    at = b.xy[b.ring[b.of_point]]
    x, y = (b.xy - at).T
    n = b.after
    c = x * y[n] - x[n] * y
    a = _sums(c, b.ring) / 2
    flat = np.abs(a) < 1e-18
    with np.errstate(divide="ignore", invalid="ignore"):
        got = np.stack([_sums((v + v[n]) * c, b.ring) / (6 * a) for v in (x, y)], 1)
        mean = np.stack([_sums(v, b.ring) / np.diff(b.ring) for v in (x, y)], 1)
    return np.where(flat[:, None], mean, got) + b.xy[np.minimum(b.ring[:-1], len(b.xy) - 1)]


def _in_rings(points: np.ndarray, b: Batch, rings: np.ndarray) -> np.ndarray:
    """Whether each point is in its ring."""
    size = np.diff(b.ring)[rings]
    k = _ranges(b.ring[rings], size)
    who = np.repeat(np.arange(len(rings)), size)
    p, q, y = b.xy[k], b.xy[b.after[k]], points[who, 1]
    cross = np.flatnonzero((p[:, 1] > y) != (q[:, 1] > y))
    p, q, y, who = p[cross], q[cross], y[cross], who[cross]
    at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return np.bincount(who[points[who, 0] < at], minlength=len(rings)) % 2 == 1


def _inner_points(b: Batch, rings: np.ndarray, area: np.ndarray) -> np.ndarray:
    """A point inside each ring, just beside the middle of its longest edge; where that fails, as polygon._inner_point finds one."""
    edge = b.xy[b.after] - b.xy
    size = np.hypot(*edge.T)
    order = np.lexsort((np.arange(len(size)), -size, b.of_point))
    k = order[b.ring[:-1][rings]]
    left = np.where(area[rings] > 0, 1.0, -1.0)[:, None]
    p = b.xy[k] + edge[k] / 2 + np.stack([-edge[k, 1], edge[k, 0]], 1) * 1e-3 * left
    for i in np.flatnonzero(~_in_rings(p, b, rings)):
        p[i] = P._inner_point(b.xy[b.ring[rings[i]] : b.ring[rings[i] + 1]])
    return p


def depths(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """In how many other rings of its region each ring lies; and its home: the innermost outer ring around a hole (-1: none), itself where it is an outer one."""
    n = np.diff(b.region)
    depth, home = np.zeros(len(b.ring) - 1, np.int64), np.arange(len(b.ring) - 1)
    owner = b.owner
    many = np.flatnonzero((n[owner] > 1) & (np.diff(b.ring) > 0))
    if not len(many):
        return depth, home
    area = signed_areas(b)
    inner = np.full((len(depth), 2), np.nan)
    inner[many] = _inner_points(b, many, area)
    k = np.repeat(many, n[owner[many]])
    j = _ranges(b.region[owner[many]], n[owner[many]])
    full = np.flatnonzero(np.diff(b.ring) > 0)
    lo, hi = np.full((len(depth), 2), np.inf), np.full((len(depth), 2), -np.inf)
    lo[full], hi[full] = np.minimum.reduceat(b.xy, b.ring[full]), np.maximum.reduceat(b.xy, b.ring[full])
    near = (k != j) & (inner[k] >= lo[j]).all(1) & (inner[k] <= hi[j]).all(1)
    k, j = k[near], j[near]
    ok = _in_rings(inner[k], b, j)
    k, j = k[ok], j[ok]
    depth = np.bincount(k, minlength=len(depth))
    home[depth % 2 == 1] = -1
    fits = (depth[k] % 2 == 1) & (depth[j] == depth[k] - 1)
    home[k[fits][::-1]] = j[fits][::-1]  # the first of several
    return depth, home


def areas(b: Batch) -> np.ndarray:
    """Of each region: rings that lie in an odd number of others are holes."""
    return _sums(np.abs(signed_areas(b)) * np.where(depths(b)[0] % 2 == 1, -1, 1), b.region)


def parts(b: Batch) -> tuple[Batch, np.ndarray]:
    """Connected parts, each an outer ring with its holes, and the region of each; by region, the largest first."""
    depth, home = depths(b)
    area = np.abs(signed_areas(b))
    owner = b.owner
    rings = np.flatnonzero(home >= 0)
    own = np.zeros(len(area))
    np.add.at(own, home[rings], np.where(depth[rings] % 2 == 1, -area[rings], area[rings]))
    outer = np.flatnonzero(depth % 2 == 0)
    outer = outer[np.lexsort((outer, -own[outer], owner[outer]))]
    rank = np.full(len(area), -1)
    rank[outer] = np.arange(len(outer))
    place = rank[home[rings]]
    order = np.lexsort((rings, depth[rings] % 2, place))
    return b.take_rings(rings[order], place[order], len(outer)), owner[outer]


def fill_holes(b: Batch) -> Batch:
    """Regions without holes, the largest part first."""
    p, owner = parts(b)
    return p.take_rings(p.region[:-1], owner, len(b))


def hulls(b: Batch) -> list[np.ndarray]:
    return [P.convex_hull(np.concatenate(g)) if g else np.zeros((0, 2)) for g in b.regions()]


def rectangles(b: Batch) -> np.ndarray:
    """The smallest rectangle around each region, four corners; nan where it collapses."""
    hull = hulls(b)
    out = np.full((len(b), 4, 2), np.nan)
    sizes = np.array([len(h) for h in hull])
    for m in np.unique(sizes[sizes > 2]):
        who = np.flatnonzero(sizes == m)
        for at in range(0, len(who), max(1, AT_ONCE // (m * m))):
            w = who[at : at + max(1, AT_ONCE // (m * m))]
            h = np.stack([hull[i] for i in w])
            origin = h[:, :1]
            h = h - origin
            e = np.roll(h, -1, 1) - h
            u = e / np.hypot(e[..., 0], e[..., 1])[..., None]
            v = np.stack([-u[..., 1], u[..., 0]], 2)
            s, t = u @ h.transpose(0, 2, 1), v @ h.transpose(0, 2, 1)
            s0, s1, t0, t1 = s.min(2), s.max(2), t.min(2), t.max(2)
            size = (s1 - s0) * (t1 - t0)
            best, least = np.zeros(len(w), int), size[:, 0].copy()
            for k in range(1, m):
                less = size[:, k] < least - 1e-15
                best[less], least[less] = k, size[less, k]
            r = np.arange(len(w))
            u, v = u[r, best], v[r, best]
            c = lambda a, d: a[r, best][:, None] * u + d[r, best][:, None] * v  # noqa: B023, E731
            out[w] = np.stack([c(s0, t0), c(s1, t0), c(s1, t1), c(s0, t1)], 1) + origin
    return out


def principal_axes(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    r = rectangles(b)
    e1, e2 = r[:, 1] - r[:, 0], r[:, 2] - r[:, 1]
    longer = (np.hypot(*e1.T) >= np.hypot(*e2.T))[:, None]
    head = lambda v: np.degrees(np.arctan2(v[:, 0], v[:, 1])) % 360
    return head(np.where(longer, e1, e2)), head(np.where(longer, e2, e1))


def sound(b: Batch, least: float = 1e-9) -> np.ndarray:
    """As polygon.is_sound."""
    size = np.diff(b.ring)
    bad = (size < 3) | (_sums(np.isnan(b.xy).any(1), b.ring) > 0)
    ok = (np.diff(b.region) > 0) & (_sums(bad, b.region) == 0)
    k = np.flatnonzero(ok)
    g = b.take(k)
    r = rectangles(g)
    with np.errstate(invalid="ignore"):
        e, f = r[:, 1] - r[:, 0], r[:, 2] - r[:, 1]
        ok[k] = (areas(g) >= least) & (np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]) > 0)
    return ok


# ---- arrangements ----


def _side_by_side(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Items (n and m: their two sizes) in groups of about one size, with a bounded product."""
    order = np.lexsort((m, n))
    order = order[(n[order] > 0) & (m[order] > 0)]
    at = 0
    while at < len(order):
        rest = order[at : at + AT_ONCE]
        cost = np.maximum.accumulate(n[rest]) * np.maximum.accumulate(m[rest]) * np.arange(1, len(rest) + 1)
        alike = n[rest] <= n[rest[0]] * 1.3 + 4
        k = max(1, int(((cost <= AT_ONCE) & alike).argmin()) if not ((cost <= AT_ONCE) & alike).all() else len(rest))
        yield rest[:k]
        at += k


def _padded(start: np.ndarray, items: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    k = start[items][:, None] + np.arange(width)
    ok = k < start[items + 1][:, None]
    return np.where(ok, k, 0), ok


def _blocks(items: int, rows: int, cols: int) -> Iterator[slice]:
    """Rows by so many that a block has AT_ONCE cells at most."""
    step = max(1, AT_ONCE // (items * cols))
    for at in range(0, rows, step):
        yield slice(at, min(rows, at + step))


def _near(lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different edges of an item whose boxes meet."""
    n = np.diff(start)
    i, j = [], []
    for items in _side_by_side(n, n):
        width = int(n[items].max())
        k, ok = _padded(start, items, width)
        l, h = np.where(ok[..., None], lo[k], np.nan), np.where(ok[..., None], hi[k], np.nan)
        for r in _blocks(len(items), width, width):
            meet = (l[:, r, None, 0] <= h[:, None, :, 0]) & (h[:, r, None, 0] >= l[:, None, :, 0])
            meet &= l[:, r, None, 1] <= h[:, None, :, 1]
            meet &= h[:, r, None, 1] >= l[:, None, :, 1]
            w, p, q = np.nonzero(meet)
            p, q = k[w, p + r.start], k[w, q]
            i.append(p[p != q]), j.append(q[p != q])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(i), cat(j)


def _crossings(pts: np.ndarray, of_pts: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, edge) where a ray to the right of the point crosses the edge of its item. of_pts: first point of each item."""
    n, m = np.diff(of_pts), np.diff(start)
    who, what = [], []
    for items in _side_by_side(n, m):
        rows, cols = int(n[items].max()), int(m[items].max())
        k, ok = _padded(of_pts, items, rows)
        e, ok_e = _padded(start, items, cols)
        y = np.where(ok, pts[k, 1], np.nan)[:, :, None]
        ay, by = np.where(ok_e, a[e, 1], np.nan)[:, None], np.where(ok_e, b[e, 1], np.nan)[:, None]
        for r in _blocks(len(items), rows, cols):
            w, p, q = np.nonzero((ay > y[:, r]) != (by > y[:, r]))
            p, q = k[w, p + r.start], e[w, q]
            at = a[q, 0] + (pts[p, 1] - a[q, 1]) * (b[q, 0] - a[q, 0]) / (b[q, 1] - a[q, 1])
            hit = pts[p, 0] < at
            who.append(p[hit]), what.append(q[hit])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(who), cat(what)


def _arranged(layers: list[Batch], rule: Callable[[list[np.ndarray]], np.ndarray], winding: bool = False) -> Batch:
    """The regions where the rule holds, item by item of batches of one length: as polygon.combine, of memberships by layer or, winding, of the number of times that the layers' rings go around."""
    n = len(layers[0])
    parts_ = []
    for l, g in enumerate(layers):
        wide = np.diff(g.ring) >= 3
        k = np.flatnonzero(wide[g.of_point])
        parts_.append((g.owner[g.of_point[k]], g.xy[k], g.xy[g.after[k]], np.full(len(k), l)))
    item, a, b, layer = (np.concatenate([p[c] for p in parts_]) for c in range(4))
    order = np.argsort(item, kind="stable")
    item, a, b, layer = item[order], a[order], b[order], layer[order]
    start = _starts(np.bincount(item, minlength=n))
    empty = Batch(np.zeros((0, 2)), np.zeros(1, np.int64), np.zeros(n + 1, np.int64))
    if not len(item):
        return empty
    full = np.flatnonzero(np.diff(start))
    origin, top = np.zeros((n, 2)), np.zeros((n, 2))
    origin[full], top[full] = np.minimum.reduceat(a, start[full]), np.maximum.reduceat(a, start[full])
    size = np.maximum((top - origin).max(1), 1e-12)
    a, b = a - origin[item], b - origin[item]
    scale = (size * P.SNAP)[item]
    # edges parted where they cross, touch or run along each other
    i, j = _near(np.minimum(a, b) - scale[:, None], np.maximum(a, b) + scale[:, None], start)
    d = b - a
    long = np.hypot(*d.T)
    p, e, w = d[i], d[j], a[j] - a[i]
    den = p[:, 0] * e[:, 1] - p[:, 1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den, (w[:, 0] * p[:, 1] - w[:, 1] * p[:, 0]) / den
        ok = (np.abs(den) > 1e-14 * long[i] * long[j]) & (u >= -1e-9) & (u <= 1 + 1e-9) & (t > 1e-9) & (t < 1 - 1e-9)
    who, at = [np.arange(len(a)), np.arange(len(a)), i[ok]], [np.zeros(len(a)), np.ones(len(a)), t[ok]]
    for q in (a[j], b[j]):
        s = ((q - a[i]) * p).sum(1) / np.maximum(long[i] ** 2, 1e-300)
        off = np.hypot(*(a[i] + s[:, None] * p - q).T)
        ok = (off <= scale[i]) & (s > 1e-9) & (s < 1 - 1e-9)
        who.append(i[ok]), at.append(s[ok])
    who, at = np.concatenate(who), np.round(np.concatenate(at), 12)
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1])])
    who, at = who[new], at[new]
    pts = a[who] + at[:, None] * d[who]
    same = np.flatnonzero(who[1:] == who[:-1])
    ends = np.stack([pts[same], pts[same + 1]], 1).reshape(-1, 2)
    own = np.repeat(item[who[same]], 2)
    # vertices, and pieces between two of them
    key = np.round(ends / (size * P.SNAP * 10)[own][:, None]).astype(np.int64)
    order = np.lexsort((key[:, 1], key[:, 0], own))
    k, o = key[order], own[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1]).any(1)])
    vid = np.empty(len(ends), np.int64)
    vid[order] = np.cumsum(new) - 1
    place = ends[order[new]]
    v_item = o[new]
    low, high = vid.reshape(-1, 2).min(1), vid.reshape(-1, 2).max(1)
    first = np.flatnonzero(low != high)
    order = first[np.lexsort((first, high[first], low[first]))]
    if not len(order):
        return empty
    new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
    pairs = np.sort(order[new])  # in the order of their first appearance
    low, high = low[pairs], high[pairs]
    p_item = v_item[low]
    # the rule beside the middle of each piece
    d2 = place[high] - place[low]
    size2 = np.hypot(*d2.T)
    nrm = np.stack([-d2[:, 1], d2[:, 0]], 1) / size2[:, None]
    step = np.minimum(size2 * 1e-3, size[p_item] * 1e-7)[:, None]
    mid = (place[low] + place[high]) / 2
    test = np.stack([mid + nrm * step, mid - nrm * step], 1).reshape(-1, 2)
    pt, ed = _crossings(test, 2 * _starts(np.bincount(p_item, minlength=n)), a, b, start)
    if winding:
        up = np.where(b[ed, 1] > a[ed, 1], 1.0, -1.0)
        held = rule([np.bincount(pt, weights=up, minlength=len(test))])
    else:
        held = rule([np.bincount(pt[layer[ed] == l], minlength=len(test)) % 2 == 1 for l in range(len(layers))])
    left, right = held[::2], held[1::2]
    side = np.flatnonzero(left != right)
    tail, head = np.where(left[side], low[side], high[side]), np.where(left[side], high[side], low[side])
    if not len(side):
        return empty
    # rings: where each vertex has one way on and one in, cycles; else as polygon.combine goes
    outs, ins = np.bincount(tail, minlength=len(place)), np.bincount(head, minlength=len(place))
    odd = np.zeros(n, bool)
    odd[v_item[(outs > 1) | (ins != outs)]] = True
    plain = ~odd[v_item[tail]]
    nxt, rank = np.full(len(place), -1), np.full(len(place), len(tail))
    nxt[tail[plain]] = head[plain]
    rank[tail[plain]] = np.flatnonzero(plain)
    v = tail[plain]
    least, far = rank.copy(), nxt.copy()
    if len(v):
        for _ in range(int(np.ceil(np.log2(len(v) + 1)))):
            low_ = np.minimum(least[v], least[far[v]])
            done = (low_ == least[v]).all()
            least[v] = low_
            far[v] = far[far[v]]
            if done:
                break
    leaders = v[least[v] == rank[v]]
    rings: list = []  # (item, order, vertices)
    if len(leaders):
        count = np.bincount(least[v], minlength=len(tail))[rank[leaders]]
        at0 = _starts(count)
        seq = np.empty(at0[-1], np.int64)
        cur, live = leaders.copy(), np.arange(len(leaders))
        for s in range(int(count.max())):
            live = live[count[live] > s]
            seq[at0[live] + s] = cur[live]
            cur[live] = nxt[cur[live]]
    else:
        at0, seq = np.zeros(1, np.int64), np.zeros(0, np.int64)
    r_item, r_rank, r_size = v_item[leaders], rank[leaders], np.diff(at0)
    more = []
    if odd.any():
        here = np.flatnonzero(~plain)
        follow: dict = defaultdict(list)
        for p_, q_ in zip(tail[here].tolist(), head[here].tolist()):
            follow[p_].append(q_)
        for p_, k_ in zip(tail[here].tolist(), here.tolist()):
            for path in _walk(follow, p_, place):
                more.append((int(v_item[p_]), k_, path))
    if more:
        seq = np.concatenate([seq, *(m[2] for m in more)])
        r_item, r_rank = np.concatenate([r_item, [m[0] for m in more]]), np.concatenate([r_rank, [m[1] for m in more]])
        r_size = np.concatenate([r_size, [len(m[2]) for m in more]])
    at0 = _starts(r_size)
    order = np.lexsort((np.arange(len(r_item)), r_rank, r_item))
    got = Batch((place[seq] + origin[v_item[seq]]), at0, np.zeros(1, np.int64)).take_rings(order, r_item[order].astype(np.int64), n)
    got = _simple(got)
    ok = (np.diff(got.ring) >= 3) & (np.abs(signed_areas(got)) > (size * size * 1e-15)[got.owner])
    return got.take_rings(np.flatnonzero(ok), got.owner[ok], n)


def _walk(follow: dict, start: int, place: np.ndarray) -> Iterator[list[int]]:
    """The closed ways from a vertex, as polygon.combine goes them."""
    while follow[start]:
        path, at, before = [start], follow[start].pop(), start
        while at != start and follow.get(at):
            path.append(at)
            nxt = follow[at]
            if len(nxt) > 1:
                back = math.atan2(*(place[before] - place[at])[::-1])
                nxt.sort(key=lambda q: -((math.atan2(*(place[q] - place[at])[::-1]) - back) % (2 * math.pi) or 2 * math.pi))  # noqa: B023
            before, at = at, nxt.pop()
        if at == start and len(path) >= 3:
            yield path


def _simple(b: Batch) -> Batch:
    """Without points on the line between their neighbours."""
    if not len(b.xy):
        return b
    p, q = b.xy[b.before], b.xy[b.after]
    e, f = b.xy - p, q - b.xy
    keep = np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]) > 1e-12 * np.hypot(*e.T) * np.hypot(*f.T)
    few = _sums(keep, b.ring) < 3
    return b.keep_points(keep | few[b.of_point])


def intersection(a: Batch, b: Batch) -> Batch:
    return _arranged([a, b], lambda m: m[0] & m[1])


def difference(a: Batch, b: Batch) -> Batch:
    return _arranged([a, b], lambda m: m[0] & ~m[1])


def union(b: Batch) -> Batch:
    """Of each region's rings by even-odd, with the inside on the left."""
    return _arranged([b], lambda m: m[0])


def united(b: Batch, group: np.ndarray, n: int) -> Batch:
    """Of n groups (group: of each region, ascending) all that one of their regions holds."""
    u = union(b)
    return _arranged([u.take_rings(np.arange(len(u.ring) - 1), group[u.owner], n)], lambda w: w[0] > 0.5, winding=True)


# ---- walls ----


def half_planes(b: Batch, p: np.ndarray, q: np.ndarray) -> Batch:
    """What of each region lies left of its line from p to q, clipped edge by edge."""
    k = b.owner[b.of_point]
    d = (q - p)[k]
    s = d[:, 0] * (b.xy[:, 1] - p[k, 1]) - d[:, 1] * (b.xy[:, 0] - p[k, 0])
    t = s[b.after]
    cross = ((s > 0) & (t < 0)) | ((s < 0) & (t > 0))
    n = (s >= 0).astype(np.int64) + cross
    with np.errstate(divide="ignore", invalid="ignore"):
        at = b.xy + (b.xy[b.after] - b.xy) * (s / (s - t))[:, None]
    v = np.repeat(np.arange(len(n)), n)
    own = (np.arange(len(v)) == np.repeat(_starts(n)[:-1], n)) & (s[v] >= 0)
    return _wide(Batch(np.where(own[:, None], b.xy[v], at[v]), _starts(_sums(n, b.ring).astype(np.int64)), b.region))


def wall_cut(b: Batch, o: Batch) -> Batch:
    """As polygon.wall_cut, region by region of two batches."""
    n = len(b)
    edge = o.owner[o.of_point]
    p, q = o.xy, o.xy[o.after] if len(o.xy) else o.xy
    t = np.linspace(0.02, 0.98, 25)
    mids = (p[:, None] + (q - p)[:, None] * t[:, None]).reshape(-1, 2)
    start = b.ring[b.region]
    pt, _ = _crossings(mids, 25 * _starts(np.bincount(edge, minlength=n)), b.xy, b.xy[b.after], start)
    odd = np.bincount(pt, minlength=len(mids)) % 2
    touched = odd.reshape(-1, 25).mean(1) * np.hypot(*(q - p).T)
    order = np.lexsort((np.arange(len(edge)), -touched, edge))
    first = order[np.concatenate([[True], edge[order][1:] != edge[order][:-1]])] if len(order) else order
    first = first[touched[first] > 0]
    who = edge[first]  # regions that touch a wall
    g, h = b.take(who), o.take(who)
    sides = [half_planes(g, p[first], q[first]), half_planes(g, q[first], p[first])]
    size = [areas(s) for s in sides]
    both = np.flatnonzero((size[0] > 0) & (size[1] > 0))
    lost = [np.round(areas(intersection(s.take(both), h.take(both))), 9) for s in sides]
    second = (lost[1] < lost[0]) | ((lost[1] == lost[0]) & (size[1][both] > size[0][both]))
    m = len(both)
    pick = _merged(2 * m, np.arange(m), sides[0].take(both), np.arange(m) + m, sides[1].take(both)).take(np.arange(m) + m * second)
    cut = who[both]
    rest = np.setdiff1d(np.arange(n), cut)
    return _merged(n, cut, pick, rest, difference(b.take(rest), o.take(rest)))


def _meet(a: Batch, b: Batch) -> np.ndarray:
    """Whether the boxes of two regions meet; not where one is empty."""
    box = []
    for g in (a, b):
        lo, hi = np.full((len(g), 2), np.inf), np.full((len(g), 2), -np.inf)
        at = g.ring[g.region]
        full = np.flatnonzero(np.diff(at))
        if len(full):
            lo[full], hi[full] = np.minimum.reduceat(g.xy, at[full]), np.maximum.reduceat(g.xy, at[full])
        box.append((lo, hi))
    return (box[0][0] <= box[1][1]).all(1) & (box[0][1] >= box[1][0]).all(1)


#: Groups of more regions are clipped one by one.
TOGETHER = 24


def clip_in_order(b: Batch, group: np.ndarray) -> Batch:
    """As polygon.clip_in_order for each group (of each region, ascending); results in the order of the input. The k-th of all groups are clipped at once."""
    size = areas(b)
    order = np.lexsort((np.arange(len(b)), -size, group))
    count = np.bincount(group)[np.unique(group)]
    start = _starts(count)
    out = list(b.regions())
    for g in np.flatnonzero(count > TOGETHER):
        k = order[start[g] : start[g + 1]]
        for i, r in zip(np.sort(k), P.clip_in_order([out[i] for i in np.sort(k)])):
            out[i] = r
    small = np.flatnonzero(count <= TOGETHER)
    for k in range(int(count[small].max()) if len(small) else 0):
        at = small[count[small] > k]
        now = order[start[at] + k]
        cur = of([out[i] for i in now])
        for q in range(k):
            done = of([out[i] for i in order[start[at] + q]])
            near = np.flatnonzero(_meet(cur, done))
            near = near[areas(intersection(cur.take(near), done.take(near))) > 1e-12]
            if not len(near):
                continue
            w, f = wall_cut(cur.take(near), done.take(near)), done.take(near)
            left = np.flatnonzero(areas(intersection(w, f)) > 1e-12)
            if len(left):
                rest = np.setdiff1d(np.arange(len(w)), left)
                w = _merged(len(w), left, difference(w.take(left), f.take(left)), rest, w.take(rest))
            rest = np.setdiff1d(np.arange(len(cur)), near)
            cur = _merged(len(cur), near, w, rest, cur.take(rest))
        p, owner = parts(cur)
        best = np.full(len(cur), -1)
        best[owner[::-1]] = np.arange(len(owner))[::-1]
        big = list(p.regions())
        for i, m in zip(now, best):
            out[i] = big[m] if m >= 0 else []
    return of(out)


# ---- buffers ----


def _oriented(b: Batch) -> Batch:
    """Outer rings against the clock, holes with it, without repeated points."""
    b = b.keep_points((b.xy != b.xy[b.after]).any(1) | (np.diff(b.ring)[b.of_point] < 2)) if len(b.xy) else b
    wrong = (signed_areas(b) > 0) == (depths(b)[0] % 2 == 1)
    k = np.arange(len(b.xy))
    r = b.of_point
    return Batch(b.xy[np.where(wrong[r], b.ring[r] + b.ring[r + 1] - 1 - k, k)], b.ring, b.region)


def _turns(b: Batch) -> np.ndarray:
    """Of each corner, left positive."""
    out = b.xy[b.after] - b.xy
    inn = out[b.before]
    return np.arctan2(inn[:, 0] * out[:, 1] - inn[:, 1] * out[:, 0], (inn * out).sum(1))


def _convex(b: Batch) -> np.ndarray:
    """Regions of one ring that only turns left, and once."""
    turn = _turns(b)
    ok = np.diff(b.region) == 1
    ok[b.owner[b.of_point[turn <= 0]]] = False
    ok[b.owner[np.abs(_sums(turn, b.ring) - 2 * math.pi) > 1e-6]] = False
    return ok


def _wide(b: Batch) -> Batch:
    wide = np.diff(b.ring) >= 3
    return b.take_rings(np.flatnonzero(wide), b.owner[wide], len(b))


def buffer(b: Batch, d: np.ndarray | float, arc: int = 8, clean: bool = False) -> Batch:
    """Regions grown by d (one number, or one for each) with round corners, or shrunk by -d; nothing may be left. clean: rings have the inside on their left and don't cross, as arrangements give them.

    The border is moved aside, with an arc where the sides part and through the corner itself where they don't; the result is where that
    line goes around once or more. An arc has the points that the round ends of both sides' capsules have, and those where they cross.
    Shrinking, sides that meet are cut off where they do, which keeps a part that is smaller than d all around; such parts fall out last."""
    d = np.broadcast_to(np.asarray(d, float), len(b))
    if (d == 0).any():
        same, other = np.flatnonzero(d == 0), np.flatnonzero(d)
        return _merged(len(b), same, b.take(same), other, buffer(b.take(other), d[other], arc, clean)) if len(other) else b
    b = _wide(b)
    if not clean and len(b.xy):
        b = _wide(_oriented(b))
        good = _convex(b)
        if not good.all():
            same, other = np.flatnonzero(good), np.flatnonzero(~good)
            b = _merged(len(b), same, b.take(same), other, union(b.take(other)))
    if not len(b.xy):
        return b
    dist = d[b.owner[b.of_point]]
    sign = np.where(dist < 0, -1.0, 1.0)
    out = b.xy[b.after] - b.xy
    inn = out[b.before]
    normal = np.stack([out[:, 1], -out[:, 0]], 1) / np.hypot(*out.T)[:, None]
    n1, n2 = normal[b.before], normal
    turn = _turns(b)
    theta = turn * sign  # of the arc, where it is positive
    theta = np.where(np.abs(turn) > math.pi - 1e-12, math.pi, theta)
    h = math.pi / (2 * arc)
    whole = np.where(theta > 0, np.floor(theta / h + 1e-9), 0).astype(np.int64)
    rest = np.where(theta > 0, theta - whole * h, 0.0)
    rest[np.abs(rest) < 1e-9] = 0.0
    cut = (sign < 0) & (theta < -1e-12) & (theta > -2.0)
    n = np.where(theta > 1e-12, np.where(rest > 0, 4 * whole + 3, whole + 1), np.where((theta < -1e-12) & ~cut, 3, 1))
    v = np.repeat(np.arange(len(b.xy)), n)
    k = np.arange(len(v)) - np.repeat(_starts(n)[:-1], n)
    four = rest[v] > 0
    q, m = np.where(four, k // 4, k), np.where(four, k % 4, 0)
    r = rest[v]
    ang = q * h + np.choose(m, [np.zeros(len(v)), r / 2, r, (r + h) / 2])
    rad = np.choose(m, [np.ones(len(v)), math.cos(h / 2) / np.cos((r - h) / 2), np.ones(len(v)), math.cos(h / 2) / np.cos(r / 2)])
    ang = ang * sign[v]
    x, y = n1[v].T
    c, s = np.cos(ang), np.sin(ang)
    move = np.stack([x * c - y * s, x * s + y * c], 1) * rad[:, None]
    last = k == n[v] - 1
    move = np.where((last & (theta[v] > 1e-12))[:, None], n2[v], move)
    move = np.where(cut[v][:, None], ((n1 + n2) / (1 + (n1 * n2).sum(1))[:, None])[v], move)
    back = (theta[v] < -1e-12) & ~cut[v]
    move = np.where(back[:, None], np.where((k == 0)[:, None], n1[v], np.where((k == 1)[:, None], 0.0, n2[v])), move)
    raw = Batch(b.xy[v] + move * dist[v][:, None], _starts(_sums(n, b.ring).astype(np.int64)), b.region)
    plain = _convex(b) & (d > 0)  # its outer line is its result
    same, other = np.flatnonzero(plain), np.flatnonzero(~plain)
    if not len(other):
        return _simple(raw)
    got = _far(_arranged([raw.take(other)], lambda w: w[0] > 0.5, winding=True), b.take(other), d[other])
    return _merged(len(b), same, _simple(raw.take(same)), other, got)


def _far(got: Batch, b: Batch, d: np.ndarray) -> Batch:
    """Of shrunk regions the rings that lie inside and keep their distance from the border."""
    check = np.flatnonzero(d[got.owner] < 0)
    if not len(check):
        return got
    # a ring is tested at its first corner; one as small as arcs are coarse must reach the distance itself, at a corner or its middle
    small = np.abs(signed_areas(got)[check]) < 0.02 * d[got.owner[check]] ** 2
    size = np.diff(got.ring)[check]
    n = np.where(small, size + 1, 1)
    k = _ranges(np.zeros(len(n), np.int64), n)
    ring = np.repeat(np.arange(len(check)), n)
    middle = np.stack([_sums(v, got.ring)[check] / size for v in got.xy.T], 1)
    p = np.where((k == size[ring])[:, None], middle[ring], got.xy[np.minimum(got.ring[check][ring] + k, got.ring[check + 1][ring] - 1)])
    item = got.owner[check][ring]
    first, last = b.ring[b.region[item]], b.ring[b.region[item + 1]]
    e = _ranges(first, last - first)
    who = np.repeat(np.arange(len(p)), last - first)
    a, v, q = b.xy[e], b.xy[b.after[e]] - b.xy[e], p[who]
    t = np.clip(((q - a) * v).sum(1) / np.maximum((v * v).sum(1), 1e-300), 0, 1)
    off = np.full(len(p), np.inf)
    np.minimum.at(off, who, np.hypot(*(a + t[:, None] * v - q).T))
    cross = np.flatnonzero((a[:, 1] > q[:, 1]) != (a[:, 1] + v[:, 1] > q[:, 1]))
    at = a[cross, 0] + (q[cross, 1] - a[cross, 1]) * v[cross, 0] / v[cross, 1]
    off[np.bincount(who[cross][q[cross, 0] < at], minlength=len(p)) % 2 == 0] = -np.inf
    most = np.maximum.reduceat(off, _starts(n)[:-1])
    keep = np.ones(len(got.ring) - 1, bool)
    keep[check] = most >= np.where(small, 1 - 1e-7, 0.98) * -d[got.owner[check]]
    return got.take_rings(np.flatnonzero(keep), got.owner[keep], len(got))


def _merged(n: int, i: np.ndarray, a: Batch, j: np.ndarray, b: Batch) -> Batch:
    """n regions: those of a at i, those of b at j."""
    both = Batch(np.concatenate([a.xy, b.xy]), np.concatenate([a.ring, b.ring[1:] + a.ring[-1]]), np.concatenate([a.region, b.region[1:] + a.region[-1]]))
    at = np.empty(n, np.int64)
    at[i], at[j] = np.arange(len(i)), len(i) + np.arange(len(j))
    return both.take(at)


def close_gaps(b: Batch, d: np.ndarray | float) -> Batch:
    """Grown by d and shrunk again, which bridges gaps under 2 d."""
    return buffer(buffer(b, d), -np.asarray(d, float), clean=True)
