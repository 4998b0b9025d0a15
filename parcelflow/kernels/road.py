"""Road centrelines: skeleton, graph healing, collinear merging, widths. Lines are N x 2 arrays in feet."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from parcelflow.kernels import mask as M
from parcelflow.kernels import polygon as P


def approx_width(region: P.Region) -> float:
    return max(10.0, 2 * P.area(region) / max(P.perimeter(region), 1e-12))


def length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum())


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's points."""
    if len(line) < 3:
        return line
    a, b = line[0], line[-1]
    d = b - a
    n = np.hypot(*d)
    off = np.abs(d[0] * (line[:, 1] - a[1]) - d[1] * (line[:, 0] - a[0])) / n if n else np.hypot(*(line - a).T)
    k = int(off.argmax())
    if off[k] <= tolerance:
        return np.array([a, b])
    return np.concatenate([simplify(line[: k + 1], tolerance)[:-1], simplify(line[k:], tolerance)])


def skeleton(region: P.Region, step: float | None = None) -> list[np.ndarray]:
    """Middle lines of a region, from the thinned raster of its shape, whose cell is a sixth of its width. Lines meet at their ends."""
    pts = np.concatenate(region)
    step = step or approx_width(region) / 6
    lo = pts.min(0) - 2 * step
    w, h = (np.ceil((pts.max(0) - lo) / step).astype(int) + 2).tolist()
    thin = M.thin(M.fill([(r - lo) / step for r in region], (h, w)))
    cells = set(zip(*(v.tolist() for v in np.nonzero(thin))))

    def near(c):
        four = [q for q in ((c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)) if q in cells]
        diag = [(c[0] + a, c[1] + b) for a in (-1, 1) for b in (-1, 1) if (c[0] + a, c[1] + b) in cells and (c[0] + a, c[1]) not in cells and (c[0], c[1] + b) not in cells]
        return four + diag

    links = {c: near(c) for c in sorted(cells)}
    nodes = [c for c, n in links.items() if len(n) != 2] or list(links)[:1]
    done, lines = set(), []
    for s in nodes:
        for n in links[s]:
            if (s, n) in done:
                continue
            path, before, at = [s, n], s, n
            while len(links[at]) == 2 and at != s:
                nxt = [q for q in links[at] if q != before]
                if not nxt or at in nodes:
                    break
                before, at = at, nxt[0]
                path.append(at)
            done |= {(s, n), (path[-1], path[-2])}
            lines.append(np.array([(x + 0.5, y + 0.5) for y, x in path]) * step + lo)
    return lines


def _ends(line: np.ndarray) -> tuple[tuple, tuple]:
    k = lambda p: (round(float(p[0]), 1), round(float(p[1]), 1))
    return k(line[0]), k(line[-1])


def heal(lines: list[np.ndarray], width: float) -> list[np.ndarray]:
    """Lines joined where just two meet, dead ends under 2.5 widths dropped, until nothing changes. Of parallel lines between two nodes the last stays."""
    while True:
        edges: dict[tuple, np.ndarray] = {}
        for x in lines:
            a, b = _ends(x)
            if a != b:
                edges[min(a, b), max(a, b)] = x if a <= b else x[::-1]
        at = defaultdict(list)
        for e in edges:
            at[e[0]].append(e), at[e[1]].append(e)
        node = next((n for n, es in sorted(at.items()) if len(es) == 2 and es[0] != es[1]), None)
        if node is not None:
            e, f = at[node]
            x = edges.pop(e) if e[1] == node else edges.pop(e)[::-1]
            y = edges.pop(f) if f[0] == node else edges.pop(f)[::-1]
            lines = [*edges.values(), np.concatenate([x, y[1:]])]
            continue
        short = [e for e, x in edges.items() if (len(at[e[0]]) == 1) != (len(at[e[1]]) == 1) and length(x) < 2.5 * width]
        if not short:
            return list(edges.values())
        drop = min(short, key=lambda e: (length(edges[e]), e))
        lines = [x for e, x in edges.items() if e != drop]


def _turn(x: np.ndarray, y: np.ndarray) -> float:
    d, e = x[-1] - x[-2], y[1] - y[0]
    return abs((math.degrees(math.atan2(e[1], e[0]) - math.atan2(d[1], d[0])) + 180) % 360 - 180)


def merge_collinear(lines: list[np.ndarray], most_turn: float = 25.0, tolerance: float = 2.0) -> list[np.ndarray]:
    """Lines that go on in each other with a turn under most_turn joined, the straightest pair of an end first."""
    lines = [np.asarray(x, float) for x in lines]
    while True:
        at = defaultdict(list)
        for k, x in enumerate(lines):
            a, b = _ends(x)
            at[a].append((k, True)), at[b].append((k, False))
        best = None
        for here in at.values():
            for i, (k, s) in enumerate(here):
                for m, t in here[i + 1 :]:
                    if k != m:
                        x, y = lines[k][::-1] if s else lines[k], lines[m] if t else lines[m][::-1]
                        turn = _turn(x, y)
                        if turn < most_turn and (best is None or turn < best[0]):
                            best = (turn, k, m, np.concatenate([x, y[1:]]))
        if best is None:
            return lines
        lines = [x for k, x in enumerate(lines) if k not in best[1:3]] + [simplify(best[3], tolerance)]


def widths(line: np.ndarray, region: P.Region, guess: float, samples: int = 9, least: float = 22.0) -> tuple[float, float]:
    """Median width of the region across the line, at least `least`, and the line's azimuth. A tape of five guesses each way is laid across at each sample; the part around the line counts."""
    seg = np.hypot(*np.diff(line, axis=0).T)
    total = seg.sum()
    got = []
    for s in np.linspace(0.1, 0.9, samples) * total:
        k = min(int(np.searchsorted(np.cumsum(seg), s)), len(seg) - 1)
        d = (line[k + 1] - line[k]) / max(seg[k], 1e-12)
        p = line[k] + d * (s - (seg[:k].sum()))
        n = np.array([-d[1], d[0]])
        t = np.linspace(-5 * guess, 5 * guess, 801)
        m = P.inside(p + t[:, None] * n, region)
        mid = 400
        if m[mid]:
            lo = mid - int(np.argmin(m[mid::-1])) if not m[: mid + 1].all() else -1
            hi = mid + int(np.argmin(m[mid:])) if not m[mid:].all() else 801
            got.append((hi - lo - 1) * (t[1] - t[0]))
    d = line[-1] - line[0]
    return max(least, float(np.median(got)) if got else guess), (math.degrees(math.atan2(d[0], d[1])) + 360) % 360


def long_networks(lines: list[np.ndarray], least: float = 100.0) -> list[np.ndarray]:
    """Lines of connected networks longer than that in all."""
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in lines:
        a, b = map(find, _ends(x))
        root[a] = b
    total: dict = defaultdict(float)
    for x in lines:
        total[find(_ends(x)[0])] += length(x)
    return [x for x in lines if total[find(_ends(x)[0])] > least]


def regularise(region: P.Region, least_area: float = 1000.0) -> list[tuple[np.ndarray, float, float]]:
    """(line, width, azimuth) of a road surface: middle lines, healed, long networks only, collinear ones merged, measured."""
    if P.area(region) <= least_area:
        return []
    w = approx_width(region)
    lines = [simplify(x, w / 6) for x in heal(skeleton(region), w)]
    lines = merge_collinear(long_networks(lines))
    return [(x, *widths(x, region, w)) for x in lines]
