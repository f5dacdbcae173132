"""Polygons as lists of rings (the first is the outer one), rings as (n, 2) arrays without a repeated last point. Simple polygons only."""

from __future__ import annotations

import struct

import numpy as np


def ring_area(ring: np.ndarray) -> float:
    """Signed: positive counter-clockwise."""
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def area(polygon: list[np.ndarray]) -> float:
    return abs(ring_area(polygon[0])) - sum(abs(ring_area(r)) for r in polygon[1:])


def length(ring: np.ndarray, closed: bool = True) -> float:
    steps = np.diff(np.vstack([ring, ring[:1]]) if closed else ring, axis=0)
    return float(np.hypot(steps[:, 0], steps[:, 1]).sum())


def centroid(ring: np.ndarray) -> tuple[float, float]:
    x, y = ring[:, 0], ring[:, 1]
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    cross = x * y1 - x1 * y
    a = cross.sum() / 2
    if a == 0:
        return float(x.mean()), float(y.mean())
    return float(((x + x1) * cross).sum() / (6 * a)), float(((y + y1) * cross).sum() / (6 * a))


def contains(polygon: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Which points lie inside, by crossings of a ray; those on an edge may count either way."""
    inside = np.zeros(len(points), bool)
    px, py = points[:, 0], points[:, 1]
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if ay == by:
                continue
            crosses = (ay > py) != (by > py)
            inside ^= crosses & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return inside


def on_edge(polygon: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Which points lie on an edge."""
    found = np.zeros(len(points), bool)
    px, py = points[:, 0], points[:, 1]
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            beside = (px >= min(ax, bx)) & (px <= max(ax, bx)) & (py >= min(ay, by)) & (py <= max(ay, by))
            found |= beside & ((bx - ax) * (py - ay) == (by - ay) * (px - ax))
    return found


def clip_half_plane(ring: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a ring where a x + b y <= c (exact for convex rings; others may get edges along the line)."""
    if not len(ring):
        return ring
    d = ring @ np.array([a, b]) - c
    out = []
    for k in range(len(ring)):
        n = (k + 1) % len(ring)
        if d[k] <= 0:
            out.append(ring[k])
        if (d[k] < 0 < d[n]) or (d[n] < 0 < d[k]):
            out.append(ring[k] + (ring[n] - ring[k]) * (d[k] / (d[k] - d[n])))
    return np.array(out).reshape(-1, 2)


def clip_convex(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring. Edges so short that rounding gives their direction cut nothing off."""
    if ring_area(convex) < 0:
        convex = convex[::-1]
    short = 1e-8 * np.ptp(convex, axis=0).max()
    for p, q in zip(convex, np.roll(convex, -1, 0), strict=True):
        n = np.array([q[1] - p[1], p[0] - q[0]])
        if np.abs(n).max() <= short:
            continue
        ring = clip_half_plane(ring, *n, float(n @ p))
        if len(ring) < 3:
            return np.zeros((0, 2))
    return ring


def subtract_convex(ring: np.ndarray, convex: np.ndarray) -> list[np.ndarray]:
    """A ring without a convex ring, in pieces: what lies beyond each edge but not beyond the ones before."""
    if ring_area(convex) < 0:
        convex = convex[::-1]
    out = []
    for p, q in zip(convex, np.roll(convex, -1, 0), strict=True):
        n = np.array([q[1] - p[1], p[0] - q[0]])
        beyond = clip_half_plane(ring, *-n, -float(n @ p))
        if len(beyond) >= 3 and abs(ring_area(beyond)) > 0:
            out.append(beyond)
        ring = clip_half_plane(ring, *n, float(n @ p))
        if len(ring) < 3:
            break
    return out


def clip_many(corners: np.ndarray, count: np.ndarray, normal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex rings, padded, without what lies beyond a line each (normal, and a place on it); fewer than three corners are none."""
    width = corners.shape[1]
    some = np.arange(width) < count[:, None]
    following = np.where(np.arange(1, width + 1) < count[:, None], np.arange(1, width + 1), 0)
    d = ((corners - at[:, None]) * normal[:, None]).sum(2)
    e, q = np.take_along_axis(d, following, 1), np.take_along_axis(corners, following[..., None], 1)
    crosses = some & (((d < 0) & (e > 0)) | ((d > 0) & (e < 0)))
    share = np.divide(d, d - e, out=np.zeros_like(d), where=crosses)
    # Each corner that stays, and then the place where the edge after it crosses.
    keep = np.stack([some & (d <= 0), crosses], 2).reshape(len(d), -1)
    every = np.stack([corners, corners + (q - corners) * share[..., None]], 2).reshape(len(d), -1, 2)
    new = keep.sum(1)
    new[new < 3] = 0
    out = np.zeros((len(d), max(width, int(new.max(initial=0))), 2))
    row, column = np.nonzero(keep & (new > 0)[:, None])
    out[row, (np.cumsum(keep, 1) - 1)[row, column]] = every[row, column]
    return out, new


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each first to before each last, and which range each is of."""
    n = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def nearest_parts(low: np.ndarray, high: np.ndarray, group: np.ndarray, sites: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(corners, count): the part of its group's box that is nearest to each site, as convex rings padded to one width.

    Sites at one place share it with the first of them. A site meets others in windows of a grid that grow around the place of the
    box nearest to it, nearer ones first, until none farther off can reach its part; all sites of all groups go side by side.
    """
    n = len(sites)
    corners, count = np.zeros((n, 8, 2)), np.zeros(n, np.int64)
    if not n:
        return corners, count
    order = np.lexsort((sites[:, 1], sites[:, 0], group))
    first = order[np.append(True, (np.diff(group[order]) != 0) | (np.diff(sites[order], axis=0) != 0).any(1))]
    # No place of a box is farther from a site than the middle of its sixteenth and the half of that one's diagonal: sites
    # farther off than that from the whole box have no part.
    heads = np.flatnonzero(np.append(True, np.diff(group[first]) != 0))
    p, g = sites[first], group[first]
    limit = np.zeros(len(low))
    for i, j in np.ndindex(4, 4):
        middle = low + (high - low) * ((np.array([i, j]) + 0.5) / 4)
        limit[g[heads]] = np.maximum(limit[g[heads]], np.minimum.reduceat(np.hypot(*(p - middle[g]).T), heads))
    limit += np.hypot(*(high - low).T) / 8
    first = first[np.hypot(*(p - np.clip(p, low[g], high[g])).T) <= limit[g] * (1 + 1e-9)]
    start, end = np.full((len(low), 2), np.inf), np.full((len(low), 2), -np.inf)
    np.minimum.at(start, group[first], sites[first])
    np.maximum.at(end, group[first], sites[first])
    n_of = np.bincount(group[first], minlength=len(low))
    wide = np.where(n_of[:, None] > 0, end - start, 0)
    size = 1.5 * np.sqrt(wide.prod(1) / np.maximum(n_of, 1))
    size = np.maximum(size, wide.max(1) / np.maximum(n_of, 1))
    size[size == 0] = 1.0
    start[n_of == 0] = 0
    cells = np.floor(wide / size[:, None]).astype(np.int64) + 1
    base = np.cumsum(cells.prod(1)) - cells.prod(1)
    place = lambda g, p: np.clip(np.floor((p - start[g]) / size[g, None]).astype(np.int64), 0, cells[g] - 1)
    own = place(group[first], sites[first])
    key = base[group[first]] + own[:, 1] * cells[group[first], 0] + own[:, 0]
    order = np.argsort(key, kind="stable")
    first, own, key = first[order], own[order], key[order]
    p, g = sites[first], group[first]
    near = np.clip(p, low[g], high[g])
    off = np.hypot(*(p - near).T)
    at = place(g, near)
    lo, hi = low[g], high[g]
    ring, left = np.zeros((len(p), 8, 2)), np.full(len(p), 4)
    ring[:, :4] = np.stack([lo, np.column_stack([hi[:, 0], lo[:, 1]]), hi, np.column_stack([lo[:, 0], hi[:, 1]])], 1)
    reach = np.hypot(*np.maximum(np.abs(p - lo), np.abs(p - hi)).T)  # to the farthest corner of what is left
    active, window, before = np.arange(len(p)), 1, -1
    while len(active):
        open_ = []
        step = max(1, most // ((2 * window + 1) ** 2 * 3))
        for k in range(0, len(active), step):
            mine = active[k : k + step]
            c, m = at[mine], cells[g[mine]]
            row, of = _ranges(np.maximum(c[:, 1] - window, 0), np.minimum(c[:, 1] + window, m[:, 1] - 1) + 1)
            line = base[g[mine]][of] + row * m[of, 0]
            other, which = _ranges(np.searchsorted(key, line + np.maximum(c[of, 0] - window, 0)), np.searchsorted(key, line + np.minimum(c[of, 0] + window, m[of, 0] - 1), side="right"))
            which = of[which]
            new = (np.abs(own[other] - c[which]).max(1) > before) & (other != mine[which])
            other, which = other[new], which[new]
            far = np.hypot(*(p[other] - near[mine][which]).T)
            by = np.lexsort((far, which))
            other, which, far = other[by], which[by], far[by]
            head, tail = np.searchsorted(which, np.arange(len(mine))), np.searchsorted(which, np.arange(len(mine)), side="right")
            go = np.flatnonzero(head < tail)
            while len(go):
                # All others of the window are as far off or farther.
                go = go[(left[mine[go]] > 0) & ((far[head[go]] - off[mine[go]]) / 2 < reach[mine[go]])]
                s, t = mine[go], other[head[go]]
                normal, middle = p[t] - p[s], (p[t] + p[s]) / 2
                beyond = (((ring[s] - middle[:, None]) * normal[:, None]).sum(2) > 0) & (np.arange(ring.shape[1]) < left[s, None])
                hit = beyond.any(1)
                s = s[hit]
                if len(s):
                    some, left[s] = clip_many(ring[s], left[s], normal[hit], middle[hit])
                    if some.shape[1] > ring.shape[1]:
                        ring = np.concatenate([ring, np.zeros((len(ring), some.shape[1] - ring.shape[1] + 4, 2))], 1)
                    ring[s, : some.shape[1]] = some
                    away = np.hypot(*np.moveaxis(some - p[s, None], 2, 0))
                    reach[s] = np.where(np.arange(some.shape[1]) < left[s, None], away, 0).max(1)
                head[go] += 1
                go = go[head[go] < tail[go]]
            whole = (c - window <= 0).all(1) & (c + window >= m - 1).all(1)
            open_.append(mine[(left[mine] > 0) & ~whole & ((window * size[g[mine]] - off[mine]) / 2 < reach[mine])])
        active = np.concatenate(open_)
        before, window = window, 2 * window
    if ring.shape[1] > corners.shape[1]:
        corners = np.zeros((n, ring.shape[1], 2))
    corners[first], count[first] = ring, left
    return corners, count


def areas_of(corners: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Areas of padded rings."""
    some = np.arange(corners.shape[1]) < count[:, None]
    p = np.where(some[..., None], corners - corners[:, :1], 0)  # padding lies at the first corner
    q = np.roll(p, -1, 1)
    return np.abs((p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(1)) / 2


def is_box(ring: np.ndarray) -> bool:
    """Whether a ring is a rectangle along the axes."""
    if len(ring) != 4:
        return False
    a, b, c, d = ring.tolist()
    turned = a[0] == b[0] and b[1] == c[1] and c[0] == d[0] and d[1] == a[1]
    return turned or (a[1] == b[1] and b[0] == c[0] and c[1] == d[1] and d[0] == a[0])


def voronoi(ring: np.ndarray, sites: np.ndarray) -> list[np.ndarray]:
    """The part of a ring that is nearest to each site; sites at one place share it with the first of them."""
    box, sites = is_box(ring), np.asarray(sites, float)
    start = 0.0 if box else ring.min(0)  # short edges of cells keep their direction in small numbers
    corners, count = nearest_parts((ring.min(0) - start)[None], (ring.max(0) - start)[None], np.zeros(len(sites), np.int64), sites - start)
    parts = [c[:k] for c, k in zip(corners, count.tolist(), strict=True)]
    return parts if box else [clip_convex(ring - start, c) + start if len(c) else c for c in parts]


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = line[a], line[b]
        d = q - p
        n = np.hypot(*d)
        rest = line[a + 1 : b] - p
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / n if n else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring between its first point and the one farthest from it; a ring that would lose its area stays as it is."""
    k = int(np.hypot(*(ring - ring[0]).T).argmax())
    if not k:
        return ring
    out = np.vstack([simplify(ring[: k + 1], tolerance), simplify(np.vstack([ring[k:], ring[:1]]), tolerance)[1:-1]])
    return out if len(out) >= 3 else ring


def clean(polygons: list[list[np.ndarray]], least_part: float, largest_hole: float) -> list[list[np.ndarray]]:
    """Parts without the small ones, holes filled below a limit; all parts if every one is small."""
    filled = [[p[0], *[h for h in p[1:] if abs(ring_area(h)) >= largest_hole]] for p in polygons]
    large = [p for p in filled if area(p) >= least_part]
    return large or filled


def inner_point(polygon: list[np.ndarray]) -> tuple[float, float]:
    """A point inside: the middle of the longest stretch of a horizontal line half-way up."""
    ys = np.unique(polygon[0][:, 1])
    middle = (ys[0] + ys[-1]) / 2
    below, above = ys[ys <= middle].max(), ys[ys > middle].min() if (ys > middle).any() else middle
    y = (below + above) / 2
    xs = []
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if (ay > y) != (by > y):
                xs.append(ax + (y - ay) * (bx - ax) / (by - ay))
    xs.sort()
    if len(xs) < 2:
        return float(polygon[0][:, 0].mean()), float(y)
    k = int(np.argmax(np.diff(xs)[::2])) * 2
    return (xs[k] + xs[k + 1]) / 2, float(y)


def along(ring: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Points at shares of a ring's length."""
    closed = np.vstack([ring, ring[:1]])
    steps = np.hypot(*np.diff(closed, axis=0).T)
    ends = np.append(0, np.cumsum(steps))
    at = shares * ends[-1]
    return np.stack([np.interp(at, ends, closed[:, 0]), np.interp(at, ends, closed[:, 1])], 1)


def clip_line(a: np.ndarray, b: np.ndarray, polygon: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pieces of a segment inside a polygon."""
    cuts = [0.0, 1.0]
    d = b - a
    for ring in polygon:
        for p, q in zip(ring, np.roll(ring, -1, 0), strict=True):
            e = q - p
            den = d[0] * e[1] - d[1] * e[0]
            if den:
                t = ((p[0] - a[0]) * e[1] - (p[1] - a[1]) * e[0]) / den
                u = ((p[0] - a[0]) * d[1] - (p[1] - a[1]) * d[0]) / den
                if 0 < t < 1 and 0 <= u <= 1:
                    cuts.append(float(t))
    cuts = sorted(set(cuts))
    middles = np.array([a + d * (s + t) / 2 for s, t in zip(cuts, cuts[1:], strict=False)])
    inside = contains(polygon, middles)
    return [(a + d * s, a + d * t) for s, t, ok in zip(cuts, cuts[1:], inside, strict=False) if ok]


def dissolve(rings: list[np.ndarray], digits: int = 9, holes: list[np.ndarray] | tuple = ()) -> list[np.ndarray]:
    """Boundary rings of the union of rings, less their holes, that tile: edges that two of them share in opposite directions go."""
    edges: dict[tuple, int] = {}
    for r in [r if ring_area(r) > 0 else r[::-1] for r in rings] + [r if ring_area(r) < 0 else r[::-1] for r in holes]:
        pts = [tuple(p) for p in np.round(r, digits)]
        for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
            if p == q:
                continue
            if edges.get((q, p), 0):
                edges[q, p] -= 1
            else:
                edges[p, q] = edges.get((p, q), 0) + 1
    after: dict[tuple, list[tuple]] = {}
    for (p, q), n in edges.items():
        if n:
            after.setdefault(p, []).extend([q] * n)
    out = []
    while after:
        start = p = next(iter(after))
        ring = []
        while True:
            ring.append(p)
            q = after[p].pop()
            if not after[p]:
                del after[p]
            p = q
            if p == start:
                break
        out.append(np.array(ring))
    return out


def faces(segments: np.ndarray, digits: int = 6, least: float = 1.0) -> list[np.ndarray]:
    """Bounded faces of a line network, (n, 4) segments: they are cut at their crossings, then each face is walked around."""
    cuts: list[list[float]] = [[0.0, 1.0] for _ in segments]
    for i in range(len(segments)):
        a, d = segments[i, :2], segments[i, 2:] - segments[i, :2]
        p, e = segments[i + 1 :, :2], segments[i + 1 :, 2:] - segments[i + 1 :, :2]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((p[:, 0] - a[0]) * e[:, 1] - (p[:, 1] - a[1]) * e[:, 0]) / den
            u = ((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / den
        for k in np.flatnonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)):
            cuts[i].append(float(t[k]))
            cuts[i + 1 + k].append(float(u[k]))
    after: dict[tuple, set[tuple]] = {}
    for (ax, ay, bx, by), c in zip(segments, cuts, strict=True):
        pts = [tuple(np.round([ax + (bx - ax) * t, ay + (by - ay) * t], digits)) for t in sorted(set(c))]
        for p, q in zip(pts, pts[1:], strict=False):
            if p != q:
                after.setdefault(p, set()).add(q)
                after.setdefault(q, set()).add(p)
    ends = [p for p in after if len(after[p]) == 1]
    while ends:  # dead ends bound nothing
        p = ends.pop()
        if p in after and len(after[p]) == 1:
            (q,) = after.pop(p)
            after[q].discard(p)
            if len(after[q]) == 1:
                ends.append(q)
            elif not after[q]:
                del after[q]
    order = {p: sorted(qs, key=lambda q, p=p: np.arctan2(q[1] - p[1], q[0] - p[0])) for p, qs in after.items()}
    seen: set[tuple] = set()
    out = []
    for p in order:
        for q in order[p]:
            if (p, q) in seen:
                continue
            ring, a, b = [], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                turns = order[b]
                a, b = b, turns[turns.index(a) - 1]
            if ring_area(np.array(ring)) > least:
                out.append(np.array(ring))
    return out


def to_wkb(polygon: list[np.ndarray]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(polygon))
    for ring in polygon:
        closed = np.vstack([ring, ring[:1]])
        out += struct.pack("<I", len(closed)) + closed.astype("<f8").tobytes()
    return out


def to_multi(polygons: list[list[np.ndarray]]) -> bytes:
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(to_wkb, polygons))


def pieces(b: bytes) -> tuple[list[list[np.ndarray]], list[np.ndarray], list[np.ndarray]]:
    """Polygons, lines and points of any WKB geometry, collections included."""
    at, polygons, lines, points = 0, [], [], []

    def take(kind):
        nonlocal at
        v = struct.unpack_from(kind, b, at)
        at += struct.calcsize(kind)
        return v[0]

    def places(e, n):
        nonlocal at
        xy = np.frombuffer(b, e + "f8", 2 * n, at).reshape(n, 2).astype(float)
        at += 16 * n
        return xy

    def geometry():
        e = "<" if take("<B") else ">"
        kind = take(e + "I")
        if kind == 1:
            points.append(places(e, 1)[0])
        elif kind == 2:
            lines.append(places(e, take(e + "I")))
        elif kind == 3:
            polygons.append([places(e, take(e + "I"))[:-1] for _ in range(take(e + "I"))])
        elif kind in (4, 5, 6, 7):
            for _ in range(take(e + "I")):
                geometry()
        else:
            raise ValueError(f"geometry type {kind}")

    geometry()
    return polygons, lines, points


def from_wkb(b: bytes) -> list[list[np.ndarray]]:
    """Polygons of a WKB polygon or multipolygon."""
    polygons, lines, points = pieces(b)
    if lines or points:
        raise ValueError("not only polygons")
    return polygons


def line_to_wkb(line: np.ndarray) -> bytes:
    return struct.pack("<BII", 1, 2, len(line)) + np.asarray(line, "<f8").tobytes()
