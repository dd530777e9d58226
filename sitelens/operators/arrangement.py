"""Many small arrangements of edges at once: those of all groups (tiles, or keys) of a batch lie in one table of arrays.

An end is a code of its group and its place there, so that one sort serves all groups; coordinates count from the group's least."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bits of a coordinate within its group and the greatest extent of a group; candidate pairs that are looked at in one step.
BITS, SPAN, PAIRS = 21, 1 << 20, 1 << 20
_MASK = (1 << BITS) - 1


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each count n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _steps(counts: np.ndarray) -> Iterator[slice]:
    """Slices of the counts whose sums are at most PAIRS, or of one count."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        yield slice(at, end)
        at = end


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code >> BITS & _MASK, code & _MASK


def _crossings(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, code of a point): where edges of a group cross inside both, rounded, for both edges; they are sorted by their smaller end."""
    (x0, y0), (x1, y1) = _split(lo), _split(hi)
    dx, dy, low, high = x1 - x0, y1 - y0, np.minimum(y0, y1), np.maximum(y0, y1)
    own = np.arange(len(lo))
    # those that start further on in the order, but before the edge ends
    counts = np.maximum(np.searchsorted(lo >> BITS, hi >> BITS) - own - 1, 0)
    edges, points = [own[:0]], [lo[:0]]
    for s in _steps(counts):
        i = np.repeat(own[s], counts[s])
        j = i + 1 + ranges(counts[s])
        meet = (low[i] < high[j]) & (low[j] < high[i])
        i, j = i[meet], j[meet]
        a = dx[i] * (y0[j] - y0[i]) - dy[i] * (x0[j] - x0[i])
        b = dx[i] * (y1[j] - y0[i]) - dy[i] * (x1[j] - x0[i])
        c = dx[j] * (y0[i] - y0[j]) - dy[j] * (x0[i] - x0[j])
        d = dx[j] * (y1[i] - y0[j]) - dy[j] * (x1[i] - x0[j])
        meet = (a != 0) & (b != 0) & (c != 0) & (d != 0) & ((a < 0) != (b < 0)) & ((c < 0) != (d < 0))
        i, j = i[meet], j[meet]
        t = ((x0[j] - x0[i]) * dy[j] - (y0[j] - y0[i]) * dx[j]) / (dx[i] * dy[j] - dy[i] * dx[j])
        x, y = np.rint(x0[i] + t * dx[i]).astype(np.int64), np.rint(y0[i] + t * dy[i]).astype(np.int64)
        edges += [i, j]
        points += [lo[i] >> 2 * BITS << 2 * BITS | x << BITS | y] * 2
    return np.concatenate(edges), np.concatenate(points)


def _touched(lo: np.ndarray, hi: np.ndarray, nodes: np.ndarray, edge: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, node) of the given pairs and of those where an edge passes through the open unit square around a node, in the
    order of nodes along edges. An edge's ends are none of its nodes."""
    (x0, y0), (x1, y1) = _split(lo), _split(hi)
    x, y = _split(nodes)
    dx, dy, low, high = x1 - x0, y1 - y0, np.minimum(y0, y1), np.maximum(y0, y1)
    length = dx * dx + dy * dy
    upright = dx == 0
    first = np.where(upright, np.searchsorted(nodes, lo, side="right"), np.searchsorted(nodes, lo >> BITS << BITS))
    last = np.where(upright, np.searchsorted(nodes, hi), np.searchsorted(nodes, hi | _MASK, side="right"))
    counts = np.maximum(last - first, 0)
    own, edges, found = np.arange(len(lo)), [edge], [node]
    for s in _steps(counts):
        e = np.repeat(own[s], counts[s])
        n = np.repeat(first[s], counts[s]) + ranges(counts[s])
        near = (y[n] >= low[e]) & (y[n] <= high[e])
        e, n = e[near], n[near]
        off = dx[e] * (y[n] - y0[e]) - dy[e] * (x[n] - x0[e])
        near = 2 * np.abs(off) < np.abs(dx[e]) + np.abs(dy[e])
        edges.append(e[near])
        found.append(n[near])
    edge, node = np.concatenate(edges), np.concatenate(found)
    along = (x[node] - x0[edge]) * dx[edge] + (y[node] - y0[edge]) * dy[edge]
    order = np.lexsort((node, along, edge))
    order = order[((along > 0) & (along < length[edge]))[order]]
    edge, node = edge[order], node[order]
    new = np.concatenate([[True], (edge[1:] != edge[:-1]) | (node[1:] != node[:-1])])[: len(edge)]
    return edge[new], node[new]


def noded(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (smaller end, greater end, weights) out of edges from a to b, split wherever they meet, merged where they are equal.

    An edge is split at its rounded crossings and at every node through whose unit square it passes, until there is none. Its pieces are
    shorter each time, so that ends. Groups in which a round splits
    nothing are through."""
    done = [(a[:0], a[:0], weight[:0])]
    while len(a):
        back, live = a > b, a != b
        lo, hi, weight = np.where(back, b, a)[live], np.where(back, a, b)[live], np.where(back[:, None], -weight, weight)[live]
        if not len(lo):
            break
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        head = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        weight = np.add.reduceat(weight[order], head, axis=0)
        some = (weight != 0).any(axis=1)
        lo, hi, weight = lo[head][some], hi[head][some], weight[some]
        edge, point = _crossings(lo, hi)
        nodes = np.unique(np.concatenate([lo, hi, point]))
        edge, node = _touched(lo, hi, nodes, edge, np.searchsorted(nodes, point))
        if not len(edge):
            done.append((lo, hi, weight))
            break
        group = lo >> 2 * BITS
        again = np.zeros(group[-1] + 1, bool)
        again[group[edge]] = True
        again = again[group]
        done.append((lo[~again], hi[~again], weight[~again]))
        own = np.flatnonzero(again)
        of = np.concatenate([own, edge, own])
        ends = np.concatenate([lo[own], nodes[node], hi[own]])
        order = np.argsort(of, kind="stable")
        of, ends = of[order], ends[order]
        next_ = np.flatnonzero(of[1:] == of[:-1])
        a, b, weight = ends[next_], ends[next_ + 1], weight[of[next_]]
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def windings(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers to the left and to the right of each noded edge, seen from its smaller end.

    Between neighbouring heights of nodes edges lie side by side, so a sum along each such row gives what is east of an edge; one level
    edge takes what is east of its middle in the row above it."""
    group = lo >> 2 * BITS
    (x0, y0), (x1, y1) = _split(lo), _split(hi)
    low, high, level = np.minimum(y0, y1), np.maximum(y0, y1), y0 == y1
    at = lambda y: group << BITS | y
    heights = np.unique(np.concatenate([at(y0), at(y1)]))
    first, last = np.searchsorted(heights, at(low)), np.searchsorted(heights, at(high))
    counts = np.where(level, 0, last - first)
    e = np.repeat(np.arange(len(lo)), counts)
    row = np.repeat(first, counts) + ranges(counts)
    bottom, top = heights[row] & _MASK, heights[np.minimum(row + 1, len(heights) - 1)] & _MASK
    slope = (x1 - x0)[e] / (y1 - y0)[e]
    from_x = x0[e] + (bottom - y0[e]) * slope
    middle = x0[e] + ((bottom + top) / 2 - y0[e]) * slope
    own = np.where((y1 > y0)[:, None], weight, -weight)

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by row and x, sums of weights up to a place in it, each row's end."""
        order = np.lexsort((x, row))
        total = np.concatenate([np.zeros((1, weight.shape[1]), np.int64), np.cumsum(own[e[order]], axis=0)])
        return order, total, np.searchsorted(row[order], np.arange(len(heights)), side="right")

    left, right = np.zeros_like(weight), np.zeros_like(weight)
    order, total, end = sums(middle)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    steep = np.flatnonzero(~level)
    # the row in which the edge's middle lies
    mid = np.clip(np.searchsorted(heights, at((low + high) // 2), side="right") - 1, first, np.maximum(last - 1, first))[steep]
    entry = (np.cumsum(counts) - counts)[steep] + mid - first[steep]
    beyond = total[end[mid]] - total[place[entry] + 1]
    north = (y1 > y0)[steep][:, None]
    left[steep], right[steep] = np.where(north, beyond + own[steep], beyond), np.where(north, beyond, beyond + own[steep])
    flat = np.flatnonzero(level)
    if len(flat):
        order, total, end = sums(from_x)
        wide = float(1 << BITS + 1)
        key = row[order] * wide + from_x[order]
        above = first[flat]
        east = np.searchsorted(key, above * wide + (x0 + x1)[flat] / 2, side="right")
        left[flat] = total[end[above]] - total[np.minimum(east, end[above])]
        right[flat] = left[flat] - weight[flat]
    return left, right


Inside = Callable[[np.ndarray], np.ndarray]


def solved(group: np.ndarray, side: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray, sides: int, insides: list[Inside]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each inside (group, (x0, y0, x1, y1)) of the result's edges, the inside on their left, out of rings: group (sorted, from 0 on) and
    side of each, points from ends[k] to ends[k + 1]."""
    size = np.diff(ends)
    of = np.repeat(group, size)
    if not len(of):
        return [(of, np.zeros((0, 4), np.int64))] * len(insides)
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    base = np.zeros((of[-1] + 1, 2), np.int64)
    base[of[heads], 0], base[of[heads], 1] = np.minimum.reduceat(x, heads), np.minimum.reduceat(y, heads)
    code = of << 2 * BITS | x - base[of, 0] << BITS | y - base[of, 1]
    after = np.arange(1, len(of) + 1)
    some = size > 0
    after[ends[1:][some] - 1] = ends[:-1][some]
    weight = np.zeros((len(of), sides), np.int64)
    weight[np.arange(len(of)), np.repeat(side, size)] = 1
    lo, hi, weight = noded(code, code[after], weight)
    left, right = windings(lo, hi, weight) if len(lo) else (weight, weight)
    out = []
    for inside in insides:
        a, b = inside(left), inside(right)
        ahead, back = a & ~b, b & ~a
        p, q = np.concatenate([lo[ahead], hi[back]]), np.concatenate([hi[ahead], lo[back]])
        order = np.argsort(p >> 2 * BITS, kind="stable")
        p, q = p[order], q[order]
        of = p >> 2 * BITS
        out.append((of, np.stack([*_split(p), *_split(q)], axis=1) + np.tile(base[of], 2)))
    return out


def measures(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed area and length of rings, seen from their first points."""
    size = np.diff(ends)
    of = np.repeat(np.arange(len(size)), size)
    after = np.arange(1, len(x) + 1)
    some = size > 0
    after[ends[1:][some] - 1] = ends[:-1][some]
    x, y = (x - x[ends[of]]).astype(np.float64), (y - y[ends[of]]).astype(np.float64)
    area = np.bincount(of, x * y[after] - x[after] * y, len(size)) / 2
    return area, np.bincount(of, np.hypot(x[after] - x, y[after] - y), len(size))


def turned(x: np.ndarray, y: np.ndarray, ends: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings, anticlockwise or (holes) clockwise."""
    area, _ = measures(x, y, ends)
    of = np.repeat(np.arange(len(area)), np.diff(ends))
    at = np.arange(len(x))
    at = np.where(((area < 0) != hole)[of], ends[of] + ends[of + 1] - 1 - at, at)
    return x[at], y[at], ends


def traced(group: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, ends, points) of the rings of whole groups' edges, as tracing makes them: at a point along the first edge clockwise,
    without points on straight sides, from the smallest point on. Edges without one to go on to are left out."""
    none = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64)
    if not len(edges):
        return none
    x0, y0, x1, y1 = edges.T
    node = _labels(group, edges)
    start, end = node[: len(edges)], node[len(edges) :]
    go, come = np.argsort(start, kind="stable"), np.argsort(end, kind="stable")
    n = node.max() + 1
    out, into = np.bincount(start, minlength=n), np.bincount(end, minlength=n)
    begin = np.cumsum(out) - out
    after = np.full(len(edges), -1)
    one = out[end] == 1
    after[one] = go[begin[end[one]]]
    many = come[(out[end] > 1)[come]]
    if len(many):
        counts = out[end[many]]
        i = np.repeat(many, counts)
        j = go[np.repeat(begin[end[many]], counts) + ranges(counts)]
        came, on = np.arctan2(y0[i] - y1[i], x0[i] - x1[i]), np.arctan2(y1[j] - y0[j], x1[j] - x0[j])
        turn = np.where(came > on, came - on, came - on + 2 * np.pi)
        order = np.lexsort((turn, i))
        i, j = i[order], j[order]
        head = np.concatenate([[True], i[1:] != i[:-1]])
        after[i[head]] = j[head]
    chain, starts, seen, follow = [], [], bytearray(len(edges)), after.tolist()
    for i in range(len(edges)):
        if not seen[i]:
            begun, at = len(chain), i
            while at >= 0 and not seen[at]:
                seen[at] = 1
                chain.append(at)
                at = follow[at]
            if at == i:
                starts.append(begun)
            else:
                del chain[begun:]
    if not starts:
        return none
    chain, starts = np.array(chain), np.array(starts)
    ring = np.repeat(np.arange(len(starts)), np.diff([*starts, len(chain)]))
    points = edges[chain, :2]
    # bends only
    last = np.concatenate([starts[1:], [len(chain)]]) - 1
    before, ahead = np.arange(-1, len(chain) - 1), np.arange(1, len(chain) + 1)
    before[starts], ahead[last] = last, starts
    p, q, r = points[before], points, points[ahead]
    bend = (q[:, 0] - p[:, 0]) * (r[:, 1] - q[:, 1]) != (q[:, 1] - p[:, 1]) * (r[:, 0] - q[:, 0])
    ring, points = ring[bend], points[bend]
    size = np.bincount(ring, minlength=len(starts))
    of = group[chain[starts]]
    first = np.cumsum(size) - size
    # from the smallest point on
    order = np.lexsort((np.arange(len(ring)), points[:, 1], points[:, 0], ring))
    least = order[first[size > 0]] if len(ring) else order
    shift = np.zeros(len(starts), np.int64)
    shift[size > 0] = least - first[size > 0]
    index = first[ring] + (ranges(size) + shift[ring]) % size[ring]
    points = points[index]
    keep = size > 2
    points = points[keep[ring]]
    return of[keep], np.concatenate([[0], np.cumsum(size[keep])]), points


def _labels(group: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A number for each different end (group, x, y), of all starts, then of all ends."""
    g, x, y = np.concatenate([group, group]), np.concatenate([edges[:, 0], edges[:, 2]]), np.concatenate([edges[:, 1], edges[:, 3]])
    order = np.lexsort((y, x, g))
    g, x, y = g[order], x[order], y[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    return out


def _cut(x: np.ndarray, y: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The parts of rings at either side of x = at (one for each ring): (x, y, ends) of the lower and the upper ones."""
    size = np.diff(ends)
    of = np.repeat(np.arange(len(size)), size)
    after = np.arange(1, len(x) + 1)
    after[ends[1:] - 1] = ends[:-1]
    line, qx, qy = at[of], x[after], y[after]
    cross = (x - line > 0) & (qx - line < 0) | (x - line < 0) & (qx - line > 0)
    ahead = x < qx
    ax, ay, bx, by = np.where(ahead, x, qx), np.where(ahead, y, qy), np.where(ahead, qx, x), np.where(ahead, qy, y)
    wide = np.where(cross, bx - ax, 1)
    across = ay + (2 * (by - ay) * (line - ax) + wide) // (2 * wide)
    out = []
    for own in (x <= line, x >= line):
        keep = np.stack([own, cross], axis=1)
        px, py = np.stack([x, line], axis=1)[keep], np.stack([y, across], axis=1)[keep]
        out.append([px, py, np.concatenate([[0], np.cumsum(np.bincount(of, weights=keep.sum(axis=1), minlength=len(size)).astype(np.int64))])])
    return out[0], out[1]


def taken(x: np.ndarray, y: np.ndarray, ends: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, ends) of some of the rings."""
    size = np.diff(ends)[rings]
    at = np.repeat(ends[:-1][rings], size) + ranges(size)
    return x[at], y[at], np.concatenate([[0], np.cumsum(size)])


def tiled(x: np.ndarray, y: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, tile column, tile row, x, y, ends) of the parts of rings of three points or more: columns are cut first, then rows, each at
    the middle line of what is left."""
    ring = np.arange(len(ends) - 1)
    axes = []
    for _ in range(2):
        todo, done = [(ring, *axes, x, y, ends)], []
        while todo:
            ring, *more, x, y, ends = todo.pop()
            if not len(ring):
                continue
            low, high = np.minimum.reduceat(x, ends[:-1]), np.maximum.reduceat(x, ends[:-1])
            first = low // size
            last = np.maximum((high - 1) // size, first)
            whole = first == last
            fits, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
            done.append((ring[fits], *(m[fits] for m in more), first[fits], *taken(x, y, ends, fits)))
            if len(rest):
                own = ring[rest]
                for px, py, pends in _cut(*taken(x, y, ends, rest), (first[rest] + last[rest] + 1) // 2 * size):
                    some = np.flatnonzero(np.diff(pends) > 2)
                    todo.append((own[some], *(m[rest][some] for m in more), *taken(px, py, pends, some)))
        cols = list(zip(*done, strict=True)) if done else [(np.zeros(0, np.int64),)] * (4 + len(axes))
        ring, *axes, x, y = (np.concatenate(c) for c in cols[:-1])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for c in cols[-1]]) if done else [])]).astype(np.int64)
        x, y = y, x
    return ring, axes[0], axes[1], x, y, ends
