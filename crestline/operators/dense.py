"""Dense routines over node sets that fit in one task or on the driver."""

from __future__ import annotations

import math
from collections import deque

import numpy as np


#: Nodes up to which a tree grows node by node, which takes the square of their number.
GROWN_NODES = 1000
#: Pairs of nodes, or ways between components, that are held at once.
PAIRS = 4_000_000


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Edges (i < j) of the Euclidean minimum spanning tree, ties by (length, i, j). Ways up to a length are found among near cells of a grid of that width; the length
    doubles, and only cells of unlike components meet, until all nodes hang together."""
    n, d = x.shape
    if n <= GROWN_NODES or not np.isfinite(x).all():
        return grown_tree(x)
    # of nodes in one place all hang on the first, which alone has ways to others
    _, at, place = np.unique(x, axis=0, return_index=True, return_inverse=True)
    first = at[place.ravel()]
    same = np.flatnonzero(first != np.arange(n))
    own = np.sort(at)
    y = x[own]
    label, width = np.arange(len(y)), float((x.max(0) - x.min(0)).max())
    # cells are counted in whole numbers that keep all digits
    while width > float((x.max(0) - x.min(0)).max()) * 2.0**-50 and (grid_cells(y, width)[1] ** 2).sum() > 4 * len(y):
        width /= 2
    edges = np.zeros((0, 2), np.int64)
    while (label != label[0]).any():
        ways = np.zeros((0, 2), np.int64)
        for more in near_pairs(y, label, width):
            ways = np.concatenate((ways, more))
            if len(ways) > PAIRS:
                ways = ways[forest(y, ways, label)[0]]
        kept, label = forest(y, ways, label)
        edges = np.concatenate((edges, ways[kept]))
        width *= 2
    out = np.concatenate((own[edges], np.stack((first[same], same), 1)))
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def grid_cells(x: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of points by their cells, sizes of the cells, and whole coordinates of each."""
    cell = np.floor((x - x.min(0)) / width)
    order = np.lexsort(cell.T)
    ordered = cell[order]
    starts = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1))))
    return order, np.diff(np.append(starts, len(x))), ordered[starts]


def near_pairs(x: np.ndarray, label: np.ndarray, width: float):
    """Parts of the pairs (i < j) of points of unlike labels at a distance up to width."""
    # a little wider, so that rounding parts no pair by two cells
    order, sizes, cells = grid_cells(x, width * (1 + 1e-9))
    starts = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(label[order], starts), np.maximum.reduceat(label[order], starts)
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * x.shape[1], indexing="ij"), -1).reshape(-1, x.shape[1])
    for step in steps[len(steps) // 2 :]:
        # cells beside others are found in one sorted list of both
        both, number = np.unique(np.concatenate((cells, cells + step)), axis=0, return_inverse=True)
        number = number.ravel()
        there = np.full(len(both), -1)
        there[number[: len(cells)]] = np.arange(len(cells))
        b = there[number[len(cells) :]]
        a = np.flatnonzero(b >= 0)
        b = b[a]
        mixed = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b = a[mixed], b[mixed]
        # a row is a point of the first cell with all of the second
        rows = np.repeat(np.arange(len(a)), sizes[a])
        i = np.arange(len(rows)) - np.repeat(np.cumsum(sizes[a]) - sizes[a], sizes[a]) + starts[a][rows]
        ends = np.cumsum(sizes[b][rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = sizes[b][rows[at:to]]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[b][rows[at:to]], n)
            p, q = order[np.repeat(i[at:to], n)], order[j]
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            if not step.any():
                p, q = p[p < q], q[p < q]
            near = ((x[p] - x[q]) ** 2).sum(1) <= width * width
            yield np.stack((np.minimum(p, q)[near], np.maximum(p, q)[near]), 1)
            at = to


def forest(x: np.ndarray, pairs: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that belong to the shortest trees over components named by label, ties by (length, i, j), and the components then."""
    d2 = ((x[pairs[:, 0]] - x[pairs[:, 1]]) ** 2).sum(1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0], d2))
    a, b = label[pairs[order, 0]], label[pairs[order, 1]]
    root, kept, left = np.arange(len(label)), [], np.arange(len(order))
    while len(left):
        best = np.full(len(label), len(order))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        took = np.unique(best[best < len(order)])
        kept.append(took)
        at = np.searchsorted(left, took)
        link, own, other = np.arange(len(label)), a[at], b[at]
        # each component follows its best way; of two that share it the lesser stays
        for here, there in ((own, other), (other, own)):
            mine = best[here] == took
            link[here[mine]] = there[mine]
        back = link[link] == np.arange(len(link))
        link = np.where(back & (np.arange(len(link)) < link), np.arange(len(link)), link)
        while (link[link] != link).any():
            link = link[link]
        root = link[root]
        a, b = link[a], link[b]
        open_ = a != b
        a, b, left = a[open_], b[open_], left[open_]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64), root[label]


def sure_pairs(x: np.ndarray, pairs: np.ndarray, rim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least member of each node's component by those pairs of a tree that belong to the tree of any larger set too, and these pairs. rim: a distance that further nodes keep at least from each node."""
    d2 = ((x[pairs[:, 0]] - x[pairs[:, 1]]) ** 2).sum(1)
    far = np.sqrt(d2) * (1 + 1e-9)
    root, free, kept = list(range(len(x))), rim.tolist(), []

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for at in np.lexsort((pairs[:, 1], pairs[:, 0], d2)).tolist():
        a, b = top(int(pairs[at, 0])), top(int(pairs[at, 1]))
        if max(free[a], free[b]) > far[at]:
            kept.append(at)
        a, b = min(a, b), max(a, b)
        root[b], free[a] = a, min(free[a], free[b])
    sure = pairs[kept]
    label = np.arange(len(x))
    if len(sure):
        held = Compact(sure[:, 0], sure[:, 1])
        label[held.ids] = held.ids[held.labels()]
    return label, sure


def grown_tree(x: np.ndarray) -> np.ndarray:
    """spanning_tree of few nodes, grown from node 0."""
    n = len(x)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    inside = np.zeros(n, bool)
    best = np.full(n, np.inf)
    other = np.zeros(n, np.int64)
    every = np.arange(n)
    out = np.empty((n - 1, 2), np.int64)
    now = 0
    for step in range(n - 1):
        inside[now] = True
        d2 = ((x - x[now]) ** 2).sum(1)
        # of equal lengths the lesser pair wins
        low, high = np.minimum(every, now), np.maximum(every, now)
        kept_low, kept_high = np.minimum(every, other), np.maximum(every, other)
        closer = (d2 < best) | ((d2 == best) & ((low < kept_low) | ((low == kept_low) & (high < kept_high))))
        take = closer & ~inside
        best[take], other[take] = d2[take], now
        free = np.flatnonzero(~inside)
        shortest = best[free].min()
        ties = free[best[free] == shortest]
        if len(ties) > 1:
            ties = ties[np.lexsort((np.maximum(ties, other[ties]), np.minimum(ties, other[ties])))]
        now = ties[0]
        out[step] = sorted((now, other[now]))
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def relative_neighbour_pairs(x: np.ndarray, rows: np.ndarray | None = None, near: int = 24) -> np.ndarray:
    """Pairs (i < j) without a third point strictly nearer to both than they are to each other; only those of rows, if given, as i.
    The nearest points of i rule out almost every j; what is left is held against all points."""
    out = []
    for i in range(len(x)) if rows is None else rows:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        first = np.argpartition(d, near)[:near] if len(x) > near else np.flatnonzero(np.isfinite(d))
        later = np.arange(i + 1, len(x))
        blocked = np.zeros(len(later), bool)
        for r in first[np.argsort(d[first])]:
            left = later[~blocked]
            if not len(left):
                break
            blocked[~blocked] = (d[r] < d[left]) & (((x[left] - x[r]) ** 2).sum(1) < d[left])
        for j in later[~blocked]:
            closer = np.flatnonzero(d < d[j])
            if not (((x[closer] - x[j]) ** 2).sum(1) < d[j]).any():
                out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


#: Distance, in extents of the points, of the corners of a simplex that holds all of them.
FAR = 1e4


def unit_shift(ids: np.ndarray, dims: int) -> np.ndarray:
    """A number from -1 to 1 for each id and dimension, the same wherever it is worked out."""
    z = (ids.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(1, dims + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(float) / 2.0**63 - 1


def sphere(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and squared radius of the sphere through the corners of a simplex."""
    centre = np.linalg.solve(2 * (points[1:] - points[0]), (points[1:] ** 2).sum(1) - (points[0] ** 2).sum())
    return centre, float(((points[0] - centre) ** 2).sum())


def simplices(points: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """Delaunay simplices of points (about the origin, of extent 1) and of d + 1 far corners, which have the places after them, with their spheres; by adding points one
    after another (Bowyer and Watson's way), in any dimension from 2."""
    n, d = points.shape
    corners = np.concatenate((np.full((1, d), -FAR), np.eye(d) * FAR * (d + 1) - FAR))
    points = np.concatenate((points, corners))
    cells = [tuple(range(n, n + d + 1))]
    spheres = [sphere(points[list(cells[0])])]
    for p in range(n):
        centres = np.array([s[0] for s in spheres])
        radii = np.array([s[1] for s in spheres])
        bad = ((centres - points[p]) ** 2).sum(1) < radii
        faces: dict[tuple, int] = {}
        for c in np.flatnonzero(bad):
            for k in range(d + 1):
                face = tuple(sorted(cells[c][:k] + cells[c][k + 1 :]))
                faces[face] = faces.get(face, 0) + 1
        keep = np.flatnonzero(~bad)
        cells = [cells[c] for c in keep]
        spheres = [spheres[c] for c in keep]
        for face, times in faces.items():
            if times == 1:
                cells.append((*face, p))
                spheres.append(sphere(points[list(cells[-1])]))
    return cells, spheres


def delaunay_pairs(x: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
    """Edges (i < j) of the Delaunay triangulation. A shift of up to 1e-9 of the extent, fixed by a point's id (its place, if none is given), settles cocircular points."""
    n, d = x.shape
    if n < 2:
        return np.zeros((0, 2), np.int64)
    if n <= d:
        return np.array([(i, j) for i in range(n) for j in range(i + 1, n)], np.int64)
    extent = max(float((x.max(0) - x.min(0)).max()), 1e-12)
    shift = unit_shift(np.arange(n) if ids is None else ids, d) * extent * 1e-9
    cells, _ = simplices((x - x.mean(0) + shift) / extent)
    pairs = {(min(a, b), max(a, b)) for c in cells for i, a in enumerate(c) for b in c[i + 1 :] if a < n and b < n}
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def fold_trees(place: dict, first: list[tuple], samples: list[tuple], reps: int, k: float) -> list[tuple]:
    """The merge of merged_trees: (src, dst, p) in the order edges were added."""
    order = list(first)
    number = {e: i for i, e in enumerate(order)}
    length = [float(np.linalg.norm(place[a] - place[b])) for a, b in order]
    p = [0.0] * len(order)
    around: dict = {}
    for a, b in order:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    counted: set[int] = set()
    now = None
    for rep, a, b in samples:
        if rep != now:
            now, counted = rep, set()
        if (a, b) in number:
            path = [number[a, b]]
        else:
            path = [number[min(u, v), max(u, v)] for u, v in fewest_hops(around, a, b)]
            direct = float(np.linalg.norm(place[a] - place[b]))
            if direct <= sum(length[e] for e in path) / k:
                number[a, b] = len(order)
                order.append((a, b))
                length.append(direct)
                p.append(0.0)
                around[a].append(b)
                around[b].append(a)
                continue
        for e in path:
            if e not in counted:
                p[e] += 1 / reps
                counted.add(e)
    return [(int(a), int(b), float(v)) for (a, b), v in zip(order, p, strict=True)]


def fewest_hops(around: dict, a, b) -> list[tuple]:
    """Edges of a path of fewest hops from a to b."""
    came, queue = {a: a}, deque([a])
    while queue and b not in came:
        u = queue.popleft()
        for v in around.get(u, ()):
            if v not in came:
                came[v] = u
                queue.append(v)
    out = []
    while b in came and b != a:
        out.append((came[b], b))
        b = came[b]
    return out[::-1]


def laplacian_solve(n: int, src: np.ndarray, dst: np.ndarray, ridge: np.ndarray, lam: float, right: np.ndarray, most_dense: int = 3000) -> np.ndarray:
    """Solve (lam L + diag(ridge)) F = right for all columns at once; L is the Laplacian with the multiplicity of the edges."""
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
    return weighted_solve(lam * degree + ridge, src, dst, np.full(len(src), lam), right, most_dense)


def weighted_solve(diagonal: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, right: np.ndarray, most_dense: int = 3000) -> np.ndarray:
    """Solve for a matrix with the given diagonal and -w for each listed edge, both ways. Beyond most_dense nodes by conjugate gradients with a
    diagonal preconditioner; an error if they do not settle."""
    n = len(diagonal)
    if n <= most_dense:
        left = np.zeros((n, n))
        np.subtract.at(left, (src, dst), w)
        np.subtract.at(left, (dst, src), w)
        left[np.arange(n), np.arange(n)] += diagonal
        return np.linalg.solve(left, right)
    diagonal = diagonal[:, None]

    def times(v):
        out = diagonal * v
        for j in range(v.shape[1]):
            out[:, j] -= np.bincount(src, w * v[dst, j], n) + np.bincount(dst, w * v[src, j], n)
        return out

    x = right / diagonal
    r = right - times(x)
    z = r / diagonal
    p, rz = z.copy(), (r * z).sum(0)
    for _ in range(20 * n):
        if np.abs(r).max() <= 1e-12 * max(1.0, np.abs(right).max()):
            return x
        ap = times(p)
        step = rz / np.maximum((p * ap).sum(0), 1e-300)
        x, r = x + step * p, r - step * ap
        z = r / diagonal
        new = (r * z).sum(0)
        p, rz = z + new / np.maximum(rz, 1e-300) * p, new
    raise RuntimeError(f"the system did not settle: residual {np.abs(r).max()}")


def central(turn: int) -> bool:
    """Whether the search of this turn starts at the most central node."""
    return turn > 2 and turn % 2 == 1


def search_order(hops, low, high, turn: int):
    """What is least for the node to search from next: any, twice the furthest from the last one, then in turn the most central one and the one of the largest bound."""
    return -hops if turn in (1, 2) else low if central(turn) else -high


class Compact:
    """A small undirected graph with nodes as places in ids, its neighbours end to end."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None):
        self.ids, both = np.unique(np.concatenate((src, dst)), return_inverse=True)
        a, b = both[: len(src)], both[len(src) :]
        start, stop = np.concatenate((a, b)), np.concatenate((b, a))
        order = np.lexsort((stop, start))
        self.start, self.to = start[order], stop[order]
        self.w = None if w is None else np.concatenate((w, w))[order]
        self.first = np.searchsorted(self.start, np.arange(len(self.ids) + 1))

    def place(self, node) -> int:
        """Place of a node, or -1."""
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def out(self, front: np.ndarray) -> np.ndarray:
        """Places in `to` of all edges that leave front."""
        sizes = self.first[front + 1] - self.first[front]
        return np.repeat(self.first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def labels(self) -> np.ndarray:
        """The least place of each node's component."""
        label = np.arange(len(self.ids))
        while True:
            low = label.copy()
            np.minimum.at(low, self.start, label[self.to])
            np.minimum.at(low, label, low)
            low = low[low]
            if (low == label).all():
                return label
            label = low

    def walk(self, source: int, by_hops: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, hops, lengths) reached from a place: along paths of fewest hops (the shortest of these), or shortest paths."""
        n = len(self.ids)
        hops, length = np.full(n, -1), np.full(n, np.inf)
        hops[source], length[source] = 0, 0.0
        front, step = np.array([source]), 0
        while len(front):
            step += 1
            e = self.out(front)
            to, new = self.to[e], length[self.start[e]] + (1.0 if self.w is None else self.w[e])
            fresh = hops[to] < 0 if by_hops else new < length[to] - 1e-12
            to, new = to[fresh], new[fresh]
            np.minimum.at(length, to, new)
            front = np.unique(to)
            hops[front] = step
        at = np.flatnonzero(hops >= 0)
        return at, hops[at], length[at]

    def hops_from(self, sources: np.ndarray) -> np.ndarray:
        """Hops of each node to the nearest of some places, -1 where none is reached."""
        hops, front, step = np.full(len(self.ids), -1), sources, 0
        hops[sources] = 0
        while len(front):
            step += 1
            to = self.to[self.out(front)]
            front = np.unique(to[hops[to] < 0])
            hops[front] = step
        return hops

    def diameter(self, searches: list[int] | None = None) -> int:
        """Most hops between two connected nodes, by searches from the nodes whose bounds allow more than was found, one in each component at a time."""
        label = self.labels()
        low, high = np.zeros(len(label), int), np.bincount(label, minlength=len(label))[label] - 1
        best, turn, hops = 0, 0, np.zeros(len(label), int)
        searched, open_ = np.zeros(len(label), bool), high > 0
        while open_.any():
            # a central node may bound the others well though it is itself no end of a longest path
            live = np.isin(label, label[open_])
            able = np.flatnonzero(live & ~searched if central(turn) else open_)
            order = able[np.lexsort((able, search_order(hops, low, high, turn)[able], label[able]))]
            sources = order[np.concatenate(([True], np.diff(label[order]) > 0))]
            if searches is not None:
                searches.append(len(sources))
            searched[sources] = True
            hops = self.hops_from(sources)
            far = np.zeros(len(label), int)
            np.maximum.at(far, label, hops)
            ecc = far[label]
            seen = hops >= 0
            low[seen] = np.maximum(low, np.maximum(hops, ecc - hops))[seen]
            high[seen] = np.minimum(high, ecc + hops)[seen]
            best, turn = max(best, int(far.max())), turn + 1
            open_ = (high > best) & (low < high) & ~searched
        return best

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(coreness, layer, global layer) of each node, 0 where it was never taken, and the last core and layer counter."""
        n = len(self.ids)
        alive, deg = np.ones(n, bool), np.diff(self.first)
        core_of, layer_of, round_of = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
        core = layer = step = 1
        while True:
            taken = np.flatnonzero(alive & (deg <= core) & (deg > 0))
            core_of[taken], layer_of[taken], round_of[taken] = core, layer, step
            alive[taken] = False
            deg = np.bincount(self.start, alive[self.start] & alive[self.to], n)
            layer, step = layer + 1, step + 1
            left = deg[alive & (deg > 0)]
            if not len(left):
                return core_of, layer_of, round_of, core, layer
            if left.min() >= core + 1:
                core, layer = core + 1, 1


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None, cells: int = 4_000_000):
    """For parts of queries: (places of queries, ranks from 1, ids, squared distances) of the k nearest points, ties to the
    smaller id; own leaves out points of the query's own id."""
    step = max(1, cells // max(1, len(points)))
    for a in range(0, len(queries), step):
        some = queries[a : a + step]
        d2 = np.zeros((len(some), len(points)))
        for j in range(points.shape[1]):
            d2 += (some[:, j, None] - points[None, :, j]) ** 2
        if own is not None:
            d2[own[a : a + step, None] == ids[None]] = np.inf
        kth = np.partition(d2, k - 1, 1)[:, k - 1] if k < len(points) else np.full(len(some), np.inf)
        q, p = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
        order = np.lexsort((ids[p], d2[q, p], q))
        q, p = q[order], p[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        kept = rank <= k
        yield a + q[kept], rank[kept], ids[p[kept]], d2[q[kept], p[kept]]


class Cells:
    """Nodes by grid cell, to find those near a batch of points."""

    def __init__(self, x: np.ndarray, sig: np.ndarray, ksig: float):
        self.x, self.reach2 = x, ksig * ksig * sig
        self.width = max(float(np.sqrt(self.reach2.max())), 1e-300)
        self.low = x.min(0)
        self.table: dict[tuple, list[int]] | None = None

    def _fill(self) -> None:
        self.table = {}
        dims = self.x.shape[1]
        steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * dims, indexing="ij"), -1).reshape(-1, dims)
        for k, c in enumerate(self._cell(self.x)):
            for s in steps:
                self.table.setdefault(tuple(c + s), []).append(k)

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return np.floor((x - self.low) / self.width).astype(np.int64)

    def pairs(self, points: np.ndarray, most: int = 4_000_000):
        """(places of points, places of nodes, squared distances) of pairs within reach, in parts of bounded size, no point in two parts;
        few enough pairs are compared at once."""
        if len(points) * len(self.x) <= most // 8:
            d2 = np.zeros((len(points), len(self.x)))
            for j in range(points.shape[1]):
                d2 += (points[:, j, None] - self.x[None, :, j]) ** 2
            p, n = np.nonzero(d2 <= self.reach2)
            yield p, n, d2[p, n]
            return
        if self.table is None:
            self._fill()
        cells = self._cell(points)
        order = np.lexsort(cells.T)
        ordered = cells[order]
        starts = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1)))) if len(order) else np.zeros(0, np.int64)
        held: list[tuple] = []
        size = 0
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            near = self.table.get(tuple(ordered[a]))
            if not near:
                continue
            near = np.array(near)
            step = max(1, most // len(near))
            for c in range(a, b, step):
                some = order[c : min(b, c + step)]
                d2 = ((points[some][:, None, :] - self.x[near][None]) ** 2).sum(2)
                p, n = np.nonzero(d2 <= self.reach2[near])
                held.append((some[p], near[n], d2[p, n]))
                size += len(p)
                if size > most:
                    yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


def shares(cells: Cells, points: np.ndarray, sig: np.ndarray, pi: np.ndarray, floor: float):
    """For parts of the points: places of points and nodes, r of each pair."""
    d = points.shape[1]
    for p, k, d2 in cells.pairs(points):
        weight = pi[k] * (2 * math.pi * sig[k]) ** (-d / 2) * np.exp(-d2 / (2 * sig[k]))
        whole = np.bincount(p, weight, len(points)) + floor
        yield p, k, weight / np.maximum(whole[p], 1e-300)


def segment_distances(x: np.ndarray, start: np.ndarray, stop: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    """Distance of each of x to the nearest of the segments from start to stop."""
    way = stop - start
    size = np.maximum((way**2).sum(1), 1e-300)
    best = np.full(len(x), np.inf)
    step = max(1, cells // max(1, len(x)))
    for a in range(0, len(start), step):
        b = slice(a, a + step)
        t = np.clip(((x[:, None, :] - start[None, b]) * way[None, b]).sum(2) / size[b], 0, 1)
        d2 = ((x[:, None, :] - start[None, b] - t[:, :, None] * way[None, b]) ** 2).sum(2)
        best = np.minimum(best, d2.min(1))
    return np.sqrt(best)
