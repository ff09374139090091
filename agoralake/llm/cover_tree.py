"""Exact cosine links by dual traversal of cover trees.

Vectors are scaled to length one, where a cosine of c is a distance of
sqrt(2 - 2c).  A bounded sample gives the centres of the top cells, whose number
grows with the table up to ``TOP``; every vector goes to its nearest centre.  A cell
with more vectors than a part holds is split by distance from its centre, so its parts
are nested shells, each with an inner and an outer covering radius, and an outlier
widens the outermost part alone.  Each part gets a cover tree: nested levels of centres
with halving radii, every node with its exact covering radius.  Pairs of parts are
dropped by their covering radii, the others are traversed from the roots down.  A pair
of nodes is dropped when its centres are further apart than both covering radii and the
threshold together, counted whole when even its furthest vectors are within the
threshold, and opened otherwise.  Single vectors meet in matrix products, of a few
leading numbers and the length of the rest where that bound of the cosine tells enough;
what passes is decided in double precision.

A pair of parts yields link counts and what connects its vectors, never its pairs.  Equal
vectors are one node with a weight.  Parts grow with the table up to ``LARGEST``
vectors, so each vector meets a bounded number of parts up to 8 times that; beyond,
the bounds must prune.  For vectors without any structure in many dimensions no radius
can, and nearly all pairs are compared in their leading numbers.

Vectors meet those of their own number of dimensions.  Vectors that are null, zero, or
hold null or non-finite numbers link with nothing.  Every row is judged by its own
vector, also where rows share a vec_id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import checkpoint, row_by_row

#: Vectors in a part at least and at most, top cells, and rows of the sample that the top centres come from.
CELL, LARGEST, TOP, SAMPLE = 4_096, 65_536, 512, 4_096
#: Shells that a cell is split into by distance from its centre, before a hash splits them further.
SHELLS = 64
_SLACK = 1e-6
#: Levels below the root; single precision tells no smaller radii apart, so below them every vector is a node.
_DEPTH = 7
#: Centres tried at a time, vectors that they must cover on average, members from which on a radius is tried on a
#: sample first, and share of its pairs that nodes of the radius must settle.
_BATCH, _COVERED, _TRIED, _SETTLED = 256, 4.0, 64, 0.9
#: Rows and columns of a cosine matrix, and pairs of vectors held at a time.
_ROWS, _COLUMNS, _PAIRS = 512, 2_048, 1 << 16
#: Pairs of children from which on a matrix product serves, and pairs of vectors up to which nodes aren't opened.
_MANY, _SMALL = 4_096, 64
#: Leading numbers that may bound a cosine, nanoseconds of a product by its numbers, of a row in which a pair passes, and at most of a pair.
_LEADING, _PRODUCT_NS, _ROW_NS, _MOST_NS = (7, 11, 15, 19, 23, 27, 31, 47, 95), 0.043, 4_000.0, 8.0
#: Share of a matrix that passes from which on all of it is decided at once.
_DENSE = 0.08
#: Components of such a matrix that are told as stars; links of any others are told one by one.
_STARS = 16


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest number first, so that no square overflows or vanishes."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _rounding(width: int) -> float:
    """More than single precision adds to or takes from a cosine."""
    return 2e-7 * (width + 16)


class Level:
    """The nodes of one level: centres, covering radii, vectors (flat, with offsets) and children (offsets into the level below).

    A node's vectors are a range of the tree's order, which begins with its centre.
    """

    def __init__(self, order: np.ndarray, first: np.ndarray, radius: np.ndarray):
        self.flat, self.first, self.radius = order, first, radius
        self.centre = order[first[:-1]]
        self.single = np.diff(first) == 1
        self.kids = np.arange(len(first))  # at the last level each node is its own child

    def members(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i + 1]]

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.first[at + 1] - self.first[at]


def _levels(order: np.ndarray, born: np.ndarray, radii: list[np.ndarray]) -> list[Level]:
    """The levels from the one at which each vector begins a node, and the radii of each level's nodes of more vectors."""
    out: list[Level] = []
    for k, wide in enumerate(radii):
        first = np.append(np.flatnonzero(born <= k), len(order))
        radius = np.zeros(len(first) - 1)
        radius[np.diff(first) > 1] = wide
        level = Level(order, first, radius)
        if out:
            out[-1].kids = np.searchsorted(first, out[-1].first)
        out.append(level)
    return out


class Tree:
    """Nested levels of nodes, the root first; the radius of a node halves from level to level.

    A node is opened into the largest nodes that settle most pairs, by a sample: too far apart to hold a link (reach is
    the distance of one) or near enough to hold nothing else.  Centres that cover next to nothing but themselves, as in
    vectors without structure, are not looked for further: the vectors left over are a node each.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, reach: float = 0.0):
        self.x, self.weight, self.reach = x, weight, reach
        self.single = x.astype(np.float32)
        self.order = np.arange(len(x))
        self.born = np.full(len(x), _DEPTH, np.int8)
        self.born[0] = 0
        nodes = [(0, len(x), float(_distance(x, x[:1]).max()))] if len(x) > 1 else []
        self.radii = [np.array([r for _, _, r in nodes])]
        while nodes and len(self.radii) <= _DEPTH:
            size = 2.0 ** (1 - len(self.radii))
            below: list[tuple[int, int, float]] = []
            for at, to, radius in nodes:
                if radius <= size and len(self.radii) < _DEPTH:
                    below.append((at, to, radius))
                else:
                    self._open(at, to, size, len(self.radii), below)
            nodes = below
            self.radii.append(np.array([r for _, _, r in nodes]))
        self.levels = _levels(self.order, self.born, self.radii)

    def _open(self, at: int, to: int, size: float, level: int, below: list[tuple[int, int, float]]) -> None:
        """Orders a node's vectors by its children and notes where these begin; those of more vectors are added to below."""
        members, put = self.order[at:to], at
        least = 2.0**-_DEPTH
        if len(members) > _TRIED:
            rows = self.single[members[:: -(-len(members) // 64)]] @ self.single[members[:: -(-len(members) // 1024)]].T
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * rows))
            while size > least and np.mean((d > 2 * size + self.reach) | (d < self.reach - 2 * size)) < _SETTLED:
                size /= 2
        order = []
        if level < _DEPTH and size > least:
            for own, radius in self._cover(members, size):
                order.append(own)
                self.born[put] = min(self.born[put], level)
                if len(own) > 1:
                    below.append((put, put + len(own), radius))
                put += len(own)
        done = np.concatenate(order) if order else members[:0]
        if len(done) < len(members):
            left = members[~np.isin(members, done)] if len(done) else members
            order.append(left)
            self.born[put:to] = np.minimum(self.born[put:to], level)
        self.order[at:to] = np.concatenate(order)

    def _cover(self, members: np.ndarray, size: float) -> Iterator[tuple[np.ndarray, float]]:
        """The vectors within size of each centre that no centre before covers, the centre first, and their radius.

        It ends when all are covered, or when centres cover too few to go on.
        """
        least = np.float32(1.0 - size * size / 2.0 + _rounding(self.x.shape[1]))
        while len(members):
            batch = members[:_BATCH]
            near = self.single[batch] @ self.single[batch].T >= least
            centres: list[int] = []
            for i in range(len(batch)):
                if not near[i, centres].any():
                    centres.append(i)
            first = np.full(len(members), len(centres))
            for lo in range(0, len(members), 1 << 14):
                own = self.single[members[lo : lo + (1 << 14)]] @ self.single[batch[centres]].T >= least
                first[lo : lo + (1 << 14)] = np.where(own.any(axis=1), own.argmax(axis=1), len(centres))
            first[centres] = np.arange(len(centres))
            order = np.argsort(first, kind="stable")
            ends = np.searchsorted(first[order], np.arange(len(centres) + 1))
            for k, i in enumerate(centres):
                own = members[order[ends[k] : ends[k + 1]]]
                own = np.concatenate([batch[i : i + 1], own[own != batch[i]]])
                yield own, float(_distance(self.x[own], self.x[own[:1]]).max()) if len(own) > 1 else 0.0
            if ends[-1] < _COVERED * len(centres) and len(members) > _TRIED:
                return
            members = members[first == len(centres)]

    def packed(self, raw: np.ndarray) -> tuple:
        """What makes the tree again: vectors as given (in single precision where that loses nothing) and weights in its order, and its levels."""
        raw = raw[self.order]
        single = raw.astype(np.float32)
        return (single if (single == raw).all() else raw), self.weight[self.order], self.born, self.radii


class Vectors:
    """A packed tree: vectors and weights in its order, so that each node's are a range."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, born: np.ndarray, radii: list[np.ndarray]):
        self.raw, self.weight = raw, weight
        self.levels = _levels(np.arange(len(raw)), born, radii)
        self.single = np.empty(raw.shape, np.float32)
        for lo in range(0, len(raw), _PAIRS // 8):
            self.single[lo : lo + _PAIRS // 8] = self.double(slice(lo, lo + _PAIRS // 8))

    def double(self, at: np.ndarray | slice) -> np.ndarray:
        return unit(self.raw[at].astype(np.float64))

    def leading(self, turn: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        """k numbers of each vector turned, and the length of all others: their products are no smaller than the cosines."""
        out = np.empty((len(at), k + 1), np.float32)
        for lo in range(0, len(at), _PAIRS // 8):
            own = self.double(at[lo : lo + _PAIRS // 8]) @ turn[:, :k]
            out[lo : lo + len(own), :k] = own
            out[lo : lo + len(own), k] = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", own, own)))
        return out


def _unpacked(blob: pa.Buffer) -> tuple[np.ndarray, Vectors]:
    node, packed = pickle.loads(blob)
    return node, Vectors(*packed)


def _products(counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of pairs with some _PAIRS products in all; of each product its pair (in the slice) and its number within the pair."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        own = counts[at:to]
        pair = np.repeat(np.arange(to - at), own)
        yield slice(at, to), pair, np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own)
        at = to


def _places(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, in a matrix of which most rows hold nothing."""
    some = np.flatnonzero(matrix.any(axis=1))
    i, j = np.nonzero(matrix[some])
    return some[i], j


def _stars(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs that connect the same of n vectors: each with the smallest of its component."""
    root, (u, v) = np.arange(n), pairs.T
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(n))
    return np.stack([some, root[some]], axis=1)


class Links:
    """What a traversal finds: weights of linked vectors for each side, and pairs that connect them.

    Single precision finds candidates, with a bound of its rounding errors added; links are decided in double precision.
    Single vectors meet in few numbers, the leading ones after a turn and the length of all others, where a sample shows
    that few pairs pass that bound of their cosine.  whole counts the pairs of which all numbers were multiplied.
    """

    def __init__(self, a: Vectors, b: Vectors, threshold: float, turn: np.ndarray | None = None):
        self.same = a is b
        self.a, self.b, self.threshold, self.turn = a, b, threshold, turn
        self.rounding = _rounding(a.raw.shape[1])
        self.reach = float(np.sqrt(2.0 - 2.0 * threshold))
        self.count_a, self.count_b = np.zeros(len(a.raw), np.int64), np.zeros(len(b.raw), np.int64)
        self.shift = 0 if self.same else len(a.raw)
        self.pairs: list[np.ndarray] = []
        self.held = self.whole = 0
        self.matrix = np.empty(_ROWS * _COLUMNS, np.float32)
        p = q = np.zeros(1, np.int64)
        depth = max(len(a.levels), len(b.levels))
        if depth == 1 and not self.same:
            self._decide(p, q)
        for level in range(1, depth):
            p, q = self._descend(level, p, q)

    def _least(self, span: np.ndarray) -> np.ndarray:
        """The least cosine of centres at which nodes may hold a link, by the sum of their radii."""
        r = np.minimum(span + (self.reach + _SLACK), 2.0)
        return 1.0 - r * r / 2.0 - self.rounding

    def _descend(self, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes one level down that stay open, of the children of pairs (p, q)."""
        ua, ub = (t.levels[min(level - 1, len(t.levels) - 1)] for t in (self.a, self.b))
        na, nb = (t.levels[min(level, len(t.levels) - 1)] for t in (self.a, self.b))
        ka, kb = ua.kids, ub.kids
        wa, wb = ka[p + 1] - ka[p], kb[q + 1] - kb[q]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        many = wa * wb > _MANY
        for i, j in zip(p[many].tolist(), q[many].tolist()):
            self._matrix(na, nb, np.arange(ka[i], ka[i + 1]), np.arange(kb[j], kb[j + 1]), self.same and i == j, out)
        p, q, wa, wb = p[~many], q[~many], wa[~many], wb[~many]
        for part, pair, k in _products(wa * wb):
            i, j, n = p[part][pair], q[part][pair], wb[part][pair]
            x, y = ka[i] + k // n, kb[j] + k % n
            if self.same:
                once = (i != j) | (x <= y)
                x, y = x[once], y[once]
            cosine = np.einsum("ij,ij->i", self.a.single[na.centre[x]], self.b.single[nb.centre[y]])
            self.whole += len(x)
            near = cosine >= self._least(na.radius[x] + nb.radius[y])
            self._sift(na, nb, x[near], y[near], out)
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))

    def _tiles(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """The products of rows x and rows y, by tiles; each is overwritten by the next."""
        for lo in range(0, len(x), _ROWS):
            rows = x[lo : lo + _ROWS]
            for at in range(0, len(y), _COLUMNS):
                columns = y[at : at + _COLUMNS]
                tile = self.matrix[: len(rows) * len(columns)].reshape(len(rows), len(columns))
                yield lo, at, np.matmul(rows, columns.T, out=tile)

    def _matrix(self, na: Level, nb: Level, p: np.ndarray, q: np.ndarray, itself: bool, out: list) -> None:
        """All children p against all children q by matrix products, wide nodes and single vectors apart."""
        self._singles(na.first[p[na.single[p]]], nb.first[q[nb.single[q]]], itself)
        for rows, cols in ((p[~na.single[p]], q), (p[na.single[p]], q[~nb.single[q]])):
            if not len(rows) or not len(cols):
                continue
            self.whole += len(rows) * len(cols)
            least = self._least(na.radius[rows] + nb.radius[cols].max()).astype(np.float32)
            for lo, at, cosine in self._tiles(self.a.single[na.centre[rows]], self.b.single[nb.centre[cols]]):
                i, j = _places(cosine >= least[lo : lo + len(cosine), None])
                c, x, y = cosine[i, j], rows[lo + i], cols[at + j]
                near = c >= self._least(na.radius[x] + nb.radius[y])
                if itself:
                    near &= x <= y
                self._sift(na, nb, x[near], y[near], out)

    def _numbers(self, x: np.ndarray, y: np.ndarray) -> int:
        """How many leading numbers bound the cosines of vectors x and y at the least cost, by a sample; 0: no bound pays."""
        width = self.a.raw.shape[1]
        if self.turn is None or len(x) * len(y) <= 1 << 18:
            return 0
        x, y = x[:: -(-len(x) // 256)], y[:: -(-len(y) // 2048)]
        other = x[:, None] != y[None, :] if self.same else np.ones((len(x), len(y)), bool)

        def cost(k: int) -> float:
            u, v = (t.leading(self.turn, k, at) for t, at in ((self.a, x), (self.b, y)))
            passed = np.mean((u @ v.T >= self.threshold - self.rounding) & other)
            return _PRODUCT_NS * k + min(_ROW_NS * passed, _MOST_NS)

        costs = {k: cost(k) for k in _LEADING if 2 * k < width}
        least = min(costs, key=costs.get, default=0)
        return least if least and costs[least] < _PRODUCT_NS * width else 0

    def _singles(self, x: np.ndarray, y: np.ndarray, itself: bool) -> None:
        """Every one of vectors x against every one of vectors y; of one node's own (itself) each pair once."""
        if not len(x) or not len(y):
            return
        k = self._numbers(x, y)
        if k:
            u = self.a.leading(self.turn, k, x)
            v = u if itself else self.b.leading(self.turn, k, y)
        else:
            u, v = self.a.single[x], self.b.single[y]
        least = np.float32(self.threshold - self.rounding)
        for lo in range(0, len(x), _ROWS):
            begin = lo - lo % _COLUMNS if itself else 0  # before, every pair has been met
            for _, at, cosine in self._tiles(u[lo : lo + _ROWS], v[begin:]):
                self.whole += 0 if k else cosine.size
                some = np.flatnonzero(cosine.max(axis=1) >= least)
                if not len(some):
                    continue
                own, other = x[lo : lo + _ROWS], y[begin + at : begin + at + _COLUMNS]
                passed = cosine[some] >= least
                if itself and begin + at < lo + _ROWS:
                    passed &= own[some, None] < other[None, :]
                if np.count_nonzero(passed) > _DENSE * cosine.size:
                    self._dense(own, other, itself, None if k else cosine)
                else:
                    i, j = _places(passed)
                    self._decide(own[some[i]], other[j])

    def _dense(self, x: np.ndarray, y: np.ndarray, itself: bool, cosine: np.ndarray | None) -> None:
        """Vectors x against vectors y where many are linked: counts are sums of a matrix, and each of its components one star."""
        if cosine is None:
            self.whole += len(x) * len(y)
            cosine = self.a.single[x] @ self.b.single[y].T
        linked = cosine >= np.float32(self.threshold + self.rounding)
        i, j = _places((cosine >= np.float32(self.threshold - self.rounding)) & ~linked)
        for lo in range(0, len(i), _PAIRS):
            r, c = i[lo : lo + _PAIRS], j[lo : lo + _PAIRS]
            linked[r, c] = self._linked(x[r], y[c])
        if itself:
            linked &= x[:, None] < y[None, :]
        one = linked.astype(np.float32)
        wa, wb = self.a.weight[x], self.b.weight[y]
        exact = np.float32 if max(wa.sum(), wb.sum()) < 1 << 24 else np.float64
        self.count_a[x] += (one @ wb.astype(exact)).astype(np.int64)
        self.count_b[y] += (wa.astype(exact) @ one).astype(np.int64)
        free = linked.any(axis=1)
        for _ in range(_STARS):
            if not free.any():
                return
            rows, reached = np.zeros(len(x), np.float32), 1
            rows[free.argmax()] = 1
            while reached:
                columns = (rows @ one > 0).astype(np.float32)
                reached, rows = -np.count_nonzero(rows), (one @ columns > 0).astype(np.float32)
                reached += np.count_nonzero(rows)
            rows, columns = np.flatnonzero(rows), np.flatnonzero(columns)
            self._connect(x[rows], np.repeat(x[rows[:1]], len(rows)))
            self._connect(y[columns] + self.shift, np.repeat(x[rows[:1]], len(columns)))
            free[rows] = False
        i, j = np.nonzero(linked & free[:, None])
        self._connect(x[i], y[j] + self.shift)

    def _connect(self, u: np.ndarray, v: np.ndarray) -> None:
        """Notes pairs of one component, b's vectors numbered after a's."""
        self.pairs.append(np.stack([u, v], axis=1))
        self.held += len(u)
        if self.held > 1 << 20:
            self.pairs = [_stars(np.concatenate(self.pairs), self.shift + len(self.b.raw))]
            self.held = 0

    def _sift(self, na: Level, nb: Level, p: np.ndarray, q: np.ndarray, out: list) -> None:
        """Pairs of nodes that may hold links: count whole, compare when small, or keep for the next level."""
        if not len(p):
            return
        product = na.sizes(p) * nb.sizes(q)
        small = product <= _SMALL
        self._vectors(na, nb, p[small], q[small])
        p, q = p[~small], q[~small]
        span = na.radius[p] + nb.radius[q]
        d = np.empty(len(p))
        for lo in range(0, len(p), _PAIRS):
            own = slice(lo, lo + _PAIRS)
            d[own] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self._cosines(na.centre[p[own]], nb.centre[q[own]])))
        if self.same:
            d[na.centre[p] == nb.centre[q]] = 0.0
        whole = d + span <= self.reach - _SLACK
        for i, j in zip(p[whole].tolist(), q[whole].tolist()):
            self._all(na.members(i), nb.members(j), self.same and i == j)
        out.append((p[~whole], q[~whole]))

    def _cosines(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.a.double(x), self.b.double(y))

    def _linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._cosines(x, y) >= self.threshold

    def _vectors(self, na: Level, nb: Level, p: np.ndarray, q: np.ndarray) -> None:
        """Every vector of nodes p against every one of nodes q, pair by pair of nodes."""
        for part, pair, k in _products(na.sizes(p) * nb.sizes(q)):
            i, j = p[part][pair], q[part][pair]
            n = nb.sizes(j)
            x, y = na.first[i] + k // n, nb.first[j] + k % n
            if self.same:
                once = (i != j) | (x < y)
                x, y = x[once], y[once]
            self._decide(x, y)

    def _decide(self, x: np.ndarray, y: np.ndarray) -> None:
        """Vectors x against vectors y, one by one."""
        self.whole += len(x)
        for lo in range(0, len(x), _PAIRS):
            i, j = x[lo : lo + _PAIRS], y[lo : lo + _PAIRS]
            maybe = np.einsum("ij,ij->i", self.a.single[i], self.b.single[j]) >= self.threshold - self.rounding
            i, j = i[maybe], j[maybe]
            linked = self._linked(i, j)
            i, j = i[linked], j[linked]
            np.add.at(self.count_a, i, self.b.weight[j])
            np.add.at(self.count_b, j, self.a.weight[i])
            self._connect(i, j + self.shift)

    def _all(self, m: np.ndarray, n: np.ndarray, itself: bool) -> None:
        """Every vector of m is linked with every one of n."""
        wa, wb = self.a.weight[m], self.b.weight[n]
        if itself:
            self.count_a[m] += wa.sum() - wa
            self._connect(np.repeat(m[:1], len(m) - 1), m[1:])
            return
        self.count_a[m] += wb.sum()
        self.count_b[n] += wa.sum()
        self._connect(m, np.repeat(n[:1] + self.shift, len(m)))
        self._connect(np.repeat(m[:1], len(n)), n + self.shift)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each side (of a tree with itself: all in the first), and pairs of components (b's vectors numbered after a's)."""
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros((0, 2), np.int64)
        pairs = _stars(pairs, self.shift + len(self.b.raw))
        if self.same:
            return self.count_a + self.count_b, np.zeros(0, np.int64), pairs
        return self.count_a, self.count_b, pairs


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.empty(len(x), np.int64)
    far = np.empty(len(x))
    for i in range(0, len(x), 4096):
        d = _distance(x[i : i + 4096], centres)
        at[i : i + 4096] = d.argmin(axis=1)
        far[i : i + 4096] = d.min(axis=1)
    return at, far


def _matrix_of(vectors: pa.Array, number: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), number).reshape(len(vectors), -1)


def _assign(sent, number: str):
    """Adds the nearest centre among those of the vector's width, and the distance from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            widths = pc.binary_length(vectors).to_numpy()
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width))
                first, centres, _ = sent.value[width]
                x = unit(_matrix_of(own.column(2), number).astype(np.float64))
                top, far = _nearest(x, centres)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(top + first, pa.int32()), pa.array(far)], names=["node", "weight", "vector", "top", "far"])

    return run


def _plant(number: str, reach: float):
    def run(key, rows):
        node = rows.column("node").to_numpy()
        order = np.argsort(node)
        node, weight = node[order], rows.column("weight").to_numpy()[order]
        raw = _matrix_of(rows.column("vector"), number)[order]
        tree = Tree(unit(raw.astype(np.float64)), weight, reach)
        blob = pickle.dumps((node[tree.order], tree.packed(raw)))
        far = rows.column("far").to_numpy()
        return pa.table({"top": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.string()), "inner": pa.array([far.min()]), "outer": pa.array([far.max()]), "tree": pa.array([blob], pa.binary())})

    return run


def _traverse(threshold: float, turns):
    def met(left: pa.Scalar, right: pa.Scalar) -> pa.RecordBatch:
        nb, b = _unpacked(right.as_buffer())
        na, a = _unpacked(left.as_buffer()) if left.is_valid else (nb, b)
        ca, cb, pairs = Links(a, b, threshold, turns.value.get(a.raw.shape[1])).result()
        names = na if a is b else np.concatenate([na, nb])
        count = ca if a is b else np.concatenate([ca, cb])
        some = np.flatnonzero(count)
        u = np.concatenate([names[some], names[pairs[:, 0]]])
        v = np.concatenate([names[some], names[pairs[:, 1]]])
        links = np.concatenate([count[some], np.zeros(len(pairs), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(met, *batch.columns)

    return run


_DOUBLES = "transform(embedding, x -> cast(x as double))"
_SINGLES = "array<float>"
_GOOD = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def _bytes_of(number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(number).itemsize
        for batch in batches:
            vectors = batch.column(1)
            width = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, size * np.diff(vectors.offsets.to_numpy()))
            data = (vectors.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(number).tobytes()  # -0.0 is 0.0
            ends = np.cumsum(np.maximum(width, 0)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[e - w : e] if w >= 0 else None for e, w in zip(ends, width.tolist())], pa.binary())], names=["vec_id", "vector"])

    return run


def _centres(nodes: DataFrame, widths: dict[int, int], number: str, cell: int, top: int, sample: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each width in bytes the number of its first centre, its centres and a turn that puts the sample's widest directions first."""
    wide = {w: n for w, n in widths.items() if n > cell}
    per = max(1, sample // max(1, len(wide)))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for w, n in wide.items() for x in (w, min(1.0, per / n))]), F.octet_length("vector")), F.lit(0.0)) if wide else F.lit(0.0)
    chosen = nodes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < share * (1 << 20)).select("vector").collect() if wide else []
    found: dict[int, list[bytes]] = {}
    for r in chosen:
        found.setdefault(len(r["vector"]), []).append(bytes(r["vector"]))
    if len(found) < len(widths):  # one vector is enough for a width of one part
        for r in nodes.groupBy(F.octet_length("vector").alias("w")).agg(F.min("vector").alias("vector")).collect():
            found.setdefault(r["w"], [bytes(r["vector"])])
    out, first = {}, 0
    for w in sorted(found):
        some = unit(np.stack([np.frombuffer(v, number) for v in sorted(found[w])]).astype(np.float64))
        spread = _spread(some, min(max(1, top // max(1, len(wide))), 1 + widths[w] // cell))
        out[w] = (first, spread, np.linalg.eigh(some.T @ some)[1][:, ::-1][:, : _LEADING[-1]])
        first += len(spread)
    return out


def _shell(cuts: dict[int, list[float]]) -> Column:
    """The number of a cell's cuts that a vector lies beyond."""
    some = {t: c for t, c in cuts.items() if c}
    if not some:
        return F.lit(0)
    of = F.element_at(F.create_map(*[x for t, c in some.items() for x in (F.lit(t), F.array(*map(F.lit, c)))]), F.col("top"))
    return F.coalesce(F.size(F.filter(of, lambda c: c < F.col("far"))), F.lit(0))


def similarity_components(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable, itself included) and kept.

    A part holds about cell vectors; by default an eighth of the table within [CELL, LARGEST].
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    single = rows.schema["embedding"].dataType.simpleString() == _SINGLES
    number = "<f4" if single else "<f8"  # as given
    rows = rows if single else rows.select("vec_id", F.expr(_DOUBLES).alias("embedding"))
    told = rows.select("vec_id", F.when(F.expr(_GOOD), F.col("embedding")).alias("embedding")).mapInArrow(_bytes_of(number), "vec_id bigint, vector binary")
    distinct = told.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # numbers instead of ids, which rows may share; the checkpoint fixes them
    nodes = checkpoint(distinct.select(F.monotonically_increasing_id().alias("node"), "id", "weight", "vector"))
    widths = {r["w"]: r["n"] for r in nodes.groupBy(F.octet_length("vector").alias("w")).agg(F.count("*").alias("n")).collect()}
    if not widths:
        return told.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    cell = cell or min(LARGEST, max(CELL, sum(widths.values()) // 8))
    reach = float(np.sqrt(2 - 2 * threshold)) + _SLACK
    sent = _centres(nodes, widths, number, cell, top, sample)
    assigned = nodes.select("node", "weight", "vector").mapInArrow(_assign(spark.sparkContext.broadcast(sent), number), "node bigint, weight bigint, vector binary, top int, far double")
    placed = checkpoint(assigned.select("top", "far"))  # vectors aren't written again
    steps = [i / SHELLS for i in range(1, SHELLS)]
    sizes = {r["top"]: r for r in placed.groupBy("top").agg(F.count("*").alias("n"), F.percentile_approx("far", steps, 1000).alias("cuts")).collect()}
    shells = {t: min(SHELLS, -(-r["n"] // cell)) for t, r in sizes.items()}
    cuts = {t: sorted({r["cuts"][i * SHELLS // shells[t] - 1] for i in range(1, shells[t])}) for t, r in sizes.items()}
    counts = placed.withColumn("shell", _shell(cuts)).groupBy("top", "shell").agg(F.count("*").alias("n")).select("top", "shell", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    part = F.concat_ws(":", "shell", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    dealt = assigned.withColumn("shell", _shell(cuts)).join(F.broadcast(counts), ["top", "shell"], "left").select("node", "weight", "vector", "top", "far", part.alias("part"))
    trees = checkpoint(dealt.groupBy("top", "part").applyInArrow(_plant(number, reach), "top int, part string, inner double, outer double, tree binary"))
    pairs = []
    for first, centres, _ in sent.values():
        apart = _distance(centres, centres)
        pairs += [(first + a, first + b, float(apart[a, b]) if a != b else 0.0) for a in range(len(centres)) for b in range(a, len(centres)) if first + a in sizes and first + b in sizes]
    near = spark.createDataFrame(pairs, "a int, b int, apart double")
    # names of the pairs first; trees join them last, each pair's two on the second one's key, a tree with itself once
    names = trees.select("top", "part", "inner", "outer")
    left = names.select(F.col("top").alias("a"), F.col("part").alias("pa"), F.col("inner").alias("ia"), F.col("outer").alias("oa"))
    right = names.select(F.col("top").alias("b"), F.col("part").alias("pb"), F.col("inner").alias("ib"), F.col("outer").alias("ob"))
    met = near.join(left, "a").join(right, "b").where((F.col("a") < F.col("b")) | (F.col("pa") <= F.col("pb")))
    met = met.where((F.col("apart") <= F.col("oa") + F.col("ob") + reach) & (F.col("ia") <= F.col("apart") + F.col("ob") + reach) & (F.col("ib") <= F.col("apart") + F.col("oa") + reach))
    # a part is the second one in half of its pairs
    turned = (F.col("a") != F.col("b")) & (F.pmod(F.xxhash64("a", "pa", "b", "pb"), F.lit(2)) == 1)
    sides = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("pa", "pb"), ("b", "a"), ("pb", "pa"))]
    met = met.select(*sides)
    same = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
    with_left = met.join(trees.select(F.col("top").alias("a"), F.col("part").alias("pa"), F.col("tree").alias("ta")), ["a", "pa"]).select("a", "pa", "b", "pb", F.when(~same, F.col("ta")).alias("ta"))
    both = with_left.join(trees.select(F.col("top").alias("b"), F.col("part").alias("pb"), F.col("tree").alias("tb")), ["b", "pb"])
    turns = spark.sparkContext.broadcast({centres.shape[1]: turn for _, centres, turn in sent.values()})
    with row_by_row(spark):  # two trees are as large as many rows
        found = checkpoint(both.select("ta", "tb").mapInArrow(_traverse(threshold, turns), "u bigint, v bigint, links bigint"))
    counts = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    component = components(found.where("links = 0").select("u", "v"))
    named = nodes.join(counts, "node", "left").join(component, "node", "left").select("vector", "id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = told.join(named.join(least, "component").select("vector", "component_id", "links"), "vector", "left")
    of = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(False)).alias("kept"))


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors, each as far as can be from those before it."""
    at, d = [0], _distance(x, x[:1])[:, 0]
    while len(at) < min(k, len(x)):
        at.append(int(d.argmax()))
        d = np.minimum(d, _distance(x, x[at[-1:]])[:, 0])
    return x[at]
