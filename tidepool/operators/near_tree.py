"""Parents of short sequences: the tree of children's beginnings is walked for many parents at once.

A parent's letters are bits of a word. For each beginning and each number of errors, a word tells how much
of the parent may be used up with so many (Wu and Manber). Beginnings that children share are seen once a
parent, and those that no alignment leads to within the distance end a walk.
"""

from __future__ import annotations

import numpy as np

#: Letters of the longest sequences that fit a word with one bit to spare.
SHORT = 63
#: Words that one step of a walk holds; the first and the largest number of parents that walk together; classes of abundance.
STEP, FIRST, MOST, CLASSES = 1 << 18, 16, 1024, 256


def letters(seqs: list[str], alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of letter numbers for each sequence, filled up with -1, which also is a letter that the alphabet
    lacks; lengths; the alphabet."""
    flat = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, seqs), np.int64, len(seqs))
    alphabet = np.unique(flat) if alphabet is None else alphabet
    x = np.full((len(seqs), int(size.max(initial=0))), -1, np.int32)
    if len(alphabet):
        at = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
        x[np.arange(x.shape[1]) < size[:, None]] = np.where(alphabet[at] == flat, at, -1)
    return x, size, alphabet


class Tree:
    """Beginnings of sorted, different rows: by length, (first, count) of the longer ones by one letter, and of these
    the last letter, the row that ends there (-1: none) and the least class of the rows below."""

    def __init__(self, x: np.ndarray, size: np.ndarray, kind: np.ndarray):
        alike = np.logical_and.accumulate((x[1:] == x[:-1]) & (x[1:] >= 0), axis=1).sum(axis=1)
        shared = np.concatenate([[-1], alike])
        node, width, self.levels = np.zeros(len(x), np.int64), 1, []
        for j in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > j)
            new = shared[rows] <= j
            start, own = np.flatnonzero(new), np.cumsum(new) - 1
            count = np.bincount(node[rows[start]], minlength=width)
            end = np.full(len(start), -1)
            done = size[rows] == j + 1
            end[own[done]] = rows[done]
            self.levels.append((np.cumsum(count) - count, count, x[rows[start], j], end, np.minimum.reduceat(kind[rows], start)))
            node[rows], width = own, len(start)


def walk(tree: Tree, x: np.ndarray, size: np.ndarray, signs: int, allowed: np.ndarray):
    """(parent, row, distance) of the rows of a tree that are near one of the parents ``x``. ``allowed``: the largest
    distance of each parent to rows of each class, -1 for none."""
    k, kind = int(allowed.max()), np.uint32 if size.max() < 32 else np.uint64
    top = kind(8 * kind().itemsize - 1)
    low = top - size.astype(kind)  # an unused parent's bit; the highest one is a parent's end
    masks = np.zeros((len(x), signs), kind)
    for i in range(x.shape[1]):
        own = np.flatnonzero(x[:, i] >= 0)
        masks[own, x[own, i]] |= kind(1) << (low[own] + kind(i))
    masks, kinds, allowed = masks.reshape(-1), allowed.shape[1], allowed.astype(np.int8).reshape(-1)
    begin = np.array([[(1 << (e + 1)) - 1 & int(np.iinfo(kind).max)] for e in range(k + 1)], kind) << low
    steps, found = [(0, np.arange(len(x)), np.zeros(len(x), np.int64), begin)], []
    while steps:
        j, q, v, state = steps.pop()
        if j == len(tree.levels):
            continue
        first, count, letter, end, least = tree.levels[j]
        n = count[v]
        total = int(n.sum())
        if total * (k + 1) > STEP and len(q) > 1:
            for part in (slice(None, len(q) // 2), slice(len(q) // 2, None)):
                steps.append((j, q[part], v[part], state[:, part]))
            continue
        up = np.repeat(np.arange(len(q)), n)
        v = np.arange(total) + np.repeat(first[v] - (np.cumsum(n) - n), n)
        q = q[up]
        same, before = masks[q * signs + letter[v]], np.take(state, up, axis=1)
        now = before & same
        now[0] <<= kind(1)
        for e in range(1, k + 1):
            now[e] |= before[e - 1]
            now[e] |= now[e - 1]
            now[e] <<= kind(1)
            now[e] |= before[e - 1]
        lost = np.zeros(total, np.int8)  # words without a bit: as many errors at least
        for word in now:
            lost += word == 0
        on = np.flatnonzero(lost <= allowed[q * kinds + least[v]])
        if not len(on):
            continue
        q, v, now = q[on], v[on], now[:, on]
        hit = np.flatnonzero((end[v] >= 0) & (now[k] >> top > 0))
        if len(hit):
            found.append((q[hit], end[v[hit]], k + 1 - (now[:, hit] >> top).sum(axis=0).astype(np.int64)))
        steps.append((j + 1, q, v, now))
    return [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3)]


def best_parents(seqs, n, parents, pn, most: np.ndarray):
    """(child, parent, distance) as places: for each child the most abundant parent at a distance d from 1 on that has
    n / pn <= most[d], then the nearest, then the first by letters. ``most`` falls. Sequences have up to ``SHORT`` letters.

    Parents walk in order of abundance, and children that have one are left out of the tree as it goes on.
    """
    seqs, parents, n, pn = list(seqs), list(parents), np.asarray(n, float), np.asarray(pn, float)
    most = most[: SHORT + 1]
    far, rising = len(most) - 1, most[:0:-1]
    order = sorted(range(len(seqs)), key=lambda i: (seqs[i], n[i]))
    order = np.array([i for a, i in zip([None, *order], order) if a is None or seqs[a] != seqs[i]], np.int64)  # the rarest of equal ones may have most parents
    by = np.array(sorted(range(len(parents)), key=lambda i: (-pn[i], parents[i])), np.int64)
    n, pn = n[order], pn[by]
    x, size, alphabet = letters([seqs[i] for i in order])
    px, psize, _ = letters([parents[i] for i in by], alphabet)
    kind = np.unique(n, return_inverse=True)[1] if len(np.unique(n)) <= CLASSES else np.unique(np.floor(np.log2(n)), return_inverse=True)[1]
    smallest = np.full(int(kind.max(initial=0)) + 1, np.inf)
    np.minimum.at(smallest, kind, n)
    reach = lambda ratio: far - np.searchsorted(rising, ratio, side="left")
    into, dist = np.full(len(n), len(pn)), np.zeros(len(n), np.int64)
    known = np.append(pn, -np.inf)  # the abundance of no parent
    live, tree, rows, at, width = np.arange(len(n)), None, None, 0, FIRST
    while at < len(pn):
        live = live[(known[into[live]] <= pn[at]) & (n[live] / pn[at] <= most[1])]
        if not len(live):
            break
        if tree is None or len(live) < 0.9 * len(rows):
            rows = live
            tree = Tree(x[rows], size[rows], kind[rows])
        rarest = n[live].min()
        k = int(reach(rarest / pn[at]))
        until = at + int(np.searchsorted(-reach(rarest / pn[at : at + width]), -k, side="right"))
        allowed = reach(smallest[None, :] / pn[at:until, None])
        allowed = np.where(allowed < 1, -1, np.minimum(allowed, k))
        q, row, d = walk(tree, px[at:until], psize[at:until], max(1, len(alphabet)), allowed)
        q, row = q + at, rows[row]
        if size[rows[0]] == 0:  # the sequence without letters ends before the first level
            q, row, d = np.append(q, np.arange(at, until)), np.append(row, np.full(until - at, rows[0])), np.append(d, psize[at:until])
        ok = (d > 0) & (d <= far) & (pn[q] > n[row])
        ok[ok] = n[row[ok]] / pn[q[ok]] <= most[d[ok]]
        q, row, d = q[ok], row[ok], d[ok]
        q, row, d = np.append(q, into[rows]), np.append(row, rows), np.append(d, dist[rows])
        first = np.lexsort((q, d, -known[q], row))
        first = first[np.append(True, np.diff(row[first]) > 0)]
        into[row[first]], dist[row[first]] = q[first], d[first]
        at, width = until, min(2 * width, MOST, max(FIRST, STEP // max(1, len(alphabet))))
    has = np.flatnonzero(into < len(pn))
    return order[has], by[into[has]], dist[has]
