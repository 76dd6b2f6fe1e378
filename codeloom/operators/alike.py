"""The most alike of many names by difflib's ratio, without rating all of them.

Matching blocks of two names are a common subsequence, so the longest one bounds the ratio. It is found over a tree of the candidates' first letters: a prefix that many of them
share is compared once, and where no continuation can reach the best ratio so far, the whole branch is left.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Letters of a name that the tree and one machine word hold; what follows counts as in common.
WORD = 64
#: Branches of all wanted names that are compared at once, at most; branches of a name that the first way down keeps.
FRONT, BEAM = 200_000, 4

#: One bit and all bits of a word.
ONE, FULL = np.uint64(1), np.uint64(2**64 - 1)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i], ... of count[i] entries, and to which i each belongs."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


class Tree:
    """Sorted names by their first ``WORD`` letters: for each depth the nodes, their children and the names that end there."""

    def __init__(self, names: list[str]):
        self.names = names = sorted(set(names))
        self.size = size = np.array([len(x) for x in names])
        held = np.minimum(size, WORD)
        self.depth = deep = int(held.max(initial=0))
        codes = np.frombuffer("".join(x[:deep].ljust(deep, "\0") for x in names).encode("utf-32-le"), np.uint32).reshape(len(names), deep)
        self.letters, at = np.unique(codes, return_inverse=True)
        at = np.where(np.arange(deep) < held[:, None], at.reshape(codes.shape), -1)
        differs = np.ones((len(names), deep), bool)
        differs[1:] = np.logical_or.accumulate(at[1:] != at[:-1], 1)
        self.letter, self.least, self.most, self.child, self.ends, self.end = [], [], [], [], [], []
        above = np.zeros(len(names), np.int64)
        for d in range(deep):
            inside = held > d
            rows = np.flatnonzero(differs[:, d] & inside)
            node = np.cumsum(differs[:, d] & inside) - 1
            self.letter.append(at[rows, d])
            self.least.append(np.minimum.reduceat(np.where(inside, size, np.iinfo(np.int64).max), rows))
            self.most.append(np.maximum.reduceat(np.where(inside, size, 0), rows))
            self.child.append(np.searchsorted(above[rows], np.arange(above[-1] + 2)))
            over = np.flatnonzero(held == d + 1)
            self.ends.append(over)
            self.end.append(np.searchsorted(node[over], np.arange(len(rows) + 1)))
            above = node


def nearest(names: list[str], candidates: list[str], least: float) -> list[tuple[float, str] | None]:
    """For each name the ratio and candidate that are greatest, if the ratio is ``least`` at least. Of equal ratios the last candidate by order wins."""
    tree = Tree([c for c in candidates if c])
    if not tree.names:
        return [None] * len(names)
    out: list[tuple[float, str] | None] = []
    for i in range(0, len(names), 256):
        out += _Search(tree, names[i : i + 256], least).run()
    return out


class _Search:
    #: Words whose first i bits are set.
    heads = np.array([2**i - 1 for i in range(WORD + 1)], np.uint64)

    def __init__(self, tree: Tree, names: list[str], least: float):
        self.tree, self.names = tree, names
        self.size = np.array([len(x) for x in names])
        self.spare = np.maximum(self.size - WORD, 0)
        self.floor, self.best = np.full(len(names), least), [None] * len(names)
        self.masks = np.zeros((len(names), len(tree.letters)), np.uint64)
        place = {chr(c): i for i, c in enumerate(tree.letters.tolist())}
        for w, name in enumerate(names):
            for bit, c in enumerate(name[:WORD]):
                if c in place:
                    self.masks[w, place[c]] |= ONE << np.uint64(bit)

    def run(self) -> list[tuple[float, str] | None]:
        every = np.arange(len(self.names))
        first = (0, every, np.zeros(len(every), np.int64), np.full(len(every), FULL))
        front, ended = first, []
        while front is not None:  # one way down for each name, so that most branches need not be compared later
            front, found = self.step(*front, beam=BEAM)
            ended.append(found)
        self.rate(*(np.concatenate(x) for x in zip(*ended)), few=True)
        todo = [first]
        while todo:
            front, found = self.step(*todo.pop())
            self.rate(*found)
            if front is not None:
                todo += [(front[0], *(x[i : i + FRONT] for x in front[1:])) for i in range(0, len(front[1]), FRONT)]
        return self.best

    def bound(self, w: np.ndarray, common: np.ndarray, depth: int, size: np.ndarray) -> np.ndarray:
        """The greatest ratio of names of ``size`` letters whose first ``depth`` ones have ``common`` in common with the wanted ones."""
        return 2.0 * np.minimum(self.size[w], common + self.spare[w] + size - depth) / (self.size[w] + size)

    def step(self, depth: int, w: np.ndarray, node: np.ndarray, row: np.ndarray, beam: int | None = None) -> tuple:
        """One letter further: what is left of the branches (None if nothing is), and the names that end there with their bounds."""
        t = self.tree
        of, node = _spread(t.child[depth][node], np.diff(t.child[depth])[node])
        w, row = w[of], row[of]
        both = row & self.masks[w, t.letter[depth][node]]
        row = (row + both) | (row - both)
        common, depth = np.bitwise_count(~row).astype(np.int64), depth + 1
        size = np.clip(self.size[w] - common - self.spare[w] + depth, t.least[depth - 1][node], t.most[depth - 1][node])
        # the letters that are left can be in common with the last ones of the wanted name alone, or take some from the first ones
        left, short, most = t.most[depth - 1][node] - depth, t.least[depth - 1][node], self.size[w] - self.spare[w]
        head = self.heads[np.maximum(most - left, 0)]
        bound = np.minimum(self.bound(w, common, depth, size), 2.0 * (np.bitwise_count(~row & head) + np.minimum(left, most) + self.spare[w]) / (self.size[w] + short))
        keep = np.flatnonzero(bound >= self.floor[w])
        if beam:
            keep = keep[np.lexsort((-bound[keep], w[keep]))]
            rank = np.arange(len(keep)) - np.searchsorted(w[keep], w[keep])
            keep = keep[rank < beam]
        w, node, row, common = w[keep], node[keep], row[keep], common[keep]
        of, at = _spread(t.end[depth - 1][node], np.diff(t.end[depth - 1])[node])
        name = t.ends[depth - 1][at]
        found = (w[of], name, self.bound(w[of], common[of], depth, t.size[name]))
        return ((depth, w, node, row) if depth < t.depth and len(w) else None), found

    def rate(self, w: np.ndarray, name: np.ndarray, bound: np.ndarray, few: bool = False) -> None:
        """Rate names by falling bound, unless theirs is under the best ratio so far; of each wanted name a ``few`` only."""
        keep = np.flatnonzero(bound >= self.floor[w])
        keep = keep[np.lexsort((-name[keep], -bound[keep], w[keep]))]
        last, rate, left = None, SequenceMatcher(None, "", ""), 0
        for v, c, top in zip(w[keep].tolist(), name[keep].tolist(), bound[keep].tolist()):
            if v != last:
                last, left = v, BEAM if few else -1
                rate.set_seq2(self.names[v])  # what it learns about the second text serves all candidates
            best, other = self.best[v], self.tree.names[c]
            if not left or top < self.floor[v] or best and top == best[0] and other <= best[1]:
                continue
            left -= 1
            rate.set_seq1(other)
            if rate.quick_ratio() < self.floor[v]:
                continue
            found = (rate.ratio(), other)
            if found[0] >= self.floor[v] and (best is None or found > best):
                self.best[v], self.floor[v] = found, found[0]
