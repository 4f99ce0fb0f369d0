"""A prefix tree over ordered token sets, searched for sets of at least a given Jaccard similarity."""

from __future__ import annotations

import numpy as np


class _Node:
    __slots__ = ("alive", "children", "edge", "least", "most", "owner", "parent")

    def __init__(self, edge: np.ndarray, parent: _Node | None):
        self.edge, self.parent = edge, parent
        self.children: dict[int, _Node] = {}
        self.alive, self.least, self.most, self.owner = 0, 1 << 62, 0, -1


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    k = int(differ.argmax()) if n else 0
    return k if n and differ[k] else n


class PrefixTree:
    """Path-compressed. Sets are sorted arrays over 0..size-1, no two equal; a set may be taken out once found."""

    def __init__(self, sets: list[np.ndarray], size: int):
        self.sets, self.root = sets, _Node(np.zeros(0, dtype=np.int64), None)
        self.member = np.zeros(size, dtype=bool)
        self.ends: list[_Node] = []
        for k, s in enumerate(sets):
            self.ends.append(self._insert(k, s))

    def _insert(self, k: int, s: np.ndarray) -> _Node:
        node, at = self.root, 0
        while True:
            if at == len(s):
                break
            child = node.children.get(int(s[at]))
            if child is None:
                child = node.children[int(s[at])] = _Node(s[at:], node)
                node, at = child, len(s)
                break
            same = _agree(child.edge, s[at:])
            if same < len(child.edge):  # split the edge
                upper = _Node(child.edge[:same], node)
                upper.alive, upper.least, upper.most = child.alive, child.least, child.most
                node.children[int(s[at])] = upper
                child.edge, child.parent = child.edge[same:], upper
                upper.children[int(child.edge[0])] = child
                child = upper
            node, at = child, at + same
        node.owner = k
        up: _Node | None = node
        while up is not None:
            up.alive += 1
            up.least, up.most = min(up.least, len(s)), max(up.most, len(s))
            up = up.parent
        return node

    def take_out(self, k: int) -> None:
        up: _Node | None = self.ends[k]
        up.owner = -1
        while up is not None:
            up.alive -= 1
            up = up.parent

    def search(self, probe: np.ndarray, num: int, den: int) -> list[int]:
        """The sets s left with den * |probe & s| >= num * |probe | s|.

        One walk: the overlap of a path is counted once for all sets below it,
        and a subtree is left when its overlap and what can still be added stay
        below what its smallest set needs.
        """
        member, n, found = self.member, len(probe), []
        member[probe] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            overlap += int(np.count_nonzero(member[node.edge]))
            depth += len(node.edge)
            if node.owner >= 0 and den * overlap >= num * (n + depth - overlap):
                found.append(node.owner)
            for child in node.children.values():
                if not child.alive:
                    continue
                best = overlap + min(child.most - depth, n - overlap)
                if den * best >= num * (n + child.least - best):
                    stack.append((child, overlap, depth))
        member[probe] = False
        return found


def link_roots(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set of hashes (no two equal) the least index it is linked with through similar sets.

    Tokens are put in one order for all, those of most sets first, so that
    similar sets share long paths. A set that was found leaves the tree, so a
    group of thousands of copies costs about one search each over what is left.
    """
    if not sets:
        return []
    lengths = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ordered = [np.sort(p) for p in np.split(rank[inverse], np.cumsum(lengths)[:-1])]
    tree = PrefixTree(ordered, len(values))
    root = [-1] * len(sets)
    for k in range(len(sets)):
        if root[k] >= 0:
            continue
        root[k] = k
        tree.take_out(k)
        queue = [k]
        while queue:
            for other in tree.search(ordered[queue.pop()], num, den):
                root[other] = k
                tree.take_out(other)
                queue.append(other)
    return root
