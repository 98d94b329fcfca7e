"""Vantage-point trees over fingerprints, as plain arrays.

A node splits by the Hamming distance to its vantage point, taken on some of the bits: the inside has distance at
most `cut`, the rest lies outside. Distances on a part of the bits obey the triangle inequality too, so a point
within `reach` (on those bits) of a point inside has a distance of at most cut + reach, and a point within reach
of one outside has more than cut - reach. A point therefore has one home leaf and may have to visit others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def distance(a: np.ndarray, b, mask: np.uint64 = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def bit_blocks(most: int, blocks: int, bits: int = 64) -> list[tuple[np.uint64, int]]:
    """Masks of equal parts of the bits, and the reach on each.

    Fingerprints that differ in `most` bits or fewer differ in at most most // blocks of the bits of some part, so
    one tree per part with that reach finds all of them. A small reach is what makes the bounds prune.
    """
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [(np.uint64(((1 << (b - a)) - 1) << a), most // blocks) for a, b in zip(edges, edges[1:])]


@dataclass(frozen=True)
class Node:
    vantage: np.uint64
    mask: np.uint64
    reach: int
    cut: int
    inside: "Node | int"
    outside: "Node | int"


def split_of(points: np.ndarray, mask: np.uint64, reach: int, most: int) -> tuple[np.uint64, np.uint64, int, int] | None:
    """Vantage point, mask, reach and cut that halve the points; all bits if the mask can't tell them apart."""
    for bits, near in ((mask, reach), (ALL_BITS, most)):
        # the point farthest from the first one spreads the distances
        vantage = points[int(distance(points, points[0], bits).argmax())]
        d = np.sort(distance(points, vantage, bits))
        if d[0] != d[-1]:
            cut = int(d[(len(d) - 1) // 2])
            if cut == d[-1]:
                cut = int(d[d < cut].max())
            return vantage, bits, near, cut
    return None


def build(sample: np.ndarray, mask: np.uint64, reach: int, most: int, leaf: int, first: int) -> tuple[Node | int, int]:
    """A tree whose leaves hold at most `leaf` points of the sample; leaves are numbered from `first` on."""
    found = split_of(sample, mask, reach, most) if len(sample) > leaf else None
    if found is None:
        return first, first + 1
    vantage, bits, near, cut = found
    inner = distance(sample, vantage, bits) <= cut
    inside, first = build(sample[inner], mask, reach, most, leaf, first)
    outside, first = build(sample[~inner], mask, reach, most, leaf, first)
    return Node(vantage, bits, near, cut, inside, outside), first


def route(tree: Node | int, points: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions of the points at home there, positions of the points that must visit it).

    Of two points at home in different leaves one visits the other's, so a pair is met at least once.
    """
    out = []

    def walk(node: Node | int, home: np.ndarray, guests: np.ndarray) -> None:
        if not len(home) and not len(guests):
            return
        if isinstance(node, int):
            out.append((node, home, guests))
            return
        at_home, visiting = distance(points[home], node.vantage, node.mask), distance(points[guests], node.vantage, node.mask)
        crossing = home[(at_home > node.cut) & (at_home <= node.cut + node.reach)]
        walk(node.inside, home[at_home <= node.cut], np.concatenate([guests[visiting <= node.cut + node.reach], crossing]))
        walk(node.outside, home[at_home > node.cut], guests[visiting > node.cut - node.reach])

    walk(tree, np.arange(len(points)), np.zeros(0, np.int64))
    return out


class Groups:
    """Union-find over positions; the root of a group is its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def link(points: np.ndarray, home: np.ndarray, guests: np.ndarray, mask: np.uint64, reach: int, most: int,
         groups: Groups, leaf: int = 192) -> None:
    """Join all pairs within `most` bits of which at least one is at home here, by a tree inside the shard."""
    if not len(home) or len(home) + len(guests) < 2:
        return
    found = split_of(points[home], mask, reach, most) if len(home) > leaf else None
    if found is None:
        _grow(points, home, guests, most, groups)
        return
    vantage, bits, near, cut = found
    at_home, visiting = distance(points[home], vantage, bits), distance(points[guests], vantage, bits)
    crossing = home[(at_home > cut) & (at_home <= cut + near)]
    link(points, home[at_home <= cut], np.concatenate([guests[visiting <= cut + near], crossing]), mask, reach, most, groups, leaf)
    link(points, home[at_home > cut], guests[visiting > cut - near], mask, reach, most, groups, leaf)


def _grow(points: np.ndarray, home: np.ndarray, guests: np.ndarray, most: int, groups: Groups) -> None:
    """Grow groups outward: a point that was reached is never compared with the reached ones again.

    A crowd of mutual neighbours is reached in one step, so it costs one comparison per point, not per pair.
    """
    free_home, free_guests = home, guests
    while len(free_home):
        frontier, free_home = [int(free_home[0])], free_home[1:]
        at_home = [True]
        while frontier:
            i, own = frontier.pop(), at_home.pop()
            near = distance(points[free_home], points[i]) <= most
            reached = free_home[near]
            if len(reached):
                free_home = free_home[~near]
                groups.join(i, reached)
                frontier += reached.tolist()
                at_home += [True] * len(reached)
            if own and len(free_guests):
                near = distance(points[free_guests], points[i]) <= most
                reached = free_guests[near]
                if len(reached):
                    free_guests = free_guests[~near]
                    groups.join(i, reached)
                    frontier += reached.tolist()
                    at_home += [False] * len(reached)
