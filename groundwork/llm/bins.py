"""Best-fit-decreasing packing of a bounded number of sizes, on a balanced search tree."""

from __future__ import annotations

from collections.abc import Sequence


class CapacityTree:
    """Treap of (remaining capacity, bin): insert, remove and tightest fit in logarithmic time."""

    def __init__(self):
        self.root, self.seed = None, 1

    def _split(self, node, key):
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, remaining: int, number: int) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, (remaining, number))
        self.root = self._join(self._join(low, [(remaining, number), self.seed >> 16, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that still holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        node = high
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            self.root = low
            return None
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]

    def take_roomiest(self) -> tuple[int, int]:
        node = self.root
        while node[3] is not None:
            node = node[3]
        self.root, _ = self._split(self.root, node[0])
        return node[0]


def decreasing(sizes: Sequence[int]) -> list[int]:
    return sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each size: largest first, each into the fullest bin that holds it, else into a new one.

    A size above ``capacity`` gets a bin of its own. Equal sizes go in the order given.
    """
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in decreasing(sizes):
        room, number = tree.take_tightest(sizes[i]) or (max(capacity, sizes[i]), bins)
        bins += number == bins
        out[i] = number
        tree.add(room - sizes[i], number)
    return out


def best_fit_into(sizes: Sequence[int], count: int) -> list[int]:
    """Bin of each size, ``count`` bins of nearly equal sums.

    A size above the fair share takes a bin alone; the other bins have the fair share of the rest
    as capacity. What fits nowhere goes where most room is left.
    """
    order, out, alone, rest = decreasing(sizes), [0] * len(sizes), 0, sum(sizes)
    while alone < min(count - 1, len(order)) and sizes[order[alone]] * (count - alone) > rest:
        rest -= sizes[order[alone]]
        out[order[alone]] = alone
        alone += 1
    tree, share = CapacityTree(), -(-rest // (count - alone))
    for number in range(alone, count):
        tree.add(share, number)
    for i in order[alone:]:
        room, number = tree.take_tightest(sizes[i]) or tree.take_roomiest()
        out[i] = number
        tree.add(room - sizes[i], number)
    return out
