"""Alignment of role sequences with the alternating grammar ``(s?(ua)+)?``.

A turn is known by its role's initial, whether it must go, and whether it is cut off. Edits: Keep costs
0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant turn 3; a cut-off turn
that stays adds 3.

All target strings that end alike share their suffixes, so one Wagner-Fischer table over suffixes holds
the cost of every target length: ``cost[i][r]`` aligns the turns from i on with the last r letters of the
alternating string. Ukkonen's band limits r in row i: a cell whose deletions or insertions alone cost more
than a known alignment is never reached. Audits are read off forwards, the least letter of an optimal
step first, and audits of all cheapest lengths are compared.

A long sequence is aligned in parts. A part is solved for every state it may be entered and left in:
START nothing kept yet, SYSTEM after a leading s, USER after u, DONE after a.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

START, SYSTEM, USER, DONE = range(4)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
_FAR = 1 << 40
#: A solved part: (state before, state after) -> (cost, audit).
Solved = dict[tuple[int, int], tuple[int, str]]


@dataclass
class Part:
    """Turns in order: initials, which must be deleted, which are cut off."""

    initials: str
    must_go: list[bool]
    cut: list[bool]

    def solve(self, entries: tuple[int, ...] = (START, SYSTEM, USER, DONE), exits: tuple[int, ...] = (START, SYSTEM, USER, DONE)) -> Solved:
        n = len(self.initials)
        drop_all = (DELETE * n, "D" * n)
        out: Solved = {}
        if START in entries and START in exits:
            out[START, START] = drop_all
        if SYSTEM in entries and SYSTEM in exits:
            out[SYSTEM, SYSTEM] = drop_all
        if START in entries and SYSTEM in exits:
            kept = [(DELETE * (n - 1) + CUT * self.cut[i], "D" * i + "K" + "D" * (n - 1 - i)) for i in self._systems()]
            if kept:
                out[START, SYSTEM] = min(kept)
        for end, last in ((DONE, "a"), (USER, "u")):
            if end not in exits:
                continue
            suffixes = _Suffixes(self, last)
            # Letters of the target from a state on: odd or even, and at least so many.
            even, odd = (0, 1) if last == "a" else (1, 0)
            for entry in entries:
                if entry == DONE:
                    found = suffixes.best(even, 0)
                elif entry == USER:
                    found = suffixes.best(odd, 0)
                elif entry == SYSTEM:
                    found = suffixes.best(even, 1)
                else:
                    found = min([suffixes.best(even, 1), *(suffixes.after_system(i, even) for i in self._systems())])
                if found[0] < _FAR:
                    out[entry, end] = found
        return out

    def _systems(self) -> list[int]:
        return [i for i, letter in enumerate(self.initials) if letter == "s" and not self.must_go[i]]


class _Suffixes:
    """Costs of aligning the turns from i on with the last r letters of ...uaua ending in ``last``."""

    def __init__(self, part: Part, last: str):
        self.part, self.last = part, last
        n = len(part.initials)
        gone = np.array(part.must_go, np.int64)
        self.left = np.concatenate([np.cumsum((1 - gone)[::-1])[::-1], [0]])
        forced = np.concatenate([np.cumsum(gone[::-1])[::-1], [0]]) * DELETE
        # A known alignment of either parity: every turn that may stay does, rerole what does not fit.
        bound = int(forced[0]) + sum((REROLE + CUT * c) for c, g in zip(part.cut, part.must_go, strict=True) if not g) + INSERT + DELETE
        room = (bound - forced) // INSERT
        width = int(self.left[0] + room[0]) + 2
        self.cost = np.full((n + 1, width), _FAR, np.int64)
        letters = np.arange(width)
        ramp = INSERT * letters
        # Letter r from the end; the first entry has none.
        is_last = letters % 2 == 1
        upto = min(width, int(room[n]) + 1)
        self.cost[n, :upto] = ramp[:upto]
        for i in range(n - 1, -1, -1):
            low = max(0, int(self.left[i]) - max(0, int(bound - forced[i])) // DELETE)
            high = min(width, int(self.left[i] + max(0, int(room[i]))) + 1)
            below = self.cost[i + 1]
            row = below[low:high] + DELETE
            if not part.must_go[i]:
                fits = self._fits(part.initials[i], is_last[low:high])
                step = np.where(fits, 0, REROLE) + CUT * part.cut[i]
                kept = np.full(high - low, _FAR, np.int64)
                first = max(low, 1)
                kept[first - low :] = below[first - 1 : high - 1] + step[first - low :]
                row = np.minimum(row, kept)
            row = np.minimum.accumulate(row - ramp[low:high]) + ramp[low:high]
            self.cost[i, low:high] = np.minimum(row, _FAR)

    def _fits(self, initial: str, is_last: np.ndarray) -> np.ndarray:
        if initial == self.last:
            return is_last
        if initial in ("u", "a"):
            return ~is_last
        return np.zeros(len(is_last), bool)

    def best(self, parity: int, least: int) -> tuple[int, str]:
        """Cheapest and, of these, least audit over all lengths of a parity with ``least`` letters or more."""
        return self._best(0, parity, least, "", 0)

    def after_system(self, i: int, parity: int) -> tuple[int, str]:
        """The same where turn i is kept as the leading system turn."""
        return self._best(i + 1, parity, 1, "D" * i + "K", DELETE * i + CUT * self.part.cut[i])

    def _best(self, i: int, parity: int, least: int, audit: str, paid: int) -> tuple[int, str]:
        lengths = np.arange(parity if parity >= least else parity + 2, self.cost.shape[1], 2)
        costs = self.cost[i, lengths]
        if not len(costs) or costs.min() >= _FAR:
            return _FAR, ""
        low = costs.min()
        return int(low) + paid, min(audit + self._audit(i, int(r)) for r in lengths[costs == low])

    def _audit(self, i: int, r: int) -> str:
        part, cost, out = self.part, self.cost, []
        n = len(part.initials)
        while i < n or r:
            here = cost[i, r]
            if i < n and cost[i + 1, r] + DELETE == here:
                out.append("D")
                i += 1
            elif r and cost[i, r - 1] + INSERT == here:
                out.append("I")
                r -= 1
            else:
                letter = self.last if r % 2 else ("u" if self.last == "a" else "a")
                out.append("K" if part.initials[i] == letter else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def joined(parts: list[Solved]) -> Solved:
    """Parts one after another as one: cheapest, then least audit, over the states between them.

    Of two cheapest audits of one part with the same states none starts with the other, since the rest
    would cost something, so the least whole audit is made of least parts.
    """
    total = parts[0]
    for part in parts[1:]:
        merged: Solved = {}
        for (a, b), (cost, audit) in total.items():
            for (c, d), (more, rest) in part.items():
                if b == c:
                    option = (cost + more, audit + rest)
                    if (a, d) not in merged or option < merged[a, d]:
                        merged[a, d] = option
        total = merged
    return total


def whole(solved: Solved) -> tuple[int, str]:
    """Cost and audit of a sequence that starts with nothing and ends with nothing or an assistant turn."""
    return min(solved[START, end] for end in (START, DONE) if (START, end) in solved)


class Follower:
    """Roles of the repaired turns, given edits one after another."""

    def __init__(self):
        self.last = ""

    def role(self, edit: str, role: str) -> str | None:
        """The role of the repaired turn, or None for a deleted one."""
        if edit == "D":
            return None
        if edit == "K":
            self.last = role[:1]
            return role
        new = "assistant" if self.last == "u" else "user"
        self.last = new[0]
        return new
