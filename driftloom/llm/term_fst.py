"""Minimal acyclic transducer over a sorted list of byte strings: it accepts them and gives their ordinals.

The strings come in order, so a state is final as soon as the next string leaves its path; it is then merged
with an equal state, if there is one. An arc carries the number of strings that end before its branch, and
the sum along a path is the string's ordinal. The arcs lie in one table, each state shifted so that none of its
arcs falls on another's, and many strings walk through it in step, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    base: np.ndarray  # by state: shift of its arcs in the table
    final: np.ndarray  # by state
    owner: np.ndarray  # by place in the table: the state whose arc lies there, or -1
    target: np.ndarray
    output: np.ndarray
    longest: int
    size: int

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinal of each string ``data[start : start + length]``, or -1 where it is none of ours."""
        found = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        state, total = np.zeros(len(live), np.int32), np.zeros(len(live), np.int64)
        at, left = starts[live], lengths[live].copy()
        while len(live):
            place = self.base[state] + data[at]
            known = self.owner[place] == state
            if not known.all():
                live, at, left, total, place = live[known], at[known], left[known], total[known], place[known]
            total = total + self.output[place]
            state, at, left = self.target[place], at + 1, left - 1
            ended = left == 0
            if ended.any():
                there = ended & self.final[state]
                found[live[there]] = total[there]
                more = ~ended
                live, at, left, total, state = live[more], at[more], left[more], total[more], state[more]
        return found


def build(strings: Iterable[bytes]) -> Transducer:
    """The transducer of distinct strings in ascending order."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        known = register.get(key)
        if known is None:
            known = register[key] = len(states)
            states.append(key)
        return known

    # the path of the last string: [final, arcs to settled states], and the byte that leads on
    path: list[list] = [[False, []]]
    last, size, longest = b"", 0, 0
    for string in strings:
        common = 0
        for a, b in zip(last, string, strict=False):
            if a != b:
                break
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        path.extend([False, []] for _ in range(len(string) - common))
        path[-1][0] = True
        last, size, longest = string, size + 1, max(longest, len(string))
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    return _laid_out(states, (path[0][0], tuple(path[0][1])), longest, size)


def _laid_out(states: list[tuple], root: tuple, longest: int, size: int) -> Transducer:
    """States renumbered with the root first, their arcs in one table at the first shift that is free."""
    counts: list[int] = []
    for final, arcs in states:  # the targets of a state come before it
        counts.append(final + sum(counts[t] for _, t in arcs))
    nodes = [root, *states]
    base = np.zeros(len(nodes), np.int32)
    width = sum(len(arcs) for _, arcs in nodes) + 512
    taken = bytearray(2 * width + 512)
    single = crowded = 0
    for s, (_, arcs) in enumerate(nodes):
        if not arcs:
            continue
        first = arcs[0][0]
        if len(arcs) == 1:  # any free place will do
            while taken[single]:
                single += 1
            shift = max(single - first, 0)
            while taken[shift + first]:
                shift += 1
        else:
            shift, tries = crowded, 0
            while any(taken[shift + b] for b, _ in arcs):
                shift += 1
                tries += 1
            crowded = shift if tries > 64 else crowded  # what lies before is nearly full
        if shift + 512 > len(taken):
            taken.extend(bytes(len(taken)))
        for b, _ in arcs:
            taken[shift + b] = 1
        base[s] = shift
    places = int(base.max()) + 256
    owner = np.full(places, -1, np.int32)
    target, output = np.zeros(places, np.int32), np.zeros(places, np.int32)
    for s, (final, arcs) in enumerate(nodes):
        total = int(final)
        for b, t in arcs:
            owner[base[s] + b], target[base[s] + b], output[base[s] + b] = s, t + 1, total
            total += counts[t]
    return Transducer(base, np.array([f for f, _ in nodes], bool), owner, target, output, longest, size)
