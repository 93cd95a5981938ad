"""Finite automata: from regular expressions over bytes to minimal transition arrays.

The accepted syntax is what secret rules need: literals, classes, groups,
alternation, ``? * + {n} {n,} {n,m}`` and ``(?i:...)``. A repeat without an upper
bound needs only its least count here, as a scan asks whether some match ends at
a byte, not where the longest one does.
"""

from __future__ import annotations

import re
from array import array
from re import _constants as C
from re import _parser as parser

import numpy as np


class Nfa:
    """Thompson construction: ``moves[state]`` are (byte set, state) and ``free[state]`` states reached without a byte."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        """Builds ``tree`` from ``start``; gives the state where it ends."""
        at = start
        for op, arg in tree:
            if op is C.LITERAL:
                at = self._byte(at, {arg}, fold)
            elif op is C.IN:
                at = self._byte(at, _class(arg), fold)
            elif op is C.ANY:
                at = self._byte(at, set(range(256)) - {10}, False)
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & re.IGNORECASE))
            elif op is C.BRANCH:
                end = self.state()
                for option in arg[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(option, begin, fold)].append(end)
                at = end
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(most - least):
                        at = self.add(inner, at, fold)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def _byte(self, at: int, values: set[int], fold: bool) -> int:
        if fold:
            values = values | {ord(chr(v).swapcase()) for v in values if v < 128}
        to = self.state()
        self.moves[at].append((frozenset(values), to))
        return to


def _class(items) -> set[int]:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    return set(range(256)) - out if negate else out


class Scanner:
    """All rules in one minimal deterministic automaton that looks for matches anywhere.

    ``table[256 * state + byte]`` is 256 times the next state. States from
    ``accepting`` on end a match; ``mask`` tells of which rules (bit per rule).
    """

    #: The byte that no UTF-8 text holds: it leads back to the start.
    RESET = 0xFF

    def __init__(self, rules: list[str]):
        nfa = Nfa()
        start = nfa.state()
        ends = {}
        for i, rule in enumerate(rules):
            begin = nfa.state()
            nfa.free[start].append(begin)
            ends[nfa.add(parser.parse(rule), begin, False)] = i
        classes, of_class = self._classes(nfa)
        moves, masks = self._subsets(nfa, start, ends, of_class)
        moves, masks = self._minimal(np.array(moves), np.array(masks))
        # accepting states last
        order = np.argsort(masks > 0, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.start = int(rank[0]) * 256
        self.accepting = int((masks == 0).sum()) * 256
        full = rank[moves[order]][:, classes]
        full[:, self.RESET] = rank[0]
        self.table = array("i", (full.astype(np.int32) * 256).ravel().tolist())
        self.mask = {int(rank[s]) * 256: int(m) for s, m in enumerate(masks) if m}
        self.states = len(order)

    @staticmethod
    def _classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no rule tells apart share a class; also a byte of each class."""
        sets = sorted({values for m in nfa.moves for values, _ in m}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
        return classes, [int(np.argmax(classes == c)) for c in range(len(kinds))]

    @staticmethod
    def _subsets(nfa: Nfa, start: int, ends: dict[int, int], of_class: list[int]) -> tuple[list[list[int]], list[int]]:
        closures: list[frozenset[int]] = []
        for s in range(len(nfa.moves)):
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures.append(frozenset(x for x in seen if nfa.moves[x] or x in ends))
        by_class = [[frozenset().union(*[closures[t] for values, t in nfa.moves[s] if b in values]) for s in range(len(nfa.moves))] for b in of_class]
        first = closures[start]
        number, todo, moves = {first: 0}, [first], []
        while len(moves) < len(todo):
            states = todo[len(moves)]
            row = []
            for to in by_class:
                new = first.union(*[to[s] for s in states])  # a match may begin at any byte
                if new not in number:
                    number[new] = len(todo)
                    todo.append(new)
                row.append(number[new])
            moves.append(row)
        return moves, [sum(1 << i for i in {ends[s] for s in states if s in ends}) for states in todo]

    @staticmethod
    def _minimal(moves: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: states stay together while they accept alike and lead to states that do."""
        kind = np.unique(masks, return_inverse=True)[1]
        while True:
            signature = np.column_stack([kind, kind[moves]])
            new = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
            if new.max() == kind.max():
                break
            kind = new
        # number the classes so that the start stays 0
        firsts = np.sort(np.unique(kind, return_index=True)[1])
        rank = {int(kind[f]): i for i, f in enumerate(firsts)}
        relabel = np.array([rank[int(k)] for k in kind])
        return relabel[moves[firsts]], masks[firsts]

    def scan(self, data: bytes) -> int:
        """The rules with a match in ``data``, a bit for each, in one pass over its bytes."""
        table, accepting, mask = self.table, self.accepting, self.mask
        state, found = self.start, 0
        for byte in data:
            state = table[state + byte]
            if state >= accepting:
                found |= mask[state]
        return found
