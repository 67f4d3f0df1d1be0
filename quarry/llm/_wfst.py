"""Weighted finite-state transducers: composition and best paths over a semiring.

Every arc reads one symbol, and writes one or none (``EPS``). So the outputs of a path stand
at the places of its inputs, and composition needs no filter for empty inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

EPS = ""


@dataclass(frozen=True)
class Semiring:
    plus: Callable[[Any, Any], Any]
    times: Callable[[Any, Any], Any]
    zero: Any
    one: Any


TROPICAL = Semiring(min, lambda a, b: a + b, float("inf"), 0.0)
COUNTING = Semiring(lambda a, b: a + b, lambda a, b: a * b, 0, 1)


@dataclass
class Transducer:
    """``arcs[state][symbol]``: (output, weight, next state) in order of preference; state 0 starts."""

    arcs: list[dict[str, list[tuple[str, Any, int]]]]
    finals: frozenset[int]
    semiring: Semiring = TROPICAL

    @classmethod
    def of(cls, arcs: Iterable[tuple], finals: Iterable[int], semiring: Semiring = TROPICAL) -> Transducer:
        """From (state, input, output, next state[, weight]) tuples."""
        arcs, finals = list(arcs), frozenset(finals)
        table: list[dict] = [{} for _ in range(1 + max([0, *finals, *(s for a in arcs for s in (a[0], a[3]))]))]
        for state, read, write, to, *weight in arcs:
            if read == EPS:
                raise ValueError("an arc must read a symbol")
            table[state].setdefault(read, []).append((write, weight[0] if weight else semiring.one, to))
        return cls(table, finals, semiring)

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this writes, ``other`` reads. Only reachable states are made."""
        times = self.semiring.times
        number, todo, made = {(0, 0): 0}, [(0, 0)], []
        for p, q in todo:  # grows while it is read
            here: dict[str, list] = {}
            for read, choices in self.arcs[p].items():
                for write, weight, p2 in choices:
                    for write2, weight2, q2 in [(EPS, self.semiring.one, q)] if write == EPS else other.arcs[q].get(write, ()):
                        if (p2, q2) not in number:
                            number[p2, q2] = len(todo)
                            todo.append((p2, q2))
                        here.setdefault(read, []).append((write2, times(weight, weight2), number[p2, q2]))
            made.append(here)
        return Transducer(made, frozenset(number[s] for s in todo if s[0] in self.finals and s[1] in other.finals), self.semiring)

    def total(self, symbols: Iterable[str]) -> Any:
        """The semiring sum of the weights of all paths that read ``symbols``."""
        plus, times = self.semiring.plus, self.semiring.times
        now = {0: self.semiring.one}
        for x in symbols:
            ahead: dict[int, Any] = {}
            for state, weight in now.items():
                for _, w, to in self.arcs[state].get(x, ()):
                    ahead[to] = plus(ahead[to], times(weight, w)) if to in ahead else times(weight, w)
            now = ahead
        out = self.semiring.zero
        for state, weight in now.items():
            if state in self.finals:
                out = plus(out, weight)
        return out

    def best(self, symbols: Iterable[str]) -> list[str] | None:
        """The outputs, symbol by symbol, of the path of least weight (tropical); of equal
        ones, the first found by order of arcs. None if no path reads ``symbols``."""
        now: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for x in symbols:
            ahead: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, path) in now.items():
                for write, w, to in self.arcs[state].get(x, ()):
                    if to not in ahead or weight + w < ahead[to][0]:
                        ahead[to] = weight + w, (write, path)
            now = ahead
        ends = [now[s] for s in now if s in self.finals]
        if not ends:
            return None
        path, out = min(ends, key=lambda e: e[0])[1], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]
