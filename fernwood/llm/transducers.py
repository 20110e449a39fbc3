"""Small weighted transducers: arcs (state, symbol) -> (output, weight, next state), composed and searched for the best path.

Weights add along a path and the path with the largest sum is best. Several arcs may leave a state under one symbol and
several states may start, so a symbol may be read one way because of what comes after it.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass

Arc = tuple[str, float, Hashable]


@dataclass
class Transducer:
    start: dict[Hashable, float]
    final: dict[Hashable, float]
    arcs: dict[Hashable, dict[str, list[Arc]]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, ``other`` reads. Only states that can be reached are made."""
        start = {(p, q): v + w for p, v in self.start.items() for q, w in other.start.items()}
        arcs: dict[Hashable, dict[str, list[Arc]]] = {}
        todo = list(start)
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            p, q = state
            arcs[state] = {
                symbol: [(out, v + w, (p2, q2)) for middle, v, p2 in row for out, w, q2 in other.arcs[q].get(middle, [])]
                for symbol, row in self.arcs[p].items()
            }
            todo += [arc[2] for row in arcs[state].values() for arc in row]
        final = {(p, q): self.final[p] + other.final[q] for p, q in arcs if p in self.final and q in other.final}
        return Transducer(start, final, arcs)

    def numbered(self) -> Transducer:
        """The same with states 0, 1, 2, ..., which are quicker to look up."""
        number = {s: i for i, s in enumerate(self.arcs)}
        arcs = {number[s]: {x: [(out, w, number[to]) for out, w, to in row] for x, row in rows.items()} for s, rows in self.arcs.items()}
        return Transducer({number[s]: w for s, w in self.start.items()}, {number[s]: w for s, w in self.final.items()}, arcs)

    def best(self, lattice: Sequence[Sequence[tuple[str, float]]]) -> list[tuple[str, float]]:
        """Output and symbol weight at every position of the best path through a lattice of weighted symbols; ties go to the first arc."""
        now: dict[Hashable, tuple[float, tuple | None]] = {s: (w, None) for s, w in self.start.items()}
        for choices in lattice:
            after: dict[Hashable, tuple[float, tuple | None]] = {}
            for state, (score, path) in now.items():
                row = self.arcs[state]
                for symbol, weight in choices:
                    for out, w, to in row.get(symbol, ()):
                        total = score + weight + w
                        if to not in after or total > after[to][0]:
                            after[to] = (total, (path, out, weight))
            now = after
        ends = [(score + self.final[s], path) for s, (score, path) in now.items() if s in self.final]
        if not ends:
            return []
        path = max(ends, key=lambda e: e[0])[1]
        out = []
        while path:
            out.append(path[1:])
            path = path[0]
        return out[::-1]
