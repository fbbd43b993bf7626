"""Small patterns (motifs) as edge sets."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

# The built-in patterns and their edges.
MOTIFS = {
    "triangle": "01 02 12",
    "path3": "01 12",
    "square": "01 12 23 30",
    "4clique": "01 02 03 12 13 23",
    "diamond": "01 02 03 12 23",
    "tailed_triangle": "01 02 12 23",
    "star3": "01 02 03",
    "path4": "01 12 23",
    "star4": "01 02 03 04",
    "5cycle": "01 12 23 34 40",
    "5clique": "01 02 03 04 12 13 14 23 24 34",
}


@dataclass(frozen=True)
class Motif:
    name: str
    size: int
    edges: frozenset

    def automorphisms(self) -> list[tuple[int, ...]]:
        return [p for p in permutations(range(self.size)) if all(frozenset(p[i] for i in e) in self.edges for e in self.edges)]

    def constraints(self) -> list[tuple[int, int]]:
        """Pairs (a, b) meaning vertex a < vertex b that keep one embedding of each instance."""
        group, out = self.automorphisms(), []
        for v in range(self.size):
            orbit = sorted({p[v] for p in group})
            out += [(v, w) for w in orbit if w != v]
            group = [p for p in group if p[v] == v]
        return out

    @property
    def is_clique(self) -> bool:
        return len(self.edges) == self.size * (self.size - 1) // 2

    @property
    def is_star(self) -> bool:
        return any(all(c in e for e in self.edges) and len(self.edges) == self.size - 1 for c in range(self.size))


def pattern(name: str, edges: str) -> Motif:
    """A pattern of one-digit vertices from the same text form as MOTIFS."""
    found = frozenset(frozenset(map(int, e)) for e in edges.split())
    if not found or any(len(e) != 2 for e in found):
        raise ValueError("a pattern needs edges of two different vertices each")
    return Motif(name, 1 + max(max(e) for e in found), found)


def motif(name: str) -> Motif:
    if name not in MOTIFS:
        raise ValueError(f"unknown motif {name}; known are {', '.join(MOTIFS)}")
    return pattern(name, MOTIFS[name])
