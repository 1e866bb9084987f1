"""Difference covers modulo X and the tables that come from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

#: For each modulus, residues whose differences give every residue.
COVERS = {
    3: (1, 2),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 6, 8, 18),
    31: (0, 1, 3, 8, 12, 18),
    39: (0, 1, 16, 20, 22, 27, 30),
    57: (0, 1, 9, 11, 14, 35, 39, 51),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 7, 16, 27, 56, 60, 68, 70, 73),
    95: (0, 1, 5, 8, 18, 20, 29, 31, 45, 61, 67),
    133: (0, 1, 32, 42, 44, 48, 51, 59, 72, 77, 97, 111),
}


@dataclass(frozen=True)
class Cover:
    """A modulus and its cover; residues ascend."""

    modulus: int
    residues: tuple[int, ...]

    @classmethod
    def of(cls, modulus: int) -> Cover:
        if modulus not in COVERS:
            raise ValueError(f"no difference cover modulo {modulus}; known: {sorted(COVERS)}")
        return cls(modulus, COVERS[modulus])

    @property
    def valid(self) -> bool:
        """Whether each residue is a difference of two of the cover."""
        return {(a - b) % self.modulus for a in self.residues for b in self.residues} == set(range(self.modulus))

    def contains(self, residue: int) -> bool:
        return residue % self.modulus in self.residues

    @cached_property
    def before(self) -> tuple[int, ...]:
        """For each residue, how many of the cover are smaller: the slot, in a block, of the first sample from there."""
        return tuple(sum(r < m for r in self.residues) for m in range(self.modulus))

    @cached_property
    def depth(self) -> tuple[tuple[int, ...], ...]:
        """depth[a][b]: the least d for which both a + d and b + d are in the cover."""
        x = self.modulus
        return tuple(tuple(next(d for d in range(x) if self.contains(a + d) and self.contains(b + d)) for b in range(x)) for a in range(x))

    @cached_property
    def turn(self) -> tuple[int, ...]:
        """turn[a * X + b]: among the samples from a position of residue a on, the number of the one at depth[a][b]."""
        x = self.modulus
        return tuple(sum(self.contains(a + k) for k in range(self.depth[a][b])) for a in range(x) for b in range(x))

    def slot(self, position: int) -> int:
        """Number, among all samples, of the first one at or after a position."""
        return position // self.modulus * len(self.residues) + self.before[position % self.modulus]

    def positions_per_residue(self, n: int) -> tuple[int, ...]:
        """How many of 0..n-1 have each residue."""
        return tuple(max(0, -(-(n - r) // self.modulus)) for r in range(self.modulus))

    def needs_dummy(self, n: int) -> bool:
        """Whether an empty sample at n has to be added, so that comparisons past the end find a rank."""
        return self.contains(n)

    def starts(self, n: int) -> dict[int, int]:
        """Where the samples of each cover residue start in the order by (residue, position); with the dummy."""
        per, at, out = self.positions_per_residue(n + self.needs_dummy(n)), 0, {}
        for r in self.residues:
            out[r] = at
            at += per[r]
        return out

    def back(self, index: int, n: int) -> int:
        """Text position of a place in the order by (residue, position)."""
        r = max((r for r, s in self.starts(n).items() if s <= index), key=lambda r: self.starts(n)[r])
        return self.modulus * (index - self.starts(n)[r]) + r
