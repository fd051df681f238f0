"""Circular (ECFP-like) fingerprints."""

from __future__ import annotations

from retort.kernel.mol import Molecule

_MASK = 0xFFFFFFFF
# Fixed value: the offset of the hash step.
_OFFSET = 0x9E3779B9
# Atomic numbers of the first atom hash; elements not listed count as 0.
ATOMIC_NUMBER = {
    s: k + 1
    for k, s in enumerate("H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr".split())
} | {"Ag": 47, "I": 53, "Cs": 55, "Ba": 56, "Pt": 78, "Au": 79, "Hg": 80, "Pb": 82}


def _mix(seed: int, value: int) -> int:
    return seed ^ ((value + _OFFSET + (seed << 6) + (seed >> 2)) & _MASK)


def ring_flags(mol: Molecule) -> list[bool]:
    """Ring flags as the atom hash wants them: they reach from each ring up to the first atom of its part.

    A depth-first tree over bonds in written order; a closure seen from below
    flags the path to its upper end, seen from above the path to the root.
    """
    n = len(mol)
    flag, up, seen = [False] * n, [-1] * n, [False] * n
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        trail = [(root, iter(mol.adj[root]))]
        while trail:
            u, rest = trail[-1]
            for v, _ in rest:
                if not seen[v]:
                    seen[v], up[v] = True, u
                    trail.append((v, iter(mol.adj[v])))
                    break
                if up[u] != v:
                    flag[v] = True
                    x = u
                    while x != v and x >= 0:
                        flag[x] = True
                        x = up[x]
            else:
                trail.pop()
    return flag


def environments(mol: Molecule, radius: int) -> list[int]:
    """32-bit hashes of all distinct atom environments up to ``radius`` bonds.

    An environment is the set of bonds it covers, kept as an integer bit mask;
    an atom whose environment was met before stops growing.
    """
    rings, sym = ring_flags(mol), mol.sym
    now = []
    for i, row in enumerate(mol.adj):
        seed = 0
        for value in (sum(sym[v] != "H" for v, _ in row), ATOMIC_NUMBER.get(sym[i], 0), max(0, mol.hyd[i]), mol.chg[i] & _MASK, 0, int(rings[i])):
            seed = _mix(seed, value)
        now.append(seed)
    out = list(now)
    cover = [0] * len(mol)
    met: set[int] = set()
    live = [i for i, row in enumerate(mol.adj) if row]
    for layer in range(radius):
        after, grown = list(now), []
        for i in live:
            mask, around = cover[i], []
            for v, k in mol.adj[i]:
                mask |= (1 << k) | cover[v]
                around.append((mol.bonds[k][2], now[v]))
            around.sort()
            h = _mix(layer, now[i])
            for order, value in around:
                h = _mix(_mix(h, order), value)
            after[i] = h
            grown.append((h, i, mask))
        grown.sort()
        for h, i, mask in grown:
            cover[i] = mask
        live = []
        for h, i, mask in grown:
            if mask not in met:
                met.add(mask)
                out.append(h)
                live.append(i)
        now = after
    return out


def morgan_bits(mol: Molecule, radius: int = 2, n_bits: int = 2048) -> bytes:
    """Environments folded into ``n_bits`` bits; bit n is bit n % 8 of byte n // 8."""
    bits = 0
    for h in environments(mol, radius):
        bits |= 1 << (h % n_bits)
    return bits.to_bytes((n_bits + 7) // 8, "little")
