"""Composition, counts and physicochemical descriptors."""

from __future__ import annotations

import math
from functools import lru_cache

from retort.kernel import patterns as P
from retort.kernel.elements import MONOISOTOPIC, NUMBER, WEIGHT, hill
from retort.kernel.mol import AROMATIC, DOUBLE, SINGLE, TRIPLE, Molecule
from retort.kernel.smarts import compile_pattern, view_of
from retort.kernel.writer import with_hydrogens


def element_counts(mol: Molecule) -> dict[str, int]:
    out: dict[str, int] = {}
    for sym, h in zip(mol.sym, mol.hyd, strict=True):
        out[sym] = out.get(sym, 0) + 1
        if h > 0:
            out["H"] = out.get("H", 0) + h
    return out


def formula(mol: Molecule) -> str:
    return hill(element_counts(mol))


def weight(mol: Molecule) -> float:
    # Summed by symbol, so that equal compositions have equal weights.
    return math.fsum(WEIGHT.get(s, 0.0) * n for s, n in sorted(element_counts(mol).items()))


def exact_mass(mol: Molecule) -> float:
    return math.fsum(MONOISOTOPIC.get(s, 0.0) * n for s, n in sorted(element_counts(mol).items()))


def heavy_atoms(mol: Molecule) -> int:
    return len(mol) - mol.sym.count("H")


def total_atoms(mol: Molecule) -> int:
    return len(mol) + sum(h for h in mol.hyd if h > 0)


def heteroatoms(mol: Molecule) -> int:
    return sum(s not in ("C", "H") for s in mol.sym)


def _carbonyl(mol: Molecule, carbon: int, without: int) -> bool:
    """A double-bonded oxygen at the atom, other than ``without``."""
    return any(v != without and mol.bonds[k][2] == DOUBLE and mol.sym[v] == "O" for v, k in mol.adj[carbon])


def acceptors(mol: Molecule) -> int:
    """Uncharged or negative O and S, and N unless it is aromatic with hydrogen or sits at a carbonyl carbon."""

    def accepts(i: int) -> bool:
        if mol.chg[i] > 0 or mol.sym[i] not in ("O", "S", "N"):
            return False
        if mol.sym[i] != "N":
            return True
        if mol.arom[i] and mol.hyd[i] > 0:
            return False
        return not any(mol.bonds[k][2] == SINGLE and mol.sym[v] == "C" and _carbonyl(mol, v, i) for v, k in mol.adj[i])

    return sum(accepts(i) for i in range(len(mol)))


def donors(mol: Molecule) -> int:
    return sum(s in ("N", "O", "S") and h > 0 for s, h in zip(mol.sym, mol.hyd, strict=True))


def rotatable_bonds(mol: Molecule) -> int:
    degree = view_of(mol).degree

    def amide(a: int, b: int) -> bool:
        return any({mol.sym[x], mol.sym[y]} == {"N", "C"} and mol.sym[y] == "C" and _carbonyl(mol, y, x) for x, y in ((a, b), (b, a)))

    return sum(
        order == SINGLE and not mol.ring_bonds[k] and "H" not in (mol.sym[a], mol.sym[b]) and degree[a] > 1 and degree[b] > 1 and not amide(a, b)
        for k, (a, b, order) in enumerate(mol.bonds)
    )


def ring_classes(mol: Molecule) -> list[tuple[bool, bool, bool]]:
    """For each ring: all bonds aromatic, all bonds single, some atom no carbon."""

    def make(m: Molecule):
        out = []
        for ring in m.rings:
            orders = {m.bonds[k][2] for k in ring}
            out.append((orders == {AROMATIC}, orders == {SINGLE}, any(m.sym[i] not in ("C", "H") for i in m.ring_members(ring))))
        return out

    return mol.once("ring_classes", make)


def fraction_csp3(mol: Molecule) -> float:
    carbons = [i for i, s in enumerate(mol.sym) if s == "C"]
    if not carbons:
        return 0.0
    return sum(not mol.arom[i] and all(mol.bonds[k][2] == SINGLE for _, k in mol.adj[i]) for i in carbons) / len(carbons)


# Polar surface of N and O by (heavy neighbours, hydrogens, charge, single, double, triple, aromatic bonds). The 3 marks what holds within
# three-rings, 0 what holds elsewhere, None both; bonds not named don't count.
NITROGEN_SURFACE = [
    ((1, 0, 0), {"triple": 1}, None, 23.79), ((1, 1, 0), {"double": 1}, None, 23.85), ((1, 2, 0), {"single": 1}, None, 26.02),
    ((1, 2, 1), {"double": 1}, None, 25.59), ((1, 3, 1), {"single": 1}, None, 27.64),
    ((2, 0, 0), {"single": 1, "double": 1}, None, 12.36), ((2, 0, 0), {"triple": 1, "double": 1}, None, 13.60), ((2, 1, 0), {"single": 2}, 3, 21.94),
    ((2, 1, 0), {"single": 2}, 0, 12.03), ((2, 0, 1), {"triple": 1, "single": 1}, None, 4.36), ((2, 1, 1), {"double": 1, "single": 1}, None, 13.97),
    ((2, 2, 1), {"single": 2}, None, 16.61), ((2, 0, 0), {"aromatic": 2}, None, 12.89), ((2, 1, 0), {"aromatic": 2}, None, 15.79),
    ((2, 1, 1), {"aromatic": 2}, None, 14.14),
    ((3, 0, 0), {"single": 3}, 3, 3.01), ((3, 0, 0), {"single": 3}, 0, 3.24), ((3, 0, 0), {"single": 1, "double": 2}, None, 11.68),
    ((3, 0, 1), {"single": 2, "double": 1}, None, 3.01), ((3, 1, 1), {"single": 3}, None, 4.44), ((3, 0, 0), {"aromatic": 3}, None, 4.41),
    ((3, 0, 0), {"single": 1, "aromatic": 2}, None, 4.93), ((3, 0, 0), {"double": 1, "aromatic": 2}, None, 8.39), ((3, 0, 1), {"aromatic": 3}, None, 4.10),
    ((3, 0, 1), {"single": 1, "aromatic": 2}, None, 3.88),
    ((4, 0, 1), {"single": 4}, None, 0.0),
]
OXYGEN_SURFACE = [
    ((1, 0, 0), {"double": 1}, None, 17.07), ((1, 1, 0), {"single": 1}, None, 20.23), ((1, 0, -1), {"single": 1}, None, 23.06),
    ((2, 0, 0), {"single": 2}, 3, 12.53), ((2, 0, 0), {"single": 2}, 0, 9.23), ((2, 0, 0), {"aromatic": 2}, None, 13.14),
]
# Where no row fits, base - per neighbour + per hydrogen, at least 0.
OTHER_SURFACE = {"N": (30.5, 8.2, 1.5), "O": (28.5, 8.6, 1.5)}
_ORDER_NAME = {SINGLE: "single", DOUBLE: "double", TRIPLE: "triple", AROMATIC: "aromatic"}


def polar_surface(mol: Molecule) -> float:
    """Topological polar surface of N and O."""
    total = 0.0
    for i, sym in enumerate(mol.sym):
        if sym not in OTHER_SURFACE:
            continue
        near = [(v, k) for v, k in mol.adj[i] if mol.sym[v] != "H"]
        hydrogens = max(0, mol.hyd[i]) + len(mol.adj[i]) - len(near)
        bonds = {name: 0 for name in _ORDER_NAME.values()}
        for _, k in near:
            bonds[_ORDER_NAME[mol.bonds[k][2]]] += 1
        around = {v for v, _ in near}
        three = any(w in around and w != v for v in around for w, _ in mol.adj[v])
        table = NITROGEN_SURFACE if sym == "N" else OXYGEN_SURFACE
        for key, need, ring, value in table:
            if key == (len(near), hydrogens, mol.chg[i]) and all(bonds[b] == n for b, n in need.items()) and ring in (None, 3 if three else 0):
                total += value
                break
        else:
            base, per, each = OTHER_SURFACE[sym]
            total += max(0.0, base - len(near) * per + hydrogens * each)
    return total


@lru_cache(maxsize=None)
def _atom_types() -> list[tuple[object, float, float]]:
    return [(compile_pattern(text), logp, mr) for _, text, logp, mr in P.ATOM_TYPES]


@lru_cache(maxsize=None)
def _atom_type_rows(kinds: frozenset) -> list[tuple[object, float, float]]:
    """The type patterns that atoms of these kinds can match, in order."""
    return [r for r in _atom_types() if any(r[0].may_be(0, kind) for kind in kinds)]


def _atom_type_sums(mol: Molecule) -> tuple[float, float]:
    """Sums over all atoms, hydrogens included, each by the first pattern that matches there."""
    full = with_hydrogens(mol)
    view = view_of(full)
    types: list = [None] * len(full)
    left = (1 << len(full)) - 1
    for pattern, a, b in _atom_type_rows(view.kind_set):
        # Only where no earlier pattern matched is a search needed.
        if view.mask(pattern.atoms[0]) & left:
            hits = pattern.starts(view) & left
            left ^= hits
            while hits:
                low = hits & -hits
                types[low.bit_length() - 1] = (a, b)
                hits ^= low
            if not left:
                break
    # Added up in the order of atoms.
    logp = mr = 0.0
    for t in types:
        if t is not None:
            logp += t[0]
            mr += t[1]
    return logp, mr


def logp(mol: Molecule) -> float:
    return mol.once("atom_types", _atom_type_sums)[0]


def molar_refractivity(mol: Molecule) -> float:
    return mol.once("atom_types", _atom_type_sums)[1]


@lru_cache(maxsize=None)
def _compiled(name: str) -> list:
    return [p for p in map(compile_pattern, getattr(P, name)) if p is not None]


def _count(text: str, mol: Molecule) -> int:
    return compile_pattern(text).count(view_of(mol))


def _strict_rotatable(mol: Molecule) -> int:
    """Single bonds outside rings of which both ends may turn, and one isn't an amide's."""
    view = view_of(mol)
    end, free = compile_pattern(P.ROTATABLE_END), compile_pattern(P.ROTATABLE_NO_AMIDE)
    fits = [end.matches_at(view, i) for i in range(len(mol))]
    return sum(
        order == SINGLE and not mol.ring_bonds[k] and fits[a] and fits[b] and (free.matches_at(view, a) or free.matches_at(view, b))
        for k, (a, b, order) in enumerate(mol.bonds)
    )


def _aromatic_systems(mol: Molecule) -> int:
    """Rings left when aliphatic ring atoms are taken out."""
    covered = 0
    for cover in compile_pattern(P.ALIPHATIC_RING).covers(view_of(mol)):
        covered |= cover
    gone = {i for i in range(len(mol)) if covered >> i & 1}
    return len(mol.rings) if not gone else len(mol.subgraph(set(range(len(mol))) - gone).rings)


# Weights of the desirability score, and its curves (a, b, c, d, e, f, maximum), for
# weight, logP, acceptors, donors, polar surface, rotatable bonds, aromatic rings, unwanted groups.
DESIRABILITY_WEIGHTS = (0.66, 0.46, 0.05, 0.61, 0.06, 0.65, 0.48, 0.95)
DESIRABILITY_CURVES = (
    (2.817065973, 392.5754953, 290.7489764, 2.419764353, 49.22325677, 65.37051707, 104.9805561),
    (3.172690585, 137.8624751, 2.534937431, 4.581497897, 0.822739154, 0.576295591, 131.3186604),
    (2.948620388, 160.4605972, 3.615294657, 4.435986202, 0.290141953, 1.300669958, 148.7763046),
    (1.618662227, 1010.051101, 0.985094388, 0.000000001, 0.713820843, 0.920922555, 258.1632616),
    (1.876861559, 125.2232657, 62.90773554, 87.83366614, 12.01999824, 28.51324732, 104.5686167),
    (0.010000000, 272.4121427, 2.558379970, 1.565547684, 1.271567166, 2.758063707, 105.4420403),
    (3.217788970, 957.7374108, 2.274627939, 0.000000001, 1.317690384, 0.375760881, 312.3372610),
    (0.010000000, 1199.094025, -0.09002883, 0.000000001, 0.185904477, 0.875193782, 417.7253140),
)


def desirability_properties(mol: Molecule) -> tuple[float, ...]:
    view = view_of(mol)
    return (
        weight(mol), logp(mol), float(sum(p.count(view) for p in _compiled("ACCEPTORS"))), float(_count(P.DONOR, mol)), polar_surface(mol),
        float(_strict_rotatable(mol)), float(_aromatic_systems(mol)), float(sum(p.found(view) for p in _compiled("UNWANTED"))),
    )


def _desirable(x: float, curve: tuple[float, ...]) -> float:
    a, b, c, d, e, f, most = curve
    # Far out on either side the exponentials overflow; there the term is at its limit.
    rise = 1 + math.exp(min(700.0, -(x - c + d / 2) / e))
    fall = 1 + math.exp(min(700.0, -(x - c - d / 2) / f))
    return (a + b / rise * (1 - 1 / fall)) / most


def qed(mol: Molecule) -> float:
    logs = [w * math.log(_desirable(x, c)) for x, w, c in zip(desirability_properties(mol), DESIRABILITY_WEIGHTS, DESIRABILITY_CURVES, strict=True)]
    return math.exp(math.fsum(logs) / math.fsum(DESIRABILITY_WEIGHTS))


def alerts(mol: Molecule) -> list[str]:
    view = view_of(mol)
    return [name for name, text in P.ALERTS if compile_pattern(text).found(view)]


# Keys set by the elements that occur, as ranges or lists of atomic numbers.
ELEMENT_KEYS = {
    35: (3, 11, 19, 37, 55, 87), 10: (4, 12, 20, 38, 56, 88), 18: (5, 13, 31, 49, 81), 42: (9,), 134: (9, 17, 35, 53), 29: (15,), 88: (16,), 103: (17,),
    5: (21, 22, 39, 40, 72), 7: (23, 24, 25, 41, 42, 43, 73, 74, 75), 9: (26, 27, 28, 44, 45, 46, 76, 77, 78), 12: (29, 30, 47, 48, 79, 80),
    3: (32, 33, 34, 50, 51, 52, 82, 83, 84), 46: (35,), 27: (53,), 6: tuple(range(57, 72)), 4: tuple(range(89, 104)), 2: (104,),
}
KEY_BYTES = 21


def structural_keys(mol: Molecule) -> bytes:
    """167 structural keys as bits; key n is bit n % 8 of byte n // 8."""
    view = view_of(mol)
    keys = {key for key, text in P.PRESENCE_KEYS if compile_pattern(text).found(view)}
    for text, limits in P.COUNT_KEYS:
        n = compile_pattern(text).count(view, 1 + max(more_than for more_than, _ in limits))
        keys |= {key for more_than, key in limits if n > more_than}
    numbers = {NUMBER.get(s, 0) for s in mol.sym}
    keys |= {key for key, members in ELEMENT_KEYS.items() if numbers & set(members)}
    if sum(aromatic for aromatic, _, _ in ring_classes(mol)) > 1:
        keys.add(125)
    if len(mol.components()) > 1:
        keys.add(166)
    return sum(1 << k for k in keys).to_bytes(KEY_BYTES, "little")
