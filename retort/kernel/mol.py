"""Molecule model and SMILES reader.

A molecule is a set of parallel per-atom lists plus a bond list; everything
derived (adjacency, rings, aromaticity) is computed once and cached on the
object, so one parse serves every descriptor asked of it.
"""

from __future__ import annotations

import re
from collections import deque

SINGLE, DOUBLE, TRIPLE, AROMATIC = 1, 2, 3, 4

# Bond symbols and the order each one states.
BOND_SYMBOLS = {"=": DOUBLE, "#": TRIPLE, "-": SINGLE, ":": AROMATIC, "/": SINGLE, "\\": SINGLE}
# Normal valences of bare atoms, (aliphatic, aromatic); any other element has none.
VALENCE = {"B": (3, 2), "C": (4, 3), "N": (3, 2), "O": (2, 2), "P": (3, 3), "S": (2, 2), "F": (1, 1), "Cl": (1, 1), "Br": (1, 1), "I": (1, 1)}
# What a bond order adds to the used valence (an aromatic bond counts once).
USED_VALENCE = {SINGLE: 1, DOUBLE: 2, TRIPLE: 3, AROMATIC: 1}
# Elements that may join a perceived aromatic six-ring.
AROMATIC_ELEMENTS = frozenset("BCNOPS")

_TOKEN = re.compile(
    r"(?P<bare>Cl|Br|[BCNOPSFI])|(?P<arom>[bcnops])|(?P<bond>[=#\-:/\\])|(?P<open>\()|(?P<close>\))|(?P<dot>\.)|%(?P<ring2>[0-9]{2})|(?P<ring1>[0-9])"
    r"|\[(?P<iso>[0-9]*)(?P<sym>\*|[A-Z][a-z]?|[a-z][a-z]?)(?P<chi>@{0,2})(?P<h>H[0-9]?)?(?P<chg>\+(?:[0-9]|\+*)|-(?:[0-9]|-*))?(?P<map>:[0-9]+)?\]"
)


class Molecule:
    """Parallel atom lists ``sym hyd chg arom brk iso amap chi`` and ``bonds`` as ``[a, b, order]``."""

    __slots__ = ("sym", "hyd", "chg", "arom", "brk", "iso", "amap", "chi", "bonds", "cache")

    def __init__(self) -> None:
        self.sym: list[str] = []
        self.hyd: list[int] = []
        self.chg: list[int] = []
        self.arom: list[bool] = []
        self.brk: list[bool] = []
        self.iso: list[int | None] = []
        self.amap: list[int | None] = []
        self.chi: list[str | None] = []
        self.bonds: list[list[int]] = []
        self.cache: dict = {}

    def __len__(self) -> int:
        return len(self.sym)

    def add_atom(self, sym: str, *, arom=False, brk=False, hyd=0, chg=0, iso=None, amap=None, chi=None) -> int:
        self.sym.append(sym)
        self.arom.append(arom)
        self.brk.append(brk)
        self.hyd.append(hyd)
        self.chg.append(chg)
        self.iso.append(iso)
        self.amap.append(amap)
        self.chi.append(chi)
        return len(self.sym) - 1

    def copy_atom(self, other: "Molecule", i: int) -> int:
        return self.add_atom(other.sym[i], arom=other.arom[i], brk=other.brk[i], hyd=other.hyd[i], chg=other.chg[i], iso=other.iso[i], amap=other.amap[i], chi=other.chi[i])

    def touched(self) -> None:
        """Forget derived data after a change."""
        self.cache = {}

    def once(self, key: str, make):
        if key not in self.cache:
            self.cache[key] = make(self)
        return self.cache[key]

    @property
    def adj(self) -> list[list[tuple[int, int]]]:
        """Per atom, (neighbour, bond index) in bond order."""
        if "adj" not in self.cache:
            out: list[list[tuple[int, int]]] = [[] for _ in self.sym]
            for k, (a, b, _) in enumerate(self.bonds):
                out[a].append((b, k))
                out[b].append((a, k))
            self.cache["adj"] = out
        return self.cache["adj"]

    @property
    def ring_bonds(self) -> list[bool]:
        """Per bond, whether it lies on a cycle (is no bridge)."""
        if "ring_bonds" not in self.cache:
            self.cache["ring_bonds"] = _non_bridges(self)
        return self.cache["ring_bonds"]

    @property
    def ring_atoms(self) -> list[bool]:
        if "ring_atoms" not in self.cache:
            out = [False] * len(self)
            for k, on in enumerate(self.ring_bonds):
                if on:
                    out[self.bonds[k][0]] = out[self.bonds[k][1]] = True
            self.cache["ring_atoms"] = out
        return self.cache["ring_atoms"]

    @property
    def rings(self) -> list[list[int]]:
        """One shortest cycle for each ring bond, as bond indices, each bond set once, in bond order."""
        if "rings" not in self.cache:
            self.cache["rings"] = _shortest_cycles(self)
        return self.cache["rings"]

    def ring_members(self, ring: list[int]) -> list[int]:
        """Atoms of a ring in the order its bonds name them."""
        return list(dict.fromkeys(x for k in ring for x in self.bonds[k][:2]))

    def components(self) -> list[list[int]]:
        """Atom indices of each connected part, ascending, parts by first atom."""
        if "components" not in self.cache:
            seen = [False] * len(self)
            out = []
            for start in range(len(self)):
                if seen[start]:
                    continue
                seen[start] = True
                part, todo = [start], [start]
                while todo:
                    for v, _ in self.adj[todo.pop()]:
                        if not seen[v]:
                            seen[v] = True
                            part.append(v)
                            todo.append(v)
                out.append(sorted(part))
            self.cache["components"] = out
        return self.cache["components"]

    def subgraph(self, keep) -> "Molecule":
        """The part induced by ``keep``, atoms in their old order, hydrogen counts as they are."""
        out, at = Molecule(), {}
        for i in sorted(keep):
            at[i] = out.copy_atom(self, i)
        out.bonds = [[at[a], at[b], o] for a, b, o in self.bonds if a in at and b in at]
        return out

    def clone(self) -> "Molecule":
        return self.subgraph(range(len(self)))


def _non_bridges(mol: Molecule) -> list[bool]:
    adj, n = mol.adj, len(mol)
    order, low = [-1] * n, [0] * n
    on = [True] * len(mol.bonds)
    clock = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(adj[root]))]
        while stack:
            u, via, rest = stack[-1]
            for v, k in rest:
                if k == via:
                    continue
                if order[v] < 0:
                    order[v] = low[v] = clock
                    clock += 1
                    stack.append((v, k, iter(adj[v])))
                    break
                if order[v] < low[u]:
                    low[u] = order[v]
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    if low[u] < low[p]:
                        low[p] = low[u]
                    if low[u] > order[p]:
                        on[via] = False
    return on


def _shortest_cycles(mol: Molecule) -> list[list[int]]:
    on = mol.ring_bonds
    if not any(on):
        return []
    adj = [[(v, k) for v, k in row if on[k]] for row in mol.adj]
    out, seen = [], set()
    for skip, (a, b, _) in enumerate(mol.bonds):
        if not on[skip]:
            continue
        cycle = [skip]
        if a != b:
            back: dict[int, tuple[int, int]] = {a: (a, -1)}
            queue = deque([a])
            while queue and b not in back:
                u = queue.popleft()
                for v, k in adj[u]:
                    if k != skip and v not in back:
                        back[v] = (u, k)
                        queue.append(v)
            while b != a:
                b, k = back[b]
                cycle.append(k)
        key = frozenset(cycle)
        if key not in seen:
            seen.add(key)
            out.append(cycle)
    return out


def aromatize(mol: Molecule) -> None:
    """Rewrite alternating six-rings to the aromatic form, ring by ring.

    Only six-rings of uncharged B, C, N, O, P, S with three single and three
    double bonds, where a bond that is aromatic already counts as one of each.
    """
    for ring in mol.rings:
        if len(ring) != 6:
            continue
        orders = [mol.bonds[k][2] for k in ring]
        shared = orders.count(AROMATIC)
        if TRIPLE in orders or orders.count(SINGLE) + shared != 3 or orders.count(DOUBLE) + shared != 3:
            continue
        atoms = mol.ring_members(ring)
        if len(atoms) != 6 or any(mol.chg[i] or mol.sym[i] not in AROMATIC_ELEMENTS for i in atoms):
            continue
        for i in atoms:
            mol.arom[i] = True
        for k in ring:
            mol.bonds[k][2] = AROMATIC


def fill_hydrogens(mol: Molecule) -> None:
    """Implicit hydrogens of bare atoms; bracket atoms keep what they state."""
    used = [0] * len(mol)
    for a, b, order in mol.bonds:
        used[a] += USED_VALENCE[order]
        used[b] += USED_VALENCE[order]
    for i, sym in enumerate(mol.sym):
        if not mol.brk[i]:
            mol.hyd[i] = max(0, VALENCE.get(sym, (0, 0))[mol.arom[i]] - used[i])


def _small(text: str | None, most: int) -> int | None:
    return int(text) if text and int(text) <= most else None


def _charge(text: str | None) -> int:
    if not text:
        return 0
    sign = 1 if text[0] == "+" else -1
    return sign * (int(text[1:]) if text[1:].isdigit() else len(text))


def read_graph(text: str | None) -> Molecule | None:
    """Atoms and bonds as written, without aromaticity and implicit hydrogens; None if it isn't SMILES.

    A stated bond order stays pending until a bond is made: a ring-opening
    digit, a closing bracket or a dot don't use it up.
    """
    if not text:
        return None
    mol = Molecule()
    bonds, arom = mol.bonds, mol.arom
    opened: dict[int, int] = {}
    branches: list[int] = []
    last, pending, at, end = -1, 0, 0, len(text)
    match = _TOKEN.match

    def join(a: int, b: int) -> None:
        bonds.append([a, b, pending or (AROMATIC if arom[a] and arom[b] else SINGLE)])

    while at < end:
        m = match(text, at)
        if m is None:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind == "bare" or kind == "arom":
            sym = m[0]
            new = mol.add_atom(sym) if kind == "bare" else mol.add_atom(sym.upper(), arom=True)
        elif kind == "bond":
            pending = BOND_SYMBOLS[m[0]]
            continue
        elif kind == "open":
            if last < 0:
                return None
            branches.append(last)
            continue
        elif kind == "close":
            if not branches:
                return None
            last = branches.pop()
            continue
        elif kind == "dot":
            last = -1
            continue
        elif kind == "ring1" or kind == "ring2":
            if last < 0:
                return None
            number = int(m[kind])
            if number in opened:
                join(opened.pop(number), last)
                pending = 0
            else:
                opened[number] = last
            continue
        else:
            sym, h = m["sym"], m["h"]
            low = sym[0].islower()
            new = mol.add_atom(
                sym.capitalize() if low else sym, arom=low, brk=True, hyd=0 if not h else int(h[1:] or 1), chg=_charge(m["chg"]),
                iso=_small(m["iso"], 65535), amap=_small((m["map"] or "")[1:], 4294967295), chi=m["chi"] or None,
            )
        if last >= 0:
            join(last, new)
            pending = 0
        last = new
    if branches or opened or not mol.sym:
        return None
    return mol


def parse(text: str | None) -> Molecule | None:
    """A SMILES text as a molecule with aromaticity and hydrogens, or None if it isn't valid."""
    mol = read_graph(text)
    if mol is not None:
        aromatize(mol)
        fill_hydrogens(mol)
    return mol


_ATOM = re.compile(r"\[[0-9]*(?:\*|[A-Z][a-z]?|[a-z][a-z]?)@{0,2}(?:H[0-9]?)?(?:\+(?:[0-9]|\+*)|-(?:[0-9]|-*))?(?::[0-9]+)?\]|Cl|Br|[BCNOPSFI]|[bcnops]")
_FRAME = re.compile(r"\0|[().]|%[0-9]{2}|[0-9]|[=#\-:/\\]+|(?s:.)")


def is_valid(text: str | None) -> bool:
    """Whether ``parse`` accepts the text, without building a molecule."""
    if not text or "\0" in text:
        return False
    placed, atoms, depth, opened = False, False, 0, set()
    for t in _FRAME.findall(_ATOM.sub("\0", text)):
        c = t[0]
        if c == "\0":
            placed = atoms = True
        elif c in "=#-:/\\":
            pass
        elif c == "(":
            if not placed:
                return False
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            placed = True
        elif c == ".":
            placed = False
        elif "0" <= c <= "9" or len(t) == 3:
            if not placed:
                return False
            opened ^= {int(t[-2:].lstrip("%"))}
        else:
            return False
    return atoms and not depth and not opened
