"""Substructure patterns.

A pattern text is compiled once: every atom expression becomes a closure over a
``View`` (per-molecule tables made on demand), and the pattern a search plan - for
each atom the earlier atom it hangs on, and the ring-closing bonds that can be
tested as soon as it is placed. A three-valued look at the expression alone tells
which (element, aromatic) kinds can match an atom at all, so most patterns are
settled for a molecule without a search. Searches work on bit sets of atoms (whole
numbers): what an atom expression allows, and what each atom reaches by an allowed
bond, is one number each, made once per molecule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

from retort.kernel.elements import PATTERN_NUMBER, PATTERN_SYMBOLS
from retort.kernel.mol import AROMATIC, DOUBLE, SINGLE, TRIPLE, USED_VALENCE, Molecule


class View:
    """What patterns ask of a molecule, each table made once."""

    def __init__(self, mol: Molecule):
        self.mol, self.sym, self.arom, self.adj = mol, mol.sym, mol.arom, mol.adj
        self.orders = [b[2] for b in mol.bonds]
        self.memo: dict = {}
        self._masks: dict = {}
        self._near: dict = {}
        self._systems: dict = {}

    def mask(self, atom: Atom) -> int:
        """The atoms an expression allows, as bits."""
        out = self._masks.get(atom)
        if out is None:
            out, test = 0, atom.test
            for kind, members in self.kinds.items():
                known = atom.kind(kind)
                if known is not False:
                    out |= self.kind_bits[kind] if known else sum(1 << i for i in members if test(self, i))
            self._masks[atom] = out
        return out

    def near(self, table: tuple[bool, ...]) -> list[int]:
        """For each atom those it reaches by a bond the table allows, as bits."""
        out = self._near.get(table)
        if out is None:
            out = [0] * len(self.sym)
            ring = self.mol.ring_bonds
            for k, (a, b, order) in enumerate(self.mol.bonds):
                if table[2 * order + ring[k]]:
                    out[a] |= 1 << b
                    out[b] |= 1 << a
            self._near[table] = out
        return out

    def in_systems(self, size: int) -> int:
        """The atoms of ring systems of at least that many atoms, as bits."""
        out = self._systems.get(size)
        if out is None:
            out = self._systems[size] = sum(1 << i for i, n in enumerate(self.system_sizes) if n >= size)
        return out

    @cached_property
    def system_sizes(self):
        return _system_sizes(len(self.sym), [b[:2] for b, ring in zip(self.mol.bonds, self.mol.ring_bonds, strict=True) if ring])

    @cached_property
    def kind_bits(self):
        return {kind: sum(1 << i for i in members) for kind, members in self.kinds.items()}

    @cached_property
    def simple(self):
        """No two bonds between the same atoms."""
        return len({(min(a, b), max(a, b)) for a, b, _ in self.mol.bonds}) == len(self.mol.bonds)

    @cached_property
    def number(self):
        return [PATTERN_NUMBER.get(s, 0) for s in self.sym]

    @cached_property
    def kinds(self):
        """(element, aromatic) to the atoms of that kind."""
        out: dict = {}
        for i, key in enumerate(zip(self.sym, self.arom, strict=True)):
            out.setdefault(key, []).append(i)
        return out

    @cached_property
    def kind_set(self):
        return frozenset(self.kinds)

    @cached_property
    def hydrogens(self):
        return [max(0, h) + sum(self.sym[v] == "H" for v, _ in row) for h, row in zip(self.mol.hyd, self.adj, strict=True)]

    @cached_property
    def connections(self):
        return [len(row) + max(0, h) for h, row in zip(self.mol.hyd, self.adj, strict=True)]

    @cached_property
    def degree(self):
        return [sum(self.sym[v] != "H" for v, _ in row) for row in self.adj]

    @cached_property
    def valence(self):
        return [sum(USED_VALENCE[self.orders[k]] for _, k in row) + max(0, h) for h, row in zip(self.mol.hyd, self.adj, strict=True)]

    @cached_property
    def ring_degree(self):
        return [sum(self.mol.ring_bonds[k] for _, k in row) for row in self.adj]

    @cached_property
    def ring_sizes(self):
        out: list[set[int]] = [set() for _ in self.sym]
        for ring in self.mol.rings:
            members = self.mol.ring_members(ring)
            for i in members:
                out[i].add(len(members))
        return out


Test = Callable[[View, int], bool]


class Atom:
    """An atom expression: the test, and ``may(symbol, aromatic)``, None where more than the kind decides."""

    __slots__ = ("test", "may", "known")

    def __init__(self, test: Test, may=lambda s, a: None):
        self.test, self.may, self.known = test, may, {}

    def kind(self, kind: tuple[str, bool]) -> bool | None:
        """``may``, remembered."""
        if kind not in self.known:
            self.known[kind] = self.may(*kind)
        return self.known[kind]


def _kind(predicate) -> Atom:
    return Atom(lambda v, i: predicate(v.sym[i], v.arom[i]), predicate)


def _all(parts: list[Atom]) -> Atom:
    if len(parts) == 1:
        return parts[0]
    tests = [p.test for p in parts]

    def may(s, a):
        seen = [p.may(s, a) for p in parts]
        return False if False in seen else None if None in seen else True

    return Atom(lambda v, i: all(t(v, i) for t in tests), may)


def _any(parts: list[Atom]) -> Atom:
    if len(parts) == 1:
        return parts[0]
    tests = [p.test for p in parts]

    def may(s, a):
        seen = [p.may(s, a) for p in parts]
        return True if True in seen else None if None in seen else False

    return Atom(lambda v, i: any(t(v, i) for t in tests), may)


def _none(part: Atom) -> Atom:
    test = part.test

    def may(s, a):
        known = part.may(s, a)
        return None if known is None else not known

    return Atom(lambda v, i: not test(v, i), may)


@lru_cache(maxsize=None)
def _element(symbol: str, aromatic: bool) -> Atom:
    return _kind(lambda s, a: a == aromatic and s == symbol)


ANY = _kind(lambda s, a: True)
ALIPHATIC = _kind(lambda s, a: not a)
AROMATIC_ATOM = _kind(lambda s, a: a)

# What bond symbols demand, given order and whether the bond is in a ring.
_BOND = {
    "-": lambda o, r: o == SINGLE,
    "/": lambda o, r: o == SINGLE,
    "\\": lambda o, r: o == SINGLE,
    "=": lambda o, r: o == DOUBLE,
    "#": lambda o, r: o == TRIPLE,
    ":": lambda o, r: o == AROMATIC,
    "!:": lambda o, r: o != AROMATIC,
    "~": lambda o, r: True,
    "@": lambda o, r: r,
    "!@": lambda o, r: not r,
    "": lambda o, r: o in (SINGLE, AROMATIC),
}


@lru_cache(maxsize=None)
def _bond_table(symbols: tuple[str, ...]) -> tuple[bool, ...]:
    """Allowed (order, in ring) as a table indexed by 2 * order + ring; all symbols must hold."""
    tests = [_BOND[s] for s in symbols or ("",)]
    return tuple(all(t(o, bool(r)) for t in tests) for o in range(5) for r in range(2))


class _Reader:
    """Recursive descent over one pattern text; ``ValueError`` where it isn't one."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, k: int = 0) -> str:
        return self.text[self.at + k : self.at + k + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(self.text)
        self.at += 1
        return c

    def digits(self) -> int:
        start = self.at
        while self.peek().isascii() and self.peek().isdigit():
            self.at += 1
        if start == self.at:
            raise ValueError(self.text)
        return int(self.text[start : self.at])

    def digit(self) -> int:
        c = self.take()
        if not ("0" <= c <= "9"):
            raise ValueError(self.text)
        return int(c)

    def bracket(self) -> Atom:
        out = self.alternatives(";", lambda: self.alternatives(",", self.row, _any), _all)
        if self.take() != "]":
            raise ValueError(self.text)
        return out

    def alternatives(self, sign: str, part, join) -> Atom:
        parts = [part()]
        while self.peek() == sign:
            self.at += 1
            parts.append(part())
        return join(parts)

    def row(self) -> Atom:
        parts = [self.unary()]
        while self.peek() not in ("", ";", ",", "]"):
            if self.peek() == "&":
                self.at += 1
            else:
                parts.append(self.unary())
        return _all(parts)

    def unary(self) -> Atom:
        if self.peek() == "!":
            self.at += 1
            return _none(self.unary())
        return self.primitive()

    def one_or(self, default: int) -> int:
        return self.digit() if "0" <= self.peek() <= "9" else default

    def primitive(self) -> Atom:
        c = self.peek()
        if "0" <= c <= "9":
            n = self.digits() & 0xFFFF
            return Atom(lambda v, i: v.mol.iso[i] == n)
        self.take()
        if c == ":":
            n = self.digits()
            return Atom(lambda v, i: v.mol.amap[i] == n)
        if c == "@":
            turn = c
            if self.peek() == "@":
                turn += self.take()
            return Atom(lambda v, i: v.mol.chi[i] == turn)
        if c == "$":
            return self.environment()
        if c == "*":
            return ANY
        if c == "R":
            if self.peek() == "0":
                self.at += 1
                return Atom(lambda v, i: not v.mol.ring_atoms[i])
            while "0" <= self.peek() <= "9":
                self.at += 1
            return Atom(lambda v, i: v.mol.ring_atoms[i])
        if c == "r":
            n = self.digits() & 0xFF if "0" <= self.peek() <= "9" else 1
            if n == 0:
                return Atom(lambda v, i: not v.mol.ring_atoms[i])
            if n == 1:
                return Atom(lambda v, i: v.mol.ring_atoms[i])
            return Atom(lambda v, i: n in v.ring_sizes[i])
        if c == "A":
            two = "A" + self.peek()
            if self.peek().islower() and two in PATTERN_SYMBOLS:
                self.at += 1
                return _element(two, False)
            return ALIPHATIC
        if c == "a":
            return AROMATIC_ATOM
        if c == "#":
            n = self.digits() & 0xFF
            return _kind(lambda s, a: PATTERN_NUMBER.get(s, 0) == n)
        if c == "H":
            n = self.one_or(1)
            return Atom(lambda v, i: v.hydrogens[i] == n)
        if c == "+":
            n = self.one_or(1)
            return Atom(lambda v, i: v.mol.chg[i] == n)
        if c == "-":
            n = self.one_or(1)
            return Atom(lambda v, i: v.mol.chg[i] == -n)
        if c == "X":
            n = self.digit()
            return Atom(lambda v, i: v.connections[i] == n)
        if c == "D":
            n = self.digit()
            return Atom(lambda v, i: v.degree[i] == n)
        if c == "x":
            n = self.digit()
            return Atom(lambda v, i: v.ring_degree[i] == n)
        if c == "v":
            n = self.digits() & 0xFF
            return Atom(lambda v, i: v.valence[i] == n)
        if c.isascii() and c.isupper():
            if self.peek().islower() and c + self.peek() in PATTERN_SYMBOLS:
                c += self.take()
            return _element(c, False)
        if c.isascii() and c.islower():
            return _element(c.upper(), True)
        raise ValueError(self.text)

    def environment(self) -> Atom:
        if self.take() != "(":
            raise ValueError(self.text)
        start, depth = self.at, 1
        while depth:
            c = self.take()
            depth += (c == "(") - (c == ")")
        inner = compile_pattern(self.text[start : self.at - 1])
        if inner is None:
            raise ValueError(self.text)
        head = inner.atoms[0]

        def test(v: View, i: int) -> bool:
            key = (inner, i)
            if key not in v.memo:
                v.memo[key] = inner.matches_at(v, i)
            return v.memo[key]

        return Atom(test, lambda s, a: False if head.may(s, a) is False else None)

    def pattern(self) -> tuple[list[Atom], list[tuple[int, int, tuple[str, ...]]]]:
        atoms: list[Atom] = []
        bonds: list[tuple[int, int, tuple[str, ...]]] = []
        branches: list[int] = []
        opened: dict[int, tuple[int, tuple[str, ...]]] = {}
        last, pending = -1, ()
        while self.at < len(self.text):
            c = self.take()
            if c == "(" and last >= 0:
                branches.append(last)
            elif c == ")" and branches:
                last = branches.pop()
            elif c == "!" and self.peek() in ("@", ":"):
                pending += (c + self.take(),)
            elif c in "-=#:~/\\@" and c:
                pending += (c,)
            elif (c == "%" or "0" <= c <= "9") and last >= 0:
                number = self.digit() * 10 + self.digit() if c == "%" else int(c)
                if number in opened:
                    other, stated = opened.pop(number)
                    bonds.append((other, last, pending or stated))
                else:
                    opened[number] = (last, pending)
                pending = ()
            else:
                if c == "[":
                    start = self.at
                    atom = self.bracket()
                    # Expressions of one wording are one object, so that a molecule answers each once.
                    atom = _ATOMS.setdefault(self.text[start : self.at], atom) if len(_ATOMS) < 10_000 else atom
                elif c == "*":
                    atom = ANY
                elif c == "A":
                    atom = ALIPHATIC
                elif c == "a":
                    atom = AROMATIC_ATOM
                elif c.isascii() and c.isalpha():
                    if c.isupper() and self.peek().islower() and c + self.peek() in PATTERN_SYMBOLS:
                        atom = _element(c + self.take(), False)
                    else:
                        atom = _element(c.upper(), c.islower())
                else:
                    raise ValueError(self.text)
                if last >= 0:
                    bonds.append((last, len(atoms), pending))
                    pending = ()
                last = len(atoms)
                atoms.append(atom)
        if branches or opened or not atoms:
            raise ValueError(self.text)
        return atoms, bonds


_ATOMS: dict[str, Atom] = {}


def _system_sizes(n: int, bonds: list) -> list[int]:
    """For each of n atoms how many the given bonds tie together with it."""
    root = list(range(n))
    for a, b in bonds:
        x, y = root[a], root[b]
        if x != y:
            root = [x if r == y else r for r in root]
    size = [0] * n
    for r in root:
        size[r] += 1
    return [size[r] for r in root]


class Pattern:
    """A compiled pattern; atom 0 is where a search is anchored."""

    def __init__(self, atoms: list[Atom], bonds: list[tuple[int, int, tuple[str, ...]]]):
        self.atoms = atoms
        # Per atom but the first: the placed atom it hangs on with the bond to it, and further bonds to placed atoms.
        self.plan: list[tuple[int, tuple[bool, ...], list[tuple[int, tuple[bool, ...]]]] | None] = [None]
        # A cycle of the pattern can only lie on a cycle of the molecule, so its bonds must be ring bonds.
        graph = Molecule()
        for _ in atoms:
            graph.add_atom("*")
        graph.bonds = [[a, b, SINGLE] for a, b, _ in bonds]
        tables = [tuple(ok and (x & 1 or not cyclic) for x, ok in enumerate(_bond_table(s))) for (_, _, s), cyclic in zip(bonds, graph.ring_bonds, strict=True)]
        for i in range(1, len(atoms)):
            back = [(a + b - i, t) for (a, b, _), t in zip(bonds, tables, strict=True) if max(a, b) == i and a != b]
            self.plan.append((*back[0], back[1:]) if back else None)
        self.connected = all(self.plan[1:]) and all(a != b for a, b, _ in bonds)
        self.able: dict[frozenset, bool] = {}
        # How many atoms hang together with each by bonds of cycles: as many the molecule's ring system must have at least.
        self.ring_size = [size if size > 1 else 0 for size in _system_sizes(len(atoms), [b[:2] for b, cyclic in zip(graph.bonds, graph.ring_bonds, strict=True) if cyclic])]

    def may_be(self, k: int, kind: tuple[str, bool]) -> bool:
        return self.atoms[k].kind(kind) is not False

    def possible(self, view: View) -> bool:
        """Whether every pattern atom has some atom in the molecule of a kind it may be."""
        kinds = view.kind_set
        if kinds not in self.able:
            if len(self.able) > 4096:
                self.able.clear()
            self.able[kinds] = self.connected and all(any(self.may_be(k, kind) for kind in kinds) for k in range(len(self.atoms)))
        return self.able[kinds]

    def placed(self, view: View, start: int) -> Iterator[tuple[int, ...]]:
        """Embeddings with atom 0 at ``start``, as atom tuples."""
        if not self.connected or not self.atoms[0].test(view, start):
            return
        if len(self.atoms) == 1:
            yield (start,)
            return
        adj, orders, atoms, plan, n = view.adj, view.orders, self.atoms, self.plan, len(self.atoms)
        ring = view.mol.ring_bonds
        spot = [start]

        def extend(k: int) -> Iterator[tuple[int, ...]]:
            if k == n:
                yield tuple(spot)
                return
            anchor, allowed, others = plan[k]
            test = atoms[k].test
            for v, b in adj[spot[anchor]]:
                if v in spot or not allowed[2 * orders[b] + ring[b]] or not test(view, v):
                    continue
                for other, table in others:
                    bond = next((x for u, x in adj[v] if u == spot[other]), None)
                    if bond is None or not table[2 * orders[bond] + ring[bond]]:
                        break
                else:
                    spot.append(v)
                    yield from extend(k + 1)
                    spot.pop()

        yield from extend(1)

    def domains(self, view: View) -> list[int] | None:
        """For each pattern atom the atoms it may be, as bits, narrowed from the last one back to the anchor; None if one has none."""
        if not self.possible(view):
            return None
        out = []
        for atom, size in zip(self.atoms, self.ring_size, strict=True):
            m = view.mask(atom)
            if size:
                m &= view.in_systems(size)
            if not m:
                return None
            out.append(m)
        for k in range(len(out) - 1, 0, -1):
            anchor, table, _ = self.plan[k]
            near, left, reached = view.near(table), out[k], 0
            while left:
                low = left & -left
                reached |= near[low.bit_length() - 1]
                left ^= low
            out[anchor] &= reached
            if not out[anchor]:
                return None
        return out

    def _fits(self, view: View, domains: list[int], start: int) -> bool:
        """Whether there is an embedding with atom 0 at ``start``, which its domain holds."""
        plan, n = self.plan, len(self.atoms)
        if n <= 2:
            return True
        spot = [start] * n

        def fits(k: int, used: int) -> bool:
            anchor, table, others = plan[k]
            left = view.near(table)[spot[anchor]] & domains[k] & ~used
            for other, closing in others:
                left &= view.near(closing)[spot[other]]
            if k + 1 == n:
                return left != 0
            while left:
                low = left & -left
                spot[k] = low.bit_length() - 1
                if fits(k + 1, used | low):
                    return True
                left ^= low
            return False

        return fits(1, 1 << start)

    def starts(self, view: View) -> int:
        """The atoms at which an embedding is anchored, as bits."""
        if self not in view.memo:
            out = 0
            if view.simple:
                domains = self.domains(view)
                left = domains[0] if domains else 0
                while left:
                    low = left & -left
                    if self._fits(view, domains, low.bit_length() - 1):
                        out |= low
                    left ^= low
            else:
                out = sum(1 << i for i in range(len(view.sym)) if next(self.placed(view, i), None) is not None)
            view.memo[self] = out
        return view.memo[self]

    def matches_at(self, view: View, start: int) -> bool:
        """Whether there is an embedding with atom 0 at ``start``."""
        return bool(self.starts(view) >> start & 1)

    def found(self, view: View) -> bool:
        if self in view.memo or not view.simple:
            return self.starts(view) != 0
        domains = self.domains(view)
        left = domains[0] if domains else 0
        while left:
            low = left & -left
            if self._fits(view, domains, low.bit_length() - 1):
                return True
            left ^= low
        return False

    def covers(self, view: View, most: int | None = None) -> set[int]:
        """The different sets of atoms that embeddings cover, as bits; no more than ``most`` are looked for."""
        if not view.simple:
            return {sum(1 << i for i in spots) for spots in self.unique(view)}
        domains = self.domains(view)
        if domains is None:
            return set()
        plan, n, out = self.plan, len(self.atoms), set()
        spot = [0] * n

        def extend(k: int, used: int) -> bool:
            anchor, table, others = plan[k]
            left = view.near(table)[spot[anchor]] & domains[k] & ~used
            for other, closing in others:
                left &= view.near(closing)[spot[other]]
            while left:
                low = left & -left
                left ^= low
                if k + 1 == n:
                    out.add(used | low)
                    if len(out) == most:
                        return True
                else:
                    spot[k] = low.bit_length() - 1
                    if extend(k + 1, used | low):
                        return True
            return False

        left = domains[0]
        while left:
            low = left & -left
            left ^= low
            spot[0] = low.bit_length() - 1
            if n == 1:
                out.add(low)
            elif extend(1, low):
                break
        return out

    def count(self, view: View, most: int | None = None) -> int:
        """How many different sets of atoms embeddings cover, counted up to ``most``."""
        if len(self.atoms) == 1:
            return view.mask(self.atoms[0]).bit_count() if self.connected else 0
        return len(self.covers(view, most))

    def unique(self, view: View) -> list[tuple[int, ...]]:
        """One embedding for each set of atoms, the first by anchor, sorted."""
        if not self.possible(view):
            return []
        out: dict[frozenset[int], tuple[int, ...]] = {}
        starts = self.starts(view) if view.simple else (1 << len(view.sym)) - 1
        while starts:
            low = starts & -starts
            for spots in self.placed(view, low.bit_length() - 1):
                out.setdefault(frozenset(spots), spots)
            starts ^= low
        return sorted(out.values())


@lru_cache(maxsize=4096)
def compile_pattern(text: str | None) -> Pattern | None:
    """The pattern, or None if the text isn't one."""
    if not text:
        return None
    try:
        return Pattern(*_Reader(text).pattern())
    except ValueError:
        return None


def view_of(mol: Molecule) -> View:
    return mol.once("view", View)
