"""Scaffolds, fragments, charge normal forms, hash keys and common substructures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from retort.kernel.descriptors import formula, heavy_atoms, weight
from retort.kernel.jsontext import dumps
from retort.kernel.mol import AROMATIC, DOUBLE, SINGLE, Molecule, aromatize
from retort.kernel.writer import canonical_smiles


# --- scaffolds ---------------------------------------------------------------------------------------------------------------------------------------


def scaffold(mol: Molecule) -> Molecule | None:
    """Rings and what links them: heavy atoms outside rings are taken off from the ends inwards; None without rings."""
    if not any(mol.ring_atoms):
        return None
    keep = {i for i, s in enumerate(mol.sym) if s != "H"}
    degree = {i: sum(v in keep for v, _ in mol.adj[i]) for i in keep}
    ends = [i for i in keep if degree[i] <= 1 and not mol.ring_atoms[i]]
    while ends:
        i = ends.pop()
        if i not in keep:
            continue
        keep.discard(i)
        for v, _ in mol.adj[i]:
            if v in keep:
                degree[v] -= 1
                if degree[v] <= 1 and not mol.ring_atoms[v]:
                    ends.append(v)
    return mol.subgraph(keep) if keep else None


def blank(mol: Molecule, element=None, orders: bool = False, aromatic: bool = False) -> Molecule:
    """The heavy-atom graph with plain atoms (all ``element``, if given) and single bonds, or its own orders and aromatic flags."""
    heavy = mol.subgraph(i for i, s in enumerate(mol.sym) if s != "H")
    out = Molecule()
    for i, sym in enumerate(heavy.sym):
        out.add_atom(element or sym, arom=aromatic and heavy.arom[i])
    out.bonds = [[a, b, o if orders else SINGLE] for a, b, o in heavy.bonds]
    return out


def murcko(mol: Molecule) -> str:
    s = scaffold(mol)
    return "" if s is None else canonical_smiles(s)


def generic(mol: Molecule) -> str:
    s = scaffold(mol)
    return "" if s is None else canonical_smiles(blank(s, "C"))


def ring_systems(mol: Molecule) -> list[dict]:
    """Fused ring systems with their rings, all numbers from 1."""
    on = mol.ring_bonds
    group: dict[int, int] = {}
    for start in range(len(mol)):
        if mol.ring_atoms[start] and start not in group:
            group[start], todo = start, [start]
            while todo:
                for v, k in mol.adj[todo.pop()]:
                    if on[k] and v not in group:
                        group[v] = start
                        todo.append(v)
    systems: dict[int, dict] = {}
    for i in sorted(group):
        systems.setdefault(group[i], {"atoms": [], "bonds": [], "rings": []})["atoms"].append(i)
    for k, (a, _, _) in enumerate(mol.bonds):
        if on[k]:
            systems[group[a]]["bonds"].append(k)
    for n, ring in enumerate(mol.rings, 1):
        atoms = sorted(mol.ring_members(ring))
        systems[group[atoms[0]]]["rings"].append({"index": n, "size": len(atoms), "aromatic": _aromatic(mol, ring), "atoms": _from1(atoms), "bonds": _from1(sorted(ring))})
    out = []
    for n, s in enumerate((systems[k] for k in sorted(systems)), 1):
        head = {"index": n, "num_atoms": len(s["atoms"]), "num_bonds": len(s["bonds"]), "num_rings": len(s["rings"]), "aromatic": _aromatic(mol, s["bonds"])}
        out.append(head | {"atoms": _from1(s["atoms"]), "bonds": _from1(s["bonds"]), "rings": s["rings"]})
    return out


def _aromatic(mol: Molecule, bonds: list[int]) -> bool:
    return all(mol.bonds[k][2] == AROMATIC for k in bonds)


def _from1(numbers) -> list[int]:
    return [n + 1 for n in numbers]


def scaffold_network(mol: Molecule) -> dict[str, list[dict]]:
    """The molecule, its scaffolds and single rings as nodes, and which comes from which as edges; each once, ordered by their text."""
    whole, core = canonical_smiles(mol), scaffold(mol)
    nodes, edges = [{"kind": "molecule", "smiles": whole}], []
    if core is not None:
        inner, plain = canonical_smiles(core), canonical_smiles(blank(core, "C"))
        nodes += [{"kind": "murcko_scaffold", "smiles": inner}, {"kind": "generic_scaffold", "smiles": plain}]
        edges += [{"from": whole, "to": inner, "kind": "murcko"}, {"from": inner, "to": plain, "kind": "generic"}]
        for ring in core.rings:
            text = canonical_smiles(core.subgraph(core.ring_members(ring)))
            nodes.append({"kind": "ring_system", "smiles": text})
            if text != inner:
                edges.append({"from": inner, "to": text, "kind": "ring_system"})

    def unique(rows: list[dict]) -> list[dict]:
        by = {dumps(r): r for r in rows}
        return [by[t] for t in sorted(by)]

    return {"nodes": unique(nodes), "edges": unique(edges)}


# --- fragments and charges ---------------------------------------------------------------------------------------------------------------------------


def _largest(mol: Molecule, parts: list[list[int]]) -> list[int]:
    """The part with most carbons, then heavy atoms, then mass, then atoms; of equal ones the one written first."""

    def rank(part: list[int]):
        symbols = [mol.sym[i] for i in part]
        milli = int(weight(mol.subgraph(part)) * 1000 + 0.5)
        return symbols.count("C"), len(part) - symbols.count("H"), milli, len(part), [-i for i in part]

    return max(parts, key=rank)


def _organic(mol: Molecule) -> list[list[int]]:
    """Parts with carbon, or the largest part if none has."""
    parts = mol.components()
    return [p for p in parts if any(mol.sym[i] == "C" for i in p)] or [_largest(mol, parts)]


def largest_fragment(mol: Molecule) -> str:
    return canonical_smiles(mol.subgraph(_largest(mol, mol.components())))


def strip_salts(mol: Molecule) -> str:
    return ".".join(sorted(canonical_smiles(mol.subgraph(p)) for p in _organic(mol)))


# Elements whose charges stay.
KEEP_CHARGE = frozenset("Li Na K Rb Cs Mg Ca Sr Ba Al Zn Fe Cu F Cl Br I".split())


def neutral(mol: Molecule) -> Molecule:
    """A copy with charges removed where hydrogens can make up for them; then neutral nitro groups are written with charges."""
    out = mol.clone()
    for i, sym in enumerate(out.sym):
        charge = out.chg[i]
        if sym in KEEP_CHARGE or not charge:
            continue
        move = -charge if charge < 0 else -min(charge, max(0, out.hyd[i]))
        out.hyd[i] += move
        out.chg[i] += move
        if out.chg[i] == 0:
            out.brk[i] = False
    for i, sym in enumerate(out.sym):
        oxygens = {o: [v for v, k in out.adj[i] if out.sym[v] == "O" and out.bonds[k][2] == o] for o in (SINGLE, DOUBLE)}
        if sym == "N" and out.chg[i] == 0 and oxygens[SINGLE] and oxygens[DOUBLE]:
            o = oxygens[SINGLE][0]
            out.chg[i], out.brk[i] = 1, True
            out.chg[o], out.hyd[o], out.brk[o] = -1, 0, True
    out.touched()
    return out


def neutralized(mol: Molecule) -> str:
    return canonical_smiles(neutral(mol))


def _rearomatized(mol: Molecule) -> str:
    aromatize(mol)
    mol.touched()
    return canonical_smiles(mol)


def normalized(mol: Molecule) -> str:
    return _rearomatized(neutral(mol))


def fragment_parent(mol: Molecule) -> str:
    return _rearomatized(neutral(mol.subgraph(_largest(mol, _organic(mol)))))


# --- hash keys ---------------------------------------------------------------------------------------------------------------------------------------


def _degrees(mol: Molecule) -> str:
    heavy = [i for i, s in enumerate(mol.sym) if s != "H"]
    return ",".join(map(str, sorted(sum(mol.sym[v] != "H" for v, _ in mol.adj[i]) for i in heavy)))


def _counts(mol: Molecule) -> str:
    return f"{heavy_atoms(mol)}:{sum('H' not in (mol.sym[a], mol.sym[b]) for a, b, _ in mol.bonds)}"


# Methods in the order they are listed, each with its other names.
HASH_METHODS = {
    "canonical_smiles": (canonical_smiles, ("canonical", "smiles")),
    "formula": (formula, ()),
    "net_charge": (lambda m: str(sum(m.chg)), ("charge",)),
    "degree_vector": (_degrees, ("degreevector",)),
    "atom_bond_counts": (_counts, ("counts",)),
    "element_graph": (lambda m: canonical_smiles(blank(m)), ("elementgraph",)),
    "bond_order_graph": (lambda m: canonical_smiles(blank(m, orders=True, aromatic=True)), ("bondordergraph",)),
    "anonymous_graph": (lambda m: canonical_smiles(blank(m, "C")), ("anonymousgraph",)),
    "murcko_scaffold": (murcko, ("murcko", "scaffold")),
    "generic_scaffold": (generic, ("generic", "framework")),
}
_BY_NAME = {alias: make for name, (make, others) in HASH_METHODS.items() for alias in (name, *others)}


def method_name(text: str) -> str:
    """A method's name as it is looked up: trimmed, lower case, ``-``, ``.`` and blanks as ``_``, other signs dropped."""
    return "".join("_" if c in "-. _" else c.lower() for c in text.strip() if c in "-. _" or (c.isascii() and c.isalnum()))


def mol_hash(mol: Molecule, method: str | None) -> str | None:
    make = None if method is None else _BY_NAME.get(method_name(method))
    return None if make is None else make(mol)


# --- maximum common substructure ---------------------------------------------------------------------------------------------------------------------

def common_pairs(a: Molecule, b: Molecule) -> list[tuple[int, int]]:
    """Atom pairs of the largest connected common substructure, by atoms of the smaller molecule.

    Atoms pair if element, aromaticity and charge agree, bonds if their orders do or one is aromatic and the other single. Bonds of the smaller molecule
    must have their partner. Of equally large results the first in order of atoms counts. The search is exact and has no bound; it is exponential in the worst case.

    Branch and bound: the lowest undecided atom at the edge of the mapped part is given each partner it can have, then left out for good. A branch ends where the atoms
    still to be had, kind by kind, can't beat the best, or can only equal it with pairs that come later. To be had are atoms that undecided ones link to the mapped part,
    on either side, so what lies in another component or behind atoms left out doesn't count.
    """
    swap = heavy_atoms(a) > heavy_atoms(b)
    small, large = (b, a) if swap else (a, b)
    kind = lambda m, i: (m.sym[i], m.arom[i], m.chg[i])
    names: dict = {}
    free: dict[int, list[int]] = {}
    spots: list[int | None] = [None] * len(large)
    for j in range(len(large)):
        if large.sym[j] != "H":
            spots[j] = names.setdefault(kind(large, j), len(names))
            free.setdefault(spots[j], []).append(j)
    kinds = [names.get(kind(small, i)) if small.sym[i] != "H" else None for i in range(len(small))]
    wanted = set(kinds) - {None}
    near = [[v for v, _ in small.adj[i] if kinds[v] is not None] for i in range(len(small))]
    far = [[v for v, _ in large.adj[j] if spots[v] in wanted] for j in range(len(large))]
    order: dict[tuple[int, int], int] = {}
    for u, v, o in large.bonds:
        order.setdefault((u, v), o)
        order.setdefault((v, u), o)
    best: list[tuple[int, int]] = []
    mapping: dict[int, int] = {}
    used: set[int] = set()
    out: set[int] = set()

    def partners(i: int) -> list[int]:
        bonds = [(mapping[v], small.bonds[k][2]) for v, k in small.adj[i] if v in mapping]
        return [j for j in free[kinds[i]] if j not in used and all((x := order.get((j, m))) == o or {x, o} == {AROMATIC, SINGLE} for m, o in bonds)]

    def later() -> bool:
        """Whether what is decided so far comes after the best in order of atoms."""
        for i, j in best:
            if i in mapping:
                if mapping[i] != j:
                    return mapping[i] > j
            else:
                return i in out
        return False

    def reached(links: list[list[int]], starts, shut, of: list) -> list[int]:
        """Numbers of atoms by kind that lead on from ``starts`` outside ``shut``."""
        counts = [0] * len(names)
        seen, todo = set(starts), list(starts)
        while todo:
            for v in links[todo.pop()]:
                if v not in seen and v not in shut:
                    seen.add(v)
                    todo.append(v)
                    counts[of[v]] += 1
        return counts

    def most() -> int:
        return len(mapping) + sum(map(min, reached(near, mapping, out, kinds), reached(far, used, (), spots)))

    def grow() -> Iterator[None]:
        """Search from the mapped part on; a generator, so that depth isn't limited by the stack: each item asks for a search from the mapped part as it is then."""
        nonlocal best
        if len(mapping) >= len(best):
            pairs = sorted(mapping.items())
            if len(pairs) > len(best) or pairs < best:
                best = pairs
        dropped = []
        while True:
            bound = most()
            if bound < len(best) or (bound == len(best) and later()):
                break
            edge = [v for u in mapping for v in near[u] if v not in mapping and v not in out]
            if not edge:
                break
            i = min(edge)
            for j in partners(i):
                mapping[i] = j
                used.add(j)
                yield
                used.discard(j)
                del mapping[i]
            out.add(i)
            dropped.append(i)
        out.difference_update(dropped)

    whole = [Counter(spots[j] for j in part if spots[j] in wanted) for part in large.components()]
    place = {j: n for n, part in enumerate(large.components()) for j in part}
    for part in small.components():
        members = sorted(i for i in part if kinds[i] is not None)
        for n, s in enumerate(members):
            out.clear()
            out.update(members[:n])
            rest = Counter(kinds[i] for i in members[n:])
            caps = [(rest & c).total() for c in whole]
            for j in free[kinds[s]]:
                # Every result from here on begins with this pair.
                if caps[place[j]] < len(best) or (caps[place[j]] == len(best) and best[0] < (s, j)):
                    continue
                mapping[s] = j
                used.add(j)
                stack = [grow()]
                while stack:
                    if next(stack[-1], stack) is stack:
                        stack.pop()
                    else:
                        stack.append(grow())
                used.discard(j)
                del mapping[s]
    return sorted(((y, x) for x, y in best), key=lambda p: p[1]) if swap else best


def mcs_smarts(a: Molecule, b: Molecule) -> str:
    pairs = common_pairs(a, b)
    return canonical_smiles(a.subgraph(x for x, _ in pairs)) if pairs else ""


def mcs(a: Molecule, b: Molecule) -> dict:
    pairs = common_pairs(a, b)
    left, right = sorted(x for x, _ in pairs), sorted(y for _, y in pairs)
    part = a.subgraph(left)
    return {
        "num_atoms": len(pairs), "num_bonds": len(part.bonds), "smarts": canonical_smiles(part) if pairs else "",
        "atoms_a": _from1(left), "atoms_b": _from1(right), "atom_pairs": [{"a": x + 1, "b": y + 1} for x, y in pairs],
    }
