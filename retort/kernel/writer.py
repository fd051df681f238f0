"""Writing molecules as SMILES."""

from __future__ import annotations

from retort.kernel.mol import DOUBLE, SINGLE, TRIPLE, AROMATIC, VALENCE, Molecule

# Symbols between atoms; the verbose form also shows aromatic bonds.
_PLAIN = {SINGLE: "", AROMATIC: "", DOUBLE: "=", TRIPLE: "#"}
_SHOWN = _PLAIN | {AROMATIC: ":"}
# How bond orders rank among the branches of an atom.
_RANK = {SINGLE: 0, AROMATIC: 1, DOUBLE: 2, TRIPLE: 3}


def _signed(charge: int) -> str:
    if not charge:
        return ""
    return ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")


def atom_token(mol: Molecule, i: int) -> str:
    """An atom as written: bare where that says it all, else in brackets."""
    sym = mol.sym[i].lower() if mol.arom[i] else mol.sym[i]
    marked = mol.chg[i] or mol.iso[i] is not None or mol.amap[i] is not None or mol.chi[i]
    if not marked and mol.sym[i] in VALENCE and (not mol.brk[i] or (mol.arom[i] and mol.hyd[i] == 0)):
        return sym
    h = mol.hyd[i]
    parts = ["[", "" if mol.iso[i] is None else str(mol.iso[i]), sym, mol.chi[i] or "", "" if h <= 0 else "H" if h == 1 else f"H{h}", _signed(mol.chg[i])]
    return "".join(parts) + ("" if mol.amap[i] is None else f":{mol.amap[i]}") + "]"


def _verbose_token(mol: Molecule, i: int) -> str:
    return f"[{mol.sym[i].lower() if mol.arom[i] else mol.sym[i]}{_signed(mol.chg[i])}]"


def _ring_mark(number: int) -> str:
    """A closure number; above 99 the two-digit form has no room, so the number is written as it is after the sign."""
    return str(number) if number < 10 else f"%{number}"


def _links(mol: Molecule) -> list[list[tuple[int, int]]]:
    """Per atom (neighbour, order) in bond order; a bond from an atom to itself counts once."""
    def make(m: Molecule):
        out: list[list[tuple[int, int]]] = [[] for _ in m.sym]
        for a, b, order in m.bonds:
            out[a].append((b, order))
            if a != b:
                out[b].append((a, order))
        return out

    return mol.once("links", make)


def _walk(start: int, links, tokens: list[str], symbols: dict[int, str], seen: list[bool], marks: dict, out: list[str], best: str | None = None) -> bool:
    """Depth-first text from ``start``; a closure gets its number at the end that is written second.

    The stack holds generators instead of frames, so chains of any length can be written. A text that turns out greater than ``best`` is left where it does: the result is false.
    """

    def atom(i: int, came: int):
        seen[i] = True
        out.append(tokens[i])
        around = [x for x in links[i] if x[0] != came]
        fresh = []
        for v, order in around:
            if seen[v]:
                close(i, v, order)
            else:
                fresh.append((v, order))
        for k, (v, order) in enumerate(fresh):
            if seen[v]:
                close(i, v, order)
                continue
            branch = any(not seen[w] for w, _ in fresh[k + 1 :])
            out.append(("(" if branch else "") + symbols[order])
            yield v, i
            if branch:
                out.append(")")

    def close(a: int, b: int, order: int) -> None:
        number = marks.setdefault((min(a, b), max(a, b)), len(marks) + 1)
        out.append(_PLAIN[order] + _ring_mark(number))

    stack = [atom(start, -1)]
    # Pieces compared with ``best`` so far, and how much of it they are; once a piece is less, the rest needs no look.
    compared, at, tied = 0, 0, best is not None
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
        else:
            stack.append(atom(*step))
        while tied and compared < len(out):
            piece = out[compared]
            there = best[at : at + len(piece)]
            if piece > there:
                return False
            compared, at, tied = compared + 1, at + len(piece), piece == there
    return True


def _cycle_text(mol: Molecule, part: list[int], links, tokens: list[str]) -> str | None:
    """The least text of a part that is one plain ring, over all starts and both directions; None if it is none."""
    if len(part) < 3 or sum(len(links[i]) for i in part) != 2 * len(part) or any(len(links[i]) != 2 for i in part):
        return None
    order: list[tuple[int, int]] = []
    last, i = -1, part[0]
    for _ in part:
        step = next(((v, o) for v, o in links[i] if v != last), None)
        if step is None:
            return None
        order.append((i, step[1]))
        last, i = i, step[0]
    if i != part[0] or len({x for x, _ in order}) != len(part):
        return None
    n = len(order)
    names = [tokens[x] for x, _ in order]
    bonds = [_PLAIN[o] for _, o in order]
    best = None
    for ring_names, ring_bonds in ((names, bonds), (names[::-1], (bonds[::-1][1:] + bonds[::-1][:1]))):
        for s in range(n):
            a, b = ring_names[s:] + ring_names[:s], ring_bonds[s:] + ring_bonds[:s]
            text = a[0] + "1" + "".join(b[k] + a[k + 1] for k in range(n - 1)) + b[n - 1] + "1"
            best = text if best is None or text < best else best
    return best


def _starts(part: list[int], links, tokens: list[str]) -> list[int]:
    """The atoms of a part from which the least text can begin: how a text begins - the atom, and how it goes on to its first neighbour - is known before it is written."""

    def begins(i: int) -> str:
        row = links[i]
        if not row or any(v == i for v, _ in row):
            return tokens[i]
        v, order = row[0]
        return tokens[i] + ("(" if len(row) > 1 else "") + _PLAIN[order] + tokens[v]

    heads = [begins(i) for i in part]
    least = min(heads)
    return [i for i, head in zip(part, heads, strict=True) if head.startswith(least)]


def canonical_smiles(mol: Molecule) -> str:
    """The least text over all start atoms, part by part, parts sorted.

    Branches follow (token, number of neighbours, atom index, bond order); with the index among them the result
    depends on the order atoms were written in.
    """
    tokens = [atom_token(mol, i) for i in range(len(mol))]
    plain = _links(mol)
    links = [sorted(row, key=lambda x: (tokens[x[0]], len(plain[x[0]]), x[0], _RANK[x[1]])) for row in plain]
    texts = []
    for part in mol.components():
        text = _cycle_text(mol, part, plain, tokens)
        if text is None:
            for start in _starts(part, links, tokens):
                out: list[str] = []
                if _walk(start, links, tokens, _PLAIN, [False] * len(mol), {}, out, text):
                    candidate = "".join(out)
                    text = candidate if text is None or candidate < text else text
        texts.append(text)
    return ".".join(sorted(texts))


def with_hydrogens(mol: Molecule) -> Molecule:
    """Implicit hydrogens as atoms at the end, atom by atom."""
    out = mol.clone()
    for i in range(len(mol)):
        for _ in range(max(0, mol.hyd[i])):
            out.bonds.append([i, out.add_atom("H", brk=True), SINGLE])
        out.hyd[i] = 0
    out.touched()
    return out


def verbose_smiles(mol: Molecule) -> str:
    """All atoms in brackets with element and charge only, from the first atom of each part on."""
    tokens = [_verbose_token(mol, i) for i in range(len(mol))]
    seen, marks, texts = [False] * len(mol), {}, []
    for start in range(len(mol)):
        if not seen[start]:
            out: list[str] = []
            _walk(start, _links(mol), tokens, _SHOWN, seen, marks, out)
            texts.append("".join(out))
    return ".".join(texts)
