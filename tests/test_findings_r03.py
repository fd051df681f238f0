"""Findings of round 3: queries that took too long."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pytest

from retort.functions import molecules as M
from retort.kernel import conformer, writer
from retort.kernel.mol import parse
from retort.kernel.writer import with_hydrogens


def test_equal_texts_of_a_batch_once(monkeypatch):
    made = []
    field = M.FIELDS["mol_formula"]
    monkeypatch.setitem(M.FIELDS, "mol_formula", dataclasses.replace(field, make=lambda m: made.append(m) or field.make(m)))
    got = M._profile_udf(("mol_formula",)).func(pa.array(["CCO", None, "CO", "bad", "CCO"] * 500)).to_pylist()
    assert [r["mol_formula"] for r in got] == ["C2H6O", None, "CH4O", None, "C2H6O"] * 500 and got[3]["valid"] is False and len(made) == 2


def test_greater_texts_are_left_early():
    """Of the atoms the least text of a chain can begin at, all but one are left after a few pieces."""
    mol = parse("C" * 50 + "O")
    tokens, links = list(mol.sym), writer._links(mol)
    best = "C(C)" + "C" * 48 + "O"
    assert writer.canonical_smiles(mol) == best

    def walk(start, least):
        out = []
        return writer._walk(start, links, tokens, writer._PLAIN, [False] * len(mol), {}, out, least), "".join(out)

    for start in range(2, 48):
        less, text = walk(start, best)
        assert not less and len(text) < 20
    assert walk(1, best) == walk(1, best + "C") == walk(1, "D") == (True, best)
    # A text that goes on where the other ends is the greater one.
    assert not walk(1, best[:-1])[0]


def test_numbers_of_a_sequence():
    """Made many at once, they are those of one state after the other."""
    for seed in (0, 11, (1 << 64) - 1, conformer.SPREAD):
        state, want = (seed + 1) & ((1 << 64) - 1), []
        for _ in range(9_000):
            state = (state * conformer.LCG_A + conformer.LCG_C) & ((1 << 64) - 1)
            want.append((state >> 11) / (1 << 53))
        numbers = conformer.Sequence(seed)
        assert [*numbers.unit(1), *numbers.unit(0), *numbers.unit(4_999), *numbers.unit(4_000)] == want


def _plain_energy(terms, xyz):
    """Energy of one set, term by term."""
    total = sum(conformer.K_BOND * (np.linalg.norm(xyz[a] - xyz[b]) - r) ** 2 for (a, b), r in zip(terms.bonds, terms.length, strict=True))
    for (a, c, b), ideal in zip(terms.angles, terms.ideal, strict=True):
        u, v = xyz[a] - xyz[c], xyz[b] - xyz[c]
        total += conformer.K_ANGLE * (np.arccos(u @ v / np.linalg.norm(u) / np.linalg.norm(v)) - ideal) ** 2
    total += sum(conformer.K_PLANE * np.linalg.det([xyz[k] - xyz[c] for k in rest]) ** 2 for c, *rest in terms.flat)
    for a, b in np.argwhere(np.triu(terms.far)):
        six = (((terms.radius[a] + terms.radius[b]) / 2) ** 2 / ((xyz[a] - xyz[b]) ** 2).sum()) ** 3
        total += conformer.DEPTH * (six * six - 2 * six)
    return total


@pytest.mark.parametrize("text", ["CC(=O)Nc1ccc(O)cc1C#N.CCO.[Cl-]", "CCO", "[Na+].[Cl-]"])
def test_energy_of_sets_by_rows_of_pairs(monkeypatch, text):
    """However many pairs are worked on at once, energies are those of the terms; half the pairs are enough, and no new memory is taken for them."""
    terms = conformer.Terms(with_hydrogens(parse(text)))
    x = np.random.default_rng(5).normal(size=(5, 3 * terms.n)) * 4
    want, slopes = [_plain_energy(terms, row.reshape(-1, 3)) for row in x], []
    for pairs, ends in ((1, 1), (60, 200), (700, 40_000), (32_000, 40_000)):
        monkeypatch.setattr(conformer, "TOGETHER", pairs)
        monkeypatch.setattr(conformer, "ENDS", ends)
        energy, slope = terms.energy(x)
        slopes.append(slope)
        assert np.allclose(energy, want, rtol=1e-9) and np.allclose(slope, slopes[0], rtol=1e-8)
    kept = terms.room
    terms.energy(x)
    assert terms.room is kept and kept.shape[1] <= max(5 * terms.n**2, 1)


def test_sets_come_to_rest_as_they_do_alone():
    """Sets of coordinates relaxed together end where each ends by itself, though they come to rest at different steps."""
    terms = conformer.Terms(with_hydrogens(parse("CCO")))
    x = np.stack([conformer.embedding(*terms.limits(), seed) for seed in range(1, 7)])
    energy, rest = conformer.relax(terms, x)
    for k in range(len(x)):
        alone, place = conformer.relax(terms, x[k : k + 1])
        assert abs(alone[0] - energy[k]) < 0.1 and np.abs(terms.energy(rest[k : k + 1])[1]).max() < conformer.FLAT and np.abs(terms.energy(place)[1]).max() < conformer.FLAT
