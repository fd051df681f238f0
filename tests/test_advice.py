"""Findings of the review: queries that did less than the whole job."""

from __future__ import annotations

import duckdb

from retort.functions import molecules as M
from retort.kernel import conformer, docking
from retort.kernel import structures as S
from retort.plans import queries, workflows


def test_docking_of_every_row(spark, tmp_path):
    texts = {1: "CCO", 2: "c1ccccc1", 3: "CCO", 4: "CC[NH3+].[Cl-]", 5: "bad", 6: None}
    spark.createDataFrame(list(texts.items()), "mol_id bigint, smiles string").write.parquet(f"{tmp_path}/smiles.parquet")
    got = {r.mol_id: r for r in queries.vs_docking(spark, str(tmp_path)).collect()}
    assert {i: r.smiles for i, r in got.items()} == texts
    assert {i for i, r in got.items() if r.score is not None and r.ligand} == {1, 2, 3, 4}
    assert (got[1].score, got[1].ligand) == (got[3].score, got[3].ligand) and got[5].receptor and got[6].plain


def test_members_of_similar_pairs(spark):
    texts = ["CCO", "OCC", "CCCO", "CCCCO", "CCCCCO", "c1ccccc1C", "Cc1ccccc1", "c1ccccc1CC", "c1ccccc1CCC", "bad", None, "CCO", "CCCCCCCCO", "CCCCCCCCCO"]
    fps = workflows.fingerprints(spark.createDataFrame(list(enumerate(texts)), "mol_id bigint, smiles string"), "smiles")
    bits = {i: int.from_bytes(M.FIELDS["morgan_fp_bits"].make(M.molecule(t)), "little") for i, t in enumerate(texts) if t and M.molecule(t)}
    for t in (0.3, 0.6, 1.0):
        want = {i: (min(j for j in bits if bits[j] == x), sum(j != i and (x & y).bit_count() / (x | y).bit_count() >= t for j, y in bits.items())) for i, x in bits.items()}
        got = {r.mol_id: (r.class_id, r.links) for r in workflows.similar_members(fps, t).collect()}
        assert got == want and got[0][0] == got[1][0] == got[11][0] == 0
    assert workflows.similar_members(fps.limit(0), 0.5).count() == 0


def test_common_parts_of_all_records_of_a_name(spark, tmp_path):
    schema = "mol_id bigint, name string, smiles string"
    spark.createDataFrame([(1, "p", "CCO"), (2, "p", "CCO"), (3, "q", None), (4, None, "CC"), (5, "r", "CC")], schema).write.parquet(f"{tmp_path}/selfies.parquet")
    spark.createDataFrame([(10, "p", None), (11, "p", "bad"), (12, "p", "OCC"), (13, "p", "CCCO"), (14, "p", "OCC"), (15, "q", "CC"), (16, None, "CC"), (17, "s", "CC")], schema).write.parquet(f"{tmp_path}/smiles.parquet")
    got = [tuple(r)[:3] for r in queries.mol_mcs(spark, str(tmp_path)).collect()]
    ok = M.molecule("CCO")
    full = {12: S.mcs_smarts(ok, M.molecule("OCC")), 13: S.mcs_smarts(ok, M.molecule("CCCO"))}
    assert sorted(got, key=repr) == sorted([*[(a, b, full.get(12 if b == 14 else b)) for a in (1, 2) for b in range(10, 15)], (3, 15, None)], key=repr) and all(full.values())


def test_common_parts_of_given_tables(spark, data):
    want = duckdb.sql(f"SELECT a.mol_id, b.mol_id FROM '{data}/selfies.parquet' a JOIN '{data}/smiles.parquet' b USING (name)").fetchall()
    assert sorted((r.a, r.b) for r in queries.mol_mcs(spark, data).collect()) == sorted(want)


def test_common_parts_without_bound():
    part = "CC(=O)Nc1ccc(cc1)S(=O)(=O)NC1CCCCC1"
    m, n = M.molecule(".".join([part] * 22)), M.molecule(".".join([part] * 22 + ["[Na+]"]))
    size = len(M.molecule(part))
    assert S.common_pairs(m, n) == [(i, i) for i in range(size)] and S.mcs_smarts(m, n) == S.mcs_smarts(M.molecule(part), M.molecule(part))
    # Deeper than Python's stack.
    assert S.common_pairs(M.molecule("C" * 1200), M.molecule("C" * 1200)) == [(i, i) for i in range(1200)]


def test_conformers_and_boxes_of_any_size(monkeypatch):
    monkeypatch.setattr(conformer, "TRIES", 1)
    monkeypatch.setattr(conformer, "STEPS", 2)
    mol, xyz = conformer.conformer("C" * 140, 1)
    assert len(mol) == 422 and xyz.shape == (422, 3)
    atom = queries.RECEPTOR.split("\n")[0]
    assert '"score"' in docking.dock("CO", atom, 0.0, 0.0, 0.0, 25.0, 25.0, 25.0, 2, 7, 7.4)
    assert docking.grids(atom, (0.0, 0.0, 0.0), (25.0, 25.0, 25.0), 7.4).n.prod() > 2_000_000


def test_core_stands_alone():
    """Nothing outside the subpackage on training data imports it, the entry but by asking whether it is there."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in [*root.glob("retort/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.relative_to(root).parts and path.name != Path(__file__).name:
            assert "retort.llm" not in path.read_text(), path
