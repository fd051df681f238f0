"""Queries over small relations of well-known molecules and texts, by the functions' SQL names; their SQL is the list of published or hand-derived answers.

Each relation is a ``VALUES`` list of inputs and answers: the Spark query computes the answers from the inputs, the SQL states them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import molecules as M
from retort.functions import rules
from retort.functions.registry import register_all
from retort.plans import workflows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else repr(v)


_SPARK_TYPES = {"VARCHAR": "STRING", "INTEGER": "INT"}


def golden(name: str, doc: str, inputs: dict[str, str], outputs: dict[str, tuple[str, str]], rows: list[tuple]) -> None:
    """Register a query: ``inputs`` are columns and types, ``outputs`` types and Spark expressions over them, ``rows`` the inputs followed by the answers."""
    types = [*inputs.items(), *[(n, t) for n, (t, _) in outputs.items()]]
    assert all(len(r) == len(types) for r in rows), name
    listed = lambda part: ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in part)
    quoted = [f'"{n}"' for n, _ in types]
    SQL[name] = f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, (_, t) in zip(quoted, types, strict=True))} FROM (VALUES {listed(rows)}) AS v({', '.join(quoted)})"
    cast = ", ".join(f"CAST({n} AS {_SPARK_TYPES.get(t, t)}) AS {n}" for n, t in inputs.items())
    made = ", ".join(f"{e} AS {n}" for n, (_, e) in outputs.items())
    text = f"SELECT {', '.join(inputs)}, {made} FROM (SELECT {cast} FROM VALUES {listed([r[: len(inputs)] for r in rows])} AS v({', '.join(inputs)}))"

    def run(spark: SparkSession, d: str) -> DataFrame:
        register_all(spark)
        return spark.sql(text)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


# Published answers (the common toolkit's figures for these molecules).
ASPIRIN, SALICYLIC, PARACETAMOL = "CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1O", "CC(=O)Nc1ccc(O)cc1"
IBUPROFEN, NAPHTHALENE, CAFFEINE = "CC(C)Cc1ccc(C(C)C(=O)O)cc1", "c1ccc2ccccc2c1", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"
CHOLESTEROL = "CC(C)CCCC(C)C1CCC2C1(CCC3C2CC=C4C3(CCC(C4)O)C)C"
_NOTHING = (None,) * 18

golden(
    "g_molecules",
    "Composition and descriptors of well-known molecules.",
    {"name": "VARCHAR", "smiles": "VARCHAR"},
    {
        "valid": ("BOOLEAN", "mol_is_valid(smiles)"), "formula": ("VARCHAR", "mol_formula(smiles)"), "atoms": ("INTEGER", "mol_num_atoms(smiles)"),
        "bonds": ("INTEGER", "mol_num_bonds(smiles)"), "weight": ("DOUBLE", "round(mol_weight(smiles), 3)"), "exact_mass": ("DOUBLE", "round(mol_exact_mass(smiles), 3)"),
        "logp": ("DOUBLE", "round(logp_crippen(smiles), 4)"), "tpsa": ("DOUBLE", "round(tpsa(smiles), 2)"), "qed": ("DOUBLE", "round(qed(smiles), 3)"),
        "acceptors": ("INTEGER", "num_h_acceptors(smiles)"), "donors": ("INTEGER", "num_h_donors(smiles)"), "rings": ("INTEGER", "ring_count(smiles)"),
        "aromatic_rings": ("INTEGER", "num_aromatic_rings(smiles)"), "aliphatic_rings": ("INTEGER", "num_aliphatic_rings(smiles)"), "saturated_rings": ("INTEGER", "num_saturated_rings(smiles)"),
        "heteroatoms": ("INTEGER", "num_heteroatoms(smiles)"), "csp3": ("DOUBLE", "round(fraction_csp3(smiles), 4)"),
        "carbocycles": ("INTEGER", "num_aromatic_carbocycles(smiles)"), "heterocycles": ("INTEGER", "num_aromatic_heterocycles(smiles)"),
    },
    [
        ("methane", "C", True, "CH4", 1, 0, 16.043, 16.031, 0.6361, 0.0, 0.36, 0, 0, 0, 0, 0, 0, 0, 1.0, 0, 0),
        ("ethanol", "CCO", True, "C2H6O", 3, 2, 46.069, 46.042, -0.0014, 20.23, 0.407, 1, 1, 0, 0, 0, 0, 1, 1.0, 0, 0),
        ("benzene", "c1ccccc1", True, "C6H6", 6, 6, 78.114, 78.047, 1.6866, 0.0, 0.443, 0, 0, 1, 1, 0, 0, 0, 0.0, 1, 0),
        ("phenol", "c1ccccc1O", True, "C6H6O", 7, 7, 94.113, 94.042, 1.3922, 20.23, 0.515, 1, 1, 1, 1, 0, 0, 1, 0.0, 1, 0),
        ("aspirin", ASPIRIN, True, "C9H8O4", 13, 13, 180.159, 180.042, 1.3101, 63.6, 0.55, 4, 1, 1, 1, 0, 0, 4, 0.1111, 1, 0),
        ("salicylic acid", SALICYLIC, True, "C7H6O3", 10, 10, 138.122, 138.032, 1.0904, 57.53, 0.61, 3, 2, 1, 1, 0, 0, 3, 0.0, 1, 0),
        ("paracetamol", PARACETAMOL, True, "C8H9NO2", 11, 11, 151.165, 151.063, 1.3506, 49.33, 0.595, 2, 2, 1, 1, 0, 0, 3, 0.125, 1, 0),
        ("ibuprofen", IBUPROFEN, True, "C13H18O2", 15, 15, 206.285, 206.131, 3.0732, 37.3, 0.822, 2, 1, 1, 1, 0, 0, 2, 0.4615, 1, 0),
        ("naphthalene", NAPHTHALENE, True, "C10H8", 10, 11, 128.174, 128.063, 2.8398, 0.0, 0.511, 0, 0, 2, 2, 0, 0, 0, 0.0, 2, 0),
        ("caffeine", CAFFEINE, True, "C8H10N4O2", 14, 15, 194.194, 194.08, -1.0293, 61.82, 0.538, 6, 0, 2, 2, 0, 0, 6, 0.375, 0, 2),
        ("pyridine", "c1ccncc1", True, "C5H5N", 6, 6, 79.102, 79.042, 1.0816, 12.89, 0.453, 1, 0, 1, 1, 0, 0, 1, 0.0, 0, 1),
        ("cholesterol", CHOLESTEROL, True, "C27H46O", 28, 31, 386.664, 386.355, 7.3887, 20.23, 0.488, 1, 1, 4, 0, 4, 3, 1, 0.9259, 0, 0),
        ("no molecule", "not_a_molecule", False, *_NOTHING),
        ("empty", "", False, *_NOTHING),
        ("cut off", "C(C", False, *_NOTHING),
        ("null", None, None, *_NOTHING),
    ],
)

golden(
    "g_flexibility",
    "Refraction and rotatable bonds of well-known molecules.",
    {"smiles": "VARCHAR"},
    {"refraction": ("DOUBLE", "round(mol_mr(smiles), 3)"), "rotatable": ("INTEGER", "num_rotatable_bonds(smiles)"), "saturated_carbo": ("INTEGER", "num_saturated_carbocycles(smiles)"),
     "saturated_hetero": ("INTEGER", "num_saturated_heterocycles(smiles)"), "aliphatic_carbo": ("INTEGER", "num_aliphatic_carbocycles(smiles)"), "aliphatic_hetero": ("INTEGER", "num_aliphatic_heterocycles(smiles)")},
    [
        ("C", 6.731, 0, 0, 0, 0, 0), ("c1ccccc1", 26.442, 0, 0, 0, 0, 0), (CAFFEINE, 51.196, 0, 0, 0, 0, 0), (IBUPROFEN, 61.035, 4, 0, 0, 0, 0), ("C1CC2CCC1C2", 30.065, 0, 2, 0, 2, 0),
        ("C1OC1", 10.819, 0, 0, 1, 0, 1), ("C1=CCCCC1", 27.608, 0, 0, 0, 1, 0), ("bad(", None, None, None, None, None, None),
    ],
)

_ON = "array_join(filter(sequence(0, 167), k -> getbit(cast(conv(hex(substring({b}, cast(floor(k / 8) AS INT) + 1, 1)), 16, 10) AS BIGINT), k % 8) = 1), ' ')"

golden(
    "g_keys",
    "Structural keys that are on, as published for these molecules.",
    {"smiles": "VARCHAR"},
    {"on_keys": ("VARCHAR", f"transform(array(maccs_keys(smiles)), b -> if(b IS NULL, NULL, {_ON.format(b='b')}))[0]"), "bytes": ("INTEGER", "octet_length(maccs_keys(smiles))")},
    [
        ("CCO", "82 109 114 139 153 155 157 160 164", 21),
        ("c1ccccc1", "162 163 165", 21),
        (ASPIRIN, "89 113 123 126 127 136 139 140 143 144 146 150 152 154 157 159 160 162 163 164 165", 21),
        (PARACETAMOL, "92 110 113 117 127 131 133 135 139 143 151 152 154 156 157 158 159 160 161 162 163 164 165", 21),
        (NAPHTHALENE, "101 105 125 145 162 163 165", 21),
        ("[Na+].[Cl-]", "35 44 49 103 134 166", 21),
        (CAFFEINE, "37 38 65 75 77 79 80 83 85 89 92 93 95 96 97 98 101 105 106 110 113 117 120 121 122 125 127 136 137 141 142 143 144 148 149 150 154 156 158 159 160 161 162 163 164 165", 21),
        ("not_a_molecule", None, None),
    ],
)

golden(
    "g_circular",
    "On-bits of circular fingerprints: published for aspirin, countable by hand where atoms are alike (one environment for each kind of atom and radius that covers new bonds).",
    {"name": "VARCHAR", "smiles": "VARCHAR"},
    {
        "on_bits": ("BIGINT", "bitmap_count(morgan_fp_bits(smiles))"), "on_bits_3_4096": ("BIGINT", "bitmap_count(morgan_fp_bits(smiles, 3, 4096))"),
        "bytes": ("INTEGER", "octet_length(morgan_fp_bits(smiles, 1, 100))"), "no_bits": ("INTEGER", "octet_length(morgan_fp_bits(smiles, 2, 0))"),
    },
    [
        ("aspirin", ASPIRIN, 26, 33, 13, None), ("methane", "C", 1, 1, 13, None), ("ethane", "CC", 2, 2, 13, None), ("ethanol", "CCO", 6, 6, 13, None), ("neopentane", "CC(C)(C)C", 4, 4, 13, None),
        ("benzene", "c1ccccc1", 3, 4, 13, None), ("no molecule", "bad", None, None, None, None),
    ],
)

golden(
    "g_similar",
    "Published similarities between circular fingerprints.",
    {"x": "VARCHAR", "y": "VARCHAR"},
    {"circular": ("DOUBLE", "round(tanimoto_bit(morgan_fp_bits(x), morgan_fp_bits(y)), 4)"), "even": ("BOOLEAN", "abs(tversky_bit(morgan_fp_bits(x), morgan_fp_bits(y), 1D, 1D) - tanimoto_bit(morgan_fp_bits(x), morgan_fp_bits(y))) < 1e-12")},
    [
        (ASPIRIN, ASPIRIN, 1.0, True), (SALICYLIC, ASPIRIN, 0.2162, True), (PARACETAMOL, ASPIRIN, 0.2162, True), ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", ASPIRIN, 0.102, True),
        ("C", ASPIRIN, 0.0, True), ("CCO", "CCN", 0.3333, True), ("bad", ASPIRIN, None, None),
    ],
)

# From the published keys: common ones over all of both.
golden(
    "g_similar_keys",
    "Similarities between structural keys, from the published keys.",
    {"x": "VARCHAR", "y": "VARCHAR"},
    {
        "tanimoto": ("DOUBLE", "round(tanimoto_bit(maccs_keys(x), maccs_keys(y)), 6)"), "dice": ("DOUBLE", "round(dice_bit(maccs_keys(x), maccs_keys(y)), 6)"),
        "russel": ("DOUBLE", "round(russel_bit(maccs_keys(x), maccs_keys(y)), 6)"), "asymmetric": ("DOUBLE", "round(asymmetric_bit(maccs_keys(x), maccs_keys(y)), 6)"),
    },
    [
        (ASPIRIN, ASPIRIN, 1.0, 1.0, round(21 / 168, 6), 1.0), (PARACETAMOL, ASPIRIN, round(13 / 31, 6), round(26 / 44, 6), round(13 / 168, 6), round(13 / 21, 6)),
        (CAFFEINE, ASPIRIN, round(14 / 53, 6), round(28 / 67, 6), round(14 / 168, 6), round(14 / 21, 6)), ("c1ccccc1", NAPHTHALENE, round(3 / 7, 6), 0.6, round(3 / 168, 6), 1.0),
        ("CCO", "[Na+].[Cl-]", 0.0, 0.0, 0.0, 0.0), ("bad", ASPIRIN, None, None, None, None),
    ],
)


def _match(n: int, spots: list[tuple[int, str]]) -> str:
    atoms = ",".join(f'{{"query_atom":{q},"target_atom":{t},"symbol":"{s}"}}' for q, (t, s) in enumerate(spots, 1))
    return f'{{"match":{n},"atom_indices":[{",".join(str(t) for t, _ in spots)}],"atoms":[{atoms}]}}'


golden(
    "g_patterns",
    "Patterns in molecules: whether, how often, and which atoms.",
    {"smiles": "VARCHAR", "pattern": "VARCHAR"},
    {"found": ("BOOLEAN", "mol_has_substructure(smiles, pattern)"), "n": ("INTEGER", "mol_substructure_count(smiles, pattern)"), "matches": ("VARCHAR", "mol_substructure_matches_json(smiles, pattern)")},
    [
        ("CC(=O)O", "C=O", True, 1, f"[{_match(1, [(2, 'C'), (3, 'O')])}]"),
        ("CCC", "[#6]~[#6]", True, 2, f"[{_match(1, [(1, 'C'), (2, 'C')])},{_match(2, [(2, 'C'), (3, 'C')])}]"),
        ("CCO", "N", False, 0, "[]"),
        ("OCCO", "[OX2H]", True, 2, f"[{_match(1, [(1, 'O')])},{_match(2, [(4, 'O')])}]"),
        ("C[N+](C)(C)C", "[N+]", True, 1, f"[{_match(1, [(2, 'N')])}]"),
        ("CC(=O)[O-].[Na+]", "[-]", True, 1, f"[{_match(1, [(4, 'O')])}]"),
        ("C1CC1C", "[R]", True, 3, f"[{_match(1, [(1, 'C')])},{_match(2, [(2, 'C')])},{_match(3, [(3, 'C')])}]"),
        ("C1CC1C", "[#6]!@[#6]", True, 1, f"[{_match(1, [(3, 'C'), (4, 'C')])}]"),
        ("CCN", "[$([#6]-[#7])]", True, 1, f"[{_match(1, [(2, 'C')])}]"),
        ("ClCCBr", "[F,Cl,Br,I]", True, 2, f"[{_match(1, [(1, 'Cl')])},{_match(2, [(4, 'Br')])}]"),
        ("[13CH4]", "[13C]", True, 1, f"[{_match(1, [(1, 'C')])}]"),
        ("F[C@H](Cl)Br", "[C@H]", True, 1, f"[{_match(1, [(2, 'C')])}]"),
        ("F[C@H](Cl)Br", "[C@@H]", False, 0, "[]"),
        ("C#N", "C#N", True, 1, f"[{_match(1, [(1, 'C'), (2, 'N')])}]"),
        ("CCN", "C.C", None, None, None),
        ("not_a_molecule", "C", None, None, None),
        ("C", None, None, None, None),
    ],
)

golden(
    "g_forms",
    "Fragments, charges and scaffolds of salts, acids and rings.",
    {"smiles": "VARCHAR"},
    {
        "largest": ("VARCHAR", "largest_fragment(smiles)"), "unsalted": ("VARCHAR", "strip_salts(smiles)"), "neutral": ("VARCHAR", "neutralize_charges(smiles)"),
        "parent": ("VARCHAR", "fragment_parent(smiles)"), "normal": ("VARCHAR", "normalize_smiles(smiles)"), "murcko": ("VARCHAR", "murcko_scaffold(smiles)"),
        "generic": ("VARCHAR", "generic_scaffold(smiles)"), "same_as_kekule": ("BOOLEAN", "canonical_smiles(smiles) = canonical_smiles('C1=CC=CC=C1')"),
    },
    [
        ("CC(=O)[O-].[Na+]", "C(C)(=O)[O-]", "C(C)(=O)[O-]", "C(C)(=O)O.[Na+]", "C(C)(=O)O", "C(C)(=O)O.[Na+]", "", "", False),
        ("CCO.CN.[Cl-]", "C(C)O", "C(C)O.CN", "C(C)O.CN.[Cl-]", "C(C)O", "C(C)O.CN.[Cl-]", "", "", False),
        ("C[NH3+].[Cl-]", "C[NH3+]", "C[NH3+]", "CN.[Cl-]", "CN", "CN.[Cl-]", "", "", False),
        ("C1=CC=CC=C1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "C1CCCCC1", True),
        ("c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "c1ccccc1", "C1CCCCC1", True),
        ("c1ccccn1", "c1ccccn1", "c1ccccn1", "c1ccccn1", "c1ccccn1", "c1ccccn1", "c1ccccn1", "C1CCCCC1", False),
        ("[Na+].[Cl-]", "[Cl-]", "[Cl-]", "[Cl-].[Na+]", "[Cl-]", "[Cl-].[Na+]", "", "", False),
        ("not_a_molecule", None, None, None, None, None, None, None, None),
    ],
)

golden(
    "g_hashes",
    "All hash methods by name.",
    {"smiles": "VARCHAR", "method": "VARCHAR"},
    {"hash": ("VARCHAR", "mol_hash(smiles, method)"), "listed": ("BOOLEAN", "array_contains(from_json(mol_hash_methods(), 'array<string>'), method)")},
    [
        ("CC(=O)[O-].[Na+]", "canonical_smiles", "C(C)(=O)[O-].[Na+]", True), ("CC(=O)[O-].[Na+]", "formula", "C2H3NaO2", True), ("CC(=O)[O-].[Na+]", "net_charge", "0", True),
        ("CC(=O)[O-]", "net_charge", "-1", True), ("CC(=O)[O-].[Na+]", "degree_vector", "0,1,1,1,3", True), ("CC(=O)[O-].[Na+]", "atom_bond_counts", "5:3", True),
        ("CC(=O)[O-].[Na+]", "element_graph", "C(C)(O)O.[Na]", True), ("CC(=O)[O-].[Na+]", "bond_order_graph", "C(C)(=O)O.[Na]", True),
        ("CC(=O)[O-].[Na+]", "anonymous_graph", "C.C(C)(C)C", True), ("Cc1ccccc1", "murcko_scaffold", "c1ccccc1", True), ("Cc1ccccn1", "generic_scaffold", "C1CCCCC1", True),
        ("CCO", "does_not_exist", None, False), ("bad(", "formula", None, True),
    ],
)


def _mapped(n: int, bonds: int, smarts: str, a: list[int], b: list[int]) -> str:
    listed = lambda x: ",".join(map(str, x))
    pairs = ",".join(f'{{"a":{i},"b":{j}}}' for i, j in zip(a, b, strict=True))
    return f'{{"num_atoms":{n},"num_bonds":{bonds},"smarts":"{smarts}","atoms_a":[{listed(a)}],"atoms_b":[{listed(b)}],"atom_pairs":[{pairs}]}}'


golden(
    "g_common",
    "Common substructures.",
    {"x": "VARCHAR", "y": "VARCHAR"},
    {"smarts": ("VARCHAR", "mcs_smarts(x, y)"), "mapped": ("VARCHAR", "mcs_json(x, y)")},
    [
        ("CC(=O)O", "CC(=O)N", "C(C)=O", _mapped(3, 2, "C(C)=O", [1, 2, 3], [1, 2, 3])),
        ("CCO", "CCO", "C(C)O", _mapped(3, 2, "C(C)O", [1, 2, 3], [1, 2, 3])),
        ("CO", "CN", "C", _mapped(1, 0, "C", [1], [1])),
        ("c1ccccc1", "Cc1ccccc1", "c1ccccc1", _mapped(6, 6, "c1ccccc1", [1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 7])),
        ("C", "bad", None, None),
        (None, "C", None, None),
    ],
)


def _ring(index: int, atoms: list[int], bonds: list[int]) -> str:
    listed = lambda x: ",".join(map(str, x))
    return f'{{"index":{index},"size":{len(atoms)},"aromatic":true,"atoms":[{listed(atoms)}],"bonds":[{listed(bonds)}]}}'


def _system(index: int, atoms: list[int], bonds: list[int], rings: list[str]) -> str:
    listed = lambda x: ",".join(map(str, x))
    return f'{{"index":{index},"num_atoms":{len(atoms)},"num_bonds":{len(bonds)},"num_rings":{len(rings)},"aromatic":true,"atoms":[{listed(atoms)}],"bonds":[{listed(bonds)}],"rings":[{",".join(rings)}]}}'


_ALL = lambda a, b: list(range(a, b + 1))

golden(
    "g_rings",
    "Ring systems, scaffold networks and explicit hydrogens as texts.",
    {"smiles": "VARCHAR"},
    {
        "systems": ("VARCHAR", "ring_systems_json(smiles)"), "nodes": ("VARCHAR", "get_json_object(scaffold_network_json(smiles), '$.nodes[*].kind')"),
        "murcko": ("BOOLEAN", "scaffold_network_json(smiles) LIKE '%\"kind\":\"murcko_scaffold\",\"smiles\":\"c1ccccc1\"%'"),
        "hydrogens": ("INTEGER", "size(split(add_hydrogens(smiles), '\\\\[H\\\\]')) - 1"), "again": ("VARCHAR", "mol_formula(add_hydrogens(add_hydrogens(smiles)))"),
    },
    [
        ("c1ccccc1", f"[{_system(1, _ALL(1, 6), _ALL(1, 6), [_ring(1, _ALL(1, 6), _ALL(1, 6))])}]", '["generic_scaffold","molecule","murcko_scaffold","ring_system"]', True, 6, "C6H6"),
        ("Cc1ccccc1", f"[{_system(1, _ALL(2, 7), _ALL(2, 7), [_ring(1, _ALL(2, 7), _ALL(2, 7))])}]", '["generic_scaffold","molecule","murcko_scaffold","ring_system"]', True, 8, "C7H8"),
        (NAPHTHALENE, f"[{_system(1, _ALL(1, 10), _ALL(1, 11), [_ring(1, [1, 2, 3, 4, 9, 10], [1, 2, 3, 9, 10, 11]), _ring(2, _ALL(4, 9), _ALL(4, 9))])}]",
         '["generic_scaffold","molecule","murcko_scaffold","ring_system"]', False, 8, "C10H8"),
        ("c1ccccc1.c1ccccc1", f"[{_system(1, _ALL(1, 6), _ALL(1, 6), [_ring(1, _ALL(1, 6), _ALL(1, 6))])},{_system(2, _ALL(7, 12), _ALL(7, 12), [_ring(2, _ALL(7, 12), _ALL(7, 12))])}]",
         '["generic_scaffold","molecule","murcko_scaffold","ring_system"]', False, 12, "C12H12"),
        ("CCO", "[]", '"molecule"', False, 6, "C2H6O"), ("C", "[]", '"molecule"', False, 4, "CH4"), ("O", "[]", '"molecule"', False, 2, "H2O"), ("", None, None, None, None, None),
    ],
)

golden(
    "g_hydrogens",
    "Explicit hydrogens as published.",
    {"smiles": "VARCHAR"},
    {"written_out": ("VARCHAR", "add_hydrogens(smiles)"), "valid": ("BOOLEAN", "mol_is_valid(add_hydrogens(smiles))")},
    [("C", "[C]([H])([H])([H])[H]", True), ("O", "[O]([H])[H]", True), ("CCO", "[C]([C]([O][H])([H])[H])([H])([H])[H]", True), ("not_a_molecule", None, None)],
)

_LONG = "C" * 36
golden(
    "g_rules",
    "Rule panels, alerts and the report of well-known molecules.",
    {"name": "VARCHAR", "smiles": "VARCHAR"},
    {
        "violations": ("INTEGER", "lipinski_violations(smiles)"), **{r: ("INTEGER", f"druglikeness_pass(smiles, '{r}')") for r in ("lipinski", "veber", "ghose", "egan", "muegge", "lead")},
        "unknown": ("INTEGER", "druglikeness_pass(smiles, 'nothing')"), "alerts": ("VARCHAR", "structural_alerts_json(smiles)"), "n_alerts": ("INTEGER", "structural_alert_count(smiles)"),
        "report_mw": ("VARCHAR", "get_json_object(admet_json(smiles), '$.descriptors.mw')"), "report_ghose": ("VARCHAR", "get_json_object(admet_json(smiles), '$.rules.Ghose.failures')"),
        "report_alerts": ("VARCHAR", "get_json_object(admet_json(smiles), '$.alerts')"),
    },
    [
        ("aspirin", ASPIRIN, 0, 1, 1, 1, 1, 0, 1, -2, "[]", 0, "180.159", "[]", '{"n":0,"hits":[]}'),
        ("caffeine", CAFFEINE, 0, 1, 1, 0, 1, 0, 1, -2, "[]", 0, "194.194", '["cLogP -1.03 outside -0.4..5.6"]', '{"n":0,"hits":[]}'),
        ("long alkane", _LONG, 2, 0, 0, 0, 0, 0, 0, -2, "[]", 0, "506.988", '["MW 507.0 outside 160-480","cLogP 14.29 outside -0.4..5.6","MR 168.3 outside 40-130","atoms 110 outside 20-70"]', '{"n":0,"hits":[]}'),
        ("methane", "C", 0, 1, 1, 0, 1, 0, 1, -2, "[]", 0, "16.043", '["MW 16.0 outside 160-480","MR 6.7 outside 40-130","atoms 5 outside 20-70"]', '{"n":0,"hits":[]}'),
        ("benzaldehyde", "O=Cc1ccccc1", 0, 1, 1, 0, 1, 0, 1, -2, '["aldehyde","aldehyde_any"]', 2, "106.124", '["MW 106.1 outside 160-480","MR 31.8 outside 40-130","atoms 14 outside 20-70"]', '{"n":2,"hits":["aldehyde","aldehyde_any"]}'),
        ("oxirane", "C1OC1", 0, 1, 1, 0, 1, 0, 1, -2, '["epoxide"]', 1, "44.053", '["MW 44.1 outside 160-480","MR 10.8 outside 40-130","atoms 7 outside 20-70"]', '{"n":1,"hits":["epoxide"]}'),
        ("nitrobenzene", "c1ccccc1N(=O)=O", 0, 1, 1, 0, 1, 0, 1, -2, '["nitro","nitro_aromatic"]', 2, "123.111", '["MW 123.1 outside 160-480","MR 35.3 outside 40-130","atoms 14 outside 20-70"]', '{"n":2,"hits":["nitro","nitro_aromatic"]}'),
        ("no molecule", "bad(", None, -1, -1, -1, -1, -1, -1, -1, None, None, None, None, None),
    ],
)

_ACETIC, _ETHANOL = "InChI=1S/C2H4O2/c1-2(3)4/h1H3,(H,3,4)", "InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3"
golden(
    "g_skeletons",
    "Skeletons of two identifiers compared: formula, connections and hydrogens count, further layers don't.",
    {"x": "VARCHAR", "y": "VARCHAR"},
    {"same": ("BOOLEAN", "inchi_skeleton_match(x, y)"), "standard": ("BOOLEAN", "inchi_is_standard(y)"), "version": ("VARCHAR", "inchi_version(y)")},
    [
        (_ETHANOL, _ETHANOL, True, True, "1S"), (_ACETIC, f"{_ACETIC}/t1-", True, True, "1S"), (_ACETIC, _ETHANOL, False, True, "1S"), (_ACETIC, _ACETIC.replace("1S", "1"), True, False, "1"),
        (_ACETIC, "bad", None, False, None), (None, _ACETIC, None, True, "1S"),
    ],
)

golden(
    "g_tokens",
    "Tokens of molecules and back, and which texts are tokens at all.",
    {"text": "VARCHAR"},
    {"tokens": ("VARCHAR", "smiles_to_selfies(text)"), "back": ("VARCHAR", "selfies_to_smiles(smiles_to_selfies(text))"), "is_tokens": ("BOOLEAN", "selfies_is_valid(text)"), "read": ("VARCHAR", "selfies_to_smiles(text)")},
    [
        ("C", "[C]", "C", False, None), ("C=O", "[C][=O]", "C=O", False, None), ("CC(C)O", "[C][C][Branch1][C][C][O]", "CC(C)O", False, None), ("", None, None, False, None),
        (None, None, None, None, None),
    ],
)

golden(
    "g_token_texts",
    "Token texts read.",
    {"tokens": "VARCHAR"},
    {"valid": ("BOOLEAN", "selfies_is_valid(tokens)"), "smiles": ("VARCHAR", "selfies_to_smiles(tokens)")},
    [("[C][=O]", True, "C=O"), ("[C][nop][Na+]", True, "C[Na+]"), ("[C]", True, "C"), ("[F][C]", True, "FC"), ("CC", False, None), ("", False, None), (None, None, None)],
)

# A ranking of ten with two actives at the top: the best fifth holds all actives, five times their share. An active on the first place is found early whatever follows.
golden(
    "g_metrics",
    "Screening metrics over lists.",
    {"name": "VARCHAR", "scores": "VARCHAR", "labels": "VARCHAR"},
    {
        "auc": ("DOUBLE", "nanvl(roc_auc(from_json(scores, 'array<double>'), from_json(labels, 'array<boolean>')), -1D)"),
        "enrichment": ("DOUBLE", "round(nanvl(enrichment_factor(from_json(scores, 'array<double>'), from_json(labels, 'array<boolean>'), 0.2D), -1D), 6)"),
        "early": ("BOOLEAN", "nanvl(bedroc(from_json(scores, 'array<double>'), from_json(labels, 'array<boolean>'), 20D), -1D) > 0.9"),
    },
    [
        ("perfect", "[-10,-9,-1,-2,-3,-4,-5,-6,-7,-8]", "[true,true,false,false,false,false,false,false,false,false]", 1.0, 5.0, True),
        ("worst", "[10,9,1,2,3,4,5,6,7,8]", "[true,true,false,false,false,false,false,false,false,false]", 0.0, 0.0, False),
        ("tied", "[1,1]", "[true,false]", 0.5, 2.0, True), ("half", "[1,2,3,4]", "[true,false,true,false]", 0.75, 2.0, True),
        ("one class", "[-1,-2]", "[true,true]", -1.0, 1.0, False), ("none active", "[1,2]", "[false,false]", -1.0, -1.0, False),
        ("uneven", "[1]", "[true,false]", None, None, None), ("null inside", "[1,null]", "[true,false]", None, None, None), ("empty", "[]", "[]", None, None, None),
    ],
)

# --- docking: what the texts hold can be counted by hand ---------------------------------------------------------------------------------------------------

_LINES = "size(filter(split({t}, '\\\\n'), l -> l LIKE '{p}'))"


def _lines(text: str, like: str) -> str:
    return _LINES.format(t=text, p=like)


golden(
    "g_ligands",
    "PDBQT texts of ligands: atoms with all hydrogens, those on N and O as donors, aromatic carbons, acceptors.",
    {"smiles": "VARCHAR"},
    {
        "atoms": ("INTEGER", _lines("smiles_to_pdbqt(smiles, 1L)", "ATOM%")), "donors": ("INTEGER", _lines("smiles_to_pdbqt(smiles, 1L)", "ATOM% HD")),
        "aromatic": ("INTEGER", _lines("smiles_to_pdbqt(smiles, 1L)", "ATOM% A")), "oxygens": ("INTEGER", _lines("smiles_to_pdbqt(smiles, 1L)", "ATOM% OA")),
        "root": ("BOOLEAN", "smiles_to_pdbqt(smiles, 1L) LIKE '%ROOT%ENDROOT%TORSDOF%'"), "again": ("BOOLEAN", "smiles_to_pdbqt(smiles, 1L) = smiles_to_pdbqt(smiles, 1L)"),
    },
    [
        ("C", 5, 0, 0, 0, True, True), ("O", 3, 2, 0, 1, True, True), ("CCO", 9, 1, 0, 1, True, True), ("c1ccccc1", 12, 0, 6, 0, True, True), ("CN", 7, 2, 0, 0, True, True),
        ("CC(=O)O", 8, 1, 0, 2, True, True), ("not-a-smiles", None, None, None, None, None, None), ("[Na+]", None, None, None, None, None, None),
    ],
)


def _residue(name: str, number: int, atoms: list[tuple[str, float, float, float]]) -> str:
    return "\n".join(f"ATOM  {i:>5}  {n:<3} {name} A{number:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {n[0]}" for i, (n, x, y, z) in enumerate(atoms, 1))


_BACKBONE = [("N", 0.0, 0.0, 0.0), ("CA", 1.46, 0.0, 0.0), ("C", 2.0, 1.42, 0.0), ("O", 1.3, 2.4, 0.0)]
_ALANINE = _residue("ALA", 1, [*_BACKBONE, ("CB", 2.0, -0.8, 1.2)])
_SERINE = _residue("SER", 1, [*_BACKBONE, ("CB", 2.0, -0.8, 1.2), ("OG", 1.5, -2.1, 1.2)])

golden(
    "g_receptors",
    "PDBQT texts of receptors: the plain one has the atoms given, the prepared one also the hydrogens of the chain's N and of a serine's O.",
    {"name": "VARCHAR", "pdb": "VARCHAR"},
    {
        "atoms": ("INTEGER", _lines("pdb_to_pdbqt(pdb)", "ATOM%")), "nitrogens": ("INTEGER", _lines("pdb_to_pdbqt(pdb)", "ATOM% NS")), "oxygens": ("INTEGER", _lines("pdb_to_pdbqt(pdb)", "ATOM% OA")),
        "prepared": ("INTEGER", _lines("prepare_receptor(pdb, 7.4D)", "ATOM%")), "donors": ("INTEGER", _lines("prepare_receptor(pdb, 7.4D)", "ATOM% HD")),
    },
    [("alanine", _ALANINE, 5, 1, 1, 6, 1), ("serine", _SERINE, 6, 1, 2, 8, 2), ("null", None, None, None, None, None, None)],
)

_DOCK = "dock(smiles, '" + _SERINE + "', 2D, 0D, 3D, 6D, 6D, 6D, runs, 7L{ph})"
golden(
    "g_docking",
    "Docking with and without a pH: as many poses as runs, best first, every atom placed, a small molecule attracted.",
    {"smiles": "VARCHAR", "runs": "INTEGER"},
    {
        "poses": ("INTEGER", f"cast(get_json_object({_DOCK.format(ph='')}, '$.n') AS INT)"),
        "sorted": ("BOOLEAN", f"transform(array(from_json({_DOCK.format(ph='')}, 'results array<struct<score: double, x: array<double>>>').results.score), s -> s = array_sort(s))[0]"),
        "atoms": ("INTEGER", f"size(from_json({_DOCK.format(ph=', 7.4D')}, 'results array<struct<score: double, x: array<double>>>').results[0].x)"),
        "attracted": ("BOOLEAN", f"from_json({_DOCK.format(ph=', 7.4D')}, 'results array<struct<score: double>>').results[0].score < 0"),
        "same": ("BOOLEAN", f"{_DOCK.format(ph='')} = {_DOCK.format(ph=', 7.4D')}"),
    },
    [
        ("CCO", 1, 1, True, 9, True, True), ("CCO", 3, 3, True, 9, True, True), ("c1ccccc1", 2, 2, True, 12, True, True), ("CO", 12, 9, True, 6, True, True),
        ("bad(", 2, None, None, None, None, None), ("CCO", None, None, None, None, None, None),
    ],
)

# --- workflows over well-known molecules -------------------------------------------------------------------------------------------------------------------


def workflow(name: str, doc: str, inputs: dict[str, str], rows: list[tuple], make, outputs: dict[str, str], answers: list[tuple]) -> None:
    """Register a query that applies a DataFrame operator to a ``VALUES`` relation; the SQL is the list of answers."""
    listed = lambda part: ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in part)
    quoted = [f'"{n}"' for n in outputs]
    SQL[name] = f"SELECT {', '.join(f'CAST({q} AS {t}) AS {q}' for q, t in zip(quoted, outputs.values(), strict=True))} FROM (VALUES {listed(answers)}) AS v({', '.join(quoted)})"
    cast = ", ".join(f"CAST({n} AS {_SPARK_TYPES.get(t, t)}) AS {n}" for n, t in inputs.items())
    text = f"SELECT {cast} FROM VALUES {listed(rows)} AS v({', '.join(inputs)})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return make(spark.sql(text)).select(*outputs)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


_KNOWN = [(1, ASPIRIN), (2, SALICYLIC), (3, PARACETAMOL), (4, "Cn1c(=O)c2c(ncn2C)n(C)c1=O"), (5, "C"), (6, "bad("), (7, None)]
_IDS = {"mol_id": "BIGINT", "smiles": "VARCHAR"}
_SIM = {"mol_id": "BIGINT", "sim": "DOUBLE"}

workflow(
    "gw_rank", "W3: published ranking by circular fingerprints; equal ones by number.", _IDS, _KNOWN,
    lambda df: workflows.rank_similar(workflows.fingerprints(df, "smiles"), ASPIRIN, 5).withColumn("sim", F.round("sim", 4)), _SIM,
    [(1, 1.0), (2, 0.2162), (3, 0.2162), (4, 0.102), (5, 0.0)],
)
workflow(
    "gw_rank_keys", "W5: ranking by structural keys, from the published keys.", _IDS, [(1, ASPIRIN), (2, PARACETAMOL), (3, CAFFEINE), (4, NAPHTHALENE), (5, "CCO"), (6, "bad(")],
    lambda df: workflows.rank_similar(workflows.fingerprints(df, "smiles", "maccs_keys"), ASPIRIN, 4, field="maccs_keys").withColumn("sim", F.round("sim", 6)), _SIM,
    [(1, 1.0), (2, round(13 / 31, 6)), (3, round(14 / 53, 6)), (5, round(4 / 26, 6))],
)
workflow(
    "gw_measures", "W4: other measures from the published keys.", _IDS, [(1, ASPIRIN), (2, PARACETAMOL), (3, "c1ccccc1")],
    lambda df: workflows.rank_similar(workflows.fingerprints(df, "smiles", "maccs_keys"), ASPIRIN, measure="dice_bit", field="maccs_keys").withColumn("sim", F.round("sim", 6)), _SIM,
    [(1, 1.0), (2, round(26 / 44, 6)), (3, 0.25)],
)
workflow(
    "gw_threshold", "Pairs of one molecule's family by structural keys, and what isn't similar enough.", _IDS, [(1, ASPIRIN), (2, PARACETAMOL), (3, "c1ccccc1"), (4, NAPHTHALENE), (5, "C1=CC=CC=C1"), (6, None)],
    lambda df: workflows.threshold_join(workflows.fingerprints(df, "smiles", "maccs_keys"), 0.41).withColumn("sim", F.round("sim", 6)), {"a": "BIGINT", "b": "BIGINT", "sim": "DOUBLE"},
    [(1, 2, round(13 / 31, 6)), (3, 4, round(3 / 7, 6))],
)
workflow(
    "gw_parents", "W6: records by salt-free parent.", _IDS, [(1, "CC(=O)[O-].[Na+]"), (2, "CC(=O)O"), (3, "[Na+].CC(=O)[O-]"), (4, "C[NH3+].[Cl-]"), (5, "CN"), (6, "CCO.CN.[Cl-]"), (7, "bad("), (8, None)],
    lambda df: workflows.parents(df, "smiles", "mol_id"), {"parent": "VARCHAR", "n": "BIGINT", "keep_id": "BIGINT"},
    [("C(C)(=O)O", 3, 1), ("CN", 2, 4), ("C(C)O", 1, 6)],
)
workflow(
    "gw_scaffolds", "W7: records by scaffold, with sums.", _IDS, [(1, "Cc1ccccc1"), (2, "c1ccccc1O"), (3, "c1ccccn1"), (4, "CCC"), (5, "C1CC1"), (6, "bad("), (7, None)],
    lambda df: workflows.scaffold_rollup(df, "smiles"), {"generic_scaffold": "VARCHAR", "murcko_scaffold": "VARCHAR", "n": "BIGINT", "level": "BIGINT"},
    [(None, None, 5, 3), ("C1CCCCC1", None, 3, 1), ("C1CCCCC1", "c1ccccc1", 2, 0), ("C1CCCCC1", "c1ccccn1", 1, 0), ("", None, 1, 1), ("", "", 1, 0), ("C1CC1", None, 1, 1), ("C1CC1", "C1CC1", 1, 0)],
)
workflow(
    "gw_screen", "W8: named patterns with their numbers of matches.", _IDS, [(1, ASPIRIN), (2, "OCCO"), (3, "CC#N"), (4, "C"), (5, "bad("), (6, None)],
    lambda df: workflows.screen(df, "smiles", {"acid": "C(=O)[OX2H1]", "hydroxyl": "[OX2H]", "nitrile": "C#N", "ring": "[R]"}).withColumn("hits", F.array_join(F.array_sort(F.transform(F.map_entries("hits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), " ")),
    {"mol_id": "BIGINT", "hits": "VARCHAR"},
    [(1, "acid=1 hydroxyl=1 ring=6"), (2, "hydroxyl=2"), (3, "nitrile=1"), (4, ""), (5, ""), (6, "")],
)
workflow(
    "gw_polymers", "W2: open ends rewritten to hydrogen.", _IDS, [(1, "*CC*"), (2, "*CC(*)c1ccccc1"), (3, "*"), (4, None)],
    lambda df: M.profile(df.withColumn("smiles", F.replace("smiles", F.lit("*"), F.lit("[H]"))), "smiles", ["mol_formula", "mol_weight"]).withColumn("mol_weight", F.round("mol_weight", 3)),
    {"mol_id": "BIGINT", "mol_formula": "VARCHAR", "mol_weight": "DOUBLE"},
    [(1, "C2H6", 30.07), (2, "C8H10", 106.168), (3, "H", 1.008), (4, None, None)],
)
workflow(
    "gw_rules", "W9: rule panels natively over one descriptor pass.", _IDS, [(1, ASPIRIN), (2, CAFFEINE), (3, _LONG), (4, "C"), (5, "bad(")],
    lambda df: (lambda rows: rows.select("mol_id", rules.violations("Lipinski").alias("lipinski_violations"), *[rules.druglikeness_pass(F.lit(r), F.col("valid")).alias(r) for r in ("lipinski", "ghose", "muegge")]))(M.profile(df, "smiles", rules.fields())),
    {"mol_id": "BIGINT", "lipinski_violations": "INTEGER", "lipinski": "INTEGER", "ghose": "INTEGER", "muegge": "INTEGER"},
    [(1, 0, 1, 1, 0), (2, 0, 1, 0, 0), (3, 2, 0, 0, 0), (4, 0, 1, 0, 0), (5, None, -1, -1, -1)],
)
