"""Drug-likeness rules and the report that holds them, as text."""

from __future__ import annotations

from retort.kernel import descriptors as D
from retort.kernel.jsontext import dumps
from retort.kernel.mol import Molecule

# Rules as (what, least, most, words); None is no limit. A value within [least, most] is fine. The first number of decimals is for the words.
RULES = {
    "Lipinski": [("mw", None, 500, "MW {:.1f} > 500"), ("logp", None, 5, "cLogP {:.2f} > 5"), ("hbd", None, 5, "HBD {} > 5"), ("hba", None, 10, "HBA {} > 10")],
    "Veber": [("rotb", None, 10, "RotB {} > 10"), ("tpsa", None, 140, "TPSA {:.1f} > 140")],
    "Ghose": [
        ("mw", 160, 480, "MW {:.1f} outside 160-480"), ("logp", -0.4, 5.6, "cLogP {:.2f} outside -0.4..5.6"), ("mr", 40, 130, "MR {:.1f} outside 40-130"),
        ("total_atoms", 20, 70, "atoms {} outside 20-70"),
    ],
    "Egan": [("tpsa", None, 131.6, "TPSA {:.1f} > 131.6"), ("logp", None, 5.88, "cLogP {:.2f} > 5.88")],
    "Muegge": [
        ("mw", 200, 600, "MW {:.1f} outside 200-600"), ("logp", -2, 5, "cLogP {:.2f} outside -2..5"), ("tpsa", None, 150, "TPSA {:.1f} > 150"),
        ("rings", None, 7, "rings {} > 7"), ("carbons", 5, None, "carbons {} <= 4"), ("heteroatoms", 2, None, "heteroatoms {} <= 1"),
        ("rotb", None, 15, "RotB {} > 15"), ("hba", None, 10, "HBA {} > 10"), ("hbd", None, 5, "HBD {} > 5"),
    ],
    "Lead-likeness": [("mw", None, 350, "MW {:.1f} > 350"), ("logp", None, 3.5, "cLogP {:.2f} > 3.5"), ("rotb", None, 7, "RotB {} > 7")],
}
# Fixed value: broken limits a rule forgives.
FORGIVES = {"Lipinski": 1}
# Names by which a rule is asked for, in lower case.
RULE_NAMES = {name.lower(): name for name in RULES} | {"lead": "Lead-likeness", "lead_likeness": "Lead-likeness"}


def descriptors(mol: Molecule) -> dict[str, float | int]:
    return {
        "mw": D.weight(mol), "logp": D.logp(mol), "tpsa": D.polar_surface(mol), "hbd": D.donors(mol), "hba": D.acceptors(mol), "rotb": D.rotatable_bonds(mol),
        "mr": D.molar_refractivity(mol), "heavy_atoms": D.heavy_atoms(mol), "total_atoms": D.total_atoms(mol), "carbons": mol.sym.count("C"),
        "heteroatoms": D.heteroatoms(mol), "rings": len(mol.rings), "aromatic_rings": sum(r[0] for r in D.ring_classes(mol)), "fraction_csp3": D.fraction_csp3(mol),
    }


def broken(values: dict, rule: str) -> list[str]:
    """The words for each limit of a rule that the values break."""
    return [words.format(values[k]) for k, low, high, words in RULES[rule] if not ((low is None or values[k] >= low) and (high is None or values[k] <= high))]


# Decimals of the report's numbers.
_DECIMALS = {"mw": 3, "logp": 3, "tpsa": 3, "mr": 3, "fraction_csp3": 4}


def admet_json(mol: Molecule) -> str:
    """Descriptors, rules and alerts as JSON with fixed decimals."""
    values, alerts = descriptors(mol), D.alerts(mol)
    numbers = ",".join(f'"{k}":{v:.{_DECIMALS[k]}f}' if k in _DECIMALS else f'"{k}":{v}' for k, v in values.items())
    rules = {}
    for rule in RULES:
        failures = broken(values, rule)
        rules[rule] = {"pass": len(failures) <= FORGIVES.get(rule, 0), "violations": len(failures), "failures": failures}
    return f'{{"descriptors":{{{numbers}}},"rules":{dumps(rules)},"alerts":{dumps({"n": len(alerts), "hits": alerts})}}}'
