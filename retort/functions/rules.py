"""Drug-likeness rules as native expressions over descriptor columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.kernel.report import FORGIVES, RULE_NAMES, RULES

#: Descriptor names of the rules and the profile fields that hold them.
INPUTS = {
    "mw": "mol_weight", "logp": "logp_crippen", "tpsa": "tpsa", "hbd": "num_h_donors", "hba": "num_h_acceptors", "rotb": "num_rotatable_bonds", "mr": "mol_mr",
    "total_atoms": "total_atoms", "carbons": "num_carbons", "heteroatoms": "num_heteroatoms", "rings": "ring_count",
}


def fields(*rules: str) -> list[str]:
    """Profile fields that rules (all, if none is named) need."""
    return list(dict.fromkeys(INPUTS[k] for r in rules or RULES for k, *_ in RULES[r]))


def violations(rule: str, columns: dict[str, Column] | None = None) -> Column:
    """Number of a rule's limits that the descriptor columns break; null where a descriptor is null."""
    total = F.lit(0)
    for k, low, high, _ in RULES[rule]:
        c = (columns or {}).get(k, F.col(INPUTS[k]))
        fine = F.lit(True)
        if low is not None:
            fine = fine & (c >= low)
        if high is not None:
            fine = fine & (c <= high)
        total = total + F.when(c.isNull(), F.lit(None).cast("int")).when(fine, 0).otherwise(1)
    return total


def passes(rule: str, columns: dict[str, Column] | None = None) -> Column:
    return violations(rule, columns) <= FORGIVES.get(rule, 0)


def druglikeness_pass(rule: Column, valid: Column, columns: dict[str, Column] | None = None) -> Column:
    """1 or 0 by the rule a text column names in any case, -1 where the molecule isn't valid, -2 for an unknown rule; null for a null molecule or rule."""
    out = F.when(valid.isNull() | rule.isNull(), F.lit(None).cast("int")).when(~valid, -1)
    for alias, name in RULE_NAMES.items():
        out = out.when(F.lower(rule) == alias, passes(name, columns).cast("int"))
    return out.otherwise(-2)
