"""PDB, mmCIF and XYZ texts as atom rows."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from retort.kernel.blocks import _NUMBER, lines_of

_INT = re.compile(r"[+-]?[0-9]+")


class Site(NamedTuple):
    model: int
    chain: str
    resid: int
    resname: str
    atom_name: str
    altloc: str
    x: np.float32
    y: np.float32
    z: np.float32
    occupancy: np.float32
    b_factor: np.float32
    element: str
    is_hetatm: bool


def _int(text: str, default: int) -> int:
    t = text.strip()
    return int(t) if _INT.fullmatch(t) and -(1 << 31) <= int(t) < 1 << 31 else default


def _real(text: str, default: float = 0.0) -> np.float32:
    t = text.strip()
    return np.float32(t if _NUMBER.fullmatch(t) else default)


def read_pdb(text: str) -> list[Site]:
    """Fixed columns of ATOM and HETATM records of at least 54 characters; MODEL records number what follows."""
    out, model = [], 1
    for r in lines_of(text):
        if r.startswith("MODEL"):
            model = _int(r[6:], model)
        elif r.startswith(("ATOM", "HETATM")) and len(r.encode()) >= 54:
            cut = lambda a, b, r=r: r[a:b].strip()
            out.append(
                Site(model, cut(21, 22), _int(r[22:26], 0), cut(17, 20), cut(12, 16), r[16:17] or " ", _real(r[30:38]), _real(r[38:46]), _real(r[46:54]),
                     _real(r[54:60], 1.0), _real(r[60:66]), cut(76, 78), r.startswith("HETATM"))
            )
    return out


# Columns of the atom loop, label names before author names.
CIF_COLUMNS = {
    "group": ("group_PDB",), "atom_name": ("label_atom_id", "auth_atom_id"), "resname": ("label_comp_id", "auth_comp_id"),
    "chain": ("label_asym_id", "auth_asym_id"), "resid": ("label_seq_id", "auth_seq_id"), "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",),
    "occupancy": ("occupancy",), "b_factor": ("B_iso_or_equiv",), "element": ("type_symbol",), "model": ("pdbx_PDB_model_num",),
}
_CIF_FIELD = re.compile(r"'((?:[^']|'(?=\S))*)(?:'|\Z)|(\S+)")


def read_cif(text: str) -> list[Site]:
    """Rows of every loop of ``_atom_site`` columns; a loop ends at an empty line, a comment, a tag or the next loop."""
    out: list[Site] = []
    columns: list[str] | None = None
    state = ""
    for raw in lines_of(text):
        row = raw.strip()
        if state == "rows" and (not row or row.startswith(("#", "loop_", "_"))):
            state = ""
        if state == "tags" and not row.startswith("_atom_site."):
            state = "rows" if columns else ""
            if state and (not row or row.startswith(("#", "loop_", "_"))):
                state = ""
        if row == "loop_":
            state, columns = "tags", []
        elif state == "tags":
            columns.append(row[len("_atom_site.") :])
        elif state == "rows":
            values = [q if q or w is None else w for q, w in ((m[1], m[2]) for m in _CIF_FIELD.finditer(row))]
            values = [v or "" for v in values]
            if len(values) < len(columns):
                continue
            at = {k: next((columns.index(n) for n in names if n in columns), None) for k, names in CIF_COLUMNS.items()}
            get = lambda k, default="": default if at[k] is None else values[at[k]]  # noqa: E731, B023
            out.append(
                Site(_int(get("model"), 1), get("chain"), _int(get("resid"), 0), get("resname"), get("atom_name"), " ", _real(get("x")), _real(get("y")),
                     _real(get("z")), _real(get("occupancy"), 1.0), _real(get("b_factor")), get("element"), get("group", "ATOM") == "HETATM")
            )
    return out


def read_xyz(text: str) -> list[Site]:
    """Frames of a count line, a comment line and that many atom lines; lines that should be a count and aren't are skipped."""
    out, rows, at, frame = [], lines_of(text), 0, 1
    while at < len(rows):
        count = rows[at].strip()
        at += 1
        if not re.fullmatch(r"\+?[0-9]+", count):
            continue
        if at >= len(rows):
            break
        for row in rows[at + 1 : at + 1 + int(count)]:
            parts = row.split()
            if len(parts) >= 4:
                out.append(Site(frame, "", 0, "", parts[0], " ", _real(parts[1]), _real(parts[2]), _real(parts[3]), np.float32(1), np.float32(0), parts[0], False))
        at += 1 + int(count)
        frame += 1
    return out


def read_structure(text: str | None) -> list[Site] | None:
    """Atoms of a structure text whose format is recognised by its look; None for null and empty texts."""
    if not text:
        return None
    if text.startswith("data_") or "_atom_site." in text:
        return read_cif(text)
    first = lines_of(text)[:1]
    return read_xyz(text) if first and re.fullmatch(r"\+?[0-9]+", first[0].strip()) else read_pdb(text)
