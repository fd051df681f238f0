"""MOL and SDF texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from retort.kernel.elements import BLOCK_WEIGHT, hill
from retort.kernel.jsontext import dumps, positional

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|infinity|nan)", re.IGNORECASE)
_WHOLE = re.compile(r"\+?[0-9]+")


def lines_of(text: str) -> list[str]:
    """Lines ended by a line feed, a carriage return before it dropped; none after the last line end."""
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    return [r[:-1] if r.endswith("\r") else r for r in rows]


def single(text: str) -> np.float32:
    """A single-precision number, 0 if the text isn't one."""
    t = text.strip()
    return np.float32(t) if _NUMBER.fullmatch(t) else np.float32(0)


def whole(text: str, most: int, default: int | None) -> int | None:
    t = text.strip()
    return int(t) if _WHOLE.fullmatch(t) and int(t) <= most else default


@dataclass
class Block:
    name: str
    atoms: list[tuple[np.float32, np.float32, np.float32, str]] = field(default_factory=list)
    bonds: list[tuple[int, int, int]] = field(default_factory=list)
    properties: list[tuple[str, str]] = field(default_factory=list)

    def formula(self) -> str:
        counts: dict[str, int] = {}
        for *_, symbol in self.atoms:
            counts[symbol] = counts.get(symbol, 0) + 1
        return hill(counts)

    def weight(self) -> float:
        return float(sum(BLOCK_WEIGHT.get(a[3], 0.0) for a in self.atoms))

    def coordinates(self) -> np.ndarray:
        return np.array([a[:3] for a in self.atoms], np.float64).reshape(-1, 3)

    def has_3d(self) -> bool:
        return any(abs(a[2]) > np.float32(1e-4) for a in self.atoms)

    def property(self, key: str) -> str | None:
        return next((v for k, v in self.properties if k == key), None)

    def property_rows(self) -> list[dict]:
        return [{"name": k, "value": v} for k, v in self.properties]

    def atoms_json(self) -> str:
        rows = (f'{{"index":{n},"symbol":{dumps(s)},"x":{positional(x)},"y":{positional(y)},"z":{positional(z)}}}' for n, (x, y, z, s) in enumerate(self.atoms, 1))
        return f"[{','.join(rows)}]"

    def bond_rows(self) -> list[dict]:
        return [{"index": n, "atom1": a, "atom2": b, "bond_type": t} for n, (a, b, t) in enumerate(self.bonds, 1)]

    def json(self) -> str:
        head = {"name": self.name, "formula": self.formula()}
        tail = {"num_atoms": len(self.atoms), "num_bonds": len(self.bonds), "has_3d": self.has_3d()}
        return (
            f'{dumps(head)[:-1]},"weight":{positional(self.weight())},{dumps(tail)[1:-1]},"atoms":{self.atoms_json()},'
            f'"bonds":{dumps(self.bond_rows())},"properties":{dumps(self.property_rows())}}}'
        )


def _properties(rows: list[str]) -> list[tuple[str, str]]:
    """``> <name>`` lines with the lines up to the next empty one as value, in order, names as often as they occur."""
    out: list[tuple[str, str]] = []
    value: list[str] | None = None
    for row in rows:
        if row.startswith("$$$$"):
            break
        if value is not None:
            if row.strip():
                value.append(row)
                continue
            out[-1] = (out[-1][0], "\n".join(value))
            value = None
        elif m := re.match(r">[^<]*<([^>]*)>", row):
            out.append((m[1], ""))
            value = []
    if value is not None:
        out[-1] = (out[-1][0], "\n".join(value))
    return out


def _v2000(rows: list[str]) -> Block | None:
    """Fixed columns; rows that are too short are left out."""
    if not all(r.isascii() for r in rows[3:4]) or len(rows[3]) < 6:
        return None
    n_atoms, n_bonds = (whole(rows[3][k : k + 3], 1 << 62, None) for k in (0, 3))
    if n_atoms is None or n_bonds is None or len(rows) < 4 + n_atoms + n_bonds:
        return None
    out = Block(rows[0].strip())
    for r in rows[4 : 4 + n_atoms]:
        if len(r) >= 34:
            out.atoms.append((single(r[:10]), single(r[10:20]), single(r[20:30]), r[30:34].strip()))
    for r in rows[4 + n_atoms : 4 + n_atoms + n_bonds]:
        if len(r) >= 9:
            out.bonds.append((whole(r[:3], 4294967295, 0), whole(r[3:6], 4294967295, 0), whole(r[6:9], 255, 1)))
    out.properties = _properties(rows[4 + n_atoms + n_bonds :])
    return out


def _v3000(rows: list[str]) -> Block | None:
    """Tagged lines, joined where they end with a dash; the stated counts must be met."""
    tagged = "\n".join(r[6:].strip() for r in rows if r.startswith("M  V30"))
    records = [" ".join(r.split()) for r in re.sub(r"\s*-+[ \t]*(?:\n|\Z)", " ", tagged).split("\n")]
    counts = next((r.split() for r in records if r.startswith("COUNTS ")), [])
    if len(counts) < 3:
        return None
    n_atoms, n_bonds = whole(counts[1], 1 << 62, None), whole(counts[2], 1 << 62, None)
    out, block = Block(rows[0].strip()), ""
    for r in records:
        parts = r.split()
        if r in ("BEGIN ATOM", "BEGIN BOND"):
            block = parts[1]
        elif r == f"END {block}":
            block = ""
        elif block == "ATOM" and len(parts) >= 6:
            out.atoms.append((single(parts[2]), single(parts[3]), single(parts[4]), parts[1]))
        elif block == "BOND" and len(parts) >= 4:
            out.bonds.append((whole(parts[2], 4294967295, 0), whole(parts[3], 4294967295, 0), whole(parts[1], 255, 1)))
    if len(out.atoms) != n_atoms or len(out.bonds) != n_bonds:
        return None
    end = next((k for k, r in enumerate(rows) if r.strip() == "M  END"), len(rows))
    out.properties = _properties(rows[end + 1 :])
    return out


def parse_block(text: str | None) -> Block | None:
    """One MOL text of either version; None for null, empty and unreadable texts."""
    rows = lines_of(text or "")
    if len(rows) < 4:
        return None
    return _v3000(rows) if "V3000" in rows[3] or any(r.startswith("M  V30") for r in rows) else _v2000(rows)


def parse_sdf(text: str | None) -> list[Block]:
    """The readable blocks between ``$$$$`` marks; line ends around a block are dropped first, so a blank name line makes a block unreadable."""
    blocks = (parse_block(part.strip("\r\n")) for part in (text or "").split("$$$$") if part.strip())
    return [b for b in blocks if b is not None]


def sdf_properties(text: str | None) -> list[dict] | None:
    if not text:
        return None
    return [{"record": n, "name": b.name, "properties": b.property_rows()} for n, b in enumerate(parse_sdf(text), 1)]
