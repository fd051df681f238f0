"""Receptor preparation, PDBQT texts and flexible docking.

The receptor's interaction grids are made once per (text, box, pH) and kept;
all runs of a ligand are optimised side by side, every gradient as one batch of
poses that is scored by array lookups in the grids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from retort.kernel.blocks import _NUMBER, lines_of
from retort.kernel.conformer import Sequence, conformer, cross
from retort.kernel.mol import DOUBLE, SINGLE, Molecule

# --- atom types --------------------------------------------------------------------------------------------------------------------------------------

# Radius, hydrophobic, acceptor, donor of each type.
TYPES = {
    "C": (2.00, 1, 0, 0), "A": (2.00, 1, 0, 0), "N": (1.75, 0, 0, 0), "NA": (1.75, 0, 1, 0), "NS": (1.75, 0, 1, 0), "O": (1.60, 0, 0, 0),
    "OA": (1.60, 0, 1, 0), "S": (2.00, 1, 0, 0), "SA": (2.00, 1, 1, 0), "P": (2.10, 0, 0, 0), "F": (1.54, 1, 0, 0), "Cl": (1.80, 1, 0, 0),
    "Br": (2.00, 1, 0, 0), "I": (2.20, 1, 0, 0), "H": (1.00, 0, 0, 0), "HD": (1.00, 0, 0, 1), "Mg": (0.65, 0, 0, 0), "Zn": (0.74, 0, 0, 0),
    "Fe": (0.65, 0, 0, 0), "Ca": (0.99, 0, 0, 0), "Mn": (0.65, 0, 0, 0), "Cu": (0.65, 0, 0, 0), "?": (1.70, 0, 0, 0),
}
# Types that have a grid; atoms of other types aren't scored.
PROBES = ("C", "A", "N", "NA", "NS", "OA", "SA", "HD", "P", "F", "Cl", "Br", "I", "S")
# Weights of two attractions, repulsion, hydrophobic contact, hydrogen bond and rotatable bonds; distance beyond which nothing acts; grid spacing.
W_NEAR, W_FAR, W_CLASH, W_GREASY, W_HBOND, W_ROTOR, REACH, SPACING = -0.035579, -0.005156, 0.840245, -0.035069, -0.587439, 0.058459, 8.0, 0.375
# Aromatic carbons of residues.
_RING6 = ("CG", "CD1", "CD2", "CE1", "CE2", "CZ")
_IMIDAZOLE = ("CG", "CD2", "CE1")
AROMATIC_ATOMS = {
    "PHE": _RING6, "TYR": _RING6, "TRP": ("CG", "CD1", "CD2", "CE2", "CE3", "CZ2", "CZ3", "CH2"),
    "HIS": _IMIDAZOLE, "HID": _IMIDAZOLE, "HIE": _IMIDAZOLE, "HIP": _IMIDAZOLE,
}
# Nitrogens of residues that carry hydrogen, and that accept, when a structure is typed as it is.
DONOR_NITROGENS = {
    "LYS": ("NZ",), "ARG": ("NH1", "NH2", "NE"), "TRP": ("NE1",), "HIS": ("ND1",), "HID": ("ND1",), "HIE": ("NE2",), "HIP": ("ND1", "NE2"), "ASN": ("ND2",), "GLN": ("NE2",)
}
ACCEPTOR_NITROGENS = {"HIE": ("ND1",), "HID": ("NE2",)}
# Hydrogens that a receptor's atoms get, (residue, atom, number, bond length, least pH, pH below which); backbone nitrogens get one, but for proline.
N_H, O_H, S_H, ANY_LOW, ANY_HIGH = 1.01, 0.96, 1.34, -np.inf, np.inf
RECEPTOR_HYDROGENS = [
    ("SER", "OG", 1, O_H, ANY_LOW, ANY_HIGH), ("THR", "OG1", 1, O_H, ANY_LOW, ANY_HIGH), ("TYR", "OH", 1, O_H, ANY_LOW, ANY_HIGH),
    ("CYS", "SG", 1, S_H, ANY_LOW, ANY_HIGH), ("ASN", "ND2", 2, N_H, ANY_LOW, ANY_HIGH), ("GLN", "NE2", 2, N_H, ANY_LOW, ANY_HIGH),
    ("TRP", "NE1", 1, N_H, ANY_LOW, ANY_HIGH), ("LYS", "NZ", 3, N_H, ANY_LOW, 10.5), ("ARG", "NE", 1, N_H, ANY_LOW, 12.5),
    ("ARG", "NH1", 2, N_H, ANY_LOW, 12.5), ("ARG", "NH2", 2, N_H, ANY_LOW, 12.5), ("HIS", "NE2", 1, N_H, ANY_LOW, ANY_HIGH),
    ("HIS", "ND1", 1, N_H, ANY_LOW, ANY_HIGH), ("HIE", "NE2", 1, N_H, 6.0, ANY_HIGH), ("HID", "ND1", 1, N_H, 6.0, ANY_HIGH),
    ("HIP", "ND1", 1, N_H, ANY_LOW, 6.0), ("HIP", "NE2", 1, N_H, ANY_LOW, 6.0), ("ASP", "OD1", 1, O_H, ANY_LOW, 4.0), ("ASP", "OD2", 1, O_H, ANY_LOW, 4.0),
    ("GLU", "OE1", 1, O_H, ANY_LOW, 4.0), ("GLU", "OE2", 1, O_H, ANY_LOW, 4.0),
]
# Nitrogens that accept in a prepared receptor from pH 6 on; solvent residues; longest bond of a donor; half angles of the hydrogen cone by number.
FREE_NITROGENS = {("HIS", "ND1"), ("HIE", "ND1"), ("HID", "NE2")}
SOLVENT = frozenset(("HOH", "WAT", "DOD", "H2O"))
LONGEST_BOND, CONE = 1.85, {1: 0.0, 2: 60.0, 3: 70.5}
DEFAULT_PH = 7.4
_BY_ELEMENT = {s: s for s in ("P", "F", "Cl", "Br", "I", "Mg", "Zn", "Fe", "Mn", "Cu")} | {"O": "OA", "S": "SA"}


@dataclass
class Site:
    serial: int
    name: str
    res: str
    chain: str
    number: int
    xyz: tuple[float, float, float]
    element: str
    hetatm: bool


def _element(text: str) -> str:
    letters = text.strip()[:2]
    return letters[:1].upper() + letters[1:].lower() if letters else "?"


def _from_name(name: str) -> str:
    """The first one or two letters of an atom name, digits before them left out."""
    at = next((k for k, c in enumerate(name) if c.isalpha()), 0)
    run = name[at : at + 2]
    return _element(run if run.isalpha() else run[:1] if run[:1].isalpha() else "")


def read_sites(text: str) -> list[Site]:
    """ATOM and HETATM records; of alternate locations the blank one and A."""
    def number(t: str, default: float) -> float:
        return float(t) if _NUMBER.fullmatch(t.strip()) else default

    out = []
    for r in lines_of(text):
        record = r[:6].rstrip()
        if len(r) < 6 or record not in ("ATOM", "HETATM") or (r[16:17] or " ") not in " A":
            continue
        name = r[12:16].strip()
        column = r[76:78].strip() if len(r) >= 78 else ""
        whole = lambda a, b, r=r: int(number(r[a:b], 0.0)) if r[a:b].strip().lstrip("+-").isdigit() else 0
        xyz = tuple(number(r[a : a + 8], 0.0) for a in (30, 38, 46))
        out.append(Site(whole(6, 11), name, r[17:20].strip(), r[21:22] or " ", whole(22, 26), xyz, _element(column) if column else _from_name(name), record == "HETATM"))
    return out


def _carbon(s: Site) -> str:
    return "A" if s.name in AROMATIC_ATOMS.get(s.res, ()) else "C"


def plain_type(s: Site) -> str:
    """Type of an atom of a structure as it is."""
    if s.element == "C":
        return _carbon(s)
    if s.element == "N":
        if s.name == "N" or s.name in DONOR_NITROGENS.get(s.res, ()):
            return "NS"
        return "NA" if s.name in ACCEPTOR_NITROGENS.get(s.res, ()) else "N"
    if s.element in ("H", "D"):
        return "HD" if s.name.startswith(("HN", "HO")) else "H"
    if s.element == "Ca":
        return "Ca" if s.hetatm else "?"
    return _BY_ELEMENT.get(s.element, "?")


def ligand_types(mol: Molecule) -> list[str]:
    """Types of a molecule with all hydrogens."""
    out = []
    for i, sym in enumerate(mol.sym):
        near = [mol.sym[v] for v, _ in mol.adj[i]]
        if sym == "C":
            out.append("A" if mol.arom[i] else "C")
        elif sym == "N":
            double = any(mol.bonds[k][2] == DOUBLE for _, k in mol.adj[i])
            out.append("NS" if "H" in near else "NA" if mol.arom[i] or double or mol.chg[i] == 0 else "N")
        elif sym == "H":
            out.append("HD" if {"N", "O", "S"} & set(near) else "H")
        else:
            out.append("Ca" if sym == "Ca" else _BY_ELEMENT.get(sym, "?"))
    return out


# --- texts -------------------------------------------------------------------------------------------------------------------------------------------


def smiles_to_pdbqt(text: str | None, seed: int | None) -> str | None:
    """A rigid ligand; None where there is no conformer."""
    made = conformer(text, seed)
    if made is None:
        return None
    mol, xyz = made
    rows = [
        f"ATOM  {n:>5}  {f'{s}{n}':<4}LIG A   1    {x:>8.3f}{y:>8.3f}{z:>8.3f}  1.00  0.00    +0.000 {t}\n"
        for n, (s, (x, y, z), t) in enumerate(zip(mol.sym, xyz.tolist(), ligand_types(mol), strict=True), 1)
    ]
    return f"REMARK  SMILES = {text}\nROOT\n{''.join(rows)}ENDROOT\nTORSDOF 0\n"


def pdb_to_pdbqt(text: str | None) -> str | None:
    """Atoms of a structure as they are, those without a type left out."""
    if text is None:
        return None
    rows = []
    for s in read_sites(text):
        if (t := plain_type(s)) != "?":
            x, y, z = s.xyz
            rows.append(f"{'HETATM' if s.hetatm else 'ATOM  '}{s.serial:>5}  {s.name:<4}{s.res:<3} {s.chain}{s.number:>4}    {x:>8.3f}{y:>8.3f}{z:>8.3f}  1.00  0.00    +0.000 {t}\n")
    return "".join(rows)


def _hydrogens(s: Site, ph: float) -> tuple[int, float]:
    """How many hydrogens an atom of a receptor gets, and their bond length."""
    if s.name == "N" and s.element == "N" and s.res != "PRO":
        return 1, N_H
    return next(((n, d) for res, name, n, d, low, high in RECEPTOR_HYDROGENS if (res, name) == (s.res, s.name) and low <= ph < high), (0, 0.0))


def cone(at: np.ndarray, near: np.ndarray, n: int, length: float) -> np.ndarray:
    """Positions of n hydrogens on a cone that opens away from the neighbours; upwards without any."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    pull = sum((unit(p - at) for p in near), np.zeros(3))
    axis = -unit(pull) if np.linalg.norm(pull) > 1e-6 else np.array([0.0, 0.0, 1.0])
    u = unit(np.cross(axis, [1.0, 0.0, 0.0] if abs(axis[0]) < 0.9 else [0.0, 1.0, 0.0]))
    w = unit(np.cross(axis, u))
    half = np.radians(CONE[n])
    phi = 2 * np.pi * np.arange(n) / n
    way = np.cos(half) * axis + np.sin(half) * (np.cos(phi)[:, None] * u + np.sin(phi)[:, None] * w)
    return at + length * way / np.linalg.norm(way, axis=1, keepdims=True)


@dataclass
class Receptor:
    xyz: np.ndarray
    types: list[str]
    names: list[tuple[str, str]]


@lru_cache(maxsize=16)
def receptor(text: str, ph: float) -> Receptor:
    """Heavy atoms without solvent, typed for the pH, then the polar hydrogens of donors."""
    sites = [s for s in read_sites(text) if s.res not in SOLVENT and s.element not in ("H", "D")]
    xyz = np.array([s.xyz for s in sites]).reshape(-1, 3)
    types = []
    for s in sites:
        free = (s.res, s.name) in FREE_NITROGENS and ph >= 6.0
        types.append(_carbon(s) if s.element == "C" else ("NA" if free else "N") if s.element == "N" else plain_type(s))
    added, names = [], []
    for s, at in zip(sites, xyz, strict=True):
        n, length = _hydrogens(s, ph)
        if n:
            d = np.sqrt(((xyz - at) ** 2).sum(1))
            added.append(cone(at, xyz[(d > 0.1) & (d < LONGEST_BOND)], n, length))
            names += [("H", s.res)] * n
    return Receptor(np.concatenate([xyz, *added]), types + ["HD"] * len(names), [(s.name, s.res) for s in sites] + names)


def _ph(ph: float) -> float:
    return ph if ph > 0 else DEFAULT_PH


def prepare_receptor(text: str | None, ph: float | None) -> str | None:
    """A prepared receptor as PDBQT; a pH that isn't positive means the default."""
    if text is None or ph is None:
        return None
    r = receptor(text, _ph(ph))
    rows = [
        f"ATOM  {n % 100000:>5} {name[:4]:<4} {res[:3]:<3} A   1    {x:>8.3f}{y:>8.3f}{z:>8.3f}  1.00  0.00     0.000 {t}\n"
        for n, ((name, res), (x, y, z), t) in enumerate(zip(r.names, r.xyz.tolist(), r.types, strict=True), 1)
    ]
    return "".join(rows)


# --- grids and scores --------------------------------------------------------------------------------------------------------------------------------


def pair_energy(a: str, b: str, r: np.ndarray) -> np.ndarray:
    """Interaction of two types at distances."""
    (ra, greasy_a, takes_a, gives_a), (rb, greasy_b, takes_b, gives_b) = TYPES[a], TYPES[b]
    d = r - ra - rb
    e = W_NEAR * np.exp(-((d / 0.5) ** 2)) + W_FAR * np.exp(-(((d - 3) / 2) ** 2)) + W_CLASH * np.minimum(d, 0) ** 2
    if greasy_a and greasy_b:
        e += W_GREASY * np.clip(1.5 - d, 0, 1)
    if (gives_a and takes_b) or (gives_b and takes_a):
        e += W_HBOND * np.clip(-d / 0.7, 0, 1)
    return np.where(d > REACH, 0.0, e)


#: Points times receptor atoms worked on at once when grids are made.
SLAB = 2_000_000


class Grids:
    """Interaction energies of all probe types at the points of a box."""

    def __init__(self, r: Receptor, center, size):
        self.center, size = np.array(center, float), np.array(size, float)
        self.origin = self.center - size
        self.n = np.ceil(2 * size / SPACING).astype(int) + 1
        if (self.n < 1).any():
            raise ValueError("box")
        count = int(self.n.prod())
        data = np.zeros((len(PROBES), count))
        kinds = sorted(set(r.types))
        members = {t: r.xyz[[x == t for x in r.types]] for t in kinds}
        for t in kinds:
            step = max(1, SLAB // len(members[t]))
            for k in range(0, count, step):
                points = self.origin + SPACING * np.stack(np.unravel_index(np.arange(k, min(k + step, count)), self.n), -1)
                d = np.sqrt(((points[:, None] - members[t][None]) ** 2).sum(2))
                for p, probe in enumerate(PROBES):
                    data[p, k : k + step] += pair_energy(probe, t, d).sum(1)
        self.data = data.reshape(len(PROBES), *self.n)

    def lookup(self, xyz: np.ndarray, probes: np.ndarray, slopes: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Trilinear energies of (poses, atoms, 3), summed by pose, and with ``slopes`` what they change by with each coordinate.

        A pose with an atom beyond the upper faces has infinite energy and no slope; below the lower faces it is extrapolated.
        """
        f = (xyz - self.origin) / SPACING
        i = np.maximum(np.trunc(f), 0).astype(int)
        outside = (i + 1 >= self.n).any((1, 2))
        i = np.minimum(i, self.n - 2)
        t = f - i
        # The eight corners of each atom's cell, one gather for all.
        at = (i[..., None, :] + _CORNERS).transpose(3, 0, 1, 2)
        v = self.data[probes[None, :, None], at[0], at[1], at[2]].reshape(*xyz.shape[:2], 2, 2, 2)
        x, y, z = (t[..., k] for k in range(3))
        vx = v[:, :, 0] + (v[:, :, 1] - v[:, :, 0]) * x[..., None, None]
        vy = vx[:, :, 0] + (vx[:, :, 1] - vx[:, :, 0]) * y[..., None]
        e = np.where(outside, np.inf, (vy[:, :, 0] + (vy[:, :, 1] - vy[:, :, 0]) * z).sum(1))
        if not slopes:
            return e, None
        dx = v[:, :, 1] - v[:, :, 0]
        dx = dx[:, :, 0] + (dx[:, :, 1] - dx[:, :, 0]) * y[..., None]
        dy = vx[:, :, 1] - vx[:, :, 0]
        g = np.stack([dx[..., 0] + (dx[..., 1] - dx[..., 0]) * z, dy[..., 0] + (dy[..., 1] - dy[..., 0]) * z, vy[:, :, 1] - vy[:, :, 0]], -1) / SPACING
        return e, np.where(outside[:, None, None], 0.0, g)


#: Corners of a cell, the first coordinate changing slowest.
_CORNERS = np.array([(c >> 2 & 1, c >> 1 & 1, c & 1) for c in range(8)])


@lru_cache(maxsize=4)
def grids(text: str, center: tuple, size: tuple, ph: float) -> Grids:
    return Grids(receptor(text, ph), center, size)


# --- ligand and search -------------------------------------------------------------------------------------------------------------------------------


class Ligand:
    """A centred conformer with its types, rotors (pivot, end, moved atoms, from the first atom outwards) and clash pairs."""

    def __init__(self, mol: Molecule, xyz: np.ndarray):
        self.xyz = xyz - xyz.mean(0)
        types = ligand_types(mol)
        self.scored = np.array([i for i, t in enumerate(types) if t in PROBES], np.int64)
        self.probes = np.array([PROBES.index(types[i]) for i in self.scored], np.int64)
        far = [self._distances(mol, i) for i in range(len(mol))]
        heavy = [i for i, s in enumerate(mol.sym) if s != "H"]
        self.pairs = np.array([(i, j) for x, i in enumerate(heavy) for j in heavy[x + 1 :] if far[i][j] >= 4], np.int64).reshape(-1, 2)
        radius = np.array([TYPES[t][0] for t in types])
        self.touch = radius[self.pairs].sum(1)
        # Clashes push their two atoms: the order of pushes by atom, and where each atom's begin.
        ends = self.pairs.T.ravel()
        self.by_atom = np.argsort(ends, kind="stable")
        self.pushed, self.begins = np.unique(ends[self.by_atom], return_index=True)
        self.rotors = []
        root = far[0]
        for k, (a, b, order) in enumerate(mol.bonds):
            free = all(any(v != q and mol.sym[v] != "H" for v, _ in mol.adj[p]) for p, q in ((a, b), (b, a)))
            if order != SINGLE or mol.ring_bonds[k] or not free or root[a] < 0 or root[b] < 0:
                continue
            pivot, end = (a, b) if root[a] <= root[b] else (b, a)
            moved, todo = {end}, [end]
            while todo:
                for v, x in mol.adj[todo.pop()]:
                    if x != k and v not in moved:
                        moved.add(v)
                        todo.append(v)
            self.rotors.append((root[pivot], pivot, end, np.array(sorted(moved), np.int64)))
        self.rotors.sort(key=lambda r: r[0])

    @staticmethod
    def _distances(mol: Molecule, start: int) -> list[int]:
        out = [-1] * len(mol)
        out[start], front = 0, [start]
        while front:
            front = [v for u in front for v, _ in mol.adj[u] if out[v] < 0 and out.__setitem__(v, out[u] + 1) is None]
        return out

    def bend(self, angles: np.ndarray) -> np.ndarray:
        """Inner coordinates of poses (poses, atoms, 3) for their angles."""
        xyz = np.repeat(self.xyz[None], len(angles), 0)
        for k, (_, pivot, end, moved) in enumerate(self.rotors):
            base, axis = self._axis(xyz, pivot, end)
            v = xyz[:, moved] - base
            s, c = np.sin(angles[:, k])[:, None, None], np.cos(angles[:, k])[:, None, None]
            xyz[:, moved] = base + v * c + cross(axis, v) * s + axis * (axis * v).sum(2, keepdims=True) * (1 - c)
        return xyz

    @staticmethod
    def _axis(xyz: np.ndarray, pivot: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        base = xyz[:, pivot, None]
        axis = xyz[:, end, None] - base
        return base, axis / np.maximum(np.sqrt((axis * axis).sum(2, keepdims=True)), 1e-9)

    def place(self, poses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner and placed coordinates of poses (3 translations, 4 quaternion parts, angles)."""
        inner = self.bend(poses[:, 7:])
        centred = inner - inner.mean(1, keepdims=True) if self.rotors else inner
        q = _unit(poses)
        w, axis = q[:, :1, None], q[:, None, 1:]
        twist = 2 * cross(axis, centred)
        return inner, centred + w * twist + cross(axis, twist) + poses[:, None, :3]

    def score(self, g: Grids, poses: np.ndarray, slopes: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Scores of poses, and with ``slopes`` what they change by with each of a pose's numbers."""
        inner, placed = self.place(poses)
        share = 1 / (1 + W_ROTOR * len(self.rotors))
        e, pull = g.lookup(placed[:, self.scored], self.probes, slopes)
        d = inner[:, self.pairs[:, 0]] - inner[:, self.pairs[:, 1]]
        r = np.sqrt((d * d).sum(2))
        deep = np.minimum(r - self.touch, 0)
        e = e * share + W_CLASH * (deep**2).sum(1)
        if not slopes:
            return e, None
        outer = np.zeros_like(placed)
        outer[:, self.scored] = pull * share
        shift = outer.sum(1)
        centred = inner - inner.mean(1, keepdims=True) if self.rotors else inner
        # How the placed atoms turn with the quaternion, from the moments of forces.
        q = _unit(poses)
        w, v = q[:, :1], q[:, 1:]
        moment = np.einsum("pai,paj->pij", centred, outer)
        torque = np.stack([moment[:, 1, 2] - moment[:, 2, 1], moment[:, 2, 0] - moment[:, 0, 2], moment[:, 0, 1] - moment[:, 1, 0]], 1)
        turn = 2 * w * torque + 2 * (np.einsum("pij,pj->pi", moment + moment.transpose(0, 2, 1), v) - 2 * np.trace(moment, axis1=1, axis2=2)[:, None] * v)
        dq = np.concatenate([2 * (v * torque).sum(1, keepdims=True), turn], 1)
        dq = (dq - q * (q * dq).sum(1, keepdims=True)) / np.maximum(np.sqrt((poses[:, 3:7] ** 2).sum(1, keepdims=True)), 1e-12)
        if not self.rotors:
            return e, np.concatenate([shift, dq], 1)
        # Forces in the ligand's own frame: turned back, without what moves its centre, and with those of clashes.
        twist = -2 * cross(v[:, None], outer)
        own = outer + w[..., None] * twist - cross(v[:, None], twist)
        own -= own.mean(1, keepdims=True)
        if len(self.begins):
            f = (2 * W_CLASH * deep / np.maximum(r, 1e-9))[..., None] * d
            own[:, self.pushed] += np.add.reduceat(np.concatenate([f, -f], 1)[:, self.by_atom], self.begins, 1)
        bends = []
        for _, pivot, end, moved in self.rotors:
            base, axis = self._axis(inner, pivot, end)
            bends.append((axis * cross(inner[:, moved] - base, own[:, moved])).sum((1, 2)))
        return e, np.concatenate([shift, dq, np.stack(bends, 1)], 1)


def _unit(poses: np.ndarray) -> np.ndarray:
    """The quaternions of poses, of length 1."""
    q = poses[:, 3:7]
    return q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-12)


# Descent steps, gradient at which to stop, halvings, first and largest step, score of a pose outside the grid, poses reported.
DESCENT, STILL, HALVINGS, FIRST_STEP, LARGEST_STEP, OUTSIDE, REPORTED = 200, 1e-4, 10, 0.1, 0.5, 1e9, 9


def search(ligand: Ligand, g: Grids, runs: int, seed: int) -> list[tuple[float, np.ndarray]]:
    """Scores and coordinates of random starts after descent, best first; starts that stay outside the grid are left out."""
    margin = float(np.linalg.norm(ligand.xyz, axis=1).max()) + 1
    half = np.maximum(g.n * SPACING / 2 - margin, 0)
    n = 7 + len(ligand.rotors)
    u = Sequence(seed).unit(runs * n).reshape(runs, n) * 2 - 1
    x = np.concatenate([g.center + u[:, :3] * half, u[:, 3:7] / np.maximum(np.linalg.norm(u[:, 3:7], axis=1, keepdims=True), 1e-12), u[:, 7:] * np.pi], 1)
    low, high = g.origin + margin, g.origin + np.maximum(g.n - 2, 0) * SPACING - margin
    # In a box too small for the ligand there is no room to move: its centre stays in the middle.
    low, high = np.minimum(low, (low + high) / 2), np.maximum(high, (low + high) / 2)

    def value(poses: np.ndarray) -> np.ndarray:
        return np.minimum(ligand.score(g, poses)[0], OUTSIDE)

    x[:, :3] = np.clip(x[:, :3], low, high)
    e, step, live = value(x), np.full(runs, FIRST_STEP), np.arange(runs)
    for _ in range(DESCENT):
        if not len(live):
            break
        grad = ligand.score(g, x[live], True)[1]
        moving = np.sqrt((grad**2).sum(1)) >= STILL
        live, grad = live[moving], grad[moving]
        slope, alpha = (grad**2).sum(1), step[live].copy()
        open_ = np.arange(len(live))
        for _ in range(HALVINGS):
            if not len(open_):
                break
            trial = x[live[open_]] - alpha[open_, None] * grad[open_]
            after = value(trial)
            good = after < e[live[open_]] - 1e-4 * alpha[open_] * slope[open_]
            done = live[open_[good]]
            x[done], e[done] = trial[good], after[good]
            step[done] = np.minimum(step[done] * 1.2, LARGEST_STEP)
            x[done, :3] = np.clip(x[done, :3], low, high)
            open_ = open_[~good]
            alpha[open_] *= 0.5
        # A run that found no lower pose would try the same again: it is done.
        live = np.delete(live, open_)
    _, placed = ligand.place(x)
    return sorted(((float(s), c) for s, c in zip(e, placed, strict=True) if s < OUTSIDE * 0.1), key=lambda r: r[0])


def dock(text, pdb, cx, cy, cz, sx, sy, sz, runs, seed, ph) -> str | None:
    """The best poses as JSON; None for nulls, molecules without conformer, receptors without atoms and boxes that are empty."""
    if any(v is None for v in (text, pdb, cx, cy, cz, sx, sy, sz, runs, seed, ph)):
        return None
    made = conformer(text, seed)
    if made is None or runs < 0:
        return None
    try:
        g = grids(pdb, (cx, cy, cz), (sx, sy, sz), _ph(ph))
    except (ValueError, OverflowError):
        return None
    if (g.n < 2).any():
        return None
    best = search(Ligand(*made), g, runs, seed & ((1 << 64) - 1))[:REPORTED] if runs else []
    axis = lambda c, k: ",".join(f"{v:.3f}" for v in c[:, k])
    rows = ",".join(f'{{"score":{s:.3f},"x":[{axis(c, 0)}],"y":[{axis(c, 1)}],"z":[{axis(c, 2)}]}}' for s, c in best)
    return f'{{"n":{len(best)},"results":[{rows}]}}'
