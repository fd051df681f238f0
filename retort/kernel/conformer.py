"""3-D conformers: distance geometry, then a small force field.

All terms of the energy are evaluated as array operations over index tables, so
one evaluation costs a fixed number of numpy calls whatever the molecule's size.
Digits depend on the linear algebra library; geometry (bond lengths, planarity)
is what can be relied on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from retort.kernel.mol import AROMATIC, DOUBLE, TRIPLE, Molecule, parse
from retort.kernel.writer import with_hydrogens

# Van der Waals and covalent radii in angstrom, with those used for other elements.
VDW = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "Cl": 1.75, "Br": 1.85, "I": 1.98, "Si": 2.10, "Se": 1.90}
OTHER_VDW = 1.70
COVALENT = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "S": 1.05, "P": 1.07, "F": 0.57, "Cl": 1.02, "Br": 1.20, "I": 1.39, "Si": 1.11, "Se": 1.20}
OTHER_COVALENT = 0.76
# Bond lengths in angstrom by the two elements, for single, double, triple and aromatic bonds; where there is none, the covalent radii are added.
LENGTHS = {
    "C C": (1.540, 1.340, 1.200, 1.400), "C H": (1.090, None, None, 1.090), "C N": (1.470, 1.270, 1.150, 1.340), "C O": (1.430, 1.200, None, 1.360),
    "C S": (1.820, 1.600, None, 1.760), "C P": (1.840, 1.660, None, None), "C F": (1.350, None, None, 1.350), "C Cl": (1.770, None, None, 1.770),
    "C Br": (1.940, None, None, 1.940), "C I": (2.140, None, None, 2.140), "C Si": (1.870, None, None, None), "C Se": (1.970, None, None, None),
    "H N": (1.010, None, None, 1.010), "N N": (1.450, 1.250, None, 1.350), "N O": (1.400, 1.210, None, None), "H O": (0.960, None, None, 0.960),
    "O O": (1.480, 1.210, None, None), "O P": (1.610, 1.480, None, None), "O S": (1.650, 1.430, None, None), "H S": (1.340, None, None, None),
    "S S": (2.050, 1.890, None, None), "H P": (1.420, None, None, None),
}
# Angles in degrees at sp3 atoms of some elements, and by hybridisation.
SP3_ANGLES = {"O": 104.5, "N": 107.0, "S": 100.0}
ANGLES = {1: 180.0, 2: 120.0, 3: 109.5}
# Force constants (bond, angle, out of plane), depth of the van der Waals well, largest number of steps, gradient at which to stop, history length.
K_BOND, K_ANGLE, K_PLANE, DEPTH, STEPS, FLAT, HISTORY = 700.0, 100.0, 400.0, 0.10, 2000, 0.2, 8
# Embeddings per molecule, tolerances of bond (share), angle and ring distances (angstrom), share of the radii that atoms keep apart.
TRIES, BOND_SLACK, ANGLE_SLACK, RING_SLACK, APART = 8, 0.05, 0.10, 0.06, 0.8
# Multiplier and increment of the random sequence, and the multiplier that spreads seeds.
LCG_A, LCG_C, SPREAD = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _jumps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What the next 1 to n states are the present one times, and plus."""
    times, plus, a, c = [], [], 1, 0
    for _ in range(n):
        a, c = a * LCG_A & _MASK, (c * LCG_A + LCG_C) & _MASK
        times.append(a)
        plus.append(c)
    return np.array(times, np.uint64), np.array(plus, np.uint64)


#: Numbers made at once.
JUMPS = _jumps(4096)


class Sequence:
    """Reproducible random numbers from a 64-bit seed."""

    def __init__(self, seed: int):
        self.state = (seed + 1) & _MASK

    def unit(self, n: int) -> np.ndarray:
        """The next n numbers of [0, 1)."""
        out = np.empty(n)
        times, plus = JUMPS
        for k in range(0, n, len(times)):
            some = min(len(times), n - k)
            # Unsigned products and sums are taken modulo 2 ** 64.
            states = times[:some] * np.full(1, self.state, np.uint64) + plus[:some]
            out[k : k + some] = (states >> np.uint64(11)) / (1 << 53)
            self.state = int(states[-1])
        return out


def bond_length(a: str, b: str, order: int) -> float:
    row = LENGTHS.get(f"{a} {b}") or LENGTHS.get(f"{b} {a}") or (None,) * 4
    stated = row[order - 1]
    return stated if stated is not None else COVALENT.get(a, OTHER_COVALENT) + COVALENT.get(b, OTHER_COVALENT)


def hybridisation(mol: Molecule, i: int) -> int:
    """1, 2 or 3 for sp, sp2, sp3."""
    orders = {mol.bonds[k][2] for _, k in mol.adj[i]}
    if TRIPLE in orders:
        return 1
    return 2 if mol.arom[i] or orders & {DOUBLE, AROMATIC} else 3


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vector products along the last axis."""
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        out[..., k] = a[..., i] * b[..., j] - a[..., j] * b[..., i]
    return out


def ring_order(mol: Molecule, ring: list[int]) -> list[int] | None:
    """Atoms of a ring in cyclic order from the smallest index; None if its bonds are no single cycle."""
    near: dict[int, list[int]] = {}
    for k in ring:
        a, b, _ = mol.bonds[k]
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    if any(len(v) != 2 for v in near.values()):
        return None
    out = [min(near)]
    while len(out) < len(near):
        step = [v for v in near[out[-1]] if v not in out]
        if not step:
            return None
        out.append(step[0])
    return out


#: Pairs of atoms, and ends of bonded terms, worked on at once: few enough for a core's own memory, and for arrays that aren't returned to the system each time.
TOGETHER, ENDS = 32_000, 40_000


def _turned(rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """Sets of a x b numbers as sets of b x a."""
    return rows.reshape(-1, a, b).transpose(0, 2, 1).reshape(len(rows), -1)


class Terms:
    """Index tables of bonds, angles, apart pairs and flat groups of a molecule with all hydrogens."""

    def __init__(self, mol: Molecule):
        self.n = n = len(mol)
        self.bonds = np.array([b[:2] for b in mol.bonds], np.int64).reshape(-1, 2)
        self.length = np.array([bond_length(mol.sym[a], mol.sym[b], o) for a, b, o in mol.bonds])
        angles, ideal, sides, flat = [], [], [], []
        for c in range(n):
            hyb = hybridisation(mol, c)
            theta = np.radians(SP3_ANGLES.get(mol.sym[c], ANGLES[3]) if hyb == 3 else ANGLES[hyb])
            row = mol.adj[c]
            for x in range(len(row)):
                for y in range(x + 1, len(row)):
                    angles.append((row[x][0], c, row[y][0]))
                    ideal.append(theta)
                    sides.append((self.length[row[x][1]], self.length[row[y][1]]))
            if hyb == 2 and len(row) == 3:
                flat.append((c, *[v for v, _ in row]))
        self.angles = np.array(angles, np.int64).reshape(-1, 3)
        self.ideal, self.sides = np.array(ideal), np.array(sides).reshape(-1, 2)
        self.rings = []
        for ring in mol.rings:
            if all(mol.bonds[k][2] == AROMATIC for k in ring) and (order := ring_order(mol, ring)) is not None and len(order) >= 3:
                self.rings.append((order, float(self.length[ring].mean())))
                if len(order) >= 4:
                    flat += [tuple(order[(s + k) % len(order)] for k in range(4)) for s in range(len(order))]
        self.flat = np.array(flat, np.int64).reshape(-1, 4)
        near = np.eye(n, dtype=bool)
        for a, b in (self.bonds.T, self.angles[:, [0, 2]].T):
            near[a, b] = near[b, a] = True
        self.far = ~near
        self.radius = np.array([VDW.get(s, OTHER_VDW) for s in mol.sym])
        # Squared distances at which pairs that are neither bound nor at one angle touch; 0 for the others, which feel nothing.
        self.touch = np.where(self.far, ((self.radius[:, None] + self.radius[None]) * 0.5) ** 2, 0.0)
        # The atoms of all terms, and forces on them added up by atom: their order by atom, and where each atom's begin.
        self.room = np.empty((3, 0))
        self.ends = np.concatenate([self.bonds.T.ravel(), self.angles[:, [0, 2, 1]].T.ravel(), self.flat[:, [1, 2, 3, 0]].T.ravel()])
        self.by_atom = np.argsort(self.ends, kind="stable")
        self.pushed, self.begins = np.unique(self.ends[self.by_atom], return_index=True)

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper distance limits, smoothed by the triangle inequality."""
        n = self.n
        low, high = np.zeros((n, n)), np.full((n, n), 100.0)
        low[self.far] = ((self.radius[:, None] + self.radius[None]) * APART)[self.far]

        def pin(a, b, least, most, fresh: bool) -> None:
            low[a, b] = low[b, a] = least if fresh else max(low[a, b], least)
            high[a, b] = high[b, a] = most if fresh else min(high[a, b], most)

        for (a, b), d in zip(self.bonds.tolist(), self.length.tolist(), strict=True):
            pin(a, b, d * (1 - BOND_SLACK), d * (1 + BOND_SLACK), True)
        p, q = self.sides.T
        span = np.sqrt(p * p + q * q - 2 * p * q * np.cos(self.ideal))
        for (a, _, b), d in zip(self.angles.tolist(), span.tolist(), strict=True):
            pin(a, b, max(0.0, d - ANGLE_SLACK), d + ANGLE_SLACK, False)
        for order, side in self.rings:
            r = len(order)
            radius = side / (2 * np.sin(np.pi / r))
            for x in range(r):
                for y in range(x + 1, r):
                    steps = min(y - x, r - y + x)
                    if steps > 1:
                        d = 2 * radius * np.sin(steps * np.pi / r)
                        pin(order[x], order[y], max(0.0, d - RING_SLACK), d + RING_SLACK, True)
        np.fill_diagonal(low, 0.0)
        np.fill_diagonal(high, 0.0)
        way = np.empty((n, n))
        for _ in range(2):
            for k in range(n):
                np.minimum(high, np.add(high[:, k, None], high[None, k], out=way), out=high)
                np.subtract(low[:, k, None], high[None, k], out=way)
                np.maximum(low, way, out=low)
                np.maximum(low, way.T, out=low)
        return low, high

    def energy(self, flat_xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Energies and gradients of several sets of coordinates (sets x 3 n)."""
        total, grad = self.by_axis(_turned(flat_xyz, self.n, 3))
        return total, _turned(grad, 3, self.n)

    def by_axis(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of sets that hold all x, then all y, then all z."""
        m, n = len(rows), self.n
        xyz = rows.reshape(m, 3, n)
        total, grad = np.empty(m), np.empty_like(xyz)
        size = max(1, ENDS // max(1, len(self.ends)))
        for k in range(0, m, size):
            total[k : k + size], grad[k : k + size] = self._bound(xyz[k : k + size])
        # Some sets at once, and of them some rows of the pairs with the columns from the first of them on: half the pairs, and few enough to stay in a core's own memory.
        size = max(1, 4 * TOGETHER // (n * n))
        for s in range(0, m, size):
            part = xyz[s : s + size]
            left, right = _factors(part)
            back, first = np.zeros_like(right), 0
            while first < n:
                last = min(n, first + max(1, TOGETHER // (len(part) * (n - first))))
                rows = last - first
                deep, weight = self._pairs(left[:, first:last], right[:, :, first:], self.touch[first:last, first:])
                # Pairs of two of these rows stand there twice.
                total[s : s + size] -= DEPTH * (deep.sum((1, 2)) - 0.5 * deep[:, :, :rows].sum((1, 2)))
                back[:, :, first:last] += right[:, :, first:] @ weight.transpose(0, 2, 1)
                if last < n:
                    back[:, :, last:] += right[:, :, first:last] @ weight[:, :, rows:]
                first = last
            grad[s : s + size] += 12 * DEPTH * (back[:, 4:] * part - back[:, :3])
        return total, grad.reshape(m, -1)

    def _pairs(self, left: np.ndarray, right: np.ndarray, touch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of atoms, how deep they lie in a well of depth 1, and a twelfth of their pull over the distance; what isn't a pair has a touching distance of 0.

        All is written to memory that is kept and overwritten by the next call, since for large molecules this is all the time, and new memory would be most of it.
        """
        shape = (*left.shape[:-1], right.shape[-1])
        count = int(np.prod(shape))
        if self.room.shape[1] < count:
            self.room = np.empty((3, count))
        square, six, deep = (row[:count].reshape(shape) for row in self.room)
        np.matmul(left, right, out=square)
        np.maximum(square, 1e-16, out=square)
        np.divide(touch, square, out=six)
        np.multiply(six, six, out=deep)
        six *= deep
        np.subtract(2, six, out=deep)
        deep *= six
        weight = np.subtract(deep, six, out=six)
        weight /= square
        return deep, weight

    def _bound(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Energies and gradients of bonds, angles and flat groups."""
        m = len(xyz)
        at = xyz.take(self.ends, 2)
        forces = np.empty_like(at)
        nb, na, nf = len(self.bonds), len(self.angles), len(self.flat)
        # Where the bonds' ends, the angles' sides and centres, and the groups' atoms begin.
        (a1, a2, a3), (f1, f2, f3, f4) = (2 * nb + na * np.arange(3)), (2 * nb + 3 * na + nf * np.arange(4))

        d = at[..., :nb] - at[..., nb:a1]
        r = np.maximum(np.sqrt((d * d).sum(1)), 1e-8)
        off = r - self.length
        total = K_BOND * (off * off).sum(1)
        np.multiply((2 * K_BOND * off / r)[:, None], d, out=forces[..., :nb])
        np.negative(forces[..., :nb], out=forces[..., nb:a1])

        # Both sides of the angles at once: unit vectors from the centre.
        sides = at[..., a1:a3].reshape(m, 3, 2, na) - at[..., None, a3:f1]
        r = np.maximum(np.sqrt((sides * sides).sum(1)), 1e-8)
        sides /= r[:, None]
        cos = np.clip((sides[:, :, 0] * sides[:, :, 1]).sum(1), -1 + 1e-10, 1 - 1e-10)
        off = np.arccos(cos) - self.ideal
        total += K_ANGLE * (off * off).sum(1)
        pull = 2 * K_ANGLE * off / np.sqrt(1 - cos * cos)
        push = (cos[:, None, None] * sides - sides[:, :, ::-1]) * (pull[:, None] / r)[:, None]
        forces[..., a1:a3] = push.reshape(m, 3, 2 * na)
        np.negative(push[:, :, 0] + push[:, :, 1], out=forces[..., a3:f1])

        # Three vectors of each group from its centre; the product of the other two is what its volume changes by with each.
        v = at[..., f1:f4].reshape(m, 3, 3, nf) - at[..., None, f4:]
        p, q = v[:, :, [1, 2, 0]], v[:, :, [2, 0, 1]]
        push = np.empty_like(v)
        for i in range(3):
            j, k = (i + 1) % 3, (i + 2) % 3
            np.subtract(p[:, j] * q[:, k], p[:, k] * q[:, j], out=push[:, i])
        volume = (v[:, :, 0] * push[:, :, 0]).sum(1)
        total += K_PLANE * (volume * volume).sum(1)
        push *= (2 * K_PLANE * volume)[:, None, None]
        forces[..., f1:f4] = push.reshape(m, 3, 3 * nf)
        np.negative(push.sum(2), out=forces[..., f4:])

        grad = np.zeros_like(xyz)
        if len(self.begins):
            grad[..., self.pushed] = np.add.reduceat(forces.take(self.by_atom, 2), self.begins, 2)

        return total, grad


def _factors(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (-2 x, 1, x x) and columns (x, x x, 1), whose product is the squared distances."""
    m, _, n = xyz.shape
    own = (xyz * xyz).sum(1)
    left, right = np.ones((m, n, 5)), np.ones((m, 5, n))
    np.multiply(xyz.transpose(0, 2, 1), -2, out=left[..., :3])
    left[..., 4], right[:, :3], right[:, 3] = own, xyz, own
    return left, right


def embedding(low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray | None:
    """Coordinates of a random distance matrix within the limits; None if it has no extent at all."""
    n = len(low)
    at = np.triu_indices(n, 1)
    d2 = np.zeros((n, n))
    d2[at] = (low[at] + Sequence(seed).unit(len(at[0])) * (high[at] - low[at])) ** 2
    d2 += d2.T
    mean = d2.mean(1)
    values, vectors = np.linalg.eigh(-0.5 * (d2 - mean[:, None] - mean[None] + mean.mean()))
    top = np.argsort(-values)[:3]
    if not len(top) or values[top[0]] <= 1e-9:
        return None
    xyz = np.zeros((n, 3))
    xyz[:, : len(top)] = vectors[:, top] * np.sqrt(np.where(values[top] > 1e-9, values[top], 0.0))
    return xyz.ravel()


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def relax(terms: Terms, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limited-memory quasi-Newton descent with step halving, for several sets of coordinates in step; energies and coordinates."""
    live, x = np.arange(len(x)), _turned(x, terms.n, 3)
    e_out, x_out = np.empty(len(x)), x.copy()
    e, g = terms.by_axis(x)
    # Of the sets that still move: the last HISTORY steps, changes of the gradient and weights, newest last (a weight of 0 stands for none), and the scale; 0 before the first.
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scale, stuck = np.zeros(len(x)), np.zeros(len(x), bool)
    for _ in range(STEPS):
        steepest = np.abs(g).max(1, initial=0.0)
        go = (steepest >= FLAT) & ~stuck
        if not go.all():
            e_out[live[~go]], x_out[live[~go]] = e[~go], x[~go]
            live, x, e, g, scale, steepest = (part[go] for part in (live, x, e, g, scale, steepest))
            held = [tuple(part[go] for part in row) for row in held]
        if not len(live):
            break
        q, used = g.copy(), []
        for s, y, rho in reversed(held):
            used.append(rho * _dots(s, q))
            q -= used[-1][:, None] * y
        q *= np.where(scale > 0, scale, 1 / (1 + steepest))[:, None]
        for (s, y, rho), w in zip(held, reversed(used), strict=True):
            q += (w - rho * _dots(y, q))[:, None] * s
        slope = -_dots(g, q)
        uphill = slope >= 0
        if uphill.any():
            q[uphill] = g[uphill]
            slope = -_dots(g, q)
        step, todo = np.ones(len(live)), np.arange(len(live))
        x_new = x - q
        e_new, g_new = terms.by_axis(x_new)
        todo = np.flatnonzero(~(e_new <= e + 1e-4 * slope))
        for _ in range(29):
            if not len(todo):
                break
            step[todo] *= 0.5
            x_new[todo] = x[todo] - step[todo, None] * q[todo]
            e_new[todo], g_new[todo] = terms.by_axis(x_new[todo])
            todo = todo[~(e_new[todo] <= e[todo] + 1e-4 * step[todo] * slope[todo])]
        # A set without a lower step is done, where it was.
        x_new[todo], e_new[todo], g_new[todo] = x[todo], e[todo], g[todo]
        stuck = np.zeros(len(live), bool)
        stuck[todo] = True
        s, y = x_new - x, g_new - g
        sy = _dots(s, y)
        keep = sy > 1e-10
        if keep.all():
            held = [*held, (s, y, 1 / sy)][-HISTORY:]
            scale = sy / np.maximum(_dots(y, y), 1e-12)
        else:
            # Sets without a new step keep theirs, in the last places.
            none = (np.zeros_like(s), np.zeros_like(y), np.zeros_like(sy))
            rows = [none] * (HISTORY - len(held)) + held
            fresh = [*rows[1:], (s, y, np.where(keep, 1 / np.where(keep, sy, 1.0), 0.0))]
            held = [tuple(np.where(keep if a.ndim == 1 else keep[:, None], a, b) for a, b in zip(new, old, strict=True)) for new, old in zip(fresh, rows, strict=True)]
            scale = np.where(keep, sy / np.maximum(_dots(y, y), 1e-12), scale)
        x, e, g = x_new, e_new, g_new
    e_out[live], x_out[live] = e, x
    return e_out, _turned(x_out, 3, terms.n)


@lru_cache(maxsize=8)
def conformer(text: str | None, seed: int | None) -> tuple[Molecule, np.ndarray] | None:
    """The molecule with its hydrogens and coordinates (atoms x 3) of the best of several embeddings; None for invalid texts and single atoms. The last few are remembered: neither part is to be changed."""
    bare = parse(text)
    if bare is None or seed is None:
        return None
    mol = with_hydrogens(bare)
    terms = Terms(mol)
    low, high = terms.limits()
    starts = [x for k in range(1, TRIES + 1) if (x := embedding(low, high, ((seed & _MASK) * SPREAD + k) & _MASK)) is not None]
    if not starts:
        return None
    e, x = relax(terms, np.stack(starts))
    return mol, x[e.argmin()].reshape(-1, 3)
