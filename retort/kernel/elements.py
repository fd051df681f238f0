"""Fixed values about elements."""

# Element symbols in order of atomic number, from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf"
).split()
NUMBER = {s: k for k, s in enumerate(SYMBOLS, 1)}
# Numbers that substructure patterns know; all others are 0 there (lanthanides and beyond astatine).
PATTERN_NUMBER = {s: n for s, n in NUMBER.items() if n <= 56 or 72 <= n <= 85}
# Two-letter symbols that substructure patterns know.
PATTERN_SYMBOLS = frozenset(s for s in PATTERN_NUMBER if len(s) == 2)

# Average atomic weights; elements not listed weigh nothing.
WEIGHT = {
    "H": 1.008, "He": 4.0026, "Li": 6.941, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078,
    "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723,
    "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Zr": 91.224, "Mo": 95.95, "Ru": 101.07,
    "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29,
    "Cs": 132.91, "Ba": 137.33, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Pb": 207.2, "Bi": 208.98,
}
# Monoisotopic masses; elements not listed count as nothing.
MONOISOTOPIC = {
    "H": 1.00782503, "B": 11.00930536, "C": 12.0, "N": 14.00307401, "O": 15.99491462, "F": 18.99840322, "Na": 22.98976928, "Mg": 23.98504170,
    "Al": 26.98153863, "Si": 27.97692653, "P": 30.97376163, "S": 31.97207100, "Cl": 34.96885268, "K": 38.96370668, "Ca": 39.96259098,
    "Fe": 55.93493633, "Cu": 62.92959772, "Zn": 63.92914201, "Br": 78.91833710, "Se": 79.91652130, "I": 126.90447190, "Ag": 106.90509300,
    "Au": 196.96656870,
}
# Weights used for MOL blocks.
BLOCK_WEIGHT = {
    "H": 1.008, "He": 4.003, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904,
    "Na": 22.990, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Si": 28.086, "Se": 78.971, "B": 10.81,
}


def hill(counts: dict[str, int]) -> str:
    """Counts as a Hill formula: carbon and hydrogen first if there is carbon, the rest by symbol; a count of one isn't printed."""
    order = sorted(counts, key=lambda s: (s != "C", s != "H", s) if "C" in counts else (True, True, s))
    return "".join(s + (str(counts[s]) if counts[s] > 1 else "") for s in order)
