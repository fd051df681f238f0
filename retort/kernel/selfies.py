"""Simplified SELFIES: a token form with placeholder indices, in which ring closures and long branches aren't kept."""

from __future__ import annotations

import re

# Symbols of two letters read outside brackets when encoding.
TWO_LETTERS = ("Cl", "Br", "Si", "Se", "Na", "Li", "Mg", "Al", "Ca", "Fe", "Cu", "Zn", "As", "Sn", "Pb")
# Symbols written without brackets when decoding.
BARE = frozenset("B C N O P S F Cl Br I c n o s p b H".split())
# What stands for a ring closure, a branch of at most one token, and a longer one.
RING_MARK, SHORT_BRANCH, LONG_BRANCH = "[Ring1][C]", "[Branch1][C]", "[Branch2][Ring1][C]"

_ATOM = re.compile("|".join(TWO_LETTERS) + r"|[\s\S]")


def encode(text: str | None) -> str | None:
    """SMILES as tokens; None for null and empty texts and where nothing is left."""
    out, at = [], 0
    text = text or ""
    while at < len(text):
        c = text[at]
        if c == "(":
            end, depth = at + 1, 1
            while end < len(text) and depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            inner = encode(text[at + 1 : end - (depth == 0)])
            if inner is not None:
                out.append((SHORT_BRANCH if inner.count("[") <= 1 else LONG_BRANCH) + inner)
            at = end if depth == 0 else end + 1
        elif c in "=#":
            at += 1
            if at < len(text):
                m = _ATOM.match(text, at)
                out.append(f"[{c}{m[0]}]")
                at = m.end()
        elif c in "123456789%":
            out.append(RING_MARK)
            at += 3 if c == "%" else 1
        elif c in "/\\-:":
            at += 1
        elif c == "[":
            end = text.find("]", at)
            end = len(text) if end < 0 else end + 1
            out.append(text[at:end])
            at = end
        else:
            m = _ATOM.match(text, at)
            out.append(f"[{m[0]}]")
            at = m.end()
    return "".join(out) or None


def _atom(token: str) -> str:
    bond = token[:1] if token[:1] in ("=", "#") else ""
    rest = token[len(bond) :]
    if token in ("nop", "."):
        return "" if token == "nop" else "."
    return bond + (rest if rest in BARE or rest.startswith("[") else f"[{rest}]")


def decode(text: str | None) -> str | None:
    """Tokens as SMILES: of a branch one token is kept, ring closures are lost; None for null and empty texts and where nothing is left."""
    tokens = re.findall(r"\[([^\]]*)\]", text or "")
    out, at = [], 0
    while at < len(tokens):
        t = tokens[at]
        level = int(t[-1]) if t[-1:].isascii() and t[-1:].isdigit() else 1
        if t.startswith("Branch"):
            at += 1 + level
            if at < len(tokens):
                out.append(f"({_atom(tokens[at])})")
                at += 1
        elif t.startswith("Ring"):
            at += 1 + level
        else:
            out.append(_atom(t))
            at += 1
    return "".join(out) or None


def valid(text: str | None) -> bool:
    return bool(text) and "[" in text and "]" in text
