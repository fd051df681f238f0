"""SQL of the queries on training data that SQL can state: the plain definition, by comparing everything with everything."""

from __future__ import annotations

# The compatibility form, for texts whose only characters it changes are full-width ones and no-break spaces, as in the given tables.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + " "
_PLAIN = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_DASHES = "‐‑‒–—―−"


def _nfkc(text: str) -> str:
    return f"translate({text}, '{_WIDE}', '{_PLAIN}')"


def structure(text: str) -> str:
    """The components of a structure as a sorted list, null without any."""
    plain = f"regexp_replace(translate({_nfkc(text)}, '{_DASHES}', '{'-' * len(_DASHES)}'), '[^A-Za-z0-9()\\[\\]=#\\-+@/\\\\%:.*]', '', 'g')"
    parts = f"list_sort(list_filter(string_split(replace(replace({plain}, 'CL', 'Cl'), 'BR', 'Br'), '.'), lambda c: c <> ''))"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} END"


_NAME = f"regexp_replace(lower({_nfkc('name')}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_RUNS = f"list_sort(list_distinct(regexp_extract_all(lower({_nfkc('author')}), '[\\p{{L}}\\p{{N}}]+')))"
_AUTHOR = f"CASE WHEN len({_RUNS}) > 0 AND trim(regexp_replace(lower({_nfkc('author')}), '\\s+', ' ', 'g')) NOT IN ('unknown', 'anonymous', 'n/a') THEN {_RUNS} END"

# Rows are tied to the first row of each of their values; the smallest number of a group spreads along these ties until nothing changes.
_GROUPS = f"""RECURSIVE r AS (SELECT mol_id, {structure('smiles')} AS s, {_AUTHOR} AS a FROM smiles),
    t AS (SELECT mol_id AS x, min(mol_id) OVER (PARTITION BY s) AS y FROM r WHERE s IS NOT NULL UNION SELECT mol_id, min(mol_id) OVER (PARTITION BY a) FROM r WHERE a IS NOT NULL),
    e AS (SELECT x, y FROM t UNION SELECT y, x FROM t),
    c(id, label) USING KEY (id) AS (SELECT mol_id, mol_id FROM r UNION
        (SELECT e.x, min(c.label) FROM e JOIN c ON c.id = e.y JOIN recurring.c AS old ON old.id = e.x GROUP BY e.x HAVING min(c.label) < min(old.label))),
    g AS (SELECT label AS group_id, id AS mol_id, count(*) OVER (PARTITION BY label) AS n FROM c)"""

_SETS = f"s AS (SELECT mol_id, list_distinct({structure('smiles')}) AS items FROM smiles), m AS (SELECT mol_id, list_sort(items) AS items, len(items) AS n FROM s WHERE len(items) >= 3)"
_TOKENS = "u AS (SELECT mol_id, n, unnest(items) AS item FROM m)"
_PAIRS = "p AS (SELECT a.mol_id AS a, b.mol_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.item = b.item AND a.mol_id < b.mol_id GROUP BY 1, 2)"
_SIMILAR = f"{_SETS}, {_TOKENS}, {_PAIRS}, q AS (SELECT a, b FROM p WHERE 10 * common >= 6 * (na + nb - common))"

_BOTH = f"""r AS (SELECT mol_id, {_NAME} AS k, {structure('smiles')} AS s FROM (SELECT mol_id, name, smiles FROM smiles UNION ALL SELECT mol_id, name, smiles FROM selfies)),
    g AS (SELECT mol_id, CASE WHEN k IS NULL OR s IS NULL THEN mol_id ELSE min(mol_id) OVER (PARTITION BY k, s) END AS keep_id FROM r)"""


def _windows(table: str, key: str) -> str:
    """Every 13 consecutive words of a text, joined by blanks."""
    words = f"SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}"
    return f"SELECT DISTINCT {key}, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS k FROM ({words}) WHERE len(w) >= 13)"


SQL = {
    "p1_found": f"WITH {_GROUPS} SELECT group_id, mol_id FROM g WHERE n >= 2",
    "p1_whole": f"WITH {_GROUPS} SELECT group_id, n, 1 AS splits FROM g GROUP BY group_id, n",
    "p3_sizes": "SELECT plan_id, subset_size::BIGINT AS chosen, subset_size::BIGINT AS own, subset_size::BIGINT AS different FROM subset_plan",
    "p4_found": f"WITH {_SIMILAR} SELECT a AS mol_id_a, b AS mol_id_b FROM q",
    "p4_classes": f"""WITH {_SETS}, c AS (SELECT items, min(mol_id) AS id, any_value(n) AS n FROM m GROUP BY items), u AS (SELECT id, n, unnest(items) AS item FROM c),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS whole FROM u a JOIN u b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, common::INTEGER AS common, common::DOUBLE / whole::DOUBLE AS similarity FROM p WHERE 10 * common >= 6 * whole""",
    "p4_members": f"""WITH {_SIMILAR}, l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM q UNION ALL SELECT b FROM q) GROUP BY id)
    SELECT mol_id, min(mol_id) OVER w AS class_id, count(*) OVER w AS copies, coalesce(links, 0) AS links FROM m LEFT JOIN l ON mol_id = id WINDOW w AS (PARTITION BY items)""",
    "p5_found": f"WITH {_BOTH} SELECT keep_id, mol_id AS copy_id FROM g WHERE mol_id <> keep_id",
    "p5_kept": f"WITH {_BOTH} SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
    "p6_found": f"WITH i AS ({_windows('eval_items', 'item_id')}), d AS ({_windows('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p7_uses": """SELECT lower(trim(m.source)) AS source, count(d.doc_id) AS documents, true AS within FROM mix_targets m
    LEFT JOIN documents d ON lower(regexp_replace(d.source, '^\\s+|\\s+$', '', 'g')) = lower(trim(m.source)) GROUP BY 1""",
}
