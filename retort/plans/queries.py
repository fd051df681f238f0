"""Registered queries of the core and, where SQL can express them, their SQL.

Names: ``mol_``, ``sim_``, ``inchi_``, ``text_``, ``vs_``, ``w_`` run over the given tables of molecules; ``f_`` run over molecules of closed-form families
made from table columns, whose every property plain SQL can state; ``r_`` are relational plans; ``p2_`` loads raw records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retort.functions import dockings, inchi, rules, screening, texts3d
from retort.functions import molecules as M
from retort.functions import similarity as S
from retort.functions.registry import python_functions, selfies_is_valid
from retort.operators import records
from retort.operators.skew import join_back, meet
from retort.plans import workflows
from retort.session import spread, tasks, written
from retort.sources.tables import table
from retort.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- raw records -------------------------------------------------------------------------------------------------------------------------------------


def _feed(spark: SparkSession, d: str, name: str, feed: records.Feed) -> DataFrame:
    return records.check_records(table(spark, d, "raw_lines").filter(F.col("feed") == name), feed)


def _both(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rejected lines of both feeds, read once."""
    return records.rejected(records.check_feeds(table(spark, d, "raw_lines"), {"smiles": records.SMILES, "inchi": records.INCHI})).select(*columns)


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines of both feeds."""
    return _both(spark, d, "line_id", "reason")


@query()
def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with the reason, the character it shows at and the column, where it is one column's."""
    return _both(spark, d, "line_id", "feed", "file", "reason", "at", "column")


@query()
def p2_smiles(spark: SparkSession, d: str) -> DataFrame:
    """Good lines of feed smiles as typed rows."""
    return records.typed(_feed(spark, d, "smiles", records.SMILES), records.SMILES, ["line_id", "file"])


_D_FIELD = r"""("(?:[^"]|"")*"|[^",\r\n]*)"""
_D_CSV = rf"""WITH q AS (SELECT line_id, file, feed, line, regexp_full_match(line, '(?s){_D_FIELD}(?:,{_D_FIELD})*') AS ok, regexp_extract_all(',' || line, '(?s),{_D_FIELD}', 1) AS f FROM raw_lines WHERE feed IN ('smiles', 'inchi'))"""
_D_UNQUOTED = "CASE WHEN reason IS NULL THEN CASE WHEN starts_with(f[{k}], '\"') THEN replace(f[{k}][2:-2], '\"\"', '\"') ELSE f[{k}] END END AS f{k}"
_D_UNQUOTE = "CASE WHEN starts_with(f[{k}], '\"') THEN replace(f[{k}][2:-2], '\"\"', '\"') ELSE f[{k}] END"
_D_INCHI_ROWS = f"""{_D_CSV}, u AS (SELECT line_id, file, {", ".join(f"{_D_UNQUOTE.format(k=k)} AS u{k}" for k in range(1, 6))} FROM q WHERE feed = 'inchi' AND ok AND len(f) = 5)
    SELECT line_id, file, u1 AS name, u2 AS inchi, u3 AS expected_formula, CASE lower(u4) WHEN 'true' THEN true WHEN 'false' THEN false END AS has_stereo, CAST(nullif(u5, '') AS INTEGER) AS stereo_centers
    FROM u WHERE starts_with(u2, 'InChI=') AND strlen(u2) > 8 AND lower(u4) IN ('', 'true', 'false') AND (u5 = '' OR (regexp_full_match(u5, '[0-9]+') AND coalesce(try_cast(u5 AS HUGEINT) <= 2147483647, false)))"""


@query(_D_INCHI_ROWS)
def p2_inchi(spark: SparkSession, d: str) -> DataFrame:
    """Good lines of feed inchi as typed rows."""
    return records.typed(_feed(spark, d, "inchi", records.INCHI), records.INCHI, ["line_id", "file"])


@query(
    f"""{_D_CSV}, r AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN line IS NULL OR len(f) <> 5 THEN 'column_count' END AS reason FROM q)
    SELECT line_id, reason, {", ".join(_D_UNQUOTED.format(k=k) for k in range(1, 6))} FROM r"""
)
def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of every line whose quoting and number of columns are right, and which of the two is wrong with the others."""
    rows = table(spark, d, "raw_lines").filter("feed in ('smiles', 'inchi')")
    tokens = records.tokenized(rows.select("line_id", "line"))
    reason = F.when(F.col("error_at").isNotNull(), "quoting").when(F.size("fields") != 5, "column_count").when(F.col("line").isNull(), "column_count")
    return tokens.withColumn("reason", reason).select("line_id", "reason", *[F.when(F.col("reason").isNull(), F.get("fields", F.lit(k))).alias(f"f{k + 1}") for k in range(5)])


# --- all functions over the given molecules ----------------------------------------------------------------------------------------------------------


def _profiled(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return M.profile(table(spark, d, "smiles").select("mol_id", "smiles"), "smiles", list(fields)).drop("smiles")


@query()
def mol_composition(spark: SparkSession, d: str) -> DataFrame:
    """Validity, composition and mass of every row."""
    return _profiled(spark, d, "mol_formula", "mol_num_atoms", "mol_num_bonds", "mol_weight", "mol_exact_mass")


@query()
def mol_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Physicochemical descriptors and ring classes of every row."""
    names = ["logp_crippen", "mol_mr", "tpsa", "qed", "num_h_acceptors", "num_h_donors", "num_rotatable_bonds", "ring_count", "num_heteroatoms", "fraction_csp3"]
    return _profiled(spark, d, *names, *[n for n in M.FIELDS if n.startswith(("num_aromatic", "num_aliphatic", "num_saturated"))])


@query()
def mol_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Canonical texts, scaffolds, fragments, charge forms and explicit hydrogens of every row."""
    names = ["canonical_smiles", "murcko_scaffold", "generic_scaffold", "ring_systems_json", "largest_fragment", "strip_salts", "neutralize_charges", "normalize_smiles"]
    return _profiled(spark, d, *names, "fragment_parent", "scaffold_network_json", "add_hydrogens")


@query()
def mol_hashes(spark: SparkSession, d: str) -> DataFrame:
    """All hash methods of every row."""
    from retort.kernel.structures import HASH_METHODS

    rows = spread(table(spark, d, "smiles").select("mol_id", "smiles"))
    return rows.select("mol_id", M.hash_methods().alias("methods"), *[M.call("mol_hash", F.col("smiles"), F.lit(m)).alias(m) for m in HASH_METHODS])


#: Patterns of the screening query.
SCREEN = {"carboxylic_acid": "C(=O)[OX2H1]", "nitrile": "C#N", "nitro": "[NX3+](=O)[O-]", "aromatic_n": "[n]", "halide": "[F,Cl,Br,I]", "ring_c": "[#6;R]", "sulfone": "S(=O)(=O)"}


@query()
def w_screen(spark: SparkSession, d: str) -> DataFrame:
    """Which named patterns every row has, how often, and the mappings of one."""
    rows = workflows.screen(spread(table(spark, d, "smiles").select("mol_id", "smiles")), "smiles", SCREEN)
    hit = M.call("mol_has_substructure", F.col("smiles"), F.lit("c1ccccc1")).alias("benzene")
    maps = M.call("mol_substructure_matches_json", F.col("smiles"), F.lit("C#N")).alias("nitriles")
    names = F.array_join(F.transform(F.array_sort(F.map_entries("hits")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("mol_id", names.alias("hits"), hit, maps)


@query()
def w_rules(spark: SparkSession, d: str) -> DataFrame:
    """All rule panels natively over one descriptor pass, with the alert count."""
    rows = _profiled(spark, d, *rules.fields(), "structural_alert_count")
    valid = F.col("valid")
    picked = [rules.druglikeness_pass(F.lit(r.lower()), valid).alias(r.lower().replace("-", "_")) for r in rules.RULES]
    return rows.select("mol_id", "valid", rules.violations("Lipinski").alias("lipinski_violations"), *picked, "structural_alert_count")


@query()
def mol_reports(spark: SparkSession, d: str) -> DataFrame:
    """The full report and the alerts of every row as text."""
    return _profiled(spark, d, "admet_json", "structural_alerts_json")


@query()
def mol_mcs(spark: SparkSession, d: str) -> DataFrame:
    """Common substructures of all pairs of a record of each molecule table with one name; each pair of distinct texts is computed once."""
    left = table(spark, d, "selfies").select("name", F.col("mol_id").alias("a"), F.col("smiles").alias("x"))
    right = table(spark, d, "smiles").select("name", F.col("mol_id").alias("b"), F.col("smiles").alias("y"))
    both = meet(left, right, "name").select("x.a", "y.b", "x.x", "y.y")
    both = written(both, "records")
    texts = both.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    # Pairs differ in cost: they are spread evenly, so that dear ones don't gather in one task.
    made = texts.repartition(4 * spark.sparkContext.defaultParallelism).select(F.struct("x", "y").alias("texts"), "n", M.call("mcs_smarts", "x", "y").alias("mcs_smarts"), M.call("mcs_json", "x", "y").alias("mcs_json"))
    return join_back(both.select("a", "b", F.struct("x", "y").alias("texts")), written(made, "common"), "texts", "n").select("a", "b", "mcs_smarts", "mcs_json")


@query()
def mol_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Both fingerprints of every row, and a longer one."""
    rows = spread(table(spark, d, "smiles").select("mol_id", "smiles"))
    longer = M.call("morgan_fp", F.col("smiles"), F.lit(3), F.lit(4096)).alias("morgan_3_4096")
    return rows.select("mol_id", M.call("morgan_fp_bits", "smiles").alias("morgan_2_2048"), longer, M.call("maccs_keys", "smiles").alias("maccs"))


REFERENCE = "CC(=O)Oc1ccccc1C(=O)O"


def _fps(spark: SparkSession, d: str, field: str = "morgan_fp_bits") -> DataFrame:
    return workflows.fingerprints(table(spark, d, "smiles").select("mol_id", "smiles"), "smiles", field)


@query()
def w_rank_similar(spark: SparkSession, d: str) -> DataFrame:
    """The hundred molecules most similar to a reference."""
    return workflows.rank_similar(_fps(spark, d), REFERENCE, 100).select("mol_id", "sim")


@query()
def w_rank_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures against the reference for every molecule."""
    base = _fps(spark, d)
    for name in S.NAMES:
        weights = {"alpha": 0.9, "beta": 0.1} if name == "tversky_bit" else {}
        plan = workflows.rank_similar(base, REFERENCE, measure=name, **weights)
        base = plan.withColumnRenamed("sim", name)
    return base.select("mol_id", *S.NAMES)


@query()
def w_rank_keys(spark: SparkSession, d: str) -> DataFrame:
    """The hundred molecules whose structural keys are most similar to a reference's."""
    return workflows.rank_similar(_fps(spark, d, "maccs_keys"), REFERENCE, 100, field="maccs_keys").select("mol_id", "sim")


@query()
def sim_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different fingerprints with similarity of at least 0.9."""
    return workflows.threshold_join(_fps(spark, d), 0.9)


@query()
def sim_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the id that stands for its fingerprint in ``sim_pairs``, and the number of other rows with similarity of at least 0.9."""
    return workflows.similar_members(_fps(spark, d), 0.9)


@query()
def w_parents(spark: SparkSession, d: str) -> DataFrame:
    """Salt-free parents with the number of their records."""
    return workflows.parents(table(spark, d, "smiles"), "smiles", "mol_id")


@query()
def w_scaffolds(spark: SparkSession, d: str) -> DataFrame:
    """Records by generic and Murcko scaffold, with sums."""
    return workflows.scaffold_rollup(table(spark, d, "smiles"), "smiles")


@query()
def w_formula_check(spark: SparkSession, d: str) -> DataFrame:
    """Computed against expected composition, by source."""
    rows = M.profile(table(spark, d, "smiles").select("source", "smiles", "expected_formula", "expected_atoms", "expected_bonds"), "smiles", ["mol_formula", "mol_num_atoms", "mol_num_bonds"])
    same = [F.count_if(F.col(a) == F.col(b)).alias(n) for n, a, b in (("formula_ok", "mol_formula", "expected_formula"), ("atoms_ok", "mol_num_atoms", "expected_atoms"), ("bonds_ok", "mol_num_bonds", "expected_bonds"))]
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), *same)


@query()
def w_polymers(spark: SparkSession, d: str) -> DataFrame:
    """Open ends rewritten to hydrogen before extraction; here the first component's last atom stands open."""
    ends = F.concat(F.lit("*"), F.col("smiles"))
    rows = table(spark, d, "smiles").select("mol_id", F.replace(ends, F.lit("*"), F.lit("[H]")).alias("smiles"))
    return M.profile(rows, "smiles", ["mol_formula", "mol_weight", "num_rotatable_bonds"]).drop("smiles")


@query()
def text_selfies(spark: SparkSession, d: str) -> DataFrame:
    """Every row as tokens and back."""
    rows = table(spark, d, "selfies").select("mol_id", M.call("smiles_to_selfies", "smiles").alias("selfies"))
    return rows.select("mol_id", "selfies", M.call("selfies_to_smiles", "selfies").alias("back"), selfies_is_valid(F.col("selfies")).alias("valid"))


# --- InChI -------------------------------------------------------------------------------------------------------------------------------------------

_D_VALID = "(starts_with(inchi, 'InChI=') AND strlen(inchi) > 8)"
_D_LAYER = {n: f"CASE WHEN {_D_VALID} THEN regexp_extract(inchi, '/{x}([^/]*)', 1) END AS {n}" for n, x in inchi.LAYERS.items()}
_INCHI_NAMES = ["inchi_is_valid", "inchi_is_standard", "inchi_version", "inchi_formula", *inchi.LAYERS, "inchi_has_stereo", "inchi_num_stereo_centers"]


@query(
    f"""SELECT mol_id, {_D_VALID} AS inchi_is_valid, starts_with(inchi, 'InChI=1S/') AND strlen(inchi) > 8 AS inchi_is_standard,
    CASE WHEN {_D_VALID} AND contains(inchi, '/') THEN regexp_extract(inchi, '^InChI=([^/]*)/', 1) END AS inchi_version,
    CASE WHEN {_D_VALID} THEN nullif(regexp_extract(inchi, '^InChI=[^/]*/([^/]*)', 1), '') END AS inchi_formula, {", ".join(_D_LAYER.values())},
    {_D_VALID} AND (contains(inchi, '/b') OR contains(inchi, '/t')) AS inchi_has_stereo,
    CAST(CASE WHEN {_D_VALID} THEN CASE WHEN regexp_extract(inchi, '/t([^/]*)', 1) = '' THEN 0 ELSE len(string_split(regexp_extract(inchi, '/t([^/]*)', 1), ',')) END END AS INTEGER)
    AS inchi_num_stereo_centers FROM inchi"""
)
def inchi_layers(spark: SparkSession, d: str) -> DataFrame:
    """All parts of every identifier."""
    return table(spark, d, "inchi").select("mol_id", *[inchi.call(n, "inchi").alias(n) for n in _INCHI_NAMES])


@query(
    """SELECT mol_id, regexp_full_match(inchikey, '[A-Z]{14}-[A-Z]{10}-[A-Z]') AS inchikey_is_valid,
    CASE WHEN strlen(inchikey) >= 14 THEN substr(inchikey, 1, 14) END AS inchikey_connectivity, CASE WHEN strlen(inchikey) >= 25 THEN substr(inchikey, 16, 10) END AS inchikey_stereo,
    CASE WHEN strlen(inchikey) = 27 THEN substr(inchikey, 27, 1) END AS inchikey_protonation FROM inchikey"""
)
def inchi_keys(spark: SparkSession, d: str) -> DataFrame:
    """All parts of every key."""
    names = ["inchikey_is_valid", "inchikey_connectivity", "inchikey_stereo", "inchikey_protonation"]
    return table(spark, d, "inchikey").select("mol_id", *[inchi.call(n, "inchikey").alias(n) for n in names])


_D_SKELETON = "CASE WHEN contains(inchi, '/c') THEN regexp_extract(inchi, '/c([^/]*)', 1) END AS c, CASE WHEN contains(inchi, '/h') THEN regexp_extract(inchi, '/h([^/]*)', 1) END AS h"


@query(
    f"""WITH s AS (SELECT mol_id, nullif(regexp_extract(inchi, '^InChI=[^/]*/([^/]*)', 1), '') AS f, {_D_SKELETON} FROM inchi WHERE {_D_VALID})
    SELECT min(mol_id) AS keep_id, count(*) AS n, count(DISTINCT mol_id) AS molecules FROM s GROUP BY f, c, h"""
)
def inchi_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers by skeleton."""
    rows = table(spark, d, "inchi").withColumn("skeleton", inchi.skeleton("inchi")).filter("skeleton is not null")
    return rows.groupBy("skeleton").agg(F.min("mol_id").alias("keep_id"), F.count("*").alias("n"), F.countDistinct("mol_id").alias("molecules")).drop("skeleton")


# Every third molecule also stands with a stereo layer of its own, under its negative number.
@query(
    f"""WITH i AS (SELECT mol_id, inchi FROM inchi UNION ALL SELECT -mol_id, inchi || '/t1-' FROM inchi WHERE mol_id % 3 = 0),
    s AS (SELECT mol_id, nullif(regexp_extract(inchi, '^InChI=[^/]*/([^/]*)', 1), '') AS f, {_D_SKELETON}, contains(inchi, '/t') AS stereo FROM i WHERE {_D_VALID}),
    d AS (SELECT DISTINCT * FROM s)
    SELECT x.mol_id AS flat_id, y.mol_id AS stereo_id, true AS match FROM d x JOIN d y ON x.f IS NOT DISTINCT FROM y.f AND x.c IS NOT DISTINCT FROM y.c AND x.h IS NOT DISTINCT FROM y.h
    WHERE NOT x.stereo AND y.stereo"""
)
def inchi_skeleton_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one skeleton of which only the second has a tetrahedral layer, by an equi-join on the skeleton, and what the function says of them."""
    rows = table(spark, d, "inchi").select("mol_id", "inchi")
    rows = rows.unionAll(rows.filter("mol_id % 3 = 0").select(-F.col("mol_id"), F.concat("inchi", F.lit("/t1-"))))
    rows = rows.select("mol_id", "inchi", F.contains("inchi", F.lit("/t")).alias("stereo"), inchi.skeleton("inchi").alias("s")).filter("s is not null")
    rows = rows.groupBy("mol_id", "s", "stereo").agg(F.first("inchi").alias("inchi"))
    flat, stereo = rows.filter(~F.col("stereo")).select(F.col("mol_id").alias("flat_id"), F.col("inchi").alias("i")), rows.filter("stereo").select(F.col("mol_id").alias("stereo_id"), F.col("inchi").alias("j"))
    return inchi.skeleton_join(flat, stereo, "i", "j").select("flat_id", "stereo_id", inchi.call("inchi_skeleton_match", "i", "j").alias("match"))


# --- closed-form families ----------------------------------------------------------------------------------------------------------------------------

_ALKANOL = "concat(repeat('C', p_size), 'O')"


def _parts(spark: SparkSession, d: str, text: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", F.expr(text).alias("smiles"))


@query(
    """SELECT p_partkey, 'C' || CASE WHEN p_size > 1 THEN CAST(p_size AS VARCHAR) ELSE '' END || 'H' || CAST(2 * p_size + 2 AS VARCHAR) || 'O' AS mol_formula,
    CAST(p_size + 1 AS INTEGER) AS mol_num_atoms, CAST(p_size AS INTEGER) AS mol_num_bonds, round(12.011 * p_size + 1.008 * (2 * p_size + 2) + 15.999, 4)::DOUBLE AS mol_weight,
    round(12.0 * p_size + 1.00782503 * (2 * p_size + 2) + 15.99491462, 5)::DOUBLE AS mol_exact_mass, true AS valid FROM part"""
)
def f_composition(spark: SparkSession, d: str) -> DataFrame:
    """Composition of alkanols."""
    rows = M.profile(_parts(spark, d, _ALKANOL), "smiles", ["mol_formula", "mol_num_atoms", "mol_num_bonds", "mol_weight", "mol_exact_mass"])
    return rows.withColumn("mol_weight", F.round("mol_weight", 4)).withColumn("mol_exact_mass", F.round("mol_exact_mass", 5)).drop("smiles", "p_size")


_D_LOGP = "(0.1441 * (p_size - 1) - 0.2035 + 0.123 * (2 * p_size + 1) - 0.2893 - 0.2677)"
_D_MW = "(12.011 * p_size + 1.008 * (2 * p_size + 2) + 15.999)"


@query(
    f"""SELECT p_partkey, round({_D_LOGP}, 4)::DOUBLE AS logp_crippen, round(2.503 * (p_size - 1) + 2.753 + 1.057 * (2 * p_size + 1) + 0.8238 + 1.395, 4)::DOUBLE AS mol_mr,
    20.23::DOUBLE AS tpsa, 1 AS num_h_acceptors, 1 AS num_h_donors, CAST(greatest(p_size - 2, 0) AS INTEGER) AS num_rotatable_bonds, 0 AS ring_count, 1 AS num_heteroatoms,
    1.0::DOUBLE AS fraction_csp3 FROM part"""
)
def f_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of alkanols."""
    names = ["logp_crippen", "mol_mr", "tpsa", "num_h_acceptors", "num_h_donors", "num_rotatable_bonds", "ring_count", "num_heteroatoms", "fraction_csp3"]
    rows = M.profile(_parts(spark, d, _ALKANOL), "smiles", names)
    return rows.select("p_partkey", *[F.round(n, 4).alias(n) if n in ("logp_crippen", "mol_mr", "tpsa") else F.col(n) for n in names])


_RING_NAMES = [n for n in M.FIELDS if n.startswith(("num_aromatic", "num_aliphatic", "num_saturated"))]
# Alkylbenzenes, alkylcyclohexanes, alkylpiperidines and alkylpyridines by key.
_D_RINGS = {
    "num_aromatic_rings": "CASE WHEN p_partkey % 4 IN (0, 3) THEN 1 ELSE 0 END", "num_aliphatic_rings": "CASE WHEN p_partkey % 4 IN (1, 2) THEN 1 ELSE 0 END",
    "num_saturated_rings": "CASE WHEN p_partkey % 4 IN (1, 2) THEN 1 ELSE 0 END", "num_aromatic_heterocycles": "CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END",
    "num_aromatic_carbocycles": "CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END", "num_saturated_heterocycles": "CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END",
    "num_saturated_carbocycles": "CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END", "num_aliphatic_heterocycles": "CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END",
    "num_aliphatic_carbocycles": "CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END",
}
_RINGED = "concat(element_at(array('c1ccccc1', 'C1CCCCC1', 'C1CCNCC1', 'c1ccncc1'), int(p_partkey % 4) + 1), repeat('C', p_size))"


@query(f"""SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _D_RINGS.items())}, CASE p_partkey % 4 WHEN 0 THEN 'c1ccccc1' WHEN 1 THEN 'C1CCCCC1' WHEN 2 THEN 'C1CCCCN1' ELSE 'c1ccccn1' END
    AS murcko_scaffold, 'C1CCCCC1' AS generic_scaffold, 1 AS ring_count FROM part""")
def f_rings(spark: SparkSession, d: str) -> DataFrame:
    """Ring classes and scaffolds of rings with a chain."""
    return M.profile(_parts(spark, d, _RINGED), "smiles", [*_RING_NAMES, "murcko_scaffold", "generic_scaffold", "ring_count"]).drop("smiles", "p_size", "valid")


_D_CANON = "CASE WHEN p_size = 1 THEN 'CO' ELSE 'C(C)' || repeat('C', p_size - 2) || 'O' END"


@query(
    f"""SELECT p_partkey, {_D_CANON} || '.[Cl-].[Na+]' AS canonical_smiles, {_D_CANON} AS largest_fragment, {_D_CANON} AS strip_salts, {_D_CANON} AS fragment_parent,
    {_D_CANON} || '.[Cl-].[Na+]' AS neutralize_charges, {_D_CANON} || '.[Cl-].[Na+]' AS normalize_smiles FROM part"""
)
def f_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Canonical texts and fragments of salted alkanols."""
    names = ["canonical_smiles", "largest_fragment", "strip_salts", "fragment_parent", "neutralize_charges", "normalize_smiles"]
    return M.profile(_parts(spark, d, f"concat('[Na+].', {_ALKANOL}, '.[Cl-]')"), "smiles", names).drop("smiles", "p_size", "valid")


@query(
    f"""SELECT p_partkey, 'C' || CASE WHEN p_size > 1 THEN CAST(p_size AS VARCHAR) ELSE '' END || 'H' || CAST(2 * p_size + 2 AS VARCHAR) || 'O' AS formula, '0' AS net_charge,
    CASE WHEN p_size = 1 THEN '1,1' ELSE '1,1' || repeat(',2', p_size - 1) END AS degree_vector, CAST(p_size + 1 AS VARCHAR) || ':' || CAST(p_size AS VARCHAR) AS atom_bond_counts,
    {_D_CANON} AS element_graph, '' AS murcko_scaffold FROM part"""
)
def f_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash methods of alkanols."""
    rows = _parts(spark, d, _ALKANOL)
    return rows.select("p_partkey", *[M.call("mol_hash", F.col("smiles"), F.lit(m)).alias(m) for m in ("formula", "net_charge", "degree_vector", "atom_bond_counts", "element_graph", "murcko_scaffold")])


@query(
    """SELECT p_partkey, true AS has_oh, false AS has_ring, CAST(p_size - 1 AS INTEGER) AS carbon_bonds, 1 AS methyls, CAST(p_size - 1 AS INTEGER) AS methylenes, CAST(NULL AS BOOLEAN) AS bad_pattern
    FROM part"""
)
def f_substructures(spark: SparkSession, d: str) -> DataFrame:
    """Pattern matches in alkanols."""
    c = F.col("smiles")
    has, count = (lambda p: M.call("mol_has_substructure", c, F.lit(p))), (lambda p: M.call("mol_substructure_count", c, F.lit(p)))
    return _parts(spark, d, _ALKANOL).select(
        "p_partkey", has("[OX2H]").alias("has_oh"), has("[R]").alias("has_ring"), count("[#6]~[#6]").alias("carbon_bonds"), count("[CH3]").alias("methyls"), count("[CH2]").alias("methylenes"), has("C.C").alias("bad_pattern")
    )


@query(
    f"""SELECT p_partkey, CAST(({_D_MW} > 500)::INT + ({_D_LOGP} > 5)::INT AS INTEGER) AS lipinski_violations, CAST((({_D_MW} > 500)::INT + ({_D_LOGP} > 5)::INT <= 1) AS INTEGER) AS lipinski,
    CAST((greatest(p_size - 2, 0) <= 10) AS INTEGER) AS veber, CAST(({_D_LOGP} <= 5.88) AS INTEGER) AS egan, -2 AS unknown,
    CAST(({_D_MW} <= 350 AND {_D_LOGP} <= 3.5 AND greatest(p_size - 2, 0) <= 7) AS INTEGER) AS lead, 0 AS structural_alert_count FROM part"""
)
def f_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rule panels of alkanols."""
    rows = M.profile(_parts(spark, d, _ALKANOL), "smiles", [*rules.fields(), "structural_alert_count"])
    passed = [rules.druglikeness_pass(F.lit(r), F.col("valid")).alias(r) for r in ("lipinski", "veber", "egan", "unknown", "lead")]
    return rows.select("p_partkey", rules.violations("Lipinski").alias("lipinski_violations"), *passed, "structural_alert_count")


@query("""SELECT p_partkey, repeat('[C]', p_size) || '[O]' AS selfies, repeat('C', p_size) || 'O' AS back, true AS valid FROM part""")
def f_selfies(spark: SparkSession, d: str) -> DataFrame:
    """Alkanols as tokens and back."""
    rows = _parts(spark, d, _ALKANOL).select("p_partkey", M.call("smiles_to_selfies", "smiles").alias("selfies"))
    return rows.select("p_partkey", "selfies", M.call("selfies_to_smiles", "selfies").alias("back"), selfies_is_valid(F.col("selfies")).alias("valid"))


@query(
    """WITH p AS (SELECT p_partkey, 3 + p_size % 4 AS k, 3 + p_size % 3 AS m FROM part)
    SELECT p_partkey, CAST(least(k, m) AS INTEGER) AS num_atoms, CAST(least(k, m) - 1 AS INTEGER) AS num_bonds FROM p"""
)
def f_mcs(spark: SparkSession, d: str) -> DataFrame:
    """Common substructures of short chains: the shorter one."""
    rows = table(spark, d, "part").select("p_partkey", F.expr("repeat('C', int(3 + p_size % 4))").alias("x"), F.expr("repeat('C', int(3 + p_size % 3))").alias("y"))
    rows = rows.withColumn("j", M.call("mcs_json", "x", "y"))
    return rows.select("p_partkey", *[F.get_json_object("j", f"$.{n}").cast("int").alias(n) for n in ("num_atoms", "num_bonds")])


_D_PAIR = """WITH e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id, CAST(len(list_filter(list_zip(a.embedding, b.embedding), lambda x: x[1] > 0 AND x[2] > 0)) AS DOUBLE) AS c,
    CAST(len(list_filter(a.embedding, lambda x: x > 0)) AS DOUBLE) AS p, CAST(len(list_filter(b.embedding, lambda x: x > 0)) AS DOUBLE) AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""


@query(
    f"""{_D_PAIR} SELECT vec_id, round(c / (p + q - c), 9) AS tanimoto_bit, round(2 * c / (p + q), 9) AS dice_bit, round(c / sqrt(p * q), 9) AS cosine_bit,
    round(c * (p + q) / (2 * p * q), 9) AS kulczynski_bit, round(c / (2 * p + 2 * q - 3 * c), 9) AS sokal_bit, round((c * (p + q) - p * q) / (p * q), 9) AS mcconnaughey_bit,
    round(c / least(p, q), 9) AS asymmetric_bit, round(c / greatest(p, q), 9) AS braun_blanquet_bit, round(c / 64, 9) AS russel_bit,
    round(c / (0.7 * p + 0.2 * q + (1 - 0.7 - 0.2) * c), 9) AS tversky_bit FROM p"""
)
def f_similarity(spark: SparkSession, d: str) -> DataFrame:
    """All measures between neighbouring rows of signs packed into bits."""
    word = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")).alias("b")), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    e = table(spark, d, "embeddings").select("vec_id", F.unhex(F.lpad(F.hex(word), 16, "0")).alias("fp"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("other")), "vec_id")
    picked = [F.round(S.call(n, F.col("fp"), F.col("other"), *((0.7, 0.2) if n == "tversky_bit" else ())), 9).alias(n) for n in S.NAMES]
    return both.select("vec_id", *picked)


# --- virtual screening -------------------------------------------------------------------------------------------------------------------------------

_D_VS = """WITH r AS (SELECT target, score, label, row_number() OVER (PARTITION BY target ORDER BY score, coalesce(mol_id, -1), label, measured_at, loaded_at) AS place,
    rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0 AS mean_rank, count(*) OVER (PARTITION BY target) AS n,
    sum(label::INT) OVER (PARTITION BY target) AS a FROM screen WHERE score IS NOT NULL AND NOT isnan(score) AND label IS NOT NULL),
    g AS (SELECT target, max(n)::DOUBLE AS n, max(a)::DOUBLE AS a, sum(CASE WHEN label THEN mean_rank ELSE 0 END)::DOUBLE AS ranks,
    sum(CASE WHEN label AND place <= least(greatest(floor(0.1 * n + 0.5), 1), n) THEN 1 ELSE 0 END)::DOUBLE AS hits, sum(CASE WHEN label THEN exp(-20.0 * place / n) ELSE 0 END)::DOUBLE AS e FROM r GROUP BY target)"""


@query(
    f"""{_D_VS} SELECT target, n::BIGINT AS n, a::BIGINT AS actives, CASE WHEN a > 0 AND a < n THEN round(1 - (ranks - a * (a + 1) / 2) / (a * (n - a)), 6) END AS roc_auc,
    CASE WHEN a > 0 THEN round((hits / least(greatest(floor(0.1 * n + 0.5), 1), n)) / (a / n), 6) END AS enrichment,
    CASE WHEN a > 0 AND a < n THEN round((e / a) / ((1 / n) * ((1 - exp(-20.0)) / (exp(20.0 / n) - 1))) * (a / n) * ((exp(10.0) - exp(-10.0)) / 2)
    / ((exp(10.0) + exp(-10.0)) / 2 - (exp(10.0 - 20.0 * a / n) + exp(-10.0 + 20.0 * a / n)) / 2) + 1 / (1 - exp(20.0 * (1 - a / n))), 6) END AS bedroc FROM g"""
)
def vs_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of every target."""
    rows = table(spark, d, "screen").withColumn("id", F.coalesce("mol_id", F.lit(-1)))
    out = screening.metrics_by_group(rows, ["target"], "score", "label", ["id", "_l", "measured_at", "loaded_at"])
    return out.select("target", F.col("n").cast("bigint").alias("n"), F.col("actives").cast("bigint").alias("actives"), *[F.round(c, 6).alias(c) for c in ("roc_auc", "enrichment", "bedroc")])


_D_LISTS = "WITH s AS (SELECT mol_id, score, label FROM screen WHERE score IS NOT NULL AND NOT isnan(score) AND label IS NOT NULL AND mol_id IS NOT NULL)"
#: Rows of a molecule up to which they are made a list; beyond, the same metrics come from counts.
LIST_ROWS = 10_000


@query(
    f"""{_D_LISTS}, r AS (SELECT mol_id, label, rank() OVER (PARTITION BY mol_id ORDER BY score) + (count(*) OVER (PARTITION BY mol_id, score) - 1) / 2.0 AS k,
    row_number() OVER (PARTITION BY mol_id ORDER BY score, label) AS place, count(*) OVER (PARTITION BY mol_id)::DOUBLE AS n FROM s),
    g AS (SELECT mol_id, max(n) AS n, sum(label::INT)::DOUBLE AS a, sum(CASE WHEN label THEN k ELSE 0 END)::DOUBLE AS ranks,
    sum(CASE WHEN label AND place <= least(greatest(floor(0.1 * n + 0.5), 1), n) THEN 1 ELSE 0 END)::DOUBLE AS hits, sum(CASE WHEN label THEN exp(-20.0 * place / n) ELSE 0 END)::DOUBLE AS e FROM r GROUP BY mol_id)
    SELECT mol_id, n::BIGINT AS n, CASE WHEN a > 0 AND a < n THEN round(1 - (ranks - a * (a + 1) / 2) / (a * (n - a)), 6)::DOUBLE + 0 END AS roc_auc,
    CASE WHEN a > 0 THEN round((hits / least(greatest(floor(0.1 * n + 0.5), 1), n)) / (a / n), 6) + 0 END AS enrichment,
    CASE WHEN a > 0 AND a < n THEN round((e / a) / ((1 / n) * ((1 - exp(-20.0)) / (exp(20.0 / n) - 1))) * (a / n) * ((exp(10.0) - exp(-10.0)) / 2)
    / ((exp(10.0) + exp(-10.0)) / 2 - (exp(10.0 - 20.0 * a / n) + exp(-10.0 + 20.0 * a / n)) / 2) + 1 / (1 - exp(20.0 * (1 - a / n))), 6) + 0 END AS bedroc FROM g"""
)
def vs_lists(spark: SparkSession, d: str) -> DataFrame:
    """The list forms of the metrics: how well targets are told apart for every molecule."""
    rows = table(spark, d, "screen").filter("score is not null and not isnan(score) and label is not null and mol_id is not null").select("mol_id", "score", "label")
    many = written(rows.groupBy("mol_id").agg(F.count("*").alias("n")).filter(F.col("n") > LIST_ROWS), "many")
    lists = rows.join(many, "mol_id", "left_anti").groupBy("mol_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("score", "label"))).alias("rows"))
    scores, labels = F.col("rows.score"), F.col("rows.label")
    values = [screening.roc_auc(scores, labels), screening.enrichment_factor(scores, labels, F.lit(0.1)), screening.bedroc(scores, labels, F.lit(20.0))]
    names = ["roc_auc", "enrichment", "bedroc"]
    # Adding 0 makes one zero of both.
    out = lists.select("mol_id", "n", *[F.when(~F.isnan(v), F.round(v, 6) + 0.0).alias(n) for v, n in zip(values, names, strict=True)])
    long = screening.metrics_by_group(rows.join(many, "mol_id", "left_semi"), ["mol_id"], "score", "label", ["_l"])
    return out.unionAll(long.select("mol_id", F.col("n").cast("bigint").alias("n"), *[(F.round(n, 6) + 0.0).alias(n) for n in names]))


#: A receptor of a serine and an aspartate, and the box the docking query searches.
RECEPTOR = "\n".join(
    f"ATOM  {i:>5}  {n:<3} {r} A{k:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {n[0]}"
    for i, (n, r, k, x, y, z) in enumerate(
        [("N", "SER", 1, 0.0, 0.0, 0.0), ("CA", "SER", 1, 1.46, 0.0, 0.0), ("C", "SER", 1, 2.0, 1.42, 0.0), ("O", "SER", 1, 1.3, 2.4, 0.0), ("CB", "SER", 1, 2.0, -0.8, 1.2),
         ("OG", "SER", 1, 1.5, -2.1, 1.2), ("N", "ASP", 2, 3.3, 1.5, 0.0), ("CA", "ASP", 2, 4.0, 2.8, 0.0), ("CB", "ASP", 2, 5.5, 2.6, 0.0), ("CG", "ASP", 2, 6.1, 1.9, 1.2),
         ("OD1", "ASP", 2, 5.4, 1.5, 2.1), ("OD2", "ASP", 2, 7.3, 1.8, 1.2)], 1
    )
)


@query()
def vs_docking(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the molecule table docked to a small receptor, with both PDBQT texts; each distinct text is docked once. Rows without a valid molecule have nulls."""
    rows = table(spark, d, "smiles").select("mol_id", "smiles")
    texts = rows.filter("smiles is not null").groupBy("smiles").agg(F.count("*").alias("copies"))
    out = dockings.dock_ligands(texts, "smiles", RECEPTOR, (3.0, 0.0, 4.0), (7.0, 7.0, 7.0), runs=4, seed=11)
    docked = written(out.select("smiles", "copies", "score", "ligand"), "docked")
    texts = [dockings.UDFS["prepare_receptor"](F.lit(RECEPTOR), F.lit(7.4)).alias("receptor"), dockings.UDFS["pdb_to_pdbqt"](F.lit(RECEPTOR)).alias("plain")]
    return join_back(rows, docked, "smiles", "copies").select("mol_id", "smiles", "score", "ligand", *texts)


# --- MOL, SDF and structure texts --------------------------------------------------------------------------------------------------------------------

# One atom per line item: quantity, line number and discount as coordinates, the return flag as element (A: C, N: N, R: O) and chain.
_SYMBOL = "CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END"
_ITEMS = "l_orderkey, l_linenumber, l_returnflag, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, round(l_discount * 10, 2) AS z"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").selectExpr(*_ITEMS.split(", ", 5)[:5], "round(l_discount * 10, 2) AS z", f"{_SYMBOL} AS symbol")
    line = F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", "x", "y", "z", "symbol")
    orders = items.repartition(tasks(spark), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("atoms"), F.count("*").alias("n"))
    head = F.format_string("order %d\n  made\n\n%3d  0  0  0  0  0  0  0  0  0999 V2000\n", "l_orderkey", "n")
    return orders.select("l_orderkey", F.concat(head, "atoms", F.lit("\nM  END\n> <ID>\n"), F.col("l_orderkey").cast("string"), F.lit("\n\n")).alias("block"))


_D_ITEMS = "SELECT l_orderkey, l_returnflag, l_linenumber, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(CAST(round(l_discount * 10, 2) AS FLOAT) AS DOUBLE) AS z FROM lineitem"
_D_EXTENT = ", ".join(f"round(avg({a}), 3) AS centroid_{a}, round(min({a}), 3) AS min_{a}, round(max({a}), 3) AS max_{a}" for a in "xyz")
_D_SPREAD = "round(sqrt(greatest(var_pop(x) + var_pop(y) + var_pop(z), 0)), 3) AS radius_of_gyration"
_EXTENTS = [f"{n}_{a}" for a in "xyz" for n in ("centroid", "min", "max")] + ["radius_of_gyration"]
_BLOCK_WEIGHT = "sum(CASE l_returnflag WHEN 'A' THEN 12.011 WHEN 'N' THEN 14.007 ELSE 15.999 END)"
_D_COUNTED = "CASE WHEN {c} = 0 THEN '' WHEN {c} = 1 THEN '{s}' ELSE '{s}' || {c} END"
_D_BLOCK_FORMULA = " || ".join(_D_COUNTED.format(c=f"count(*) FILTER (l_returnflag = '{f}')", s=s) for f, s in (("A", "C"), ("N", "N"))) + " || " + _D_COUNTED.format(c="count(*) FILTER (l_returnflag NOT IN ('A', 'N'))", s="O")


@query(
    f"""WITH i AS ({_D_ITEMS}) SELECT l_orderkey, 'order ' || l_orderkey AS name, {_D_BLOCK_FORMULA} AS formula, round({_BLOCK_WEIGHT}, 3)::DOUBLE AS weight,
    CAST(count(*) AS INTEGER) AS num_atoms, 0 AS num_bonds, max(abs(z)) > 0.0001 AS has_3d, CAST(l_orderkey AS VARCHAR) AS id, {_D_EXTENT}, {_D_SPREAD} FROM i GROUP BY l_orderkey"""
)
def text_mol_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A MOL text for every order, made and read again."""
    plain = ["name", "formula", "num_atoms", "num_bonds", "has_3d"]
    rows = texts3d.text_profile(_blocks(spark, d), "block", [f"mol_block_{n}" for n in (*plain, "weight", *_EXTENTS)])
    prop = texts3d.UDFS["mol_block_property"](F.col("block"), F.lit("ID")).alias("id")
    return rows.select("l_orderkey", *[F.col(f"mol_block_{n}").alias(n) for n in plain], F.round("mol_block_weight", 3).alias("weight"), prop, *[F.round(f"mol_block_{n}", 3).alias(n) for n in _EXTENTS])


@query()
def text_mol_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON forms of the same texts."""
    return spread(_blocks(spark, d)).select("l_orderkey", *[texts3d.UDFS[f"mol_block_{n}"](F.col("block")).alias(n) for n in ("json", "atoms_json", "bonds_json", "properties_json")])


@query(
    """WITH b AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT o_custkey, CAST(count(*) AS INTEGER) AS records, CAST(min(o_orderkey) AS VARCHAR) AS first_id, CAST(NULL AS VARCHAR) AS no_id FROM b GROUP BY o_custkey"""
)
def text_sdf(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each customer's orders as one SDF text."""
    prop = lambda n: texts3d.UDFS["sdf_property"](F.col("sdf"), F.lit(n), F.lit("ID"))
    return _sdf(spark, d).select("o_custkey", texts3d.UDFS["sdf_count"](F.col("sdf")).alias("records"), prop(1).alias("first_id"), prop(0).alias("no_id"))


def _sdf(spark: SparkSession, d: str) -> DataFrame:
    """One SDF text for every customer: a customer has few orders."""
    rows = _blocks(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "block"))), lambda r: F.concat(r["block"], F.lit("$$$$\n")))
    return rows.repartition(tasks(spark), "o_custkey").groupBy("o_custkey").agg(F.array_join(blocks, "").alias("sdf"))


def _pdb(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").selectExpr(*_ITEMS.split(", ", 5)[:5], "round(l_discount * 10, 2) AS z", f"{_SYMBOL} AS symbol")
    line = F.format_string("%-6s%5d  %-3s ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           %s", F.when(F.col("l_returnflag") == "R", "HETATM").otherwise("ATOM"), "l_linenumber", "symbol", "l_returnflag", "l_linenumber", "x", "y", "z", "symbol")
    return items.repartition(tasks(spark), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))


def read_structures(texts: DataFrame) -> DataFrame:
    """Counts and extents of the structure in ``text`` of every order."""
    counts = ["atom_count", "chain_count", "residue_count", "model_count"]
    rows = texts3d.text_profile(texts, "text", [f"structure_{n}" for n in (*counts, *_EXTENTS)])
    return rows.select("l_orderkey", *[F.col(f"structure_{n}").alias(n) for n in counts], *[F.round(f"structure_{n}", 3).alias(n) for n in _EXTENTS])


_D_STRUCT = f"""WITH i AS ({_D_ITEMS}) SELECT l_orderkey, CAST(count(*) AS INTEGER) AS atom_count, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS chain_count,
    CAST(count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_returnflag || l_linenumber END) AS INTEGER) AS residue_count, 1 AS model_count, {_D_EXTENT}, {_D_SPREAD} FROM i GROUP BY l_orderkey"""


@query(_D_STRUCT)
def text_structures(spark: SparkSession, d: str) -> DataFrame:
    """A PDB text for every order, made and read again by the functions."""
    return read_structures(_pdb(spark, d))


@query(_D_STRUCT)
def text_structure_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The same, by exploding texts into atoms and plain aggregates over them."""
    stats = texts3d.structure_stats(texts3d.explode_atoms(_pdb(spark, d), "text"), ["l_orderkey"])
    return stats.select("l_orderkey", "atom_count", "chain_count", "residue_count", "model_count", *[F.round(n, 3).alias(n) for n in _EXTENTS])


# --- relational plans and streams --------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey) AS customers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority"""
)
def r_join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Joins over three keys with sums and a distinct count."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_custkey").alias("customers"))


@query("""SELECT mol_id, name FROM smiles s WHERE EXISTS (SELECT 1 FROM inchi i WHERE i.mol_id = s.mol_id) AND NOT EXISTS (SELECT 1 FROM screen c WHERE c.mol_id = s.mol_id)""")
def r_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Molecules with an identifier and without a measurement."""
    return table(spark, d, "smiles").join(table(spark, d, "inchi"), "mol_id", "left_semi").join(table(spark, d, "screen"), "mol_id", "left_anti").select("mol_id", "name")


@query(
    """SELECT target, place, mol_id, score FROM (SELECT target, mol_id, score, row_number() OVER (PARTITION BY target ORDER BY score, mol_id, measured_at, loaded_at) AS place FROM screen
    WHERE score IS NOT NULL AND NOT isnan(score) AND mol_id IS NOT NULL) WHERE place <= 3"""
)
def r_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three best measurements of every target."""
    w = W.partitionBy("target").orderBy("score", "mol_id", "measured_at", "loaded_at")
    rows = table(spark, d, "screen").filter("score is not null and not isnan(score) and mol_id is not null")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 3").select("target", "place", "mol_id", "score")


@query("""SELECT target, label, count(*) AS n, CAST(round(sum(CASE WHEN isnan(score) THEN NULL ELSE score END) * 1000) AS BIGINT) AS milli, grouping(target, label) AS level FROM screen GROUP BY CUBE (target, label)""")
def r_cube(spark: SparkSession, d: str) -> DataFrame:
    """Grouping sets over target and label."""
    clean = F.when(~F.isnan("score"), F.col("score"))
    return table(spark, d, "screen").cube("target", "label").agg(F.count("*").alias("n"), F.round(F.sum(clean) * 1000).cast("bigint").alias("milli"), F.grouping_id().alias("level"))


@query("""(SELECT name FROM smiles INTERSECT SELECT name FROM selfies) EXCEPT SELECT name FROM inchi""")
def r_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Names in two tables and not in a third."""
    names = lambda t: table(spark, d, t).select("name")
    return names("smiles").intersect(names("selfies")).subtract(names("inchi"))


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"""
)
def r_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream that keeps all windows open, run over all that is there."""
    counts = streams.windowed_counts(streams.read_stream(spark, f"{d}/events.parquet*"), "ts", ["event_type"], "1 hour", "36500 days")
    out = streams.run_updates(counts, ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query()
def r_stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of molecules on a stream, into a table."""
    stream = streams.read_stream(spark, f"{d}/selfies.parquet*").select("mol_id", "smiles")
    return streams.run_all(streams.profile_stream(stream, "smiles", ["mol_formula", "mol_weight"])).drop("smiles")


#: All SQL names that run in Python workers, for the record of what the queries above cover.
FUNCTION_NAMES = tuple(python_functions())
