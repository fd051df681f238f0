"""Registered queries over text formats, sources and sinks, typed results, table functions, time joins and streams with lateness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import molecules as M
from retort.functions import similarity as S
from retort.functions import texts3d, typed
from retort.functions.registry import register_all
from retort.operators.ranges import asof_join, range_join
from retort.plans import queries as Q
from retort.session import checkpoint_dir, shared, tasks
from retort.sources import sdf
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


# --- MOL texts of version 3000, mmCIF and XYZ, made from line items and read again -----------------------------------------------------------------------


def _grouped(spark: SparkSession, d: str, line: F.Column) -> DataFrame:
    """The lines of every order in the order of their numbers, and how many: an order has few items."""
    items = table(spark, d, "lineitem").selectExpr(*Q._ITEMS.split(", ", 5)[:5], "round(l_discount * 10, 2) AS z", f"{Q._SYMBOL} AS symbol")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line"))))
    return items.repartition(tasks(spark), "l_orderkey").groupBy("l_orderkey").agg(lines.alias("rows"), F.count("*").alias("n"))


def _v3000(spark: SparkSession, d: str) -> DataFrame:
    """A chain: item i is bound to item i + 1, by bonds of orders 1, 2 and 3 in turn."""
    orders = _grouped(spark, d, F.format_string("%s %.4f %.4f %.4f 0", "symbol", "x", "y", "z"))
    atoms = F.transform("rows", lambda r, i: F.concat(F.lit("M  V30 "), (i + 1).cast("string"), F.lit(" "), r["line"]))
    bonds = F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r, i: F.format_string("M  V30 %d %d %d %d", i + 1, i % 3 + 1, i + 1, i + 2))
    head = F.format_string("order %d\n  made\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS %d %d 0 0 0\nM  V30 BEGIN ATOM", "l_orderkey", "n", F.col("n") - 1)
    text = F.concat_ws(
        "\n", head, F.array_join(atoms, "\n"), F.lit("M  V30 END ATOM\nM  V30 BEGIN BOND"), F.when(F.col("n") > 1, F.array_join(bonds, "\n")),
        F.lit("M  V30 END BOND\nM  V30 END CTAB\nM  END\n> <ID>"), F.col("l_orderkey").cast("string"), F.lit("\n"),
    )
    return orders.select("l_orderkey", text.alias("block"))


@query(
    f"""WITH i AS ({Q._D_ITEMS}) SELECT l_orderkey, 'order ' || l_orderkey AS name, {Q._D_BLOCK_FORMULA} AS formula, round({Q._BLOCK_WEIGHT}, 3)::DOUBLE AS weight,
    CAST(count(*) AS INTEGER) AS num_atoms, CAST(count(*) - 1 AS INTEGER) AS num_bonds, max(abs(z)) > 0.0001 AS has_3d, CAST(l_orderkey AS VARCHAR) AS id, {Q._D_EXTENT}, {Q._D_SPREAD} FROM i GROUP BY l_orderkey"""
)
def text_mol_v3000(spark: SparkSession, d: str) -> DataFrame:
    """A MOL text of version 3000 with bonds for every order, made and read again."""
    plain = ["name", "formula", "num_atoms", "num_bonds", "has_3d"]
    rows = texts3d.text_profile(_v3000(spark, d), "block", [f"mol_block_{n}" for n in (*plain, "weight", *Q._EXTENTS)])
    prop = texts3d.UDFS["mol_block_property"](F.col("block"), F.lit("ID")).alias("id")
    return rows.select("l_orderkey", *[F.col(f"mol_block_{n}").alias(n) for n in plain], F.round("mol_block_weight", 3).alias("weight"), prop, *[F.round(f"mol_block_{n}", 3).alias(n) for n in Q._EXTENTS])


_ATOM_JSON = "array<struct<index: int, symbol: string, x: double, y: double, z: double>>"
_BOND_JSON = "array<struct<index: int, atom1: int, atom2: int, bond_type: int>>"


@query(
    f"""WITH i AS ({Q._D_ITEMS}), n AS (SELECT l_orderkey, count(*) AS n, round(sum(x), 2) AS sum_x, round(sum(y), 2) AS sum_y, round(sum(z), 2) AS sum_z FROM i GROUP BY l_orderkey)
    SELECT l_orderkey, 'order ' || l_orderkey AS name, n::INTEGER AS atoms, (n - 1)::INTEGER AS bonds, sum_x::DOUBLE AS sum_x, sum_y::DOUBLE AS sum_y, sum_z::DOUBLE AS sum_z, (n * n - 1)::BIGINT AS ends,
    (n - 1 + 3 * ((n - 1) // 3) + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS types, CAST(l_orderkey AS VARCHAR) AS id, n::INTEGER AS listed FROM n"""
)
def text_mol_json_read(spark: SparkSession, d: str) -> DataFrame:
    """The JSON forms of the same texts, parsed again: counts and sums of what they hold."""
    call = lambda n: texts3d.UDFS[f"mol_block_{n}"](F.col("block"))
    made = _v3000(spark, d).select("l_orderkey", *[call(n).alias(n) for n in ("json", "atoms_json", "bonds_json", "properties_json")])
    whole = F.from_json("json", f"name string, num_atoms int, num_bonds int, atoms {_ATOM_JSON}, bonds {_BOND_JSON}, properties array<struct<name: string, value: string>>")
    atoms, bonds, props = F.from_json("atoms_json", _ATOM_JSON), F.from_json("bonds_json", _BOND_JSON), F.from_json("properties_json", "array<struct<name: string, value: string>>")
    rows = made.select("l_orderkey", whole.alias("w"), atoms.alias("a"), bonds.alias("b"), props.alias("p"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 2)
    count = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, v: t + v)
    return rows.select(
        "l_orderkey", F.col("w.name").alias("name"), F.col("w.num_atoms").alias("atoms"), F.size("w.bonds").alias("bonds"), *[total(F.col(f"a.{x}")).alias(f"sum_{x}") for x in "xyz"],
        (count(F.col("b.atom1")) + count(F.col("b.atom2"))).alias("ends"), count(F.col("b.bond_type")).alias("types"), F.col("p")[0]["value"].alias("id"), F.element_at(F.col("a.index"), -1).alias("listed"),
    )


@query("""WITH b AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT o_custkey, CAST(count(*) AS INTEGER) AS records, CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(count(*) AS INTEGER) AS last_record FROM b GROUP BY o_custkey""")
def text_sdf_json(spark: SparkSession, d: str) -> DataFrame:
    """All properties of each customer's SDF text as JSON, parsed again."""
    rows = F.from_json(texts3d.UDFS["sdf_properties_json"](F.col("sdf")), "array<struct<record: int, name: string, properties: array<struct<name: string, value: string>>>>")
    ids = F.aggregate(F.transform("r", lambda x: x["properties"][0]["value"].cast("bigint")), F.lit(0).cast("bigint"), lambda t, v: t + v)
    return Q._sdf(spark, d).select("o_custkey", rows.alias("r")).select("o_custkey", F.size("r").alias("records"), ids.alias("ids"), F.element_at(F.col("r.record"), -1).alias("last_record"))


@query(Q._D_STRUCT)
def text_structures_cif(spark: SparkSession, d: str) -> DataFrame:
    """The same structures as mmCIF texts."""
    orders = _grouped(spark, d, F.concat_ws(" ", F.when(F.col("l_returnflag") == "R", "HETATM").otherwise("ATOM"), "symbol", F.concat(F.lit("'"), F.col("symbol"), F.lit("1'")), "l_returnflag", F.col("l_linenumber").cast("string"), F.format_string("%.3f %.3f %.3f", "x", "y", "z")))
    names = ("group_PDB", "type_symbol", "label_atom_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")
    head = F.concat(F.lit("data_"), F.col("l_orderkey").cast("string"), F.lit("\n#\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names)))
    return Q.read_structures(orders.select("l_orderkey", F.concat(head, F.array_join("rows.line", "\n"), F.lit("\n#\n")).alias("text")))


@query(
    f"""WITH i AS ({Q._D_ITEMS}) SELECT l_orderkey, CAST(2 * count(*) AS INTEGER) AS atom_count, 1 AS chain_count, 1 AS residue_count, 2 AS model_count, {Q._D_EXTENT}, {Q._D_SPREAD} FROM i GROUP BY l_orderkey"""
)
def text_structures_xyz(spark: SparkSession, d: str) -> DataFrame:
    """The same structures as XYZ texts of two equal frames."""
    orders = _grouped(spark, d, F.format_string("%s %.3f %.3f %.3f", "symbol", "x", "y", "z"))
    frame = F.concat(F.col("n").cast("string"), F.lit("\norder\n"), F.array_join("rows.line", "\n"), F.lit("\n"))
    return Q.read_structures(orders.select("l_orderkey", F.concat(frame, frame).alias("text")))


# --- sources and sinks -------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT mol_id, name, smiles, expected_atoms, author FROM smiles")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV with quotes, blanks, nulls and empty texts, and read again."""
    columns = ["mol_id", "name", "smiles", "expected_atoms", "author"]
    path = shared(spark, "csv")
    sdf.write_csv(table(spark, d, "smiles").select(*columns), path)
    return sdf.read_csv(spark, path, "mol_id bigint, name string, smiles string, expected_atoms int, author string")


@query(f"""WITH i AS ({Q._D_ITEMS}) SELECT 'order ' || l_orderkey AS name, CAST(count(*) AS INTEGER) AS atoms, CAST(l_orderkey AS VARCHAR) AS id, round(sum(x), 2)::DOUBLE AS sum_x FROM i GROUP BY l_orderkey""")
def src_sdf(spark: SparkSession, d: str) -> DataFrame:
    """MOL texts written as SDF files and read again record by record."""
    path = shared(spark, "sdf")
    sdf.write_sdf(Q._blocks(spark, d), "block", path)
    mol = F.col("mol")
    total = F.aggregate(mol["atoms"]["x"], F.lit(0.0), lambda t, v: t + v.cast("double"))
    return sdf.read_sdf(spark, path).select(mol["name"].alias("name"), F.size(mol["atoms"]).alias("atoms"), mol["properties"][0]["value"].alias("id"), F.round(total, 2).alias("sum_x"))


@query("SELECT n_nationkey, n_name, CAST(n_nationkey + 1 AS INTEGER) AS atoms, 1 AS models, round(n_nationkey / 2.0, 3)::DOUBLE AS centroid_x FROM nation")
def src_texts(spark: SparkSession, d: str) -> DataFrame:
    """One structure file per nation, written and read as whole texts."""
    atoms = F.transform(F.sequence(F.lit(0), F.col("n_nationkey").cast("int")), lambda i: F.format_string("C %d.0 0.0 0.0", i))
    text = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit("\n"), F.col("n_name"), F.lit("\n"), F.array_join(atoms, "\n"))
    path = shared(spark, "texts")
    sdf.write_texts(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), text.alias("text")), "key", "text", path)
    rows = sdf.read_texts(spark, path).withColumn("n_nationkey", F.regexp_extract("file", r"key=(\d+)", 1).cast("bigint"))
    call = lambda n: texts3d.UDFS[f"structure_{n}"](F.col("text"))
    return rows.select("n_nationkey", F.split("text", "\n")[1].alias("n_name"), call("atom_count").alias("atoms"), call("model_count").alias("models"), F.round(call("centroid_x"), 3).alias("centroid_x"))


# --- typed results, table functions, aggregates ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, 1 AS systems, 6 AS ring_size, p_partkey % 4 IN (0, 3) AS aromatic, CASE p_partkey % 4 WHEN 0 THEN 'c1ccccc1' WHEN 1 THEN 'C1CCCCC1' WHEN 2 THEN 'C1CCCCN1' ELSE 'c1ccccn1' END AS murcko,
    CAST(p_size + 6 AS INTEGER) AS common_atoms, CAST(p_size + 6 AS INTEGER) AS common_bonds, CAST(p_size - 1 AS INTEGER) AS chain_matches, 0 AS alerts FROM part"""
)
def t_typed(spark: SparkSession, d: str) -> DataFrame:
    """Typed twins over rings with a chain: ring systems, scaffold network, common substructure with itself, matches, alerts."""
    rows = Q._parts(spark, d, Q._RINGED)
    f = typed.UDFS
    rows = rows.select(
        "p_partkey", f["ring_systems"]("smiles").alias("s"), f["scaffold_network"]("smiles").alias("n"), f["mcs"](F.col("smiles"), F.col("smiles")).alias("c"),
        f["mol_substructure_matches"](F.col("smiles"), F.lit("[C;!R;D2]")).alias("m"), f["structural_alerts"]("smiles").alias("a"),
    )
    scaffold = F.filter("n.nodes", lambda x: x["kind"] == "murcko_scaffold")[0]["smiles"]
    return rows.select(
        "p_partkey", F.size("s").alias("systems"), F.col("s")[0]["rings"][0]["size"].alias("ring_size"), F.col("s")[0]["aromatic"].alias("aromatic"), scaffold.alias("murcko"),
        F.col("c.num_atoms").alias("common_atoms"), F.col("c.num_bonds").alias("common_bonds"), F.size("m").alias("chain_matches"), F.size("a").alias("alerts"),
    )


@query("""SELECT p_partkey, k::INTEGER AS "match", k::INTEGER AS "first", (k + 1)::INTEGER AS "second", 'C-C' AS symbols FROM part, range(1, p_size) AS r(k)""")
def t_lateral(spark: SparkSession, d: str) -> DataFrame:
    """A table function for every row: all carbon bonds of alkanols."""
    typed.register_typed(spark)
    Q._parts(spark, d, Q._ALKANOL).createOrReplaceTempView("alkanols")
    return spark.sql(
        "SELECT p_partkey, m.match, m.atom_indices[0] AS first, m.atom_indices[1] AS second, array_join(m.symbols, '-') AS symbols FROM alkanols, LATERAL substructure_matches(smiles, 'CC') m"
    )


@query(
    f"""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS resid, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS element,
    round(x, 2)::DOUBLE AS x, l_returnflag = 'R' AS is_hetatm FROM ({Q._D_ITEMS})"""
)
def t_lateral_atoms(spark: SparkSession, d: str) -> DataFrame:
    """A table function over structure texts: their atoms."""
    typed.register_typed(spark)
    line = F.format_string("%-6s%5d  %-3s ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           %s", F.when(F.col("l_returnflag") == "R", "HETATM").otherwise("ATOM"), "l_linenumber", "symbol", "l_returnflag", "l_linenumber", "x", "y", "z", "symbol")
    _grouped(spark, d, line).select("l_orderkey", F.array_join("rows.line", "\n").alias("text")).createOrReplaceTempView("order_texts")
    return spark.sql(
        "SELECT l_orderkey, a.resid, a.element, round(cast(a.x AS DOUBLE), 2) AS x, a.is_hetatm FROM order_texts, LATERAL structure_atoms(text) a"
    )


@query(
    """WITH v AS (SELECT vec_id % 10 AS kind, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT kind, i, max(x) > 0 AS lit, min(x) > 0 AS always FROM v GROUP BY kind, i)
    SELECT kind, count(*) FILTER (lit)::INTEGER AS any_bits, count(*) FILTER (always)::INTEGER AS all_bits FROM m GROUP BY kind"""
)
def t_group_bits(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of bit vectors: how many bits any, and all, vectors of a group have on."""
    word = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("kind"), F.array(word).alias("words"))
    out = rows.groupBy("kind").agg(typed.any_words(F.col("words"), 1).alias("some"), typed.all_words(F.col("words"), 1).alias("every"))
    return out.select("kind", S.popcount(F.col("some")).alias("any_bits"), S.popcount(F.col("every")).alias("all_bits"))


@query(
    """SELECT p_partkey, CAST((12.011 * p_size + 1.008 * (2 * p_size + 2) + 15.999 > 500)::INT + (0.1441 * (p_size - 1) - 0.2035 + 0.123 * (2 * p_size + 1) - 0.2893 - 0.2677 > 5)::INT AS INTEGER) AS violations,
    CAST((12.011 * p_size + 1.008 * (2 * p_size + 2) + 15.999 > 500)::INT + (0.1441 * (p_size - 1) - 0.2035 + 0.123 * (2 * p_size + 1) - 0.2893 - 0.2677 > 5)::INT <= 1 AS INTEGER) AS lipinski,
    CAST(greatest(p_size - 2, 0) <= 10 AS INTEGER) AS veber, true AS tokens, repeat('C', p_size) || 'O' AS back, true AS valid FROM part"""
)
def t_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions by their SQL names over a whole table."""
    register_all(spark)
    Q._parts(spark, d, Q._ALKANOL).createOrReplaceTempView("alkanols")
    return spark.sql(
        """SELECT p_partkey, lipinski_violations(smiles) AS violations, druglikeness_pass(smiles, 'lipinski') AS lipinski, druglikeness_pass(smiles, 'veber') AS veber,
        selfies_is_valid(smiles_to_selfies(smiles)) AS tokens, selfies_to_smiles(smiles_to_selfies(smiles)) AS back, mol_is_valid(smiles) AS valid FROM alkanols"""
    )


# --- time and range joins, distinct counts -----------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
    SELECT c.event_id, c.user_id, c.ts, e.ts AS prior_ts, e.event_id AS prior_event_id FROM c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.ts >= e.ts"""
)
def r_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every click with the user's latest error that isn't later."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return asof_join(rows.filter("event_type = 'click'").drop("event_type"), rows.filter("event_type = 'error'").select("user_id", "ts", "event_id"), ["user_id"], "ts", 86_400.0)


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 20""")
def r_range(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose price lies in the narrow band of a part, by a join on bins."""
    bands = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 20).alias("high"))
    return range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 100.0).select("o_orderkey", "p_partkey")


@query("""SELECT target, count(DISTINCT mol_id) AS molecules, true AS near FROM screen GROUP BY target""")
def r_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct molecules of every target, exactly and by a mergeable sketch that must come within a tenth."""
    out = table(spark, d, "screen").groupBy("target").agg(F.countDistinct("mol_id").alias("molecules"), F.approx_count_distinct("mol_id", 0.02).alias("about"))
    return out.select("target", "molecules", (F.abs(F.col("about") - F.col("molecules")) <= F.greatest(F.col("molecules") / 10, F.lit(1))).alias("near"))


# --- streams -----------------------------------------------------------------------------------------------------------------------------------------------

# Events come in three files: those up to the 20th, the later ones, and last every event of the first ten days whose number ends in 7: 36 hours of lateness don't cover them.
_LATE = "ts < TIMESTAMP '2024-01-11 00:00:00' AND event_id % 10 = 7"
_IN_TIME = f"ts IS NOT NULL AND NOT ({_LATE})"
_MARK = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 36 HOUR FROM events WHERE {_IN_TIME})"


def _events_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("ts is not null")
    late, early = F.expr(_LATE), F.expr("ts < TIMESTAMP_NTZ '2024-01-21 00:00:00'")
    return streams.in_files(spark, [rows.filter(~late & early), rows.filter(~late & ~early), rows.filter(late)])


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events WHERE {_IN_TIME} GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_MARK}""")
def r_stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream into a table: windows are given out when the watermark has passed them, and later rows are dropped."""
    out = streams.run_all(streams.windowed_counts(_events_in_order(spark, d), "ts", ["event_type"], "1 hour", "36 hours"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, value FROM events, range(0, 3) AS r(k) WHERE {_IN_TIME})
    SELECT start, count(*) AS n FROM w GROUP BY start HAVING start + INTERVAL 3 HOUR <= {_MARK}"""
)
def r_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a stream over windows of three hours that begin every hour."""
    out = streams.run_all(streams.windowed_counts(_events_in_order(spark, d), "ts", [], "3 hours", "36 hours", slide="1 hour"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS opens FROM events WHERE {_IN_TIME} AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 2 HOUR <= {_MARK}"""
)
def r_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users on a stream, ended by two hours without an event."""
    out = streams.run_all(streams.session_counts(_events_in_order(spark, d).filter("user_id is not null"), "ts", ["user_id"], "2 hours", "36 hours"))
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("session.end").cast("timestamp_ntz").alias("end"), "n")


@query(
    """SELECT p_partkey, 'C' || CASE WHEN p_size > 1 THEN CAST(p_size AS VARCHAR) ELSE '' END || 'H' || CAST(2 * p_size + 2 AS VARCHAR) || 'O' AS mol_formula, CAST(greatest(p_size - 2, 0) AS INTEGER) AS num_rotatable_bonds,
    true AS valid FROM part"""
)
def r_stream_alkanols(spark: SparkSession, d: str) -> DataFrame:
    """The profile of alkanols on a stream, into a table."""
    stream = streams.read_stream(spark, f"{d}/part.parquet*").select("p_partkey", F.expr(Q._ALKANOL).alias("smiles"))
    return streams.run_all(streams.profile_stream(stream, "smiles", ["mol_formula", "num_rotatable_bonds"])).drop("smiles")
